import hashlib
import json

from pyspark.sql import functions as F

from wordloom.functions.text import content_key, is_substantive
from wordloom.plans.build import build, pending, translate_file, translate_json


def translator():
    def shout(texts, lang):  # within a function, so that it reaches the workers by value
        if lang == "fr":
            raise RuntimeError("no French today")
        return [f"{t.upper()} {lang}" for t in texts]

    return shout


def test_unchanged_files_are_not_translated_again(spark):
    files = spark.createDataFrame([("a", '{"x": "one"}'), ("b", '{"y": "two"}')], "ns string, text string")
    first = pending(files, None, ["es", "de"])
    assert {r.ns: r.key for r in first.collect()}["a"] == hashlib.md5(b'{"x": "one"}es,de').hexdigest()
    changed = files.withColumn("text", F.when(F.col("ns") == "b", '{"y": "2"}').otherwise(F.col("text")))
    assert [r.ns for r in pending(changed, first, ["es", "de"]).collect()] == ["b"] and pending(files, first, ["es"]).count() == 2
    assert files.select(content_key("text", [])).first()[0] == hashlib.md5(b'{"x": "one"}').hexdigest()


def test_build_with_failures_and_fallbacks(spark):
    files = spark.createDataFrame([("a", '{"x": "one", "n": 5}'), ("broken", "{")], "ns string, text string")
    got = {(r.lang, r.ns, r.path): (r.value, r.origin) for r in build(spark, files, ["pt-BR", "fr"], translator()).collect()}
    assert got == {
        ("pt", "a", "x"): ("ONE pt", "own"), ("pt-BR", "a", "x"): ("ONE pt-BR", "own"), ("fr", "a", "x"): ("one", "source"),
        ("pt", "a", "n"): ("5", "own"), ("pt-BR", "a", "n"): ("5", "own"), ("fr", "a", "n"): ("5", "own"),
    }


def test_translate_json_and_file(spark, tmp_path):
    tree = {"b": {"list": ["one", 2]}, "a": "two", "z": None}
    out, counts = translate_json(spark, tree, "es", translator(), existing={"a": 7})
    assert out == {"b": {"list": ["ONE es", 2]}, "a": 7, "z": None} and list(out) == ["b", "a", "z"] and counts == {"translated": 1, "reused": 1}
    (tmp_path / "en.json").write_text(json.dumps(tree))
    assert translate_file(spark, str(tmp_path / "en.json"), ["de"], translator())["de"]["a"] == "TWO de"


def test_substantive(spark):
    df = spark.createDataFrame([("one two three four", "x"), ("one two three", "x"), ("a b c d", "a b c d")], "s string, t string")
    assert [r[0] for r in df.select(is_substantive("s", "t")).collect()] == [True, False, False]
