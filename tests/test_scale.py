"""What large tables need: plans and files that don't grow in one place."""

import json

import pytest

from wordloom import queries as core


@pytest.mark.parametrize("name", ["full_check", "lock_merge", "review_counts", "glossary_dnt", "glossary_summary", "lock_build", "lock_clobbered", "substantive_pairs", "semantic_exclusion", "cache_antijoin", "verdict_fanout", "review_prompts"])
def test_entries_are_not_sent_to_all(spark, sf_dir, name):
    """The size of a compressed file says little about that of its rows: no table of entries may be broadcast for it."""
    plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [k for k, line in enumerate(plan) if "BroadcastExchange HashedRelation" in line]
    depth = lambda k: len(plan[k]) - len(plan[k].lstrip(" :+-|"))
    for k in sent:
        below = next((i for i in range(k + 1, len(plan)) if depth(i) <= depth(k)), len(plan))
        assert not any("FileScan" in line for line in plan[k:below]), "\n".join(line[:120] for line in plan[k:below])


def test_documents_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """Locks and trees are written, and locks read, without a text in the driver; odd names and texts come back as they were."""
    from wordloom import files as fs
    from wordloom.schema import LOCK
    from wordloom.sinks import reports
    from wordloom.sources.locales import read_locks

    rows = [("es", "n", f'a"b\\{k}\n é\u0001::x', None if k % 7 == 0 else f"h{k}", f'",\n    }}{k}') for k in range(500)]
    locks = spark.createDataFrame(rows, LOCK)
    path = str(tmp_path / "locks.json")
    real = fs.read_text
    monkeypatch.setattr(fs, "read_text", lambda *a: pytest.fail("read in the driver"))
    monkeypatch.setattr(fs, "write_text", lambda *a: pytest.fail("written in the driver"))
    reports.write_locks(locks, path)
    assert sorted(map(tuple, read_locks(spark, path).collect()), key=str) == sorted(rows, key=str)
    entries = [(lang, "a b%#ü", "k.x", f"{lang} text", "string") for lang in ("es", "pt-BR")]
    for nested in (True, False):
        reports.write_translations(spark.createDataFrame(entries, "lang string, ns string, path string, value string, vtype string"), str(tmp_path / "out"), nested=nested)
    assert (tmp_path / "out/es/a b%#ü.json").read_text() == '{\n  "k": {\n    "x": "es text"\n  }\n}'
    assert (tmp_path / "out/pt-BR.json").read_text() == '{\n  "k": {\n    "x": "pt-BR text"\n  }\n}\n'
    monkeypatch.setattr(fs, "read_text", real)
    text = (tmp_path / "locks.json").read_text()
    (tmp_path / "twice.json").write_text(text.replace("a\\\"b\\\\1\\n", "a\\\"b\\\\2\\n"))  # a repeated id: the last counts, as in any JSON
    assert read_locks(spark, str(tmp_path / "twice.json")).count() == 499
    (tmp_path / "cut.json").write_text(text[:-20])
    assert read_locks(spark, str(tmp_path / "cut.json")).count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_tree_is_found_under_each_spelling_of_its_path(spark, tmp_path, scheme):
    from wordloom.sources.locales import _names

    (tmp_path / "en").mkdir()
    (tmp_path / "en/a.json").write_text("{}")
    assert [r.rel for r in _names(spark, f"{scheme}{tmp_path}").collect()] == ["en/a.json"]


def _rows(tree):
    return sorted((tuple(r) for df in (tree.files, tree.source, tree.target, tree.findings) for r in df.collect()), key=str)


def test_a_string_catalog_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    """No process holds the catalog; what is read is what the parser finds in the text as a whole, also where keys are repeated or the layout is another."""
    from wordloom import files as fs
    from wordloom.sinks import reports
    from wordloom.sources import locales

    unit = lambda v, s="translated": {"stringUnit": {"state": s, "value": v}}
    entry = lambda k: {} if k % 9 == 0 else {"localizations": {"en": unit(f'a\n    }},\n"{k}'), ("es", "pt-BR")[k % 2]: unit(f"b {k}", ("new", "stale", "translated")[k % 3])}}
    every = {f'k"\\\n é{k}': entry(k) for k in range(400)}
    path = str(tmp_path / "App.xcstrings")
    with monkeypatch.context() as m:
        for name in ("read_text", "write_text"):
            m.setattr(fs, name, lambda *a: pytest.fail("in the driver"))
        m.setattr(locales, "parse_catalog", lambda t: pytest.fail("as a whole"))
        reports.write_catalog(spark.createDataFrame([(k, json.dumps(e)) for k, e in every.items()], "key string, entry string").repartition(3), path)
        laid = _rows(locales.read_tree(spark, path))
    text = (tmp_path / "App.xcstrings").read_text()
    assert json.loads(text) == {"sourceLanguage": "en", "strings": every, "version": "1.0"}
    assert locales._laid_catalog(spark, path) is not None

    def put(folder, text):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "App.xcstrings").write_text(text)
        return str(tmp_path / folder / "App.xcstrings")

    path = put("one line", json.dumps(json.loads(text)))
    assert locales._laid_catalog(spark, path) is None and _rows(locales.read_tree(spark, path)) == laid
    path = put("twice", text.replace("é11\" :", "é10\" :"))
    assert locales._laid_catalog(spark, path) is None and locales.read_tree(spark, path).source.count() == 399
    path = put("broken", text.replace('"stringUnit"', '"stringUnit', 1))
    with pytest.raises(locales.UsageError):
        locales.read_tree(spark, path)
    xcode = '{\n  "sourceLanguage" : "de",\n  "strings" : {\n    "" : {\n\n    },\n    "x" : {\n      "localizations" : {\n        "fr" : {\n          "stringUnit" : {\n            "state" : "translated",\n            "value" : "y"\n          }\n        }\n      }\n    }\n  },\n  "version" : "1.0"\n}'
    path = put("xcode", xcode)
    tree = locales.read_tree(spark, path)
    assert locales._laid_catalog(spark, path) is not None and [tuple(r)[2:4] for r in tree.target.collect()] == [("x", "y")] and sorted(r.path for r in tree.source.collect()) == ["", "x"]


def test_reports_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    """The files say what the strings say, without a finding in the driver; languages and namespaces without findings are there too."""
    from pyspark.sql import functions as F

    from wordloom import files as fs
    from wordloom.operators import stats
    from wordloom.plans.check import _result
    from wordloom.sinks import reports

    odd = 'é"\\\n            {\n"findings": []\n            },\u0001'
    rows = [(("es", "pt-BR")[k % 2], f"n{k % 3}{odd}", f"k{k % 50}{odd}", ("orphan-key", "missing-key")[k % 2], ("warning", "error")[k % 2], odd, None if k % 4 else odd, str(k % 2)) for k in range(600)]
    found = spark.createDataFrame(rows, "lang string, ns string, path string, type string, severity string, message string, source string, translation string").repartition(3)
    counts = spark.createDataFrame([(lang, f"{n}{odd}", 500, 5) for lang in ("es", "fr", "pt-BR") for n in ("a", "n0", "n1", "n2", "z")], "lang string, ns string, source_keys long, target_keys long")
    files = counts.select("lang", "ns", F.lit(False).alias("is_source"), F.concat("lang", F.lit("/"), "ns").alias("file"))
    path = str(tmp_path / "report.json")
    for some in (found, found.limit(0)):
        r = _result("nested", "en", files, None, some, counts, "error", None)
        said, sarif = json.loads(reports.json_report(r)), json.loads(reports.sarif_report(r))
        with monkeypatch.context() as m:
            m.setattr(fs, "read_text", lambda *a: pytest.fail("read in the driver"))
            reports.write_json_report(r, path)
            reports.write_sarif_report(r, path + ".sarif")
            held, each = reports.read_json_report(spark, path)
            around, results = reports.read_sarif_report(spark, path + ".sarif")
        assert json.loads((tmp_path / "report.json").read_text()) == said
        assert json.loads((tmp_path / "report.json.sarif").read_text()) == sarif
        assert sorted(map(tuple, each.select(found.columns).collect()), key=str) == sorted(map(tuple, some.collect()), key=str)
        for x in said["languages"]:
            for n in x["namespaces"]:
                n["findings"] = []
        assert held == said
        got = [x.result.asDict(True) for x in results.orderBy("place").collect()]
        assert got == sarif["runs"][0]["results"] and around["runs"][0]["tool"] == sarif["runs"][0]["tool"]


def test_groups_are_put_together_across_batches(spark):
    """No array of a group's entries is made; groups may end in any batch, and null is a group of its own."""
    from wordloom.functions.nested import nest, unflatten

    rows = [(None if g == 3 else g, None if h == 0 else f"h{h}", f"a{k % 2}.k{k}", f"{g} {h} {k}" if k else None, "string" if k % 3 else "object" if not k else "string") for g in range(7) for h in range(3) for k in range(g * 5 % 13 + 1)]
    entries = spark.createDataFrame(rows, "g long, h string, path string, value string, vtype string").repartition(3)
    assert "collect_list" not in unflatten(entries, "g", "h")._jdf.queryExecution().executedPlan().toString()
    want = {}
    for g, h, path, value, _ in sorted(rows, key=lambda r: r[2]):
        want.setdefault((g, h), {})[path] = value
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "2", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = [((r.g, r.h), json.loads(r.json)) for r in unflatten(entries, "g", "h").collect()]
            assert len(got) == len(want) and dict(got) == {k: nest(v) for k, v in want.items()}, n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert unflatten(entries.limit(0), "g").collect() == []


def test_a_review_reads_findings_and_pairs_once(spark, sf_dir):
    """What is read several times is written before; joins of all entries aren't made again for each reader."""
    plan = core.queries()["semantic_run"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert " parquet" not in plan, plan


@pytest.mark.parametrize("name", ["build_entries", "fallback_fill", "translated_texts", "verification", "topmost_missing"])
def test_entries_to_translate_are_merged(spark, sf_dir, name):
    """Only lists of languages are sent to all, whatever the optimiser thinks of the size of entries."""
    plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Subquery:")[0].split("\n")
    first = next(k for k, line in enumerate(plan) if "SortMergeJoin" in line)
    joins = [line for line in plan[first:] if "Join " in line and "lang#" in line and ("path#" in line or "prefix#" in line)]
    assert joins and all("SortMergeJoin" in line for line in joins), "\n".join(line[:160] for line in joins)


def test_a_build_asks_once_for_each_text(spark, tmp_path):
    """Files are read and texts translated once, though both are needed several times."""
    from wordloom.plans.build import build

    asked = str(tmp_path / "asked")

    def shout(texts, lang):
        with open(asked, "a") as f:
            f.writelines(f"{lang} {t}\n" for t in texts)
        return [f"{t.upper()} {lang}" for t in texts]

    files = spark.createDataFrame([("a", json.dumps({"k": {f"x{k}": f"text {k}" for k in range(90)}})), ("b", '{"y": "one", "z": ["two", null, 3]}'), ("none", "{}"), ("broken", "{")], "ns string, text string")
    got = build(spark, files, ["pt-BR", "de"], shout).collect()
    assert len(got) == 3 * 94 and {(r.path if r.value is None else "", r.origin) for r in got} == {("", "own"), ("z.1", "source")}
    lines = (tmp_path / "asked").read_text().splitlines()
    assert len(lines) == len(set(lines)) == 3 * 92


def test_leaves_of_a_long_text_come_in_batches(spark):
    import pyarrow as pa

    from wordloom.functions.nested import _leaf_rows, flatten, flatten_files

    texts = [json.dumps({f"k{k}": [k, None, f"t{k}", {"x": True}] for k in range(n)}) for n in (0, 1, 60, 3)]
    rows = [(n, t) for n, t in enumerate([*texts, None, "{", "\ufeff" + texts[1], "[1]"])]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted(map(str, flatten_files(df, "text", "id").collect())) == sorted(map(str, flatten(df, "text", "id").collect()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["id", "text"])
    held = list(_leaf_rows(1, iter([batch]), 7))
    assert {len(b) for b in held[:-1]} == {7} and sum(map(len, held)) == flatten(df, "text", "id").count()


@pytest.mark.parametrize("name", ["glossary_dnt", "glossary_locked", "glossary_summary", "full_check"])
def test_words_are_not_shuffled(spark, sf_dir, name):
    """All pairs with a frequent word would meet in one task."""
    plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and any("BroadcastHashJoin [token" in line for line in plan.split("\n"))


def test_terms_without_a_word_are_sent_to_all(spark):
    from wordloom.operators.glossary import glossary, term_pairs

    pairs = spark.createDataFrame([("es", "n", "a", "a東京b", "y"), ("es", "n", "b", "tokyo", "y")], "lang string, ns string, path string, source string, translation string")
    held = term_pairs(pairs, glossary(spark, {"東京": {"dnt": True}, "tokyo": {"dnt": True}}))
    assert "CartesianProduct" not in held._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.term) for r in held.collect()} == {("a", "東京"), ("b", "tokyo")}


@pytest.mark.parametrize("name", ["lock_build", "lock_clobbered", "lock_stale", "cache_antijoin"])
def test_pairs_and_locks_are_merged_however_small_they_seem(spark, sf_dir, name):
    """Also under a threshold that would let any table be sent to all."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [line for line in plan if "Join " in line and "path#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), "\n".join(line[:160] for line in joins)
