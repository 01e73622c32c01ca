"""Whole trees on disk: layouts, formats, reports and the command line."""

import importlib
import json
import xml.etree.ElementTree as ET

import pytest

from wordloom import cli
from wordloom.functions.text import pair_hash
from wordloom.operators.glossary import glossary
from wordloom.plans.check import check_tree, run_semantic
from wordloom.plans.tools import diff, review_pairs, summarize
from wordloom.sinks import reports
from wordloom.sources.locales import UsageError, read_cache, read_glossary, read_locks, read_tree


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))
    return str(root)


def types(result):
    return sorted((r.lang, r.ns, r.path, r.type) for r in result.findings.collect())


FLAT = {"en.json": {"a": "Hi {{name}}", "b": {"c": "Bye now"}}, "es.json": {"a": "Hola", "b": {"c": "Adiós"}}, "fr.json": {"a": "Salut {{name}}"}, ".hidden.json": {}, "notes.json": {"x": 1}}


def test_flat(spark, tmp_path):
    r = check_tree(spark, put(tmp_path, FLAT))
    assert r.layout == "flat" and types(r) == [("es", "translation", "a", "placeholder-missing"), ("fr", "translation", "b.c", "missing-key")]
    assert {x.lang: x.coverage for x in r.languages.collect()} == {"es": 1.0, "fr": 0.5} and r.verdict.first().failures == ["2 error(s)"]
    assert {x.lang: x.coverage for x in summarize(r).collect()} == {"es": 100.0, "fr": 50.0}
    by_file = check_tree(spark, str(tmp_path / "fr.json"), "en")
    assert by_file.source_lang == "fr" and {x.lang for x in by_file.languages.collect()} == {"en", "es"}
    assert [tuple(x) for x in review_pairs(r, "es", 5).collect()] == [("translation", "b.c", "Bye now", "Adiós")]
    assert diff(r.findings, r.languages, lang="fr").first().missing == ["b.c"]
    with pytest.raises(UsageError):
        read_tree(spark, str(tmp_path), "ja")


def test_nested_with_missing_and_broken_files(spark, tmp_path):
    files = {"en/home.json": {f"k{i}": f"text {i}" for i in range(50)}, "en/mini.json": {"m": "x"}, "es/mini.json": {"m": "y"}, "de/home.json": "{", "de/mini.json": {"m": "z"}, "de/extra.json": {"q": "1"}, ".git/x.json": {}, "node_modules/a.json": {}, "assets/b.json": {"z": "1"}}
    r = check_tree(spark, put(tmp_path, files))
    assert r.layout == "nested" and types(r) == [("de", "home", "home", "invalid-json"), ("es", "home", "home", "missing-file")]
    assert {x.lang: x.coverage for x in r.languages.collect()} == {"es": 1 / 51, "de": 1 / 51}
    kept = check_tree(spark, str(tmp_path), ignore="home")
    assert types(kept) == [("de", "home", "home", "invalid-json")] and {x.lang: x.coverage for x in kept.languages.collect()}["es"] == 1.0
    (tmp_path / "en/mini.json").write_text("[")
    with pytest.raises(UsageError):
        check_tree(spark, str(tmp_path))


def test_arb(spark, tmp_path):
    files = {"my_app_en.arb": {"@@locale": "en", "hi": "Hi {x}", "@hi": {"type": "text"}, "bye": "Bye"}, "app_pt_BR.arb": {"hi": "Oi", "bye": "Tchau"}, "nolang.arb": {"@@locale": "fr", "hi": "Salut {x}"}, "none.arb": {"hi": "?"}}
    r = check_tree(spark, put(tmp_path, files))
    assert r.layout == "arb" and types(r) == [("fr", "my_app_en", "bye", "missing-key"), ("pt-BR", "my_app_en", "hi", "placeholder-missing")]


def unit(value, state="translated"):
    return {"stringUnit": {"state": state, "value": value}}


def test_catalog(spark, tmp_path):
    plural = lambda **forms: {"variations": {"plural": {k: unit(v) for k, v in forms.items()}}}
    strings = {
        "Hello": {"localizations": {"ru": unit("Привет"), "fr": unit("Bonjour", "new")}}, "Check %@": {"localizations": {"ru": unit("Проверка", "needs_review")}},
        "files": {"localizations": {"en": plural(one="%lld file", other="%lld files"), "ru": plural(one="%lld файл", few="%lld файла", many="файлов", other="%lld файла")}}, "plain": {"localizations": {"ru": plural(one="x", other="y")}},
    }
    path = tmp_path / "App.xcstrings"
    path.write_text(json.dumps({"sourceLanguage": "en", "strings": strings, "version": "1.0"}))
    r = check_tree(spark, str(path))
    ns = "App.xcstrings"
    got = [(lang, p, t) for lang, n, p, t in types(r) if n == ns and lang == "ru"]
    assert got == [("ru", "Check %@", "placeholder-missing"), ("ru", "Check %@", "stale-translation"), ("ru", "files.plural.many", "placeholder-missing"), ("ru", "plain", "missing-key"), ("ru", "plain.plural.one", "orphan-key"), ("ru", "plain.plural.other", "orphan-key")]
    assert {p for lang, _, p, t in types(r) if lang == "fr" and t == "missing-key"} == {"Hello", "Check %@", "files.plural.one", "files.plural.other", "plain"}


def test_reports(spark, tmp_path):
    r = check_tree(spark, put(tmp_path, {"en/a.json": {"k<&": "Hi {{n}} \"q\"", "s": "same text"}, "es/a.json": {"k<&": "<Hola> & 'x'", "s": "same text"}}))
    sarif = json.loads(reports.sarif_report(r))
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and [x["id"] for x in run["tool"]["driver"]["rules"]] == ["placeholder-missing", "untranslated"]
    assert [(x["ruleId"], x["ruleIndex"], x["level"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for x in run["results"]] == [("placeholder-missing", 0, "error", "es/a.json"), ("untranslated", 1, "warning", "es/a.json")]
    assert reports.sarif_report(r) == reports.sarif_report(r)
    root = ET.fromstring(reports.junit_report(r).encode())
    case = root.find("testsuite/testcase")
    assert root.get("failures") == "1" and case.get("classname") == "es" and "<Hola> & 'x'" in case.find("failure").text and "identical to source" in case.find("system-out").text
    j = json.loads(reports.json_report(r))
    assert not j["ok"] and j["totals"] == {"errors": 1, "warnings": 1} and len(j["languages"][0]["namespaces"][0]["findings"]) == 2
    text = reports.text_report(r)
    assert "es  coverage 100.0%  1 error(s), 1 warning(s)" in text and text.endswith("check failed: 1 error(s)")
    assert "and 1 more" in reports.text_report(r, most=1)


def test_semantic(spark, tmp_path):
    from wordloom.operators import semantic

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/shared")
    r = check_tree(spark, put(tmp_path / "t", {"en.json": {"a": "one day", "b": "one day", "c": "Hi {{x}}", "d": "two"}, "es.json": {"a": "un mes", "b": "un mes", "c": "roto", "d": "dos"}}))

    def judge(text):
        asked = json.loads(text[text.index('[{"id": "k0", "source"') :])
        return json.dumps([{"id": a["id"], "verdict": "mistranslation" if a["translation"] == "un mes" else "ok", "note": "another unit"} for a in asked])

    out, verdicts, counts = run_semantic(r, judge)
    assert [(p, t) for _, _, p, t in types(out) if t.startswith("semantic")] == [("a", "semantic-mistranslation"), ("b", "semantic-mistranslation")]
    assert verdicts.count() == 2 and tuple(counts.first()) == (3, 0, 2)
    reports.write_cache(verdicts, str(tmp_path / "cache.json"))

    def never(text):
        raise AssertionError("asked although cached")

    again, new, counts = run_semantic(r, never, cache=read_cache(spark, str(tmp_path / "cache.json")), fail=True)
    assert new.count() == 0 and tuple(counts.first()) == (3, 3, 2) and again.verdict.first().errors == 3
    assert semantic.to_judge(r.pairs.withColumn("pair_hash", pair_hash("source", "translation", "lang", "lang"))).count() == 3


def test_locks_glossary_and_command_line(spark, tmp_path, capsys):
    root = put(tmp_path / "t", {"en.json": {"a": "GitHub rocks", "b": "text here"}, "es.json": {"a": "GitHub mola", "b": "texto"}})
    lock = str(tmp_path / "x" / "lock.json")
    assert cli.main(["lock", root, "--file", lock, "--keys", "b"]) == 0
    assert [tuple(r)[:3] for r in read_locks(spark, lock).collect()] == [("es", "translation", "b")]
    assert cli.main(["check", root, "--locks", lock]) == 0
    put(tmp_path / "t", {"es.json": {"a": "El sitio mola", "b": "otro"}})
    put(tmp_path, {"glossary.json": {"GitHub": {"dnt": True}}, "bad.json": "{", "old.json": {"version": 999, "locked": {}}})
    assert cli.main(["check", root, "--locks", lock, "--glossary", str(tmp_path / "glossary.json"), "--format", "json", "--output", str(tmp_path / "out.json")]) == 1
    out = json.loads((tmp_path / "out.json").read_text())
    assert {f["type"] for n in out["languages"][0]["namespaces"] for f in n["findings"]} == {"glossary-violation", "manual-translation-clobbered"}
    for kind in ("text", "sarif", "junit"):  # the exit code doesn't depend on the report
        assert cli.main(["check", root, "--glossary", str(tmp_path / "glossary.json"), "--format", kind]) == 1
    assert cli.main(["check", root, "--min-coverage", "100", "--fail-on", "none"]) == 0
    assert cli.main(["check", root, "--glossary", str(tmp_path / "bad.json")]) == 2 and cli.main(["check", str(tmp_path / "none")]) == 2
    assert read_locks(spark, str(tmp_path / "bad.json")).count() == read_locks(spark, str(tmp_path / "old.json")).count() == read_cache(spark, "/none").count() == 0
    assert read_glossary(spark, str(tmp_path / "glossary.json")).first().dnt and glossary(spark, {}).count() == 0
    assert cli.main(["diff", root]) == 0 and '"lang"' in capsys.readouterr().out
    assert cli.main(["translate", root, "--to", "fr,pt-BR", "--translator", "tests.test_trees:shout", "--out", str(tmp_path / "done")]) == 0
    assert json.loads((tmp_path / "done" / "pt-BR.json").read_text()) == {"a": "GITHUB ROCKS pt-BR", "b": "TEXT HERE pt-BR"}


def shout(texts, lang):
    return [f"{t.upper()} {lang}" for t in texts]


def judge_by_rule(text):
    asked = json.loads(text[text.index('[{"id": "k0", "source"') :].split("\nThe last")[0])
    assert not any("secret" in a["source"] for a in asked), "shown an ignored key"
    return json.dumps([{"id": a["id"], "verdict": "omission" if a["translation"] == "corto" else "ok", "note": ""} for a in asked])


def test_ignored_keys_are_not_reviewed(spark, tmp_path):
    files = {"en.json": {"a": "a long text", "secret": "a secret text"}, "es.json": {"a": "corto", "secret": "corto"}}
    r = check_tree(spark, put(tmp_path / "t", files), ignore="secret")
    by_name = importlib.import_module("tests.test_trees").judge_by_rule  # as the workers can import it
    out, _, counts = run_semantic(r, by_name)
    assert [(p, t) for _, _, p, t in types(out)] == [("a", "semantic-omission")] and counts.first().judged == 1
    assert [x.path for x in review_pairs(r, "es", 5).collect()] == ["a"]


def test_semantic_pass_on_the_command_line(spark, tmp_path, capsys):
    root = put(tmp_path / "t", {"en.json": {"a": "a long text", "b": "Hi {{n}}"}, "es.json": {"a": "corto", "b": "Hola"}})
    cache = str(tmp_path / "c" / "verdicts.json")
    args = ["check", root, "--no-locks", "--semantic", "--semantic-cache", cache, "--ignore", "b", "--format", "json", "--output", str(tmp_path / "o.json")]
    assert cli.main([*args, "--judge", "tests.test_trees:judge_by_rule"]) == 0
    assert "judged 1 (0 cached), flagged 1, 3 call(s), 0 discarded" in capsys.readouterr().err
    found = [f for n in json.loads((tmp_path / "o.json").read_text())["languages"][0]["namespaces"] for f in n["findings"]]
    assert [(f["type"], f["severity"]) for f in found] == [("semantic-omission", "warning")]
    assert [v["category"] for v in json.loads((tmp_path / "c" / "verdicts.json").read_text()).values()] == ["omission"]
    assert cli.main([*args, "--judge", "tests.test_trees:broken_judge", "--semantic-fail"]) == 1  # all is cached
    assert "(1 cached), flagged 1, 0 call(s)" in capsys.readouterr().err
    assert cli.main([*args]) == 2 and cli.main([*args, "--judge", "tests.test_trees:broken_judge", "--semantic-cache", str(tmp_path / "d.json")]) == 2
    only = put(tmp_path / "u", {"en.json": {"b": "Hi {{n}}"}, "es.json": {"b": "Hola"}})
    assert cli.main(["check", only, "--no-locks", "--semantic", "--semantic-cache", cache, "--judge", "tests.test_trees:judge_by_rule"]) == 1
    assert "all 1 translated key(s)" in capsys.readouterr().err


def broken_judge(text):
    raise RuntimeError("no answer")


def test_locks_are_found_by_default(spark, tmp_path, monkeypatch, capsys):
    root = put(tmp_path / "t", {"en.json": {"b": "text"}, "es.json": {"b": "texto"}})
    monkeypatch.chdir(tmp_path)
    assert cli.main(["lock", root]) == 0 and (tmp_path / ".wordloom" / "locks.json").exists()
    put(tmp_path / "t", {"es.json": {"b": "otro"}})
    assert cli.main(["check", root, "--fail-on", "warning"]) == 1 and cli.main(["check", root, "--fail-on", "warning", "--no-locks"]) == 0


def test_action(spark, tmp_path, capsys):
    """What changed is translated, what was skipped stays, and the outputs say so; for a file and for a folder."""
    put(tmp_path / "t", {"en.json": {"a": "one {x}", "b": "two changed", "brand": "Acme"}, "es.json": {"a": "uno {x}", "b": "dos", "gone": "x"}})
    put(tmp_path / "old", {"en.json": {"a": "one {x}", "b": "two", "brand": "Acme"}})
    step = ["action", "--source-file", str(tmp_path / "t" / "en.json"), "--target-languages", "es,fr", "--translator", "tests.test_trees:shout", "--before", str(tmp_path / "old" / "en.json"), "--skip-keys", "brand"]
    assert cli.main(step) == 0
    assert json.loads((tmp_path / "t" / "es.json").read_text()) == {"a": "uno {x}", "b": "TWO CHANGED es", "brand": "Acme"}
    assert json.loads((tmp_path / "t" / "fr.json").read_text()) == {"a": "ONE {X} fr", "b": "TWO CHANGED fr", "brand": "Acme"}
    said = dict(line.split("=", 1) for line in capsys.readouterr().out.splitlines() if "=" in line)
    assert said["files-changed"] == "2" and said["languages"] == "es,fr" and said["verification-errors"] == "1" and said["skipped-keys-count"] == "1"
    put(tmp_path / "n", {"en/home.json": {"h": "home"}, "es/home.json": {"h": ""}})
    assert cli.main(["action", "--source-dir", str(tmp_path / "n" / "en"), "--target-languages", "es", "--translator", "tests.test_trees:shout"]) == 0
    assert json.loads((tmp_path / "n" / "es" / "home.json").read_text()) == {"h": "HOME es"}
    assert cli.main(["action", "--target-languages", "es", "--translator", "tests.test_trees:shout"]) == 2


def test_parser_text_of_broken_files(spark, tmp_path):
    r = check_tree(spark, put(tmp_path, {"en.json": {"a": "x"}, "es.json": '{"a": }'}))
    assert r.findings.first().message.startswith("invalid JSON: Expecting value")


def test_review_envelope(spark, tmp_path):
    from wordloom.plans.tools import review

    r = check_tree(spark, put(tmp_path, FLAT))
    row = review(r, "es", 5).first()
    assert (row.lang, row.source, row.returned, row.excluded) == ("es", "en", 1, 1) and [c.category for c in row.criteria] == ["mistranslation", "omission", "addition"]
    assert [tuple(p) for p in row.pairs] == [("translation", "b.c", "Bye now", "Adiós")] and "data" in row.instructions
    with pytest.raises(ValueError):
        review(r, "ja", 5)


def test_languages_are_ordered_as_read(spark, tmp_path):
    files = {"en.json": {"a": "x y"}} | {f"{c}.json": {"a": "z"} for c in ("zh-TW", "zh-cn", "zh-Hans", "es")}
    j = json.loads(reports.json_report(check_tree(spark, put(tmp_path, files))))
    assert [x["lang"] for x in j["languages"]] == ["es", "zh-cn", "zh-Hans", "zh-TW"]
