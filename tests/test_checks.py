"""Single operators on small tables."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import nested
from wordloom.functions.placeholders import minus, placeholders
from wordloom.functions.text import has_pipe_plural, ignore_regex, is_blank, language_name, looks_translatable, pair_hash, skip_regex, split_list, xml_escape
from wordloom.operators import semantic, stats
from wordloom.operators import translate as work
from wordloom.operators.checks import without_ignored
from wordloom.operators.glossary import glossary, glossary_findings
from wordloom.operators.locks import lock_findings, merge_locks, new_locks
from wordloom.plans.check import check_pairs
from wordloom.plans.tools import check_placeholders, list_languages


def found(spark, source, target, **how):
    return sorted((r.path, r.type, r.severity, r.message) for r in check_pairs(spark, source, target, "es", **how).collect())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x").alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [
        ("Save %@ to %lld files", ["%@", "%lld"]), ("%1$@ took %2$lld ms", ["%1$@", "%2$lld"]), ("score %.2f, count %llu of %ld", ["%.2f", "%ld", "%llu"]),
        ("{{name}} %{x} {count} %1$s %d $t(a.b)", ["$t(a.b)", "%1$s", "%d", "%{x}", "{count}", "{{name}}"]), ("100%done %s %s", ["%d", "%s", "%s"]), ("{n, plural, other {x}}", ["{x}"]),
        ("%{a {{x}} b}", ["%{a       b}", "{{x}}"]), ("", []), (None, []),
    ],
)
def test_placeholders(spark, text, want):
    assert one(spark, placeholders, text) == want


def test_multiset_difference(spark):
    df = spark.createDataFrame([(["%s", "%s", "a"], ["%s"]), ([], ["x"]), (["b"], ["b"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(minus("a", "b"), minus("b", "a")).collect()] == [(["%s", "a"], []), ([], ["x"]), ([], [])]


def test_structural_checks(spark):
    assert found(spark, {"a": "Hi {{name}}", "n": 5, "t": {"u": "{count} left"}}, {"a": "Hola {{name}}", "n": 6, "t": {"u": "quedan {count}"}}) == []
    assert found(spark, {"a": "x", "b": "y"}, {"a": "z"}) == [("b", "missing-key", "error", "missing in es")]
    assert found(spark, {"a": "x"}, {"a": "z", "b": "w"}) == [("b", "orphan-key", "warning", "not present in source")]
    assert found(spark, {"a": "Hi {{name}}", "b": "x"}, {"a": "Hola", "b": "y {{extra}}"}) == [("a", "placeholder-missing", "error", "dropped {{name}}"), ("b", "placeholder-added", "warning", "unexpected {{extra}}")]
    assert found(spark, {"a": "{count} file | {count} files", "t": "Home | About"}, {"a": "{count} archivo", "t": "Inicio"}) == [("a", "placeholder-missing", "error", "dropped {count}"), ("a", "plural-forms", "error", "source has 2 plural forms ('|'), es has 1")]
    assert found(spark, {"a": "text"}, {"a": "  "}) == [("a", "empty-value", "error", "empty translation")]
    assert found(spark, {"a": "a long text", "b": "OK", "c": "Brand"}, {"a": "a long text", "b": "OK", "c": "Brand"}) == [("a", "untranslated", "warning", "identical to source")]
    assert found(spark, {"a": 5, "b": None}, {"a": "five", "b": "x"}) == [("a", "type-mismatch", "warning", "source is number, es is string"), ("b", "type-mismatch", "warning", "source is object, es is string")]


def test_white_space_and_boundaries(spark):
    assert all(one(spark, is_blank, x) for x in ("", " \t\n", " ﻿　")) and not one(spark, is_blank, " x ")
    assert one(spark, looks_translatable, "a b") and not one(spark, looks_translatable, " ab ") and not one(spark, looks_translatable, "日 本") and one(spark, looks_translatable, "日\nx")
    assert not one(spark, has_pipe_plural, "a | b") and one(spark, has_pipe_plural, "{n} | b")


def test_glossary(spark):
    pairs = lambda s, t: spark.createDataFrame([("es", "n", "p", s, t)], "lang string, ns string, path string, source string, translation string")
    terms = glossary(spark, {"GitHub": {"dnt": True}, "release": {"es": "versión"}, "C++": {"dnt": True}, "日": {"dnt": True}})
    say = lambda s, t: [r.message for r in glossary_findings(pairs(s, t), terms).collect()]
    assert say("Open GitHub now", "Abre el sitio") == ['do-not-translate term "GitHub" is missing from the translation']
    assert say("open github now", "abre github") == [] and say("日GitHubを", "x") == ['do-not-translate term "GitHub" is missing from the translation']
    assert say("A new Release", "La nueva VERSIÓN") == [] and say("A new release", "Un nuevo lanzamiento") == ['locked term "release" must be translated as "versión"']
    assert say("prereleases", "x") == [] and say("GitHub github", "GitHub") != []
    assert glossary_findings(pairs("release", "x").withColumn("lang", F.lit("fr")), terms).count() == 0


def test_globs():
    import re

    python = lambda p: p.replace(r"\A", "^").replace(r"\z", "$").replace(r"\x{2028}\x{2029}", "")
    ignore = re.compile(python(ignore_regex("*.copyright, home:mcp.badge,legacy,a?b")))
    assert [bool(ignore.match(x)) for x in ("x.y.copyright", "home:mcp.badge", "legacy", "legacy.x", "a?b", "aab")] == [True, True, True, False, True, False]
    skip = lambda g, x: bool(re.match(python(skip_regex([g]).removeprefix("(?s)")), x))
    assert skip("states.*", "states.CA") and not skip("states.*", "states.CA.name") and not skip("*.internal", "a.b.internal") and skip("**.secret", "a.b.secret") and not skip("config.*.secret", "config.secret")
    assert ignore_regex("") is None and split_list(" a , ,b,") == ["a", "b"]


def test_ignored_files(spark):
    rows = [("es", "n", "n", "missing-file"), ("es", "n", "n", "invalid-json"), ("es", "n", "k", "missing-key")]
    df = spark.createDataFrame(rows, "lang string, ns string, path string, type string")
    assert [r.type for r in without_ignored(df, "n").collect()] == ["invalid-json", "missing-key"]


def test_locks(spark):
    t = lambda rows: spark.createDataFrame(rows, "lang string, ns string, path string, source string, translation string")
    base = t([("es", "n", k, "s", "t") for k in "abcd"])
    locks = new_locks(base)
    now = t([("es", "n", "a", "s", "t"), ("es", "n", "b", "s", "changed"), ("es", "n", "c", "changed", "t"), ("es", "n", "d", "changed", "changed")])
    assert sorted((r.path, r.type) for r in lock_findings(now, locks).collect()) == [("b", "manual-translation-clobbered"), ("c", "manual-translation-stale"), ("d", "manual-translation-clobbered")]
    assert new_locks(now, keys="a,n:b", langs=["es"]).count() == 2 and new_locks(now, langs=["fr"]).count() == 0
    both = {r.path: r for r in merge_locks(locks, new_locks(now.where("path = 'b'").union(t([("es", "n", "z", "s", "t")])))).collect()}
    assert len(both) == 5 and both["z"].added and not both["b"].added and both["b"].translation_hash != both["a"].translation_hash


def test_stats_and_verdict(spark):
    langs = spark.createDataFrame([("es", 5, 4, 1, 0, 0, 4, 0.8), ("fr", 0, 0, 0, 0, 2, 0, 1.0)], "lang string, source_keys long, target_keys long, missing long, errors long, warnings long, covered long, coverage double")
    say = lambda **how: tuple(stats.verdict(langs, **how).first())[:2]
    assert say() == (True, []) and say(fail_on="warning") == (False, ["0 error(s), 2 warning(s)"]) and say(fail_on="none", min_coverage=95) == (False, ["es coverage 80.0% < 95%"])
    with pytest.raises(ValueError):
        stats.verdict(langs, fail_on="never")
    counts = spark.createDataFrame([("es", "a", 50, 0), ("es", "b", 1, 1)], "lang string, ns string, source_keys long, target_keys long")
    f = spark.createDataFrame([("es", "a", "missing-file", "error")], "lang string, ns string, type string, severity string")
    assert stats.language_stats(stats.namespace_stats(counts, f)).first().coverage == 1 / 51
    assert one(spark, lambda c: stats.one_decimal(F.col(c)), 0.8, "double") == "80.0"


def test_hashes_names_escapes(spark):
    import hashlib

    want = hashlib.sha256(json.dumps(["a \"b\"\n", "é", "en", "es", "default", None], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
    df = spark.createDataFrame([("a \"b\"\n", "é")], "s string, t string")
    assert df.select(pair_hash("s", "t", F.lit("en"), F.lit("es"))).first()[0] == want
    assert [one(spark, language_name, x) for x in ("pt-BR", "de-AT", "xx", None)] == ["Brazilian Portuguese", "German", "xx", None]
    assert one(spark, xml_escape, "<a b=\"c\">&'") == "&lt;a b=&quot;c&quot;&gt;&amp;&apos;" and list_languages(spark).count() == 34
    assert tuple(check_placeholders(spark, "%s %s", "%s").first()) == (False, ["%s"], [])


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


def slow_flat(x, at=""):
    out = {}
    for k, v in x.items() if isinstance(x, dict) else enumerate(x):
        p = f"{at}.{k}" if at else str(k)
        out |= slow_flat(v, p) if isinstance(v, dict | list) else {p: v}
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), JSON, max_size=4))
def test_flatten(tree):
    assert nested.flat(tree) == slow_flat(tree)
    there_and_back = nested.flat(nested.nest(nested.flat(tree)))
    assert nested.flat(tree).items() <= there_and_back.items()
    # An empty container within an array leaves a hole, which is written as null.
    assert all(v is None for k, v in there_and_back.items() if k not in nested.flat(tree))


def test_flatten_cases(spark):
    assert nested.flat({"a.b": 1, "a": {"b": 2}}) == {"a.b": 2} and nested.nest({"l.0": "x", "l.1": "y", "0": 1}) == {"l": ["x", "y"], "0": 1}
    rows = [('{"a": 1, "a": {"b": null}}',), ("[1,",), (None,), ("﻿{}",), ('{"x": NaN}',), ('["p", true]',)]
    got = [r.y and [tuple(x) for x in r.y] for r in spark.createDataFrame(rows, "x string").coalesce(1).select(nested.flatten_json("x").alias("y")).collect()]
    assert got == [[("a.b", None, "object")], None, None, [], None, [("0", "p", "string"), ("1", "true", "boolean")]]
    e = spark.createDataFrame([("es", "a.b", "1", "number"), ("es", "c", "x", "string")], "lang string, path string, value string, vtype string")
    assert json.loads(nested.unflatten(e, "lang").first().json) == {"a": {"b": 1}, "c": "x"}


V = "pair_hash string, pass int, verdict string, note string"


@pytest.mark.parametrize(
    "votes, passes, want",
    [
        (["mistranslation", "ok", "mistranslation"], 3, ("mistranslation", "0", 2)), (["omission", "ok", "ok"], 3, (None, None, 1)), (["mistranslation", "omission", "omission"], 3, ("omission", "1", 3)),
        ([None, "addition", "addition"], 3, ("addition", "1", 2)), (["omission", "ok"], 2, ("omission", "0", 1)), (["addition", "omission", "mistranslation"], 3, ("mistranslation", "2", 3)), ([None, None, None], 3, (None, None, 0)),
    ],
)
def test_majority(spark, votes, passes, want):
    r = semantic.majority(spark.createDataFrame([("h", k, v, str(k)) for k, v in enumerate(votes)], V), passes=passes).first()
    assert (r.category, r.note, r.votes) == want and r.valid_passes == sum(v is not None for v in votes)
    assert semantic.cacheable(semantic.majority(spark.createDataFrame([("h", 0, votes[0], "")], V), passes=passes)).count() == (votes[0] is not None)


def test_parse_verdicts():
    p = semantic.parse_verdicts
    assert p('Sure: [{"id":"k0","verdict":"ok"},{"id":"k0","verdict":"omission","note":"n"},{"id":"k9","verdict":"ok"},{"id":"k1","verdict":"bad"}] done', {"k0", "k1"}) == {"k0": ("omission", "n")}
    assert p("nothing", {"k0"}) is None and p("[]", {"k0"}) is None and p("[{]", {"k0"}) is None and p(None, {"k0"}) is None


def test_judging(spark):
    """A reviewer that answers badly once, and then by rule."""
    items = spark.createDataFrame([(f"h{k}", "es", f"source {k}", "bad" if k % 4 == 0 else "good") for k in range(20)], "pair_hash string, lang string, source string, translation string").coalesce(1)

    def judge(text):
        if "no valid JSON" not in text:
            return "what?"
        asked = json.loads(text[text.index('[{"id": "k0", "source"') :].split("\nThe last")[0])
        return "ok then " + json.dumps([{"id": a["id"], "verdict": "omission" if a["translation"] == "bad" else "ok", "note": "x"} for a in asked])

    votes = semantic.judge_votes(items, judge, passes=2)
    assert votes.count() == 40
    flawed = {r.pair_hash for r in semantic.majority(votes, passes=2).where("category = 'omission'").collect()}
    assert flawed == {f"h{k}" for k in range(0, 20, 4)}
    with pytest.raises(ValueError):
        semantic.judge_votes(items, judge, passes=0)


E = "lang string, ns string, path string, value string, vtype string"


def test_translate(spark):
    source = spark.createDataFrame([("n", "a", "A {{x}}", "string"), ("n", "b", "B", "string"), ("n", "c", "3", "number"), ("n", "d", "D {{y}}", "string")], "ns string, path string, value string, vtype string")
    existing = spark.createDataFrame([("es", "n", "a", "viejo", "string"), ("es", "n", "b", "", "string"), ("es", "n", "gone", "x", "string")], E)
    langs = spark.createDataFrame([("es",)], "lang string")
    held = work.partition_work(source, existing, langs)
    assert {r.path: r.action for r in held.collect()} == {"a": "reuse", "b": "translate", "c": "pass", "d": "translate"}
    done = work.translate(held, lambda texts, lang: [t.replace("{{y}}", "").upper() + lang for t in texts], batch=1)
    assert {r.path: r.result for r in done.collect()} == {"a": "viejo", "b": "Bes", "c": "3", "d": "D es"}
    assert tuple(work.translation_stats(done).first()) == ("es", 2, 1, 1, 1)
    assert work.parse_strings('Here: ["a", "b"].', 2) == ["a", "b"]
    with pytest.raises(ValueError):
        work.parse_strings("[1]", 2)


def test_regional_targets(spark):
    t = lambda *x: [r.lang for r in work.regional_targets(work.language_table(spark, list(x))).orderBy("place").collect()]
    assert t("pt-BR", "fr", "pt-PT", "fr") == ["pt", "pt-BR", "fr", "pt-PT"] and t("de-AT", "de") == ["de-AT", "de"]
    assert work.regional_targets(work.language_table(spark, ["a-B"]), on=False).count() == 1


def test_fallback(spark):
    source = spark.createDataFrame([("n", k, k.upper(), "string") for k in "abc"], "ns string, path string, value string, vtype string")
    target = spark.createDataFrame([("pt", "n", "a", "pa", "string"), ("pt", "n", "b", "pb", "string"), ("pt-BR", "n", "a", "bra", "string"), ("fr", "n", "a", "", "string")], E)
    langs = spark.createDataFrame([("pt", None), ("pt-BR", "pt"), ("pt-PT", "pt"), ("fr", None), ("xx", None)], "lang string, base string")
    say = lambda **how: {(r.lang, r.path): (r.value, r.origin) for r in work.fill_from_fallbacks(source, target, langs, **how).collect()}
    got = say()
    assert got["pt-BR", "a"] == ("bra", "own") and got["pt-BR", "b"] == ("pb", "regional") and got["pt-BR", "c"] == ("C", "source")
    assert got["pt-PT", "a"] == ("pa", "regional") and ("pt-PT", "c") not in got and got["fr", "a"] == ("A", "source") and got["xx", "b"] == ("B", "source")
    assert ("xx", "a") not in say(to_source=False) and say(to_source=False)["pt-PT", "b"] == ("pb", "regional") and say(regional=False)["pt-PT", "a"] == ("A", "source")


def test_missing_keys_and_topmost_ancestor(spark):
    source = spark.createDataFrame([("n", p, "x", "string") for p in ("a.b", "a.c", "d.e.f", "d.e.g", "d.h", "l.0", "l.1")], "ns string, path string, value string, vtype string")
    target = spark.createDataFrame([("es", "n", "a.b", "x", "string"), ("es", "n", "a.c", "", "string"), ("es", "n", "d.h", "x", "string"), ("es", "n", "l.0", "x", "string")], E)
    got = {(r.path, r.top) for r in work.missing_keys(source, target, spark.createDataFrame([("es",)], "lang string")).collect()}
    assert got == {("a.c", "a.c"), ("d.e.f", "d.e"), ("d.e.g", "d.e")}


def test_changes_skips_merges(spark):
    t = lambda d: spark.createDataFrame(list(d.items()), "path string, value string")
    got = {r.path: r.change for r in work.changed_keys(t({"a": "1", "b": "2", "gone": "3", "n": None}), t({"a": "1", "b": "x", "c": "new", "n": None}), ["path"]).collect()}
    assert got == {"b": "modified", "c": "added", "gone": "deleted"}
    entries = t({"greeting": "Hello", "brandName": "Acme", "company.name": "A", "states.CA": "C", "states.NY": "N"})
    assert {r.path for r in work.split_skipped(entries, ["brandName", "company.name"], ["states.*"]).where("skipped").collect()} == {"brandName", "company.name", "states.CA", "states.NY"}
    assert work.split_skipped(entries).where("skipped").count() == 0
    assert {r.path: r.value for r in work.merged(t({"a": "1", "b": "1"}), t({"b": "2", "c": "2"}), ["path"]).collect()} == {"a": "1", "b": "2", "c": "2"}
    assert work.only_keys(entries, ["greeting"]).count() == 1 and work.without_keys(entries, ["greeting"]).count() == 4


def test_verify(spark):
    source = spark.createDataFrame([("n", "g", "Hello {{name}}", "string"), ("n", "bye", "Goodbye", "string"), ("n", "l", "A rather long sentence", "string")], "ns string, path string, value string, vtype string")
    target = spark.createDataFrame([("es", "n", "g", "Hola", "string"), ("es", "n", "l", "x", "string")], E)
    got = {r.path: r.type for r in work.verify(source, target, spark.createDataFrame([("es",)], "lang string")).collect()}
    assert got == {"g": "placeholder", "bye": "missing_keys", "l": "length_ratio"}


def test_eval_metrics(spark):
    gold = spark.createDataFrame([(1, "omission"), (2, "omission"), (3, None), (4, None)], "item int, expected string")
    hits = spark.createDataFrame([(1, "omission"), (2, None), (3, "addition")], "item int, category string")
    got = {r.category: (r.recall, r.label_accuracy, r.false_rate) for r in semantic.metrics(hits, gold).collect()}
    assert got == {"omission": (0.5, 1.0, None), "all": (0.5, 1.0, 0.5)}


def test_values_at_paths():
    tree = {"a": {"b": [1, {"c": "x"}]}, "n": None, "s": "text"}
    assert [nested.get_value(tree, p) for p in ("a.b.1.c", "a.b.0", "a.b.7", "s.x", "none", "n")] == ["x", 1, None, None, None, None]
    for path, value in (("a.b.1.d", 5), ("q.r.s", "new"), ("s.t", 1), ("a.b.3", "far")):
        nested.set_value(tree, path, value)
        assert nested.get_value(tree, path) == value
    assert tree["a"]["b"] == [1, {"c": "x", "d": 5}, None, "far"] and tree["s"] == {"t": 1}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=2), JSON, max_size=4), st.text("ab", min_size=1, max_size=2), st.text("ab.", max_size=4))
def test_value_at_every_path(tree, key, rest):
    for path, value in nested.flat(tree).items():
        assert nested.get_value(tree, path) == value
    path = ".".join(p for p in (key + "." + rest).split(".") if p)
    nested.set_value(tree, path, "put")
    held = nested.get_value(tree, path)
    assert held == "put" or isinstance(tree.get(key), list)  # a word is no place in an array


def test_empty_keys_and_deep_trees():
    assert nested.flat({"": {"b": 1}, "x": {"": 2}}) == {"b": 1, "x.": 2} and nested.flat({"": 5}) == {"": 5}
    deep = x = {}
    for _ in range(5000):
        x["k"] = {}
        x = x["k"]
    x["end"] = 1
    assert list(nested.flat(deep).values()) == [1]


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a": {"b": "é"}}', "a.b"), ("[1, 2]", "1"), ("{", "a"), (None, "a"), ('{"a": 1}', None)], "t string, p string")
    got = [tuple(r) for r in df.coalesce(1).select(nested.json_at("t", "p"), nested.json_with("t", "p", F.lit("v")), nested.json_fault("t").isNull()).collect()]
    assert got == [('"é"', '{"a":{"b":"v"}}', True), ("2", None, True), (None, None, False), (None, None, False), (None, None, True)]


def test_relative_paths(spark):
    from wordloom.functions.text import relative

    rel = lambda p, root: spark.createDataFrame([(p,)], "p string").select(relative("p", root).alias("r")).first().r
    assert [rel("/a/b/c.json", "/a/"), rel("/a/b/c.json", "/a/b"), rel("/ab/c", "/a"), rel("a\\b\\c", "a"), rel(None, "/a")] == ["b/c.json", "c.json", "/ab/c", "b/c", None]


def test_gates(spark):
    rates = "category string, recall double, false_rate double"
    say = lambda rows, *g: {r.gate: r.ok for r in semantic.gates(spark.createDataFrame(rows, rates), *g).collect()}
    good = [("all", 0.8, 0.09), ("mistranslation", 0.6, None), ("omission", 1.0, None), ("addition", 0.6, None)]
    assert say(good, 6, 6, 0) == {"catch": True, "mistranslation recall": True, "omission recall": True, "addition recall": True, "false alarms": True, "glossary": True}
    assert say([("all", 0.79, 0.1)], 6, 6, 1) == {"catch": False, "mistranslation recall": False, "omission recall": False, "addition recall": False, "false alarms": False, "glossary": False}
    assert "glossary" not in say(good)


def test_calls_and_failures_are_counted(spark):
    """A batch is asked again once if its answer is of no use; a pass that stays so is a failure."""
    items = spark.createDataFrame([(f"h{k}", "es", f"s{k}", "bad" if k == 0 else "t") for k in range(6)], "pair_hash string, lang string, source string, translation string").coalesce(1)

    def judge(text):
        return "no" if '"bad"' in text else '[{"id": "k0", "verdict": "ok"}]'

    votes = semantic.judge_votes(items, judge, passes=3, batch=2).cache()
    assert tuple(semantic.call_stats(votes).first()) == (3 * (2 + 1 + 1), 3) and votes.where("verdict IS NULL").count() == 6
    assert tuple(semantic.call_stats(votes.limit(0)).first()) == (0, 0)


def test_fallback_info(spark):
    source = spark.createDataFrame([("n", k, k.upper(), "string") for k in ("a.x", "a.y", "b")], "ns string, path string, value string, vtype string")
    target = spark.createDataFrame([("pt", "n", "b", "pb", "string"), ("pt-BR", "n", "a.x", "x", "string"), ("full", "n", "a.x", "1", "string"), ("full", "n", "a.y", "2", "string"), ("full", "n", "b", "3", "string")], E)
    langs = spark.createDataFrame([("pt", None), ("pt-BR", "pt"), ("pt-PT", "pt"), ("full", None), ("xx", None)], "lang string, base string")
    say = lambda **how: {r.lang: (r.kind, r.base, r["keys"]) for r in work.fallback_info(source, target, langs, **how).collect()}
    assert say() == {"pt": ("keys", None, ["a"]), "pt-BR": ("keys", None, ["a.y", "b"]), "pt-PT": ("regional", "pt", None), "xx": ("source", None, None)}
    assert say(to_source=False) == {"pt-PT": ("regional", "pt", None)} and say(regional=False)["pt-PT"] == ("source", None, None)


def test_translator_by_prompt():
    asked = []

    def complete(text):
        asked.append(text)
        return 'Sorry, ["a"' if len(asked) == 1 else 'Here: ["A", "B"]'

    assert work.by_prompt(complete)(["a", "b"], "es") == ["A", "B"] and len(asked) == 2
    with pytest.raises(ValueError):
        work.by_prompt(lambda text: "[]")(["a"], "es")


def test_names_at_the_package():
    import wordloom

    assert len(wordloom.__all__) >= 60 and all(callable(getattr(wordloom, n)) or n in ("LANGUAGES", "TYPES") for n in wordloom.__all__)
    with pytest.raises(AttributeError):
        wordloom.nothing


def test_no_list_is_sent_by_a_cross_join(spark):
    """Languages come as one value to each row: no product of tables in the plan."""
    from wordloom.operators.checks import in_each

    few = spark.createDataFrame([("es", None), ("fr", "x"), ("fr", "x")], "lang string, base string")
    df = in_each(spark.range(3), few)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(k, *x) for k in range(3) for x in (("es", None), ("fr", "x"))], key=str)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and in_each(df, few.limit(0).select(F.col("lang").alias("l"))).count() == 0
