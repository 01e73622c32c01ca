"""Queries of sources, sinks and whole plans, over files and documents that are made from the supplied tables, and their SQL."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as fs
from .fixtures import duck, load
from .functions.nested import json_at, json_with, unflatten
from .functions.text import content_key, is_substantive, relative, split_list
from .operators import semantic, stats
from .operators import translate as work
from .operators.checks import text_pairs, without_ignored
from .operators.locks import new_locks
from .plans import tools
from .plans.build import build
from .plans.check import Result, _result, run_semantic
from .queries import _FALL, _FINDINGS, _HASHED, _IGNORED, _KEYS, _PAIRS, _SHA16, _TEXTS, _VERDICTS, IGNORE, _findings, _hashed, _lang_stats, _layout, _ns_stats, _pairs, _verdicts, query, table
from .schema import TYPES
from .sinks import reports
from .sources.locales import choose_layout, missing_files, read_cache, read_locks, read_tree

_Q = "'"


def _text(x: str) -> str:
    return _Q + x.replace(_Q, _Q * 2) + _Q


def _folder(spark: SparkSession) -> str:
    return f"{fs.shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _kept(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """``df`` computed once, so that the files that it was made of may go."""
    out = df.checkpoint(eager=True)
    fs.delete(spark, folder)
    return out


# Trees of files. A number in the middle of a path would make it an array, and an entry below another would hide it, so both are part of a name here.


def _named(df: DataFrame) -> DataFrame:
    path = F.replace(F.regexp_replace("path", r"^part\.", "part.k"), F.lit(".legacy"), F.lit("_legacy"))
    return df.withColumns({"path": path, "vtype": F.lit("string")})


def _named_sql(of: str) -> str:
    return f"(SELECT * REPLACE (replace(regexp_replace(path, '^part\\.', 'part.k'), '.legacy', '_legacy') AS path, 'string' AS vtype) FROM {duck(of)} z)"


def _write_tree(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """A folder of JSON files, of which one of Spanish is missing and one of French is broken; and their namespaces."""
    root = _folder(spark)
    source = _named(load(spark, sf_dir, "source")).withColumn("lang", F.lit("en"))
    target = _named(load(spark, sf_dir, "target"))
    reports.write_translations(source.unionByName(target, allowMissingColumns=True).select("lang", "ns", "path", "value", "vtype"), root, nested=True)
    lost, broken = source.agg(F.min("ns"), F.max("ns")).first()
    fs.delete(spark, f"{root}/es/{lost}.json")
    fs.write_text(spark, f"{root}/fr/{broken}.json", '{"part": ')
    fs.write_text(spark, f"{root}/node_modules/{lost}.json", "{}")
    return root, lost, broken


_LOST, _BROKEN = (f"(SELECT {f}(ns) FROM {duck('source')} z)" for f in ("min", "max"))
_READ = f"(lang <> 'es' OR ns <> {_LOST}) AND (lang <> 'fr' OR ns <> {_BROKEN})"


@query(f"SELECT 'en' AS lang, ns, path, value, vtype FROM {_named_sql('source')} s UNION ALL SELECT lang, ns, path, value, vtype FROM {_named_sql('target')} t WHERE {_READ}")
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a tree of files, written and read back."""
    root, _, _ = _write_tree(spark, sf_dir)
    tree = read_tree(spark, root)
    return _kept(spark, tree.source.withColumn("lang", F.lit("en")).select("lang", "ns", "path", "value", "vtype").unionByName(tree.target), root)


@query(f"SELECT 'es' AS lang, {_LOST} AS ns, 'missing-file' AS type, 'error' AS severity, 'file missing: es/' || {_LOST} || '.json' AS message UNION ALL SELECT 'fr', {_BROKEN}, 'invalid-json', 'error', 'invalid JSON: Expecting value: line 1 column 10 (char 9)'")
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the files themselves."""
    root, _, _ = _write_tree(spark, sf_dir)
    return _kept(spark, read_tree(spark, root).findings.select("lang", "ns", "type", "severity", "message"), root)


@query(f"SELECT * FROM (SELECT 'en' AS lang, ns, true AS is_source, 'ok' AS status, count(*) AS keys FROM {duck('source')} s GROUP BY ns UNION ALL SELECT lang, ns, false, CASE WHEN {_READ} THEN 'ok' ELSE 'invalid' END, CASE WHEN {_READ} THEN count(*) ELSE 0 END FROM {duck('target')} t WHERE lang <> 'es' OR ns <> {_LOST} GROUP BY lang, ns) x")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a tree, with the number of their keys."""
    root, _, _ = _write_tree(spark, sf_dir)
    return _kept(spark, read_tree(spark, root).files.select("lang", "ns", "is_source", "status", F.col("keys").cast("bigint").alias("keys")), root)


_STEM = "CASE n_nationkey % 4 WHEN 0 THEN lower(substr(n_name, 1, 2)) || substr('lxyz', CAST(floor(n_nationkey / 8) AS INT) + 1, 1) WHEN 1 THEN lower(substr(n_name, 1, 3)) || '-' || n_nationkey || substr(n_name, 2, 3) WHEN 2 THEN n_name ELSE '.' || lower(substr(n_name, 1, 2)) END"


@query(f"SELECT DISTINCT stem AS lang, stem = 'nal' AS is_source FROM (SELECT {_STEM} AS stem FROM nation) x WHERE regexp_full_match(stem, '[a-z]{{2,3}}(-[0-9A-Za-z]{{2,8}})*')")
def flat_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a flat folder are languages, by their names; folders beside them don't count."""
    from .sources.locales import json_files

    names = table(spark, sf_dir, "nation").select(F.expr(_STEM).alias("stem")).distinct()
    rel = names.select(F.concat("stem", F.lit(".json")).alias("rel")).union(names.select(F.concat("stem", F.lit("/x.json"))))
    layout, mine = choose_layout(json_files(rel.select(F.col("rel").alias("path"), "rel")), "nal")
    return mine.where(F.lit(layout) == "flat").select("lang", "is_source")


@query("SELECT DISTINCT lang, ns, lang = 'en' AS is_source FROM (SELECT regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 1) AS lang, regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 2) AS ns FROM pages) x WHERE lang <> ''")
def nested_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for folders by language."""
    _, mine = choose_layout(_layout(spark, sf_dir).drop("is_source"), "en")
    return mine.select("lang", "ns", "is_source").distinct()


@query("SELECT page_id, CASE WHEN starts_with(url, 'http:/') THEN substr(url, 7) ELSE url END AS rel FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", relative("url", "http:").alias("rel"))


# ARB bundles: languages by name, by content, and the metadata between the keys

_ARB = {"en": "app_en.arb", "es": "app_es_MX.arb", "fr": "my_app_fr_Latn_CA.arb", "de": "nolang.arb"}
_ARB_LANG = {"es": "es-MX", "fr": "fr-Latn-CA", "de": "de-AT"}


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.translate(F.concat("ns", F.lit("_"), "path"), ". ", "__"))


def _key_sql(of: str) -> str:
    return f"(SELECT * REPLACE (translate(ns || '_' || path, '. ', '__') AS path) FROM {duck(of)} z)"


@query(f"SELECT 'en' AS lang, 'app_en' AS ns, path, value FROM {_key_sql('source')} s UNION ALL SELECT CASE lang {' '.join(f'WHEN {_text(a)} THEN {_text(b)}' for a, b in _ARB_LANG.items())} END, 'app_en', path, value FROM {_key_sql('target')} t")
def arb_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ARB bundles, written and read back."""
    root = _folder(spark)
    every = _key(load(spark, sf_dir, "source").withColumn("lang", F.lit("en"))).select("lang", "path", "value").unionByName(_key(load(spark, sf_dir, "target")).select("lang", "path", "value"))
    meta = every.select("lang", F.concat(F.lit("@"), "path").alias("path"), F.lit("about this text").alias("value"))
    own = spark.createDataFrame([("de", "@@locale", "de_AT"), ("es", "@@locale", "xx")], "lang string, path string, value string")
    texts = unflatten(every.unionByName(meta).unionByName(own).withColumn("vtype", F.lit("string")), "lang")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in _ARB.items() for x in pair)), F.col("lang"))
    fs.write_each(texts.select(name.alias("name"), F.col("json").alias("text")), root, "name")
    fs.write_text(spark, f"{root}/unknown.arb", '{"k": "v"}')
    tree = read_tree(spark, root)
    return _kept(spark, tree.source.withColumn("lang", F.lit("en")).unionByName(tree.target).select("lang", "ns", "path", "value"), root)


# A string catalog: plain texts and plurals, with states

_CAT = """SELECT 'part ' || CAST(p_partkey AS STRING) AS key, p_partkey AS k, p_name AS name, p_partkey % 7 = 0 AS plural, CASE p_partkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'stale' ELSE 'translated' END AS state FROM {}"""
_CAT_DUCK = f"({_CAT.format('part')})"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and entries of the catalog: every seventh text is a plural, every other third has no source of its own."""
    t = spark.sql(_CAT.format(f"parquet.`{sf_dir}/part.parquet`"))
    unit = lambda value, state: F.struct(F.struct(state.alias("state"), value.alias("value")).alias("stringUnit"))
    said = F.lit("translated")
    form = lambda tail, state: unit(F.concat(F.lit("%lld "), "name", F.lit(tail)), state)
    forms = F.struct(F.struct(form("", said).alias("one"), form("s", said).alias("other")).alias("plural"))
    more = F.struct(F.struct(form(" uno", F.col("state")).alias("one"), F.when(F.col("k") % 2 == 0, unit(F.concat("name", F.lit(" pocos")), said)).alias("few"), form(" otros", said).alias("other")).alias("plural"))
    en = F.struct(F.when(~F.col("plural") & (F.col("k") % 3 != 1), F.struct(said.alias("state"), F.concat(F.lit("The "), "name").alias("value"))).alias("stringUnit"), F.when(F.col("plural"), forms).alias("variations"))
    es = F.struct(F.when(~F.col("plural"), F.struct(F.col("state").alias("state"), F.concat(F.lit("El "), "name").alias("value"))).alias("stringUnit"), F.when(F.col("plural"), more).alias("variations"))
    entry = F.struct(F.struct(en.alias("en"), es.alias("es")).alias("localizations"))
    return t.select("key", F.to_json(entry).alias("entry"))


def _catalog_tree(spark: SparkSession, sf_dir: str):
    root = _folder(spark)
    reports.write_catalog(_catalog(spark, sf_dir), f"{root}/App.xcstrings")
    return root, read_tree(spark, f"{root}/App.xcstrings")


@query(f"""SELECT 'en' AS lang, key AS path, CASE WHEN k % 3 = 1 THEN key ELSE 'The ' || name END AS value FROM {_CAT_DUCK} c WHERE NOT plural
UNION ALL SELECT 'en', key || '.plural.one', '%lld ' || name FROM {_CAT_DUCK} c WHERE plural UNION ALL SELECT 'en', key || '.plural.other', '%lld ' || name || 's' FROM {_CAT_DUCK} c WHERE plural
UNION ALL SELECT 'es', key, 'El ' || name FROM {_CAT_DUCK} c WHERE NOT plural AND state <> 'new'
UNION ALL SELECT 'es', key || '.plural.one', '%lld ' || name || ' uno' FROM {_CAT_DUCK} c WHERE plural AND state <> 'new' UNION ALL SELECT 'es', key || '.plural.other', '%lld ' || name || ' otros' FROM {_CAT_DUCK} c WHERE plural""")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts and plural forms of a string catalog, written and read back."""
    root, tree = _catalog_tree(spark, sf_dir)
    return _kept(spark, tree.source.withColumn("lang", F.lit("en")).unionByName(tree.target).select("lang", "path", "value"), root)


@query(f"""SELECT key AS path, 'stale-translation' AS type, 'warning' AS severity, 'state is "' || state || '"' AS message FROM {_CAT_DUCK} c WHERE NOT plural AND state IN ('needs_review', 'stale')
UNION ALL SELECT key || '.plural.few', 'placeholder-missing', 'error', 'dropped %lld' FROM {_CAT_DUCK} c WHERE plural AND k % 2 = 0""")
def catalog_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts marked for review, and forms that the source lacks without their placeholder."""
    root, tree = _catalog_tree(spark, sf_dir)
    return _kept(spark, tree.findings.select("path", "type", "severity", "message"), root)


# Locks and verdicts on disk


@query(f"SELECT {_KEYS}, {_SHA16.format('source')} AS source_hash, {_SHA16.format('translation')} AS translation_hash FROM {_TEXTS} p")
def lock_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks, written and read back."""
    root = _folder(spark)
    reports.write_locks(new_locks(text_pairs(_pairs(spark, sf_dir))), f"{root}/locks.json")
    return _kept(spark, read_locks(spark, f"{root}/locks.json"), root)


@query(f"SELECT pair_hash, category, '' AS note FROM {_VERDICTS} v")
def verdict_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, written and read back; then a broken file, which holds none."""
    root = _folder(spark)
    reports.write_cache(_verdicts(_hashed(spark, sf_dir)), f"{root}/verdicts.json")
    fs.write_text(spark, f"{root}/broken.json", "{")
    return _kept(spark, read_cache(spark, f"{root}/verdicts.json").unionByName(read_cache(spark, f"{root}/broken.json")), root)


# Reports, as documents taken apart again


def _whole(spark: SparkSession, sf_dir: str, ignore: str | None = None, once: bool = False) -> Result:
    """A whole check; with ``once`` its findings are written, since a report reads them several times."""
    pairs, found = _pairs(spark, sf_dir), without_ignored(_findings(spark, sf_dir), ignore)
    if once:
        fs.shared_dir(spark)
        found = found.checkpoint()
    target = load(spark, sf_dir, "target")
    files = target.select("lang", "ns").distinct().withColumns({"is_source": F.lit(False), "file": F.concat("lang", F.lit("/"), "ns", F.lit(".json"))})
    counts = stats.key_counts(load(spark, sf_dir, "source"), target, load(spark, sf_dir, "langs"))
    from .functions.text import is_ignored

    return _result("nested", "en", files, pairs.where(~is_ignored(ignore)), found, counts, "error", None)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in text.split("\n") if line], "line string")


_RANK = f'(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ns, path, type, message) AS place, count(*) OVER (PARTITION BY lang) AS "of" FROM {_FINDINGS} f)'


@query(f"""SELECT 'wordloom-check: nested layout, source en' AS line
UNION ALL SELECT lang || '  coverage ' || printf('%.1f', coverage * 100) || '%  ' || errors || ' error(s), ' || warnings || ' warning(s)' FROM {_lang_stats(_FINDINGS)} s
UNION ALL SELECT '    ' || severity || '  ' || ns || ':' || path || '  ' || type || ': ' || message FROM {_RANK} r WHERE place <= 50
UNION ALL SELECT DISTINCT '    ... and ' || ("of" - 50) || ' more' FROM {_RANK} r WHERE "of" > 50
UNION ALL SELECT 'check failed: ' || sum(errors)::BIGINT || ' error(s)' FROM {_lang_stats(_FINDINGS)} s""")
def text_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, reports.text_report(_whole(spark, sf_dir)))


def _json_report(spark: SparkSession, sf_dir: str) -> tuple[str, tuple[dict, DataFrame]]:
    root = _folder(spark)
    reports.write_json_report(_whole(spark, sf_dir, once=True), f"{root}/report.json")
    return root, reports.read_json_report(spark, f"{root}/report.json")


@query(f"SELECT {_KEYS}, type, severity, message, source, translation FROM {_FINDINGS} f")
def json_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings that the JSON document holds."""
    root, (_, found) = _json_report(spark, sf_dir)
    return _kept(spark, found.select("lang", "ns", "path", "type", "severity", "message", "source", "translation"), root)


@query(f"SELECT 'totals' AS part, NULL AS lang, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings FROM {_lang_stats(_FINDINGS)} s UNION ALL SELECT 'language', lang, errors, warnings FROM {_lang_stats(_FINDINGS)} s")
def json_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the JSON document, and its languages."""
    root, (held, _) = _json_report(spark, sf_dir)
    fs.delete(spark, root)
    rows = [("totals", None, held["totals"]["errors"], held["totals"]["warnings"])] + [("language", x["lang"], x["errors"], x["warnings"]) for x in held["languages"]]
    return spark.createDataFrame(rows, "part string, lang string, errors long, warnings long")


@query(f"""SELECT place - 1 AS place, uri, type AS rule_id, dense_rank() OVER (ORDER BY type) - 1 AS rule_index, severity AS level, text FROM (SELECT *, row_number() OVER (ORDER BY uri, path, type, lang, text) AS place FROM (
SELECT *, lang || '/' || ns || '.json' AS uri, '[' || lang || '] ' || path || ': ' || message AS text FROM {_FINDINGS} f) x) y""")
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of the SARIF document, in its order."""
    root = _folder(spark)
    reports.write_sarif_report(_whole(spark, sf_dir, once=True), f"{root}/report.sarif")
    held, results = reports.read_sarif_report(spark, f"{root}/report.sarif")
    ids = F.array(*(F.lit(r["id"]) for r in held["runs"][0]["tool"]["driver"]["rules"]), F.lit(None))
    rule = F.get(ids, F.col("result.ruleIndex").cast("int"))
    uri = F.col("result.locations")[0]["physicalLocation"]["artifactLocation"]["uri"]
    return _kept(spark, results.select("place", uri.alias("uri"), rule.alias("rule_id"), F.col("result.ruleIndex").alias("rule_index"), F.col("result.level").alias("level"), F.col("result.message.text").alias("text")), root)


@query(f"SELECT lang, count(*) AS tests, count(*) FILTER (WHERE errors > 0) AS failures FROM {_ns_stats(_FINDINGS)} n GROUP BY lang UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE errors > 0) FROM {_ns_stats(_FINDINGS)} n")
def junit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the JUnit document and of its suites."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(reports.junit_report(_whole(spark, sf_dir)).encode())
    return spark.createDataFrame([("all" if x is root else x.get("name"), int(x.get("tests")), int(x.get("failures"))) for x in (root, *root)], "lang string, tests long, failures long")


@query("SELECT * FROM (VALUES " + ", ".join(f"({_text(k)}, {_text(v)})" for k, v in TYPES.items()) + ") t(type, says)")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding type, and what the documents say of it."""
    return spark.createDataFrame(list(TYPES.items()), "type string, says string")


@query(f"SELECT lang, round(coverage * 100, 1) AS coverage, errors, warnings FROM {_lang_stats(_FINDINGS)} s")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.summarize(_whole(spark, sf_dir))


# Functions


@query("SELECT * FROM (VALUES (0, 'es'), (1, 'pt-BR'), (2, 'zh Hans'), (3, 'fr')) t(place, lang)")
def target_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(split_list(" es, pt-BR ,,zh Hans,\tfr,"))), "place int, lang string")


@query("SELECT doc_id, md5(text || 'es,pt-BR') AS key FROM documents")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_key("text", ["es", "pt-BR"]).alias("key"))


@query(f"SELECT {_KEYS}, len(string_split_regex(source, '\\s+')) >= 4 AND source <> translation AS substantive FROM {_TEXTS} p")
def substantive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pairs(_pairs(spark, sf_dir)).select("lang", "ns", "path", is_substantive("source", "translation").alias("substantive"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS other, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"a\":{\"b\":\"' || event_type || '\"}}' AS changed FROM events")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies at a path of a JSON text, and the text with something put at another."""
    none = json_at("props", F.lit("k.x"))
    return table(spark, sf_dir, "events").select("event_id", json_at("props", F.lit("k")).alias("k"), none.alias("other"), json_with("props", F.lit("a.b"), "event_type").alias("changed"))


_MISSING = f"(SELECT l.lang, s.ns, 'missing-file' AS type FROM (SELECT DISTINCT ns FROM {duck('source')} a) s CROSS JOIN {duck('langs')} l)"


@query(f"SELECT lang, ns, type FROM (SELECT * FROM {_MISSING} m UNION ALL SELECT lang, ns, 'invalid-json' FROM {_MISSING} m) x WHERE type = 'invalid-json' OR ns <> (SELECT min(ns) FROM {duck('source')} z)")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing file is ignored by its namespace; a broken one never is."""
    source = load(spark, sf_dir, "source")
    files = source.select("ns", F.lit("en").alias("lang"), F.lit(True).alias("is_source")).distinct().unionByName(load(spark, sf_dir, "langs").select(F.lit("other").alias("ns"), "lang", F.lit(False).alias("is_source")))
    lost = missing_files(files)
    every = lost.unionByName(lost.withColumn("type", F.lit("invalid-json")))
    return without_ignored(every, source.agg(F.min("ns")).first()[0]).select("lang", "ns", "type")


# Review


def _rule(text: str) -> str:
    """A reviewer by arithmetic: the length of the texts decides; it answers badly about every thirteenth at first."""
    start = text.index('[{"id": "k0", "source"')
    asked, _ = json.JSONDecoder().raw_decode(text[start:])
    if len(asked[0]["source"]) % 13 == 0 and "no valid JSON" not in text:
        return "let me think"
    say = lambda a: "omission" if len(a["translation"]) % 7 == 0 else "mistranslation" if len(a["source"]) % 11 == 0 else "ok"
    return "Here: " + json.dumps([{"id": a["id"], "verdict": say(a), "note": f"{len(a['source'])} to {len(a['translation'])}"} for a in asked])


_OPEN = f"(SELECT *, CASE WHEN length(translation) % 7 = 0 THEN 'omission' WHEN length(source) % 11 = 0 THEN 'mistranslation' END AS category FROM {_HASHED} p WHERE NOT {_IGNORED} AND NOT EXISTS (SELECT 1 FROM {_FINDINGS} f WHERE f.severity = 'error' AND f.lang = p.lang AND f.ns = p.ns AND f.path = p.path))"


@functools.lru_cache(8)
def _by_value():
    """The reviewer as a function that reaches the workers by value."""
    import types

    return types.FunctionType(_rule.__code__, {"json": json, "len": len})


@query(f"SELECT {_KEYS}, 'semantic-' || category AS type, 'error' AS severity, length(source) || ' to ' || length(translation) AS message FROM {_OPEN} p WHERE category IS NOT NULL")
def semantic_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole review, without ignored keys and those with structural errors."""
    out, _, _ = run_semantic(_whole(spark, sf_dir, IGNORE), _by_value(), batch=1, fail=True)
    return out.findings.where("type LIKE 'semantic-%'").select("lang", "ns", "path", "type", "severity", "message")


@query(f"""SELECT (SELECT count(*) FROM {_OPEN} o) AS judged, (SELECT count(*) FROM {_OPEN} o WHERE lang = 'de') AS cached, (SELECT count(category) FROM {_OPEN} o WHERE lang <> 'de') AS flagged,
(SELECT CAST(3 * sum(CASE WHEN length(source) % 13 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM (SELECT DISTINCT pair_hash, source FROM {_OPEN} o WHERE lang <> 'de') x) AS calls, CAST(0 AS BIGINT) AS parse_failures,
(SELECT count(*) FROM {_TEXTS} p WHERE NOT {_IGNORED} AND EXISTS (SELECT 1 FROM {_FINDINGS} f WHERE f.severity = 'error' AND f.lang = p.lang AND f.ns = p.ns AND f.path = p.path)) AS excluded""")
def semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review counts; German is cached as fine."""
    cache = _hashed(spark, sf_dir).where("lang = 'de'").select("pair_hash", F.lit(None).cast("string").alias("category"), F.lit("").alias("note")).distinct()
    out, _, _ = run_semantic(_whole(spark, sf_dir, IGNORE), _by_value(), batch=1, cache=cache)
    return out.review


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'omission' WHEN 1 THEN 'ok' WHEN 4 THEN 'addition' END AS verdict, CASE doc_id % 5 WHEN 0 THEN 'about ' || n_chars WHEN 1 THEN '' WHEN 4 THEN 'last' END AS note FROM documents""")
def parsed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with prose around them, without notes, cut short, of no use, and with an id twice."""
    import pyarrow as pa

    answer = F.expr("""CASE doc_id % 5 WHEN 0 THEN 'Sure. [{"id": "k0", "verdict": "omission", "note": "about ' || n_chars || '"}] Done.' WHEN 1 THEN '[{"id":"k0","verdict":"ok","note":5},{"id":"k7","verdict":"omission"}]'
      WHEN 2 THEN '[{"id":"k0","verdict":"ok"' WHEN 3 THEN '[{"id":"k0","verdict":"maybe"}]' ELSE '[{"id":"k0","verdict":"ok"},{"id":"k0","verdict":"addition","note":"last"}]' END""")

    def run(batches):
        for b in batches:
            found = [(semantic.parse_verdicts(t, {"k0"}) or {}).get("k0", (None, None)) for t in b.column("answer").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["doc_id", "verdict", "note"])

    return table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer")).mapInArrow(run, "doc_id bigint, verdict string, note string")


_PROMPT = semantic.prompt([], "en", "@").replace("0 translations", "1 translations").removesuffix("[]")


@query(f"SELECT pair_hash, replace({_text(_PROMPT)}, '@', lang) || '[{{\"id\": \"k0\", \"source\": ' || to_json(source) || ', \"translation\": ' || to_json(translation) || '}}]' AS question FROM (SELECT DISTINCT pair_hash, lang, source, translation FROM {_HASHED} p) x")
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked about each different pair."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            asked = [semantic.prompt([{"id": "k0", "source": r["source"], "translation": r["translation"]}], "en", r["lang"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("pair_hash"), pa.array(asked, pa.string())], ["pair_hash", "question"])

    return semantic.to_judge(_hashed(spark, sf_dir)).select("pair_hash", "lang", "source", "translation").mapInArrow(run, "pair_hash string, question string")


_BROKEN_FR = f"(SELECT DISTINCT ns, path FROM {_FINDINGS} f WHERE severity = 'error' AND lang = 'fr')"


@query(f"SELECT 'fr' AS lang, 'en' AS source, least(20, (SELECT count(*) FROM {_TEXTS} p WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM {_BROKEN_FR} b WHERE b.ns = p.ns AND b.path = p.path))) AS returned, (SELECT count(*) FROM {_BROKEN_FR} b) AS excluded, 3 AS criteria")
def review_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.review(_whole(spark, sf_dir), "fr", 20).select("lang", "source", "returned", "excluded", F.size("criteria").alias("criteria"))


@query(f"""SELECT gate, value, need, coalesce(CASE WHEN gate = 'false alarms' THEN value < need ELSE value >= need END, false) AS ok FROM (
SELECT CASE k.c WHEN 'all' THEN 'catch' ELSE k.c || ' recall' END AS gate, count(*) FILTER (WHERE expected IS NOT NULL AND found IS NOT NULL AND (k.c = 'all' OR expected = k.c)) / CAST(nullif(count(*) FILTER (WHERE expected IS NOT NULL AND (k.c = 'all' OR expected = k.c)), 0) AS DOUBLE) AS value, CAST(CASE k.c WHEN 'all' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS need
FROM (SELECT g.expected, m.category AS found FROM {duck("gold")} g LEFT JOIN @majority@ m ON g.item = m.item) x CROSS JOIN (VALUES ('all'), ('mistranslation'), ('omission'), ('addition')) k(c) GROUP BY k.c
UNION ALL SELECT 'false alarms', count(*) FILTER (WHERE expected IS NULL AND found IS NOT NULL) / CAST(count(*) FILTER (WHERE expected IS NULL) AS DOUBLE), CAST(0.1 AS DOUBLE) FROM (SELECT g.expected, m.category AS found FROM {duck("gold")} g LEFT JOIN @majority@ m ON g.item = m.item) x
UNION ALL SELECT 'glossary', 5 / CAST(6 AS DOUBLE), CAST(1 AS DOUBLE)) y""".replace("@majority@", __import__("wordloom.queries", fromlist=["x"])._majority_sql(3)))
def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import eval_metrics

    return semantic.gates(eval_metrics(spark, sf_dir), 6, 5, 0)


@query(f"SELECT {_KEYS}, place FROM (SELECT {_KEYS}, row_number() OVER (PARTITION BY lang ORDER BY ns, path) AS place FROM {_PAIRS} p WHERE source_type IS NOT NULL AND target_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_FINDINGS} f WHERE f.lang = p.lang AND f.ns = p.ns AND f.path = p.path)) x WHERE place <= 55")
def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 55 pairs of each language without any finding."""
    return tools.clean_pairs(_pairs(spark, sf_dir), _findings(spark, sf_dir), 55)


# Translation


@query(f"SELECT {_KEYS}, CASE action WHEN 'pass' THEN value WHEN 'reuse' THEN old ELSE upper(value) || ' ' || lang END AS result FROM (SELECT s.lang, s.ns, s.path, s.value, t.value AS old, CASE WHEN s.vtype <> 'string' THEN 'pass' WHEN t.value IS NOT NULL AND NOT (t.vtype = 'string' AND t.value = '') THEN 'reuse' ELSE 'translate' END AS action FROM (SELECT * FROM {duck('source')} a CROSS JOIN {duck('langs')} b) s LEFT JOIN {duck('target')} t ON s.lang = t.lang AND s.ns = t.ns AND s.path = t.path) w")
def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts by a translator that is asked by prompts, and whose answers are parsed."""

    def complete(question: str) -> str:
        lang = question.split(" into ", 1)[1].split(".", 1)[0]
        texts = json.loads(question[question.index("\n[") + 1 :].split("\nThe last")[0])
        return "Of course: " + json.dumps([f"{t.upper()} {lang}" for t in texts])

    held = work.partition_work(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"))
    return work.translate(held, work.by_prompt(complete)).select("lang", "ns", "path", "result")


@query(f"""SELECT l.lang, s.ns, s.path, CASE WHEN l.lang = 'fr' AND s.vtype = 'string' THEN s.value WHEN s.vtype <> 'string' THEN s.value ELSE upper(s.value) || ' ' || l.lang END AS value, CASE WHEN l.lang = 'fr' AND s.vtype = 'string' THEN 'source' ELSE 'own' END AS origin
FROM {_named_sql('source')} s CROSS JOIN (VALUES ('pt'), ('pt-BR'), ('fr')) l(lang)""")
def build_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files translated as a build step: a base language is added, and French, which fails, is filled from the source."""

    def shout(texts: list[str], lang: str) -> list[str]:
        if lang == "fr":
            raise RuntimeError("no French today")
        return [f"{t.upper()} {lang}" for t in texts]

    files = unflatten(_named(load(spark, sf_dir, "source")), "ns").select("ns", F.col("json").alias("text"))
    return build(spark, files, ["pt-BR", "fr"], shout).select("lang", "ns", "path", "value", "origin")


_NONE = "CAST(NULL AS VARCHAR)"


@query(f"""SELECT 'de-AT' AS lang, 'regional' AS kind, 'de' AS base, {_NONE} AS keys UNION ALL SELECT 'pt', 'source', NULL, NULL UNION ALL SELECT 'pt-BR', 'source', NULL, NULL UNION ALL SELECT 'es-MX', 'regional', 'es', NULL
UNION ALL SELECT lang, 'keys', NULL, string_agg(DISTINCT regexp_replace(path, '\\.label$', ''), ' ' ORDER BY regexp_replace(path, '\\.label$', '')) FROM (
SELECT s.lang, s.ns, s.path FROM (SELECT * FROM {duck("source")} a CROSS JOIN {duck("langs")} b) s LEFT JOIN (SELECT * FROM {duck("target")} t WHERE value <> '') t ON s.lang = t.lang AND s.ns = t.ns AND replace(t.path, '.legacy', '') = s.path WHERE t.path IS NULL) x GROUP BY lang""")
def fallback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which languages fall back, to what, and which keys."""
    name = lambda df: df.withColumn("path", F.regexp_replace("path", r"^part\.", "part.k"))
    langs = spark.createDataFrame(list(_FALL.items()), "lang string, base string")
    out = work.fallback_info(name(load(spark, sf_dir, "source")), name(load(spark, sf_dir, "target")), langs)
    keys = F.array_join(F.array_sort(F.transform("keys", lambda k: F.regexp_replace(k, r"^part\.k", "part."))), " ")
    return out.select("lang", "kind", "base", keys.alias("keys"))

