"""Every operator as a query over the supplied tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .fixtures import GLOSSARY, LANGS, duck, load
from .functions.nested import flatten, unflatten
from .functions.placeholders import PATTERNS, placeholders
from .functions.text import LANGUAGES, has_pipe_plural, is_blank, language_name, lock_id, looks_translatable, pair_hash, plural_forms, xml_escape
from .operators import semantic, stats
from .operators import translate as work
from .operators.checks import checkable, pair_findings, side_by_side, text_pairs, without_ignored
from .operators.glossary import glossary, glossary_findings
from .operators.locks import CLOBBERED, STALE, lock_findings, merge_locks, new_locks
from .plans import tools
from .plans.check import check_tables
from .sinks.reports import junit_cases, rule_indexes, sarif_rows, top_findings
from .sources.locales import json_files, missing_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
IGNORE = "*.legacy,economy:part.1*,promo"
SKIP_KEYS, SKIP_GLOBS = ["part.7.label", "part.8.label"], ["part.1*.label", "**.legacy", "*.label"]
MIN_COVERAGE = 93.7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same for DuckDB

_SP = r"[\s\x{FEFF}\p{Z}]"


def _found(of: str, column: str, out: str) -> str:
    """``of`` with the placeholders of a column: nine nested SELECTs, each on what the one before left."""
    text = f"(SELECT *, coalesce({column}, '') AS w0 FROM {of} z)"
    for k, p in enumerate(PATTERNS):
        text = f"(SELECT *, list_reduce(list_prepend(w{k}, m{k}), lambda t, m: replace(t, m, repeat(' ', length(m)))) AS w{k + 1} FROM (SELECT *, regexp_extract_all(w{k}, '{p}') AS m{k} FROM {text} z) z)"
    drop = ", ".join([f"w{k}" for k in range(10)] + [f"m{k}" for k in range(9)])
    return f"(SELECT * EXCLUDE ({drop}), list_sort(flatten([{', '.join(f'm{k}' for k in range(9))}])) AS {out} FROM {text} z)"


def _minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda p, i: len(list_filter({a}[:i], lambda q: q = p)) > len(list_filter({b}, lambda q: q = p)))"


def _blank(x: str) -> str:
    return f"regexp_full_match({x}, '{_SP}*')"


def _wordy(x: str) -> str:
    return f"(regexp_matches({x}, '(?s)[^\\s\\x{{FEFF}}\\p{{Z}}]{_SP}+[^\\s\\x{{FEFF}}\\p{{Z}}]') AND regexp_matches({x}, '[A-Za-z]'))"


def _forms(x: str) -> str:
    return f"len(string_split({x}, '|'))"


_PAIRS = f"""(SELECT coalesce(s.lang, t.lang) AS lang, coalesce(s.ns, t.ns) AS ns, coalesce(s.path, t.path) AS path,
  s.value AS source, s.vtype AS source_type, t.value AS translation, t.vtype AS target_type
FROM (SELECT lang, ns, path, value, vtype FROM {duck("source")} a CROSS JOIN {duck("langs")} b) s
FULL JOIN {duck("target")} t ON s.lang = t.lang AND s.ns = t.ns AND s.path = t.path)"""
_TEXTS = f"(SELECT * FROM {_PAIRS} p WHERE source_type = 'string' AND target_type = 'string')"
_FULL = f"(SELECT * FROM {_TEXTS} p WHERE NOT ({_blank('translation')} AND NOT {_blank('source')}))"
_WITH = f"(SELECT *, {_minus('want', 'got')} AS lost, {_minus('got', 'want')} AS extra FROM {_found(_found(_FULL, 'source', 'want'), 'translation', 'got')} p)"
_KEYS = "lang, ns, path"
_FINDINGS = f"""(
SELECT {_KEYS}, 'missing-key' AS type, 'error' AS severity, 'missing in ' || lang AS message, source, translation FROM {_PAIRS} p WHERE target_type IS NULL
UNION ALL SELECT {_KEYS}, 'orphan-key', 'warning', 'not present in source', source, translation FROM {_PAIRS} p WHERE source_type IS NULL
UNION ALL SELECT {_KEYS}, 'type-mismatch', 'warning', 'source is ' || source_type || ', ' || lang || ' is ' || target_type, source, translation FROM {_PAIRS} p WHERE source_type <> target_type
UNION ALL SELECT {_KEYS}, 'empty-value', 'error', 'empty translation', source, translation FROM {_TEXTS} p WHERE {_blank("translation")} AND NOT {_blank("source")}
UNION ALL SELECT {_KEYS}, 'placeholder-missing', 'error', 'dropped ' || array_to_string(lost, ', '), source, translation FROM {_WITH} p WHERE len(lost) > 0
UNION ALL SELECT {_KEYS}, 'placeholder-added', 'warning', 'unexpected ' || array_to_string(extra, ', '), source, translation FROM {_WITH} p WHERE len(extra) > 0
UNION ALL SELECT {_KEYS}, 'plural-forms', 'error', 'source has ' || {_forms("source")} || ' plural forms (''|''), ' || lang || ' has ' || {_forms("translation")}, source, translation
  FROM {_FULL} p WHERE {_forms("source")} > 1 AND regexp_matches(source, '\\{{[^}}]+\\}}') AND {_forms("source")} <> {_forms("translation")}
UNION ALL SELECT {_KEYS}, 'untranslated', 'warning', 'identical to source', source, translation FROM {_FULL} p WHERE source = translation AND {_wordy("source")})"""

_TERMS = " UNION ALL ".join(f"SELECT '{t}' AS term, {str(bool(r.get('dnt'))).lower()} AS dnt, '{lang}' AS lang, {repr(r[lang]) if lang in r else 'NULL'} AS required" for t, r in GLOSSARY.items() for lang in LANGS)
_HITS = rf"(SELECT p.*, g.term, g.dnt, g.required, list_distinct(regexp_extract_all(source, '(?i)\b' || term || '\b')) AS written FROM {_FULL} p JOIN ({_TERMS}) g ON p.lang = g.lang AND regexp_matches(source, '(?i)\b' || term || '\b'))"
_DNT = f"""(SELECT {_KEYS}, 'glossary-violation' AS type, 'error' AS severity, 'do-not-translate term "' || term || '" is missing from the translation' AS message, source, translation
FROM {_HITS} h WHERE dnt AND len(list_filter(written, lambda w: NOT contains(translation, w))) > 0)"""
_TERM = f"""(SELECT {_KEYS}, 'glossary-violation' AS type, 'error' AS severity, 'locked term "' || term || '" must be translated as "' || required || '"' AS message, source, translation
FROM {_HITS} h WHERE NOT dnt AND required IS NOT NULL AND NOT contains(lower(translation), lower(required)))"""
_IGNORED = r"(regexp_full_match(path, '.*\.legacy|economy:part\.1.*|promo') OR regexp_full_match(ns || ':' || path, '.*\.legacy|economy:part\.1.*|promo'))"
_SHA16 = "left(sha256({}), 16)"
_LOCKS = f"(SELECT {_KEYS}, {_SHA16.format('source')} AS source_hash, {_SHA16.format('translation')} AS translation_hash FROM {duck('locked')} k)"


def _ns_stats(findings: str) -> str:
    return f"""(SELECT *, CASE WHEN source_keys = 0 THEN 1.0 ELSE (source_keys - missing) / CAST(source_keys AS DOUBLE) END AS coverage FROM (
SELECT c.lang, c.ns, c.source_keys, c.target_keys, least(coalesce(f.missing, 0), c.source_keys) AS missing, coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings
FROM (SELECT l.lang, s.ns, s.n AS source_keys, coalesce(t.n, 0) AS target_keys FROM (SELECT ns, count(*) AS n FROM {duck("source")} a GROUP BY ns) s CROSS JOIN {duck("langs")} l
      LEFT JOIN (SELECT lang, ns, count(*) AS n FROM {duck("target")} a GROUP BY lang, ns) t ON t.lang = l.lang AND t.ns = s.ns) c
LEFT JOIN (SELECT lang, ns, count(*) FILTER (WHERE type = 'missing-key') AS missing, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings
           FROM {findings} f GROUP BY lang, ns) f ON f.lang = c.lang AND f.ns = c.ns) x)"""


def _lang_stats(findings: str) -> str:
    return f"""(SELECT *, CASE WHEN source_keys = 0 THEN 1.0 ELSE covered / CAST(source_keys AS DOUBLE) END AS coverage FROM (
SELECT lang, CAST(sum(source_keys) AS BIGINT) AS source_keys, CAST(sum(target_keys) AS BIGINT) AS target_keys, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(CAST(round(coverage * source_keys) AS BIGINT)) AS BIGINT) AS covered FROM {_ns_stats(findings)} n GROUP BY lang) x)"""


_KEPT = f"(SELECT * FROM {_FINDINGS} f WHERE NOT {_IGNORED})"


def _of(kind: str, columns: str = "lang, ns, path, severity, message") -> str:
    return f"SELECT {columns} FROM {_FINDINGS} f WHERE type = '{kind}'"


# Inputs


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side_by_side(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_findings(_pairs(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _findings(spark, sf_dir).where(F.col("type") == kind).select("lang", "ns", "path", "severity", "message")


def _spaces(spark: SparkSession, sf_dir: str, findings: DataFrame | None = None) -> DataFrame:
    counts = stats.key_counts(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"))
    return stats.namespace_stats(counts, findings if findings is not None else _findings(spark, sf_dir))


# Queries: coverage and checks


@query(f"SELECT * FROM {_lang_stats(_FINDINGS)} s")
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_stats(_spaces(spark, sf_dir))


@query(f"SELECT * FROM {_ns_stats(_FINDINGS)} s")
def coverage_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spaces(spark, sf_dir)


def _add_typed(name: str, kind: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _typed(spark, sf_dir, kind)

    f.__name__ = name
    query(_of(kind))(f)


for _name, _kind in (
    ("missing_keys", "missing-key"), ("orphan_keys", "orphan-key"), ("type_mismatch", "type-mismatch"), ("empty_values", "empty-value"), ("placeholder_missing", "placeholder-missing"),
    ("placeholder_added", "placeholder-added"), ("plural_forms", "plural-forms"), ("untranslated", "untranslated"),
):
    _add_typed(_name, _kind)


@query(f"SELECT * FROM {_FINDINGS} f")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"SELECT lang, type, count(*) AS n, CAST(grouping(lang, type) AS BIGINT) AS level FROM {_FINDINGS} f GROUP BY CUBE (lang, type)")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary_cube(_findings(spark, sf_dir))


@query(f"SELECT {_KEYS}, type, severity, message FROM {_KEPT} f")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_ignored(_findings(spark, sf_dir), IGNORE).select("lang", "ns", "path", "type", "severity", "message")


@query(f"SELECT * FROM {_lang_stats(_KEPT)} s")
def coverage_after_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_stats(_spaces(spark, sf_dir, without_ignored(_findings(spark, sf_dir), IGNORE)))


@query(f"""SELECT len(failures) = 0 AS ok, array_to_string(failures, '; ') AS failures, errors, warnings FROM (
SELECT list_concat(CASE WHEN errors > 0 THEN [errors || ' error(s)'] ELSE [] END, coalesce(low, [])) AS failures, errors, warnings FROM (
SELECT CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, list(lang || ' coverage ' || printf('%.1f', coverage * 100) || '% < {MIN_COVERAGE}%' ORDER BY lang) FILTER (WHERE coverage * 100 < {MIN_COVERAGE}) AS low
FROM {_lang_stats(_FINDINGS)} s) x) y""")
def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.verdict(coverage_by_language(spark, sf_dir), min_coverage=MIN_COVERAGE)
    return out.withColumn("failures", F.array_join("failures", "; "))


# Queries: placeholders and text


@query(f"SELECT ns, path, array_to_string(found, ' ') AS found FROM {_found(duck('source'), 'value', 'found')} s")
def placeholder_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "source").select("ns", "path", F.array_join(placeholders("value"), " ").alias("found"))


@query(f"SELECT placeholder, count(*) AS n FROM (SELECT unnest(found) AS placeholder FROM {_found(duck('target'), 'value', 'found')} s) x GROUP BY placeholder")
def placeholder_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "target").select(F.explode(placeholders("value")).alias("placeholder")).groupBy("placeholder").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_forms('text')} AS forms, {_forms('text')} > 1 AND regexp_matches(text, '\\{{[^}}]+\\}}') AS piped, {_wordy('text')} AS wordy, {_blank('text')} AS blank, len(string_split_regex(text, '\\s+')) >= 4 AS substantive FROM documents")
def prose_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = plural_forms("text").cast("bigint").alias("forms")
    return table(spark, sf_dir, "documents").select("doc_id", forms, has_pipe_plural("text").alias("piped"), looks_translatable("text").alias("wordy"), is_blank("text").alias("blank"), (F.size(F.split("text", r"\s+")) >= 4).alias("substantive"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", xml_escape("text").alias("escaped"))


@query("SELECT code, name, count(*) AS n FROM (SELECT code, CASE " + " ".join(f"WHEN split_part(code, '-', 1) = '{c}' THEN '{n}'" for c, n in LANGUAGES.items() if "-" not in c) + " ELSE code END AS name FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '-' || upper(source) END AS code FROM documents) d) x GROUP BY code, name")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '-' || upper(source) END").alias("code")
    return table(spark, sf_dir, "documents").select(code).groupBy("code", language_name("code").alias("name")).agg(F.count("*").alias("n"))


# Queries: glossary and locks


def _glossary(spark: SparkSession, sf_dir: str, dnt: bool) -> DataFrame:
    terms = {t: r for t, r in GLOSSARY.items() if bool(r.get("dnt")) == dnt}
    return glossary_findings(checkable(_pairs(spark, sf_dir)), glossary(spark, terms))


@query(f"SELECT * FROM {_DNT} g")
def glossary_dnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glossary(spark, sf_dir, True)


@query(f"SELECT * FROM {_TERM} g")
def glossary_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glossary(spark, sf_dir, False)


@query(f"SELECT lang, count(*) AS violations, string_agg(DISTINCT message, ' | ' ORDER BY message) AS messages FROM (SELECT * FROM {_DNT} g UNION ALL SELECT * FROM {_TERM} h) x GROUP BY lang")
def glossary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.check_glossary(checkable(_pairs(spark, sf_dir)), glossary(spark, GLOSSARY)).withColumn("messages", F.array_join("messages", " | "))


@query(f"SELECT {_KEYS}, lang || '::' || ns || '::' || path AS id, {_SHA16.format('source')} AS source_hash, {_SHA16.format('translation')} AS translation_hash FROM {_TEXTS} p")
def lock_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = new_locks(text_pairs(_pairs(spark, sf_dir)))
    return held.withColumn("id", lock_id("lang", "ns", "path")).select("lang", "ns", "path", "id", "source_hash", "translation_hash")


@query(f"""SELECT lang, count(*) AS total, count(*) FILTER (WHERE NOT known) AS added, count(*) FILTER (WHERE NOT fresh) AS kept, count(*) FILTER (WHERE fresh AND known AND changed) AS refreshed FROM (
SELECT coalesce(p.lang, k.lang) AS lang, p.path IS NOT NULL AS fresh, k.path IS NOT NULL AS known, k.source_hash <> {_SHA16.format("p.source")} OR k.translation_hash <> {_SHA16.format("p.translation")} AS changed
FROM (SELECT * FROM {_TEXTS} p WHERE regexp_full_match(path, 'part\\.1.*')) p FULL JOIN {_LOCKS} k ON p.lang = k.lang AND p.ns = k.ns AND p.path = k.path) x GROUP BY lang""")
def lock_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _locks(spark, sf_dir)
    new = new_locks(text_pairs(_pairs(spark, sf_dir)), keys="part.1*")
    key = ["lang", "ns", "path"]
    was = old.select(*key, F.col("source_hash").alias("s"), F.col("translation_hash").alias("t"))
    held = merge_locks(old, new).join(was, key, "left").join(new.select(*key, F.lit(True).alias("fresh")), key, "left")
    changed = (F.col("s") != F.col("source_hash")) | (F.col("t") != F.col("translation_hash"))
    return held.groupBy("lang").agg(F.count("*").alias("total"), F.count_if("added").alias("added"), F.count_if(F.col("fresh").isNull()).alias("kept"), F.count_if(changed).alias("refreshed"))


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_locks(load(spark, sf_dir, "locked"))


def _lock(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return lock_findings(text_pairs(_pairs(spark, sf_dir)), _locks(spark, sf_dir)).where(F.col("type") == kind).select("lang", "ns", "path", "type", "severity", "message")


_CLOBBERED = f"{_SHA16.format('p.translation')} <> k.translation_hash"
_LOCK_JOIN = f"FROM {_TEXTS} p JOIN {_LOCKS} k ON p.lang = k.lang AND p.ns = k.ns AND p.path = k.path"


@query(f"SELECT p.lang, p.ns, p.path, 'manual-translation-clobbered' AS type, 'warning' AS severity, '{CLOBBERED}' AS message {_LOCK_JOIN} WHERE {_CLOBBERED}")
def lock_clobbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lock(spark, sf_dir, "manual-translation-clobbered")


@query(f"SELECT p.lang, p.ns, p.path, 'manual-translation-stale' AS type, 'warning' AS severity, '{STALE}' AS message {_LOCK_JOIN} WHERE NOT ({_CLOBBERED}) AND {_SHA16.format('p.source')} <> k.source_hash")
def lock_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lock(spark, sf_dir, "manual-translation-stale")


@query(f"SELECT * FROM (SELECT {_KEYS}, type, severity FROM {_FINDINGS} f UNION ALL SELECT {_KEYS}, type, severity FROM {_DNT} g UNION ALL SELECT {_KEYS}, type, severity FROM {_TERM} h UNION ALL SELECT p.lang, p.ns, p.path, CASE WHEN {_CLOBBERED} THEN 'manual-translation-clobbered' WHEN {_SHA16.format('p.source')} <> k.source_hash THEN 'manual-translation-stale' END, 'warning' {_LOCK_JOIN}) x WHERE type IS NOT NULL")
def full_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check_tables(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"), terms=glossary(spark, GLOSSARY), locks=_locks(spark, sf_dir))
    return found.select("lang", "ns", "path", "type", "severity")


# Queries: semantic review

_HASH = "left(sha256('[' || to_json({}) || ',' || to_json({}) || ',\"en\",' || to_json({}) || ',\"default\",null]'), 32)"
_HASHED = f"(SELECT *, {_HASH.format('source', 'translation', 'lang')} AS pair_hash FROM {_TEXTS} p)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pairs(_pairs(spark, sf_dir)).withColumn("pair_hash", pair_hash("source", "translation", F.lit("en"), "lang"))


@query("SELECT pair_hash, min(conv_id) AS conv_id, count(*) AS paths FROM (SELECT *, " + _HASH.format("source", "translation", "'en'") + f" AS pair_hash FROM {duck('turns')} t) x GROUP BY pair_hash")
def pair_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "turns").withColumn("pair_hash", pair_hash("source", "translation", F.lit("en"), F.lit("en")))
    return held.groupBy("pair_hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("paths"))


@query(f"SELECT {_KEYS}, pair_hash FROM {_HASHED} p WHERE NOT EXISTS (SELECT 1 FROM {_FINDINGS} f WHERE f.severity = 'error' AND f.lang = p.lang AND f.ns = p.ns AND f.path = p.path)")
def semantic_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.reviewable(text_pairs(_pairs(spark, sf_dir)), _findings(spark, sf_dir)).select("lang", "ns", "path", "pair_hash")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "votes").select(F.col("item").cast("string").alias("pair_hash"), "pass", "verdict", F.concat("verdict", F.lit(" "), F.col("pass").cast("string")).alias("note"))


def _majority_sql(passes: int) -> str:
    return f"""(SELECT item, CASE WHEN votes >= {-(-passes // 2)} THEN CASE WHEN m >= o AND m >= a THEN 'mistranslation' WHEN o >= a THEN 'omission' ELSE 'addition' END END AS category,
  CASE WHEN votes >= {-(-passes // 2)} THEN CASE WHEN m >= o AND m >= a THEN 'mistranslation ' || fm WHEN o >= a THEN 'omission ' || fo ELSE 'addition ' || fa END END AS note, votes, valid_passes FROM (
SELECT item, count(*) FILTER (WHERE verdict = 'mistranslation') AS m, count(*) FILTER (WHERE verdict = 'omission') AS o, count(*) FILTER (WHERE verdict = 'addition') AS a,
  min(pass) FILTER (WHERE verdict = 'mistranslation') AS fm, min(pass) FILTER (WHERE verdict = 'omission') AS fo, min(pass) FILTER (WHERE verdict = 'addition') AS fa,
  count(*) FILTER (WHERE verdict <> 'ok') AS votes, count(verdict) AS valid_passes FROM {duck("votes")} v GROUP BY item) x)"""


@query(f"SELECT CAST(item AS VARCHAR) AS pair_hash, category, note, votes, valid_passes FROM {_majority_sql(3)} m")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.majority(_votes(spark, sf_dir), passes=3)


@query(f"SELECT pair_hash, min(path) AS path FROM {_HASHED} p WHERE pair_hash NOT IN (SELECT pair_hash FROM {_HASHED} q WHERE lang = 'fr') GROUP BY pair_hash")
def cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _hashed(spark, sf_dir)
    wanted = semantic.to_judge(held, held.where("lang = 'fr'").select("pair_hash").distinct())
    return held.join(wanted.select("pair_hash"), "pair_hash").groupBy("pair_hash").agg(F.min("path").alias("path"))


_VERDICTS = f"(SELECT DISTINCT pair_hash, CASE WHEN pair_hash < '4' THEN 'omission' WHEN pair_hash < '8' THEN 'addition' END AS category FROM {_HASHED} p)"


def _verdicts(pairs: DataFrame) -> DataFrame:
    c = F.when(F.col("pair_hash") < "4", "omission").when(F.col("pair_hash") < "8", "addition")
    return pairs.select("pair_hash", c.alias("category"), F.lit("").alias("note")).distinct()


@query(f"SELECT {_KEYS}, 'semantic-' || category AS type, category AS message FROM {_HASHED} p JOIN {_VERDICTS} v ON p.pair_hash = v.pair_hash WHERE category IS NOT NULL")
def verdict_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _hashed(spark, sf_dir)
    return semantic.semantic_findings(held, _verdicts(held)).select("lang", "ns", "path", "type", "message")


@query(f"SELECT count(*) AS judged, count(*) FILTER (WHERE lang = 'de') AS cached, count(category) AS flagged FROM {_HASHED} p JOIN {_VERDICTS} v ON p.pair_hash = v.pair_hash")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _hashed(spark, sf_dir)
    de, rest = _verdicts(held.where("lang = 'de'")), _verdicts(held.where("lang <> 'de'"))
    return semantic.review_stats(held, rest, de)


@query(f"""SELECT category, planted, caught, "right", clean, false_alarms, CASE WHEN planted > 0 THEN caught / CAST(planted AS DOUBLE) END AS recall, CASE WHEN caught > 0 THEN "right" / CAST(caught AS DOUBLE) END AS label_accuracy,
  CASE WHEN clean > 0 THEN false_alarms / CAST(clean AS DOUBLE) END AS false_rate FROM (
SELECT coalesce(k.category, 'all') AS category, count(*) FILTER (WHERE expected IS NOT NULL) AS planted, count(*) FILTER (WHERE expected IS NOT NULL AND found IS NOT NULL) AS caught,
  count(*) FILTER (WHERE expected = found) AS "right", count(*) FILTER (WHERE expected IS NULL) AS clean, count(*) FILTER (WHERE expected IS NULL AND found IS NOT NULL) AS false_alarms
FROM (SELECT g.expected, m.category AS found FROM {duck("gold")} g LEFT JOIN {_majority_sql(3)} m ON g.item = m.item) x
JOIN (SELECT NULL AS category UNION ALL SELECT 'mistranslation' UNION ALL SELECT 'omission') k ON k.category IS NULL OR k.category = x.expected GROUP BY k.category HAVING count(*) > 0) y""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.majority(_votes(spark, sf_dir), passes=3).select(F.col("pair_hash").cast("bigint").alias("item"), "category")
    return semantic.metrics(found, load(spark, sf_dir, "gold"))


# Queries: translation

_WORK = f"""(SELECT s.lang, s.ns, s.path, s.value, s.vtype, CASE WHEN s.vtype <> 'string' THEN 'pass' WHEN t.value IS NOT NULL AND NOT (t.vtype = 'string' AND t.value = '') THEN 'reuse' ELSE 'translate' END AS action, t.value AS old
FROM (SELECT * FROM {duck("source")} a CROSS JOIN {duck("langs")} b) s LEFT JOIN {duck("target")} t ON s.lang = t.lang AND s.ns = t.ns AND s.path = t.path)"""


@query(f"SELECT {_KEYS}, action, CASE action WHEN 'pass' THEN value WHEN 'reuse' THEN old END AS result FROM {_WORK} w")
def incremental_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = work.partition_work(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"))
    return held.select("lang", "ns", "path", "action", "result")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts by arithmetic: every third loses its percent signs."""
    held = work.partition_work(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs"))
    made = F.when(F.length("path") % 3 == 0, F.replace("value", F.lit("%"), F.lit(""))).otherwise(F.concat(F.lit("t:"), "value"))
    return held.withColumn("result", F.when(F.col("action") == "translate", made).otherwise(F.col("result")))


_DONE = f"(SELECT *, CASE WHEN action = 'translate' THEN CASE WHEN length(path) % 3 = 0 THEN replace(value, '%', '') ELSE 't:' || value END END AS result FROM {_WORK} w)"
_DRIFT = f"(SELECT * FROM (SELECT {_KEYS}, {_minus('want', 'got')} AS missing, {_minus('got', 'want')} AS added FROM {_found(_found(_DONE, 'value', 'want'), 'result', 'got')} d WHERE action = 'translate') x WHERE len(missing) > 0 OR len(added) > 0)"


@query(f"SELECT {_KEYS}, array_to_string(missing, ' ') AS missing, array_to_string(added, ' ') AS added FROM {_DRIFT} d")
def drift_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.drift(_done(spark, sf_dir)).select("lang", "ns", "path", F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"))


@query(f"""SELECT w.lang, count(*) FILTER (WHERE action = 'translate') AS translated, count(*) FILTER (WHERE action = 'reuse') AS reused, count(*) FILTER (WHERE action = 'pass') AS passed,
  (SELECT count(*) FROM {_DRIFT} d WHERE d.lang = w.lang) AS placeholder_warnings FROM {_WORK} w GROUP BY w.lang""")
def translation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.translation_stats(_done(spark, sf_dir))


_REQUESTED = "SELECT n_nationkey AS pos, CASE WHEN n_nationkey % 3 = 0 THEN lower(substr(n_name, 1, 2)) ELSE lower(substr(n_name, 1, 2)) || '-' || upper(substr(n_name, length(n_name) - 1, 2)) END AS lang FROM {}"


@query(f"""WITH r AS (SELECT lang, min(pos) AS pos FROM ({_REQUESTED.format("nation")}) n GROUP BY lang)
SELECT lang, CASE WHEN contains(lang, '-') THEN split_part(lang, '-', 1) END AS base, false AS added, CAST(pos AS DOUBLE) AS place FROM r
UNION ALL SELECT b, NULL, true, min(pos) - 0.5 FROM (SELECT split_part(lang, '-', 1) AS b, pos FROM r WHERE contains(lang, '-')) x WHERE b NOT IN (SELECT lang FROM r) GROUP BY b""")
def regional_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.regional_targets(spark.sql(_REQUESTED.format(f"parquet.`{sf_dir}/nation.parquet`")))


_AT = "SELECT lang, ns, path, value, vtype FROM {0} a UNION ALL SELECT 'de-AT', ns, path, value || ' (AT)', vtype FROM {0} b WHERE lang = 'de' AND length(path) % 2 = 0"
_FALL = {"es": None, "es-MX": "es", "fr": None, "de": None, "de-AT": "de", "pt": None, "pt-BR": "pt"}


@query(f"""WITH t AS (SELECT * FROM ({_AT.format(duck("target"))}) x WHERE value IS NOT NULL AND NOT (vtype = 'string' AND value = '')), w AS (SELECT s.ns, s.path, s.value, s.vtype, l.lang, l.base FROM {duck("source")} s CROSS JOIN (VALUES {", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in _FALL.items())}) l(lang, base))
SELECT w.lang, w.ns, w.path, coalesce(o.value, b.value, w.value) AS value, CASE WHEN o.path IS NOT NULL THEN 'own' WHEN b.path IS NOT NULL THEN 'regional' ELSE 'source' END AS origin
FROM w LEFT JOIN t o ON o.lang = w.lang AND o.ns = w.ns AND o.path = w.path LEFT JOIN t b ON b.lang = w.base AND b.ns = w.ns AND b.path = w.path
WHERE o.path IS NOT NULL OR b.path IS NOT NULL OR NOT (w.lang NOT IN (SELECT lang FROM t) AND coalesce(w.base, '') IN (SELECT lang FROM t))""")
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "target")
    extra = t.where("lang = 'de' AND length(path) % 2 = 0").withColumns({"lang": F.lit("de-AT"), "value": F.concat("value", F.lit(" (AT)"))})
    langs = spark.createDataFrame(list(_FALL.items()), "lang string, base string")
    return work.fill_from_fallbacks(load(spark, sf_dir, "source"), t.unionByName(extra), langs).select("lang", "ns", "path", "value", "origin")


@query(f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.value AS \"old\", n.value AS \"new\" FROM {duck('old')} o FULL JOIN {duck('new')} n ON o.path = n.path WHERE o.value IS DISTINCT FROM n.value")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.changed_keys(load(spark, sf_dir, "old"), load(spark, sf_dir, "new"), ["path"])


@query(f"SELECT {_KEYS}, path IN ('part.7.label', 'part.8.label') OR regexp_full_match(path, 'part\\.1[^.]*\\.label|.*\\.legacy|[^.]*\\.label') AS skipped FROM {duck('target')} t")
def skip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.split_skipped(load(spark, sf_dir, "target"), SKIP_KEYS, SKIP_GLOBS).select("lang", "ns", "path", "skipped")


@query(f"SELECT coalesce(n.path, o.path) AS path, coalesce(n.value, o.value) AS value FROM {duck('old')} o FULL JOIN {duck('new')} n ON o.path = n.path")
def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.merged(load(spark, sf_dir, "old"), load(spark, sf_dir, "new"), ["path"])


@query(f"""SELECT {_KEYS}, path AS top FROM (SELECT s.lang, s.ns, s.path FROM (SELECT * FROM {duck("source")} a CROSS JOIN {duck("langs")} b) s
LEFT JOIN (SELECT * FROM {duck("target")} t WHERE value <> '') t ON s.lang = t.lang AND s.ns = t.ns AND replace(t.path, '.legacy', '') = s.path WHERE t.path IS NULL) x""".replace("path AS top", "regexp_replace(path, '\\.label$', '') AS top"))
def topmost_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = load(spark, sf_dir, "source"), load(spark, sf_dir, "target")
    # The number in the middle of a path would make it an array; here it is a key.
    name = lambda df: df.withColumn("path", F.regexp_replace("path", r"^part\.", "part.k"))
    out = work.missing_keys(name(s), name(t), load(spark, sf_dir, "langs"))
    return out.select("lang", "ns", *(F.regexp_replace(c, r"^part\.k", "part.").alias(c) for c in ("path", "top")))


@query(f"""SELECT * FROM (SELECT {_KEYS}, CASE WHEN translation IS NULL THEN 'missing_keys' WHEN len({_minus("want", "got")}) > 0 THEN 'placeholder' WHEN length(source) >= 10 AND NOT length(translation) / CAST(length(source) AS DOUBLE) BETWEEN 0.3 AND 3.0 THEN 'length_ratio' END AS type
FROM {_found(_found(f"(SELECT * FROM {_PAIRS} p WHERE source_type = 'string')", "source", "want"), "translation", "got")} p) x WHERE type IS NOT NULL""")
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.verify(load(spark, sf_dir, "source"), load(spark, sf_dir, "target"), load(spark, sf_dir, "langs")).select("lang", "ns", "path", "type")


# Queries: sources

_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem"


def _order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    held = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return held.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total"), (F.col("o_totalprice") > 100000).alias("large")).alias("price"), "lines")).alias("doc"))


@query(f"""SELECT *, NULL AS cents FROM (SELECT o_orderkey, 'status' AS path, o_orderstatus AS value, 'string' AS vtype FROM orders
UNION ALL SELECT o_orderkey, 'price.large', CAST(o_totalprice > 100000 AS VARCHAR), 'boolean' FROM orders
UNION ALL SELECT l_orderkey, 'lines.' || i || '.n', CAST(l_linenumber AS VARCHAR), 'number' FROM ({_LINES}) l JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, 'lines.' || i || '.qty', CAST(l_quantity AS VARCHAR), 'number' FROM ({_LINES}) l JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, 'lines.' || i || '.flag', l_returnflag, 'string' FROM ({_LINES}) l JOIN orders ON l_orderkey = o_orderkey) x
UNION ALL SELECT o_orderkey, 'price.total', NULL, 'number', CAST(round(o_totalprice * 100) AS BIGINT) FROM orders""")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_cents(flatten(_order_json(spark, sf_dir), "doc", "o_orderkey"))


def _in_cents(out: DataFrame) -> DataFrame:
    """How a price is written differs between engines, so it is compared in cents."""
    price = F.col("path") == "price.total"
    return out.withColumns({"cents": F.when(price, F.round(F.col("value").cast("double") * 100).cast("bigint")), "value": F.when(~price, F.col("value"))})


@query()
def unflatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unflatten(flatten(_order_json(spark, sf_dir), "doc", "o_orderkey"), "o_orderkey")


@query(_SQL["flatten_json"])
def unflatten_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart, put together, and taken apart again."""
    return _in_cents(flatten(unflatten_json(spark, sf_dir), "json", "o_orderkey"))


_REL = "regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 1) || '/' || regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 2)"


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.expr(_REL + " || '.json'")
    return json_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), rel.alias("rel"))).withColumn("is_source", F.col("lang") == "en")


@query(f"SELECT 'nested' AS layout, split_part(r, '/', 1) AS lang, split_part(r, '/', 2) AS ns, count(*) AS pages FROM (SELECT {_REL} AS r FROM pages) x WHERE r <> '/' GROUP BY ALL")
def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).groupBy("layout", "lang", "ns").agg(F.count("*").alias("pages"))


@query(f"""WITH f AS (SELECT DISTINCT split_part(r, '/', 1) AS lang, split_part(r, '/', 2) AS ns FROM (SELECT {_REL} AS r FROM pages) x WHERE r <> '/')
SELECT l.lang, s.ns, 'file missing: ' || l.lang || '/' || s.ns || '.json' AS message FROM (SELECT ns FROM f WHERE lang = 'en') s CROSS JOIN (SELECT DISTINCT lang FROM f WHERE lang <> 'en') l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = l.lang AND f.ns = s.ns)""")
def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_files(_layout(spark, sf_dir)).select("lang", "ns", "message")


# Queries: reports and tools


@query(f"""SELECT s.lang, round(s.coverage * 100, 1) AS coverage, coalesce(array_to_string(list_sort(list(ns || ':' || path) FILTER (WHERE type = 'missing-key')), ','), '') AS missing, coalesce(array_to_string(list_sort(list(ns || ':' || path) FILTER (WHERE type = 'orphan-key')), ','), '') AS orphaned,
  coalesce(array_to_string(list_sort(list(ns || ':' || path) FILTER (WHERE type = 'untranslated')), ','), '') AS untranslated FROM {_lang_stats(_FINDINGS)} s LEFT JOIN {_FINDINGS} f ON f.lang = s.lang GROUP BY s.lang, s.coverage""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tools.diff(_findings(spark, sf_dir), coverage_by_language(spark, sf_dir), layout="nested")
    return out.select("lang", "coverage", *(F.array_join(c, ",").alias(c) for c in ("missing", "orphaned", "untranslated")))


@query(f"SELECT ns, path, source, translation FROM {_TEXTS} p WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM {_FINDINGS} f WHERE f.severity = 'error' AND f.lang = p.lang AND f.ns = p.ns AND f.path = p.path) ORDER BY ns, path LIMIT 50")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pairs_for_review(text_pairs(_pairs(spark, sf_dir)), _findings(spark, sf_dir), "fr", 50)


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ns, path, type, message) AS place, count(*) OVER (PARTITION BY lang) AS \"of\" FROM {_FINDINGS} f)"


@query(f'SELECT lang, ns, path, type, place, "of" FROM {_RANKED} r WHERE place <= 50')
def top_findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_findings(_findings(spark, sf_dir)).select("lang", "ns", "path", "type", F.col("place").cast("bigint").alias("place"), "of")


@query(f"SELECT type, dense_rank() OVER (ORDER BY type) - 1 AS rule_index FROM (SELECT DISTINCT type FROM {_FINDINGS} f) x")
def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_indexes(_findings(spark, sf_dir)).select("type", F.col("rule_index").cast("bigint").alias("rule_index"))


@query(f"SELECT lang || '/' || ns || '.json' AS uri, path, type AS rule_id, dense_rank() OVER (ORDER BY type) - 1 AS rule_index, severity AS level, '[' || lang || '] ' || path || ': ' || message AS text FROM {_FINDINGS} f")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "target").select("lang", "ns").distinct().withColumns({"is_source": F.lit(False), "file": F.concat("lang", F.lit("/"), "ns", F.lit(".json"))})
    return sarif_rows(_findings(spark, sf_dir), t).select("uri", "path", "rule_id", F.col("rule_index").cast("bigint").alias("rule_index"), "level", "text")


@query(f"SELECT n.lang, n.ns, count(*) FILTER (WHERE severity = 'error') > 0 AS failed FROM {_ns_stats(_FINDINGS)} n LEFT JOIN {_FINDINGS} f ON f.lang = n.lang AND f.ns = n.ns GROUP BY n.lang, n.ns")
def junit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junit_cases(_spaces(spark, sf_dir), _findings(spark, sf_dir)).select("lang", "ns", "failed")


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_HEAD = "path || ': ' || type || ' — ' || message"
_SHOWN = f"{_HEAD} || coalesce(chr(10) || '  source:      ' || source, '') || coalesce(chr(10) || '  translation: ' || translation, '')"


@query(f"""SELECT lang, ns, errors > 0 AS failed, CASE WHEN body = '' THEN tag || '/>' ELSE tag || '>' || chr(10) || body || '    </testcase>' END AS xml FROM (SELECT *, '    <testcase classname="' || {_escaped("lang")} || '" name="' || {_escaped("ns")} || '"' AS tag,
  CASE WHEN errors > 0 THEN '      <failure message="' || errors || ' error(s) in ' || {_escaped("lang || '/' || ns")} || '">' || {_escaped("bad")} || '</failure>' || chr(10) ELSE '' END || CASE WHEN length(odd) > 0 THEN '      <system-out>' || {_escaped("odd")} || '</system-out>' || chr(10) ELSE '' END AS body
FROM (SELECT n.lang, n.ns, count(*) FILTER (WHERE severity = 'error') AS errors, string_agg({_SHOWN}, chr(10) ORDER BY path, type, {_SHOWN}) FILTER (WHERE severity = 'error') AS bad, string_agg({_HEAD}, chr(10) ORDER BY path, type, {_HEAD}) FILTER (WHERE severity = 'warning') AS odd
FROM {_ns_stats(_FINDINGS)} n LEFT JOIN (SELECT * FROM {_FINDINGS} f) f ON f.lang = n.lang AND f.ns = n.ns GROUP BY n.lang, n.ns) x) y""")
def junit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junit_cases(_spaces(spark, sf_dir), _findings(spark, sf_dir))


@query(f"SELECT path, 'left' AS side FROM {duck('old')} o WHERE path NOT IN (SELECT path FROM {duck('new')} n) UNION ALL SELECT path, 'right' FROM {duck('new')} n WHERE path NOT IN (SELECT path FROM {duck('old')} o)")
def key_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.parity(load(spark, sf_dir, "old"), load(spark, sf_dir, "new"), ["path"])


def queries() -> dict[str, Query]:
    from . import queries_io  # noqa: F401, registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_io  # noqa: F401

    return dict(_SQL)


__all__ = ["fixtures", "oracle_sql", "queries"]
