"""Locale catalogs made from the supplied tables by arithmetic that Spark and DuckDB do alike.

Each is one SELECT that both engines read; the queries use it through Spark, the expected results through DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LANGS = ("es", "fr", "de")
#: Terms: one brand as it is, and three nouns with a rendering in each language.
DNT = "Brand#13"
REQUIRED = {"widget": {"es": "artilugio", "fr": "gadget", "de": "Dings"}, "bolt": {"es": "perno", "fr": "boulon", "de": "Bolzen"}, "rod": {"es": "vara", "fr": "tige", "de": "Stange"}}
GLOSSARY = {DNT: {"dnt": True}, **REQUIRED}

_SOURCE = """SELECT lower(p_type) AS ns, 'part.' || CAST(p_partkey AS STRING) || '.label' AS path,
  CASE p_partkey % 8
    WHEN 0 THEN p_name WHEN 1 THEN 'Buy {{name}} now: ' || p_name
    WHEN 2 THEN '{count} ' || p_name || ' | {count} more ' || p_name WHEN 3 THEN '%d of %s in ' || p_name
    WHEN 4 THEN 'See $t(part.link) for ' || p_name WHEN 5 THEN p_brand
    WHEN 6 THEN '%1$@ has %2$lld ' || p_name || ' by ' || p_brand ELSE 'From %s to %s by ' || p_brand END AS value,
  CASE WHEN p_partkey % 101 = 100 THEN 'number' ELSE 'string' END AS vtype, p_partkey, p_name, p_brand,
  CAST(floor(p_partkey / 8) AS BIGINT) AS octet
FROM @part@"""
_LANG = "SELECT 'es' AS lang, 0 AS n UNION ALL SELECT 'fr', 1 UNION ALL SELECT 'de', 2"
_WANT = "CASE " + " ".join(f"WHEN l.lang = '{lang}' AND s.p_name LIKE '%{noun}%' THEN '{word}'" for noun, by in REQUIRED.items() for lang, word in by.items()) + " ELSE '' END"
_TARGET = f"""SELECT lang, ns, path, value, vtype FROM (
  SELECT lang, ns, path, vtype, defect, CASE defect
      WHEN 1 THEN '  ' WHEN 2 THEN tag || p_name WHEN 3 THEN tag || value || ' {{{{extra}}}}'
      WHEN 4 THEN tag || split_part(value, ' | ', 1) WHEN 5 THEN value
      WHEN 6 THEN tag || replace(value, 'From %s to %s', 'From %s') WHEN 7 THEN '7'
      WHEN 8 THEN tag || replace(value, '#', ' No. ') ELSE tag || value || word END AS value
  FROM (SELECT l.lang, s.ns, s.path, s.value, s.p_name, '[' || l.lang || '] ' AS tag, (s.octet + 5 * l.n) % 16 AS defect,
          CASE WHEN (s.octet + 5 * l.n) % 16 = 7 THEN 'number' ELSE s.vtype END AS vtype,
          CASE WHEN s.p_partkey % 3 <> 0 THEN ' ' || {_WANT} ELSE '' END AS word
        FROM ({_SOURCE}) s CROSS JOIN ({_LANG}) l) x) y
WHERE defect <> 0
UNION ALL
SELECT l.lang, s.ns, s.path || '.legacy', s.value, 'string' FROM ({_SOURCE}) s CROSS JOIN ({_LANG}) l WHERE s.p_partkey % 37 = 0"""

#: Locked at an earlier state of source and translation: every fifth key has had its translation, every seventh its source, changed since.
_LOCKED = f"""SELECT t.lang, t.ns, t.path, CASE WHEN s.p_partkey % 7 = 3 THEN s.value || ' (old)' ELSE s.value END AS source,
  CASE WHEN s.p_partkey % 5 = 2 THEN t.value || ' by hand' ELSE t.value END AS translation
FROM ({_TARGET}) t JOIN ({_SOURCE}) s ON t.ns = s.ns AND t.path = s.path
WHERE s.p_partkey % 2 = 0 AND t.vtype = 'string' AND s.vtype = 'string'"""

_SNAPSHOT = """SELECT CAST(user_id AS STRING) || '.' || event_type AS path, max(CAST(round(value * 100) AS BIGINT)) AS value FROM @events@
WHERE ts {} TIMESTAMP '2024-01-15 00:00:00' AND user_id % 3 <> {} GROUP BY user_id, event_type"""

#: Three reviewers by arithmetic; the truth is the label.
_VOTES = """SELECT d.doc_id AS item, p.pass, CASE
    WHEN l.toxic = 1 AND (d.doc_id + p.pass) % 4 <> 0 THEN 'mistranslation'
    WHEN l.quality = 0 AND (d.n_chars + p.pass) % 3 <> 0 THEN 'omission'
    WHEN (d.n_chars + 7 * p.pass) % 11 = 0 THEN 'addition' ELSE 'ok' END AS verdict
FROM @documents@ d JOIN @labels@ l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 0 AS pass UNION ALL SELECT 1 UNION ALL SELECT 2) p"""
_GOLD = "SELECT doc_id AS item, CASE WHEN toxic = 1 THEN 'mistranslation' WHEN quality = 0 THEN 'omission' END AS expected FROM @labels@"

_TURNS = """SELECT u.conv_id, u.turn, u.text AS source, a.text AS translation
FROM @conversations@ u JOIN @conversations@ a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""

SQL = {
    "source": f"SELECT ns, path, value, vtype FROM ({_SOURCE}) s", "target": _TARGET, "langs": f"SELECT lang FROM ({_LANG}) l", "locked": _LOCKED,
    "old": _SNAPSHOT.format("<", 1), "new": _SNAPSHOT.format(">=", 2), "votes": _VOTES, "gold": _GOLD, "turns": _TURNS,
}


TABLES = ("part", "events", "documents", "labels", "conversations")


def duck(name: str) -> str:
    """The SELECT for DuckDB, in parentheses."""
    text = SQL[name]
    for t in TABLES:
        text = text.replace(f"@{t}@", t)
    return f"({text})"


#: The tables that Spark has to merge, by alias: their compressed files look small enough to be sent to every task, their rows aren't.
_MERGED = {"locked": "s", "votes": "l", "turns": "a"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``SQL``, over the files of a folder."""
    text = SQL[name]
    if name in _MERGED:
        text = text.replace("SELECT", f"SELECT /*+ MERGE({_MERGED[name]}) */", 1)
    for t in TABLES:
        text = text.replace(f"@{t}@", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)
