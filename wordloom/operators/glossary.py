"""Glossary terms that a translation has to keep, or to render in an agreed way."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FINDING_COLUMNS

#: A word boundary of ASCII letters, digits and underscore, whatever the letters of other scripts beside it.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TERM = "term string, dnt boolean, required map<string,string>, regex string, token string"


def glossary(spark: SparkSession, terms: dict[str, dict]) -> DataFrame:
    """A table of terms from ``{term: {"dnt": true}}`` and ``{term: {lang: rendering}}``."""
    rows = []
    for term, rule in terms.items():
        words = re.findall(r"[a-z0-9_]+", term.lower())
        inner = "".join(c if re.fullmatch(r"[A-Za-z0-9_]", c) else f"\\x{{{ord(c):X}}}" for c in term)
        required = {k: v for k, v in rule.items() if isinstance(v, str)}
        rows.append((term, rule.get("dnt") is True, required, f"(?iu){BOUNDARY}{inner}{BOUNDARY}", max(words, key=len, default=None)))
    return spark.createDataFrame(rows, TERM)


def term_pairs(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs with each term that occurs in their source, in any case.

    Both ends of a term lie on word boundaries, so its longest word is a whole word of the source: an equi join on words finds the
    candidates, and only those run the term's expression. Terms without an ASCII word are tried on every pair. The terms, which the
    driver has made of a dictionary, are sent to all: shuffled by word, all pairs with a frequent one would meet in one task.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("source"), F.lit("[a-z0-9_]+"), F.lit(0)))
    worded = terms.where("token IS NOT NULL")
    by_word = pairs.withColumn("token", F.explode(words)).join(F.broadcast(worded), "token")
    bare = terms.where("token IS NULL").drop("token")
    found = by_word.drop("token")
    if not bare.isEmpty():
        found = found.unionByName(pairs.join(F.broadcast(bare), F.expr("source RLIKE regex")))
    return found.where(F.expr("source RLIKE regex"))


def glossary_findings(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Violations in text pairs (lang, ns, path, source, translation).

    A do-not-translate term has to stand in the translation as it is written in the source, in each of its spellings. Any other with a rendering for
    the language needs that, in any case.
    """
    found = term_pairs(pairs, terms)
    spellings = F.array_distinct(F.expr("regexp_extract_all(source, regex, 0)"))
    lost = F.exists(spellings, lambda s: ~F.contains(F.col("translation"), s))
    want = F.try_element_at("required", F.col("lang"))
    absent = ~F.contains(F.lower("translation"), F.lower(want))
    message = F.when(F.col("dnt") & lost, F.concat(F.lit('do-not-translate term "'), "term", F.lit('" is missing from the translation'))).when(
        ~F.col("dnt") & absent, F.concat(F.lit('locked term "'), "term", F.lit('" must be translated as "'), want, F.lit('"'))
    )
    out = found.withColumn("message", message).where("message IS NOT NULL")
    return out.withColumns({"type": F.lit("glossary-violation"), "severity": F.lit("error")}).select(FINDING_COLUMNS)


def glossary_summary(findings: DataFrame) -> DataFrame:
    """Per language: how many violations, and their messages."""
    return findings.where("type = 'glossary-violation'").groupBy("lang").agg(F.count("*").alias("violations"), F.array_sort(F.collect_set("message")).alias("messages"))
