"""Counts, coverage and verdicts from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import in_each

FILE_TYPES = ("missing-file", "invalid-json")


def coverage(keys, missing):
    """The share of source keys that are there; 1 if there are none."""
    return F.when(keys == 0, F.lit(1.0)).otherwise((keys - missing) / keys)


def key_counts(source: DataFrame, target: DataFrame, langs: DataFrame) -> DataFrame:
    """Source and target keys by language and namespace of the source."""
    s = in_each(source.groupBy("ns").agg(F.count("*").alias("source_keys")), langs.select("lang"))
    t = target.groupBy("lang", "ns").agg(F.count("*").alias("target_keys"))
    return s.join(t, ["lang", "ns"], "left").select("lang", "ns", "source_keys", F.coalesce("target_keys", F.lit(0)).alias("target_keys"))


def namespace_stats(counts: DataFrame, findings: DataFrame) -> DataFrame:
    """Per language and namespace. A namespace whose file is missing or broken lacks all its keys."""
    n = findings.groupBy("lang", "ns").agg(
        F.count_if(F.col("type") == "missing-key").alias("lost"),
        F.max(F.col("type").isin(*FILE_TYPES)).alias("no_file"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    out = counts.join(n, ["lang", "ns"], "left").na.fill(0, ["lost", "errors", "warnings"])
    missing = F.least(F.when(F.col("no_file"), F.col("source_keys")).otherwise(F.col("lost")), "source_keys")
    out = out.withColumn("missing", missing)
    return out.select("lang", "ns", "source_keys", "target_keys", "missing", "errors", "warnings", coverage(F.col("source_keys"), F.col("missing")).alias("coverage"))


def language_stats(namespaces: DataFrame) -> DataFrame:
    """Per language: coverage weighted by keys."""
    covered = F.sum(F.round(F.col("coverage") * F.col("source_keys")).cast("bigint"))
    sums = [F.sum(c).alias(c) for c in ("source_keys", "target_keys", "missing", "errors", "warnings")]
    out = namespaces.groupBy("lang").agg(*sums, covered.alias("covered"))
    return out.withColumn("coverage", F.when(F.col("source_keys") == 0, 1.0).otherwise(F.col("covered") / F.col("source_keys")))


def totals(languages: DataFrame) -> DataFrame:
    return languages.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


def one_decimal(ratio):
    """A ratio as a percentage with one decimal, from the exact binary value; halves go up."""
    return F.format_string("%s", F.round((ratio * 100).cast("decimal(38,18)"), 1).cast("decimal(10,1)"))


def verdict(languages: DataFrame, *, fail_on: str = "error", min_coverage: float | None = None) -> DataFrame:
    """One row: ``ok``, and ``failures`` in words. ``fail_on``: error, warning (either counts) or none."""
    if fail_on not in ("error", "warning", "none"):
        raise ValueError("fail_on is error, warning or none")
    low = F.lit(False) if min_coverage is None else F.col("coverage") * 100 < min_coverage
    text = F.concat("lang", F.lit(" coverage "), one_decimal(F.col("coverage")), F.lit(f"% < {min_coverage:g}%" if min_coverage is not None else ""))
    agg = languages.agg(
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.array_sort(F.collect_list(F.when(low, text))).alias("low"),
    )
    errors, warnings = F.concat(F.col("errors").cast("string"), F.lit(" error(s)")), F.concat(F.col("warnings").cast("string"), F.lit(" warning(s)"))
    by_error = F.when(F.lit(fail_on == "error") & (F.col("errors") > 0), errors)
    by_warning = F.when(F.lit(fail_on == "warning") & (F.col("errors") + F.col("warnings") > 0), F.concat(errors, F.lit(", "), warnings))
    out = agg.withColumn("failures", F.concat(F.array_compact(F.array(by_error, by_warning)), "low"))
    return out.select((F.size("failures") == 0).alias("ok"), "failures", "errors", "warnings")


def summary_cube(findings: DataFrame) -> DataFrame:
    """Findings by language and type with all subtotals; an addition of this engine."""
    return findings.cube("lang", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
