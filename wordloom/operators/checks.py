"""Structural checks of translations against their source, as one join and one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placeholders import minus, placeholders
from ..functions.text import has_pipe_plural, is_blank, is_ignored, looks_translatable, plural_forms
from ..schema import FINDING_COLUMNS


def _finding(when: Column, kind: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message")))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def in_each(df: DataFrame, few: DataFrame) -> DataFrame:
    """``df`` with the columns of each row of ``few``: a list as short as that of languages, which every task has as one value.

    It is one row's array, so it suits what is bounded by its kind only.
    """
    names = few.columns
    held = few.agg(F.collect_set(F.struct(*(F.col(c) for c in names)))).scalar()
    return df.withColumn("__each", F.explode(held)).select(*df.columns, *(F.col(f"__each.{c}") for c in names))


def side_by_side(source: DataFrame, target: DataFrame, langs: DataFrame | None = None) -> DataFrame:
    """Every source key in every target language beside its translation, and translations without a source.

    ``source`` has ns, path, value, vtype; ``target`` has lang besides. ``langs`` names the languages (by default those of ``target``).
    One full outer join on (lang, ns, path). It stays a merge where a filter makes it an inner one: the optimiser takes the size of
    compressed files for that of rows, and would send the whole source through the driver to every task.
    """
    langs = langs if langs is not None else target.select("lang").distinct()
    s = source.select("ns", "path", F.col("value").alias("source"), F.col("vtype").alias("source_type"))
    s = in_each(s, langs.select("lang"))
    t = target.select("lang", "ns", "path", F.col("value").alias("translation"), F.col("vtype").alias("target_type"))
    return s.join(t.hint("merge"), ["lang", "ns", "path"], "full_outer")


def pair_findings(pairs: DataFrame) -> DataFrame:
    """Findings of rows from ``side_by_side``, without those of glossary and locks.

    The first four are exclusive and come in this order: missing key (or orphan), type mismatch, values that are no text, blank
    translation. Of the rest a pair can have several.
    """
    both = pairs.withColumns({"want": F.when(F.col("source_type") == "string", placeholders("source")), "got": F.when(F.col("target_type") == "string", placeholders("translation"))})
    both = both.withColumns({"lost": minus("want", "got"), "extra": minus("got", "want")})
    none = F.array().cast("array<struct<type:string,severity:string,message:string>>")
    there = F.col("target_type").isNotNull()
    rest = F.array_compact(
        F.array(
            _finding(F.size("lost") > 0, "placeholder-missing", "error", _text("dropped ", F.array_join("lost", ", "))),
            _finding(F.size("extra") > 0, "placeholder-added", "warning", _text("unexpected ", F.array_join("extra", ", "))),
            _finding(
                has_pipe_plural("source") & (plural_forms("source") != plural_forms("translation")), "plural-forms", "error",
                _text("source has ", plural_forms("source").cast("string"), " plural forms ('|'), ", F.col("lang"), " has ", plural_forms("translation").cast("string")),
            ),
            _finding((F.col("source") == F.col("translation")) & looks_translatable("source"), "untranslated", "warning", F.lit("identical to source")),
        )
    )
    one = lambda kind, severity, message: F.array(_finding(F.lit(True), kind, severity, message))
    found = (
        F.when(F.col("source_type").isNull(), one("orphan-key", "warning", F.lit("not present in source")))
        .when(~there, one("missing-key", "error", _text("missing in ", F.col("lang"))))
        .when(F.col("source_type") != F.col("target_type"), one("type-mismatch", "warning", _text("source is ", F.col("source_type"), ", ", F.col("lang"), " is ", F.col("target_type"))))
        .when(F.col("source_type") != "string", none)
        .when(is_blank("translation") & ~is_blank("source"), one("empty-value", "error", F.lit("empty translation")))
        .otherwise(rest)
    )
    return both.select("lang", "ns", "path", "source", "translation", F.explode(found).alias("f")).select("lang", "ns", "path", "f.*", "source", "translation").select(FINDING_COLUMNS)


def text_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs that have text on both sides."""
    return pairs.where("source_type = 'string' AND target_type = 'string'")


def checkable(pairs: DataFrame) -> DataFrame:
    """Text pairs whose translation isn't blank where the source has something: those that the glossary is held against."""
    return text_pairs(pairs).where(~(is_blank("translation") & ~is_blank("source")))


def without_ignored(findings: DataFrame, globs: str | list[str] | None) -> DataFrame:
    """Findings whose path no glob matches. A missing file is ignored by its namespace; invalid JSON never is."""
    return findings.where((F.col("type") == "invalid-json") | ~is_ignored(globs))
