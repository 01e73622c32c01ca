"""Locks on translations edited by hand: hashes of both sides, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ignored, short_hash
from ..schema import FINDING_COLUMNS

CLOBBERED = "this translation was locked as hand-edited and has since changed"
STALE = "the source changed after this translation was locked — the manual edit may be out of date"


def new_locks(pairs: DataFrame, *, keys: str | list[str] | None = None, langs: list[str] | None = None) -> DataFrame:
    """Locks of the text pairs that the key globs and languages select; all, without any."""
    held = pairs.where(F.col("lang").isin(langs)) if langs else pairs
    held = held.where(is_ignored(keys)) if keys else held
    return held.select("lang", "ns", "path", short_hash("source").alias("source_hash"), short_hash("translation").alias("translation_hash"))


def merge_locks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old locks with those of ``new`` in place of the same ids. ``added`` says which weren't there. None: start from nothing."""
    key = ["lang", "ns", "path"]
    if old is None:
        return new.withColumn("added", F.lit(True))
    n = new.select(*key, F.struct("source_hash", "translation_hash").alias("n"))
    o = old.select(*key, F.struct("source_hash", "translation_hash").alias("o"))
    both = o.join(n, key, "full_outer")
    return both.select(*key, F.coalesce("n", "o").alias("x"), F.col("o").isNull().alias("added")).select(*key, "x.*", "added")


def lock_findings(pairs: DataFrame, locks: DataFrame) -> DataFrame:
    """A changed translation comes before a changed source, since work is already lost."""
    held = pairs.join(locks.hint("merge"), ["lang", "ns", "path"])  # locks grow with the pairs
    kind = F.when(F.col("translation_hash") != short_hash("translation"), "manual-translation-clobbered").when(F.col("source_hash") != short_hash("source"), "manual-translation-stale")
    out = held.withColumn("type", kind).where("type IS NOT NULL")
    message = F.when(F.col("type") == "manual-translation-clobbered", CLOBBERED).otherwise(STALE)
    return out.withColumns({"message": message, "severity": F.lit("warning")}).select(FINDING_COLUMNS)
