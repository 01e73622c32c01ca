"""Checks of translations as they are edited: an addition of this engine, on the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import pair_findings


def edit_findings(source: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings of a stream of edits (lang, ns, path, value, vtype) against a source at rest. Keys without a source are orphans.

    The source side is a plain table, so no state is kept.
    """
    s = source.select("ns", "path", F.col("value").alias("source"), F.col("vtype").alias("source_type"))
    t = edits.select("lang", "ns", "path", F.col("value").alias("translation"), F.col("vtype").alias("target_type"))
    return pair_findings(t.join(s, ["ns", "path"], "left"))


def edit_rates(edits: DataFrame, *, time_col: str = "ts", by: str = "lang", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Edits by window and language; what comes later than ``late`` is left out."""
    held = edits.withWatermark(time_col, late)
    return held.groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("edits")).select(F.col("w.start").alias("start"), by, "edits")


def latest(edits: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last edit of each key in a batch."""
    rest = [c for c in edits.columns if c not in key]
    return edits.groupBy(key).agg(F.max_by(F.struct(rest), order).alias("x")).select(*key, "x.*")


def maintain(edits: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str, *, key: list[str], order: str) -> StreamingQuery:
    """Keep a table of the newest entry of each key, until the edits at hand are done.

    ``read`` gives the table as it is (None: not yet there) and ``write`` replaces it; it is given the number of the batch,
    so that a batch that is run again after a failure writes the same place again.
    """

    def batch(new: DataFrame, number: int) -> None:
        old = read()
        held = new if old is None else old.unionByName(new.select(old.columns))
        write(latest(held, key, order), number)

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
