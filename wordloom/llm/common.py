"""What the corpus operators share: the shared folder, plain inputs and bounded slices."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import shared_dir

#: Text that one vectorised step takes at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def place(df: DataFrame, column: str) -> int:
    """Where a column is; of names that differ in case only, the one that is spelt the same."""
    names = df.columns
    if column in names:
        return names.index(column)
    return [n.lower() for n in names].index(column.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, so that no name can clash; ``toDF`` names them as before."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; what else ``df`` has can't clash."""
    kinds = {"id": "bigint", "text": "string"}
    held = numbered(df)
    return held.select(*(F.col(f"c{place(df, c)}").cast(kinds[k]).alias(k) if k in kinds else F.col(f"c{place(df, c)}").alias(k) for k, c in columns.items()))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


#: Numbers that ``perhaps`` sends to all at most, however large the tables are: 4 million longs, some 200 MB.
MARKS = 1 << 22


def perhaps(df: DataFrame, column: str, keys: DataFrame, *, among: bool, marks: int = MARKS) -> DataFrame:
    """Rows of ``df`` whose hash ``column`` may be among those of ``keys`` (a column of the same name), or those whose surely isn't.

    Hashes are put into ``marks`` classes, and the classes that occur are sent to all, so a row is judged where it is read. The fewer
    the keys, the fewer rows pass by chance; with more keys than classes most do, and nothing but the saving is lost.
    """
    of = F.pmod(F.xxhash64(column), F.lit(marks).cast("bigint"))
    held = keys.select(of.alias("__mark")).distinct()
    return df.withColumn("__mark", of).join(F.broadcast(held), "__mark", "left_semi" if among else "left_anti").drop("__mark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
