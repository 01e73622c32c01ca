"""Small text files on whatever file system Spark has: local, distributed or an object store."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path) if _is_local(spark) else path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _is_local(spark: SparkSession) -> bool:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return (conf.get("fs.defaultFS") or "file:///").startswith("file:")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None if it can't be read or isn't UTF-8."""
    from py4j.protocol import Py4JJavaError

    try:
        fs, p = _at(spark, path)
        stream = fs.open(p)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    except (Py4JJavaError, UnicodeDecodeError):
        return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file, making its folders."""
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_rows(rows: DataFrame, path: str, head: str, sep: str, tail: str, empty: str) -> None:
    """Replace a file by one document of any size: ``head``, the texts of ``rows`` in their order with ``sep`` between, and ``tail``; ``empty`` if there are none.

    The executors write the texts. The driver only has their files copied one behind the other, a buffer at a time.
    """
    spark = rows.sparkSession
    parts = _beside(path)
    try:
        rows.write.text(parts, lineSep=sep)
        fs, at = _at(spark, parts)
        if not _parts(fs, at):
            return write_text(spark, path, empty)
        to, p = _at(spark, path)
        out = to.create(p, True)
        try:
            out.write(bytearray(head.encode()))
            _copy(spark, fs, _parts(fs, at), out, sep)
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
    finally:
        delete(spark, parts)


def _parts(fs, at) -> list:
    """The files of a written folder that hold something, in their order."""
    return sorted((s for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())


def _copy(spark: SparkSession, fs, held: list, out, sep: str) -> None:
    """Files one behind the other, without the ``sep`` at the end of the last."""
    for k, s in enumerate(held):
        stream = fs.open(s.getPath())
        try:
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, s.getLen() - (len(sep.encode()) if k == len(held) - 1 else 0))
        finally:
            stream.close()


def write_lists(rows: DataFrame, by: str, path: str, around: list[tuple[str, str | None]], opens: str, sep: str, closes: str, empty: str) -> None:
    """Replace a file by one document with many lists: each text of ``around`` followed by the list that it names, none for None.

    A list is ``opens``, the texts (``value``) of ``rows`` whose column ``by`` names it, in the order of ``rows`` with ``sep`` between, and ``closes``; or ``empty``.
    ``rows`` are ordered by ``by`` first. The executors write the texts, a folder for each list; the driver only has them copied.
    """
    spark = rows.sparkSession
    parts = _beside(path)
    try:
        rows.select(by, "value").write.partitionBy(by).text(parts, lineSep=sep)
        fs, at = _at(spark, parts)
        there = {s.getPath().getName().removeprefix(f"{by}="): s.getPath() for s in fs.listStatus(at) if s.isDirectory()}
        to, p = _at(spark, path)
        out = to.create(p, True)
        try:
            for text, name in around:
                out.write(bytearray(text.encode()))
                held = _parts(fs, there[name]) if name in there else []
                if held:
                    out.write(bytearray(opens.encode()))
                    _copy(spark, fs, held, out, sep)
                if name is not None:
                    out.write(bytearray((closes if held else empty).encode()))
        finally:
            out.close()
    finally:
        delete(spark, parts)


def ends(spark: SparkSession, path: str, most: int = 1 << 16) -> tuple[str, str] | None:
    """The first and the last bytes of a file, as text; None if it can't be read."""
    from py4j.protocol import Py4JJavaError

    try:
        fs, p = _at(spark, path)
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            io = spark._jvm.org.apache.commons.io.IOUtils
            held = []
            for at in (0, max(0, size - most)):
                stream.seek(at)
                held.append(bytes(io.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, most))).decode(errors="replace"))
        finally:
            stream.close()
    except Py4JJavaError:
        return None
    return held[0], held[1]


def numbered(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, int]:
    """What stands between the separators of a file, as ``value`` with ``pos``, its place; and how many there are. The executors read."""
    _, p = _at(spark, path)
    held = spark.read.text(p.toString(), lineSep=sep).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"))
    counts = sorted((r.part, r.n) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for _, n in counts:
        starts.append(before)
        before += n
    first = F.try_element_at(F.map_from_arrays(F.lit([k for k, _ in counts]), F.lit(starts)), F.col("part"))
    return held.select("value", (first.cast("bigint") + F.col("pos")).alias("pos")), before


def read_rows(spark: SparkSession, path: str, head: str, sep: str, tail: str) -> DataFrame | None:
    """The texts of a file that ``write_rows`` made, as ``value`` with ``pos``, their place; None if it doesn't begin with ``head`` and end with ``tail``."""
    from py4j.protocol import Py4JJavaError

    try:
        fs, p = _at(spark, path)
        size, (a, b) = fs.getFileStatus(p).getLen(), (len(head.encode()), len(tail.encode()))
        stream = fs.open(p)
        try:
            if size < a + b:
                return None
            io = spark._jvm.org.apache.commons.io.IOUtils
            ends = []
            for at, n in ((0, a), (size - b, b)):
                stream.seek(at)
                ends.append(bytes(io.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n))))
        finally:
            stream.close()
    except Py4JJavaError:
        return None
    if ends != [head.encode(), tail.encode()]:
        return None
    held, before = numbered(spark, path, sep)
    without = lambda end, text: F.when(F.col("pos") == end, text).otherwise(F.col("value"))
    held = held.withColumn("value", without(0, F.substr("value", F.lit(len(head) + 1))))
    return held.withColumn("value", without(before - 1, F.expr(f"substring(value, 1, length(value) - {len(tail)})"))).select("pos", "value")


def write_each(texts: DataFrame, folder: str, name: str, *, end: str = "}") -> None:
    """A file below ``folder`` for each row: ``text``, which ends with ``}``, under the path in column ``name``. The executors write, the driver renames.

    The text source puts a line's end behind every row; here it is the text's own last character, with what else is to follow.
    """
    spark = texts.sparkSession
    parts = _beside(f"{folder.rstrip('/')}/x")
    try:
        texts.select(F.col(name).alias("name"), F.expr("substring(text, 1, length(text) - 1)").alias("value")).write.partitionBy("name").text(parts, lineSep=end)
        fs, at = _at(spark, parts)
        plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for held in (s.getPath() for s in fs.listStatus(at) if s.isDirectory()):
            (file,) = (s.getPath() for s in fs.listStatus(held) if s.getPath().getName().startswith("part-"))
            _, to = _at(spark, f"{folder.rstrip('/')}/{plain(held.getName().removeprefix('name='))}")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            if not fs.rename(file, to):
                raise OSError(f"{to} can't be written")
    finally:
        delete(spark, parts)


def _beside(path: str) -> str:
    at, _, name = path.rpartition("/")
    return f"{at or '.'}/.{name}.parts-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a local session without the setting gets one of its own, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wordloom-")
        atexit.register(shutil.rmtree, path, True)
        named = f"file://{path}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; nothing happens if there is none."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
