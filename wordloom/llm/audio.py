"""Chroma audio fingerprints in a media column, and the alignment of recordings by them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plain, slices

RATE, FRAME, HOP = 11025, 4096, 1365
AT_ONCE = 256
#: Frames that one filter looks over; a fingerprint has as many values less than there are frames, and one more.
SPAN = 16
#: Sixteen filters: kind, lowest pitch class, pitch classes, frames. What each kind sets against what is said in ``_boxes``.
FILTERS = (
    ("pitch", 0, 4, 16), ("pitch", 4, 4, 16), ("pitch", 8, 4, 16), ("pitch", 0, 12, 8),
    ("time", 0, 4, 16), ("time", 4, 4, 16), ("time", 8, 4, 16), ("time", 2, 6, 8),
    ("cross", 0, 6, 16), ("cross", 6, 6, 16), ("cross", 3, 8, 12), ("middle_pitch", 0, 9, 12),
    ("middle_pitch", 3, 9, 12), ("middle_time", 0, 6, 15), ("middle_time", 6, 6, 15), ("pitch", 2, 8, 4),
)
#: A filter's value falls into one of four steps, written as two bits of a Gray code.
STEPS = (-0.4, 0.0, 0.4)
_GRAY = np.array([0, 1, 3, 2], np.uint32)
#: The value of a silent window.
SILENCE = 0x55555555


@functools.lru_cache(1)
def _pitch_classes() -> tuple[np.ndarray, np.ndarray]:
    """Bins of the spectrum from 55 to 3,520 Hz, and a matrix that adds each to its pitch class."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    bins = np.flatnonzero((hz >= 55) & (hz <= 3520))
    return bins, np.eye(12, dtype=np.float32)[np.round(12 * np.log2(hz[bins] / 440)).astype(int) % 12]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy by pitch class of each frame, smoothed over five frames and scaled to length 1; silent frames are zero.

    Spectra are made of ``AT_ONCE`` frames at a time, so an hour of sound needs little more than its own samples.
    """
    n = (len(samples) - FRAME) // HOP + 1
    if n < 5:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, classes = _pitch_classes()
    window = np.hamming(FRAME).astype(np.float32)
    out = np.zeros((n, 12))
    for k in range(0, n, AT_ONCE):
        power = np.abs(np.fft.rfft(frames[k : k + AT_ONCE].astype(np.float32) * window, axis=1)[:, bins]) ** 2
        out[k : k + AT_ONCE] = power @ classes
    smooth = sum(w * out[k : n - 4 + k] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-3), 0)


def _boxes(kind: str, low: int, height: int, width: int) -> tuple[list, list]:
    """The rectangles (first frame, end, lowest class, end) that a filter adds, and those that it sets them against."""
    t, h, w = low, height // 2, width // 2
    top = low + height
    if kind == "pitch":
        return [(0, width, t, t + h)], [(0, width, t + h, top)]
    if kind == "time":
        return [(0, w, t, top)], [(w, width, t, top)]
    if kind == "cross":
        return [(0, w, t, t + h), (w, width, t + h, top)], [(w, width, t, t + h), (0, w, t + h, top)]
    h, w = height // 3, width // 3
    if kind == "middle_pitch":
        return [(0, width, t + h, t + 2 * h)], [(0, width, t, t + h), (0, width, t + 2 * h, top)]
    return [(w, 2 * w, t, top)], [(0, w, t, top), (2 * w, width, t, top)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each place of a window of ``SPAN`` frames: every filter's sums are four reads of an integral image."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    out = np.zeros(n, np.uint32)
    for spec in FILTERS:
        a, b = (sum(total[at + e, q] - total[at + s, q] - total[at + e, p] + total[at + s, p] for s, e, p, q in boxes) / sum((e - s) * (q - p) for s, e, p, q in boxes) for boxes in _boxes(*spec))
        value = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
        out = out << np.uint32(2) | _GRAY[np.searchsorted(STEPS, value)]
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Values of ``b`` that lie over ``a`` when its first is at ``offset``, and the share of bits that differ there."""
    start, stop = max(0, offset), min(len(a), len(b) + offset)
    if stop <= start:
        return 0, 1.0
    return stop - start, float(np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).mean() / 32)


def melody(vector: np.ndarray, note: int = 1378) -> np.ndarray:
    """A recording made of numbers: one note for each, an eighth of a second long, its pitch by the number."""
    v = np.nan_to_num(np.asarray(vector, float))
    pitch = np.round(24 * np.tanh(2 * v))
    phase = np.outer(2 * np.pi * 440 * 2 ** (pitch / 12) / RATE, np.arange(note)).astype(np.float32)
    first = np.sin(phase)
    wave = (first + first * np.cos(phase)) * np.hanning(note).astype(np.float32)  # half of sin 2x is sin x cos x
    return (wave.ravel() * np.float32(12000)).astype("<i2")


def melodies(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", per_task: int = 2048) -> DataFrame:
    """``rec_id`` and ``audio``, 16-bit mono samples at 11,025 Hz, of every row. Null vectors have null audio, empty ones empty audio; nulls in them and NaN count as 0.

    Null ids stay; repeated rows have equal audio, and an empty table gives no rows. Other columns are left out. Audio is some hundred times as large as its vector, and
    dear to analyse, so vectors are spread evenly first, about ``per_task`` to a task.
    """
    held = plain(vectors, id=id_col, vector=vector_col).select("id", F.col("vector").cast("array<double>"))
    held = held.repartition(max(1, -(-held.count() // per_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                audio = [None if v is None else melody([np.nan if x is None else x for x in v]).tobytes() for v in part.column("vector").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(audio, pa.binary())], ["rec_id", "audio"])

    return held.mapInArrow(run, "rec_id bigint, audio binary")


def fingerprints(recordings: DataFrame, *, id_col: str = "rec_id", audio_col: str = "audio") -> DataFrame:
    """``rec_id`` and ``fingerprint`` of every recording: 16-bit mono samples at 11,025 Hz, read whole.

    Null audio has a null fingerprint; empty audio, and any of less than 20 frames (2.7 seconds), has an empty one, and an odd last byte is ignored.
    Null ids stay. Repeated rows have equal fingerprints. An empty table gives no rows. Other columns are left out. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "audio"):
                prints = [None if x is None else fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2")).view(np.int32) for x in part.column("audio").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.list_(pa.int32()))], ["rec_id", "fingerprint"])

    return plain(recordings, id=id_col, audio=audio_col).mapInArrow(run, "rec_id bigint, fingerprint array<int>")


_ALIGNED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("offset", pa.int32()), ("overlap", pa.int32()), ("error", pa.float64())])


def _best(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, least_overlap: int) -> tuple[float, int, int]:
    """Error, offset and overlap of the best of ``offsets`` and those next to them; ties: the smallest. Without enough overlap, an infinite error."""
    need = max(1, min(least_overlap, len(a), len(b)))
    tried = ((o, *bit_error(a, b, o)) for o in np.unique(np.add.outer((-1, 0, 1), offsets)).tolist())
    return min(((e, o, n) for o, n, e in tried if n >= need), default=(np.inf, 0, 0))


def align(prints: DataFrame, *, max_error: float = 0.15, least_overlap: int = 20, least_hits: int = 1) -> DataFrame:
    """``a``, ``b``, ``offset``, ``overlap`` and ``error`` of every pair of recordings, a < b, that sound alike.

    Equal values vote for the offset of one recording against the other. Every offset with ``least_hits`` votes is checked, and those next to
    it, by the share of differing bits where the two overlap; the one of least error counts (ties: the smallest). A run of equal values, as
    in a steady tone, votes once, by its first place; silence has no vote, so that silent recordings match nothing. Pairs need
    ``least_overlap`` values in common, or all those of the shorter.

    Null and empty fingerprints, and null ids, match nothing. Rows with the same id are one recording, the first by value. An empty table gives no rows.
    """
    held = cut(prints.where("rec_id IS NOT NULL AND size(fingerprint) > 0").groupBy("rec_id").agg(F.min("fingerprint").alias("fp")))
    each = held.select("rec_id", F.posexplode("fp").alias("pos", "value"), F.concat(F.array(F.lit(None).cast("int")), "fp").alias("before"))
    heads = each.where((F.col("value") != SILENCE) & ~F.col("before")[F.col("pos")].eqNullSafe(F.col("value"))).select("rec_id", "pos", "value")
    x, y = (heads.select(F.col("rec_id").alias(k), F.col("pos").alias(f"p{k}"), "value") for k in "ab")
    votes = x.join(y, "value").where("a < b").groupBy("a", "b", (F.col("pa") - F.col("pb")).alias("offset")).agg(F.count("*").alias("n")).where(F.col("n") >= least_hits)
    voted = votes.groupBy("a", "b").agg(F.collect_list("offset").alias("offsets"))
    pairs = voted.join(held.select(F.col("rec_id").alias("a"), F.col("fp").alias("fa")), "a").join(held.select(F.col("rec_id").alias("b"), F.col("fp").alias("fb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, offsets, fa, fb in zip(*(batch.column(c) for c in ("a", "b", "offsets", "fa", "fb")), strict=True):
                x, y = (np.asarray(f.values, np.int32).view(np.uint32) for f in (fa, fb))
                error, offset, overlap = _best(x, y, np.asarray(offsets.values), least_overlap)
                if error <= max_error:
                    rows.append((a.as_py(), b.as_py(), offset, overlap, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ALIGNED)], schema=_ALIGNED)

    return pairs.select("a", "b", "offsets", "fa", "fb").mapInArrow(run, "a bigint, b bigint, offset int, overlap int, error double")


def recordings_alike(prints: DataFrame, **how) -> DataFrame:
    """``rec_id``, ``fingerprint`` and ``alike`` of every row: the ids of all recordings that ``align`` pairs with it, in order.

    What matches nothing has an empty list: null ids, null and empty fingerprints, silence. Rows with the same id have the same list. An empty table gives no rows.
    Equal recordings are all in each other's lists; where there may be many, use ``recording_classes``.
    """
    prints = cut(plain(prints, rec_id="rec_id", fingerprint="fingerprint"))
    return prints.join(_lists(align(prints, **how)), "rec_id", "left").select("rec_id", "fingerprint", F.coalesce("alike", F.array().cast("array<bigint>")).alias("alike"))


def _lists(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("rec_id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    return both.groupBy("rec_id").agg(F.array_sort(F.collect_list("other")).alias("alike"))


def recording_classes(prints: DataFrame, **how) -> DataFrame:
    """``rec_id``, ``fingerprint``, ``class_id``, ``class_rows`` and ``alike`` of every row.

    Recordings with equal fingerprints are a class, named by the least id of them and counted once an id; ``alike`` names, in order, the classes that ``align`` pairs
    with it. Each class is aligned once, however many copies it has, and copies are not told pair by pair. Null ids, null and empty fingerprints and silence
    have no class: null, 0 and an empty list. Rows with the same id are one recording, the first by value. An empty table gives no rows.
    """
    prints = cut(plain(prints, rec_id="rec_id", fingerprint="fingerprint"))
    sound = F.exists("fingerprint", lambda x: x != SILENCE)
    each = prints.where(F.col("rec_id").isNotNull() & sound).groupBy("rec_id").agg(F.min("fingerprint").alias("fp"))
    classes = cut(each.groupBy("fp").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_rows")))
    lists = _lists(align(classes.select(F.col("class_id").alias("rec_id"), F.col("fp").alias("fingerprint")), **how))
    held = classes.join(lists.withColumnRenamed("rec_id", "class_id"), "class_id", "left")
    of = each.join(held, "fp").select("rec_id", "class_id", "class_rows", "alike")
    none = F.array().cast("array<bigint>")
    return prints.join(of, "rec_id", "left").select("rec_id", "fingerprint", "class_id", F.coalesce("class_rows", F.lit(0)).alias("class_rows"), F.coalesce("alike", none).alias("alike"))
