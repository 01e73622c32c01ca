"""A quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, place, plain, slices
from .words import Words, raw, split

STATISTICS = (
    "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "upper", "digits", "symbols",
    "exclamations", "bars", "spaces", "other_scripts", "stops", "repeated_lines", "line_length", "caps_words",
)
_CHAR = np.arange(256)
_UPPER, _DIGIT, _SPACE, _HIGH = (_CHAR >= 65) & (_CHAR <= 90), (_CHAR >= 48) & (_CHAR <= 57), (_CHAR == 32) | ((_CHAR >= 9) & (_CHAR <= 13)), _CHAR >= 128
_LETTER = _UPPER | ((_CHAR >= 97) & (_CHAR <= 122)) | _HIGH
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | np.isin(_CHAR, list(b".,;:'\"!?-()|")))
#: Seven kinds of byte, counted in one pass each over running sums.
_KINDS = (_UPPER, _DIGIT, _SYMBOL, _CHAR == ord("!"), _CHAR == ord("|"), _SPACE, _HIGH, np.isin(_CHAR, list(b".?")), _LETTER)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def _groups(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of different values, and how often the commonest occurs."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])))
    most = np.zeros(n)
    np.maximum.at(most, t[first], np.diff(np.append(first, len(v))))
    return np.bincount(t[first], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` a text, over the whole of it; a null or empty text has zeros."""
    n = len(texts)
    data, offsets = raw(texts)
    size = np.diff(offsets).astype(float)
    upper, digit, symbol, bang, bar, space, high, stop, letter = (_sums(k[data], offsets) for k in _KINDS)
    w: Words = split(texts)
    words = np.bincount(w.text, minlength=n).astype(float)
    letters = np.bincount(w.text, w.length, minlength=n)
    distinct, top = _groups(w.text, w.hashes, n)
    pairs = w.text[1:] == w.text[:-1]
    same = np.bincount(w.text[1:][pairs & (w.hashes[1:] == w.hashes[:-1])], minlength=n)
    ends = _sums(data == 10, offsets)
    lines = ends + 1.0
    # A line's key: the sum of its words' hashes, by the number of line ends before it.
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == 10)))
    again, shout = np.zeros(n), np.zeros(n)
    if len(w.start):
        # The same words in the original bytes: lower case may change a letter's length, but neither parts nor joins words.
        o: Words = split(texts, lower=False)
        number = before[o.start] + o.text
        head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        spread = w.hashes * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(head, np.diff(np.append(head, len(number)))).astype(np.uint64)
        kinds, _ = _groups(w.text[head], np.add.reduceat(spread ^ (spread >> np.uint64(29)), head), n)
        filled = np.bincount(w.text[head], minlength=n)
        again = filled - kinds
        shout = np.bincount(w.text[_UPPER[data[o.start]] & _UPPER[data[np.minimum(o.start + 1, len(data) - 1)]] & (o.length > 1)], minlength=n)
    s, m = np.maximum(size, 1), np.maximum(words, 1)
    out = np.stack(
        [
            np.log1p(size), np.log1p(words), letters / m / 8, np.bincount(w.text[w.length > 15], minlength=n) / m, distinct / m, top / m, same / m,
            upper / np.maximum(letter, 1), digit / s, symbol / s, bang / s, bar / s, space / s, high / s, stop / m, again / lines, np.log1p(size / lines), shout / m,
        ],
        1,
    )
    out[size == 0] = 0
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    chances: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.cos(z @ self.waves + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))), 1)

    def probability(self, texts: pa.Array) -> np.ndarray:
        """The calibrated chance that each text is good; 0 for null and empty texts."""
        out = np.zeros(len(texts))
        at = 0
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            text = part.column("text")
            p = np.interp(self.features(statistics(text)) @ self.weights, self.steps, self.chances)
            out[at : at + len(text)] = np.where(np.diff(raw(text)[1]) > 0, p, 0)
            at += len(text)
        return out


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising rates nearest to ``good / n``, of bins in order of score."""
    held: list[list[float]] = []
    for count, hits in zip(n, good, strict=True):
        held.append([count, hits, 1])
        while len(held) > 1 and held[-2][1] * held[-1][0] >= held[-1][1] * held[-2][0]:
            last = held.pop()
            held[-1] = [a + b for a, b in zip(held[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), hits / count) for count, hits, k in held]) if held else np.zeros(0)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("fold"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "fold", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", max_rows: int = 50_000, waves: int = 256, gamma: float = 0.05, ridge: float = 1e-3, bins: int = 1000, seed: int = 7) -> Model:
    """Fit on the labelled rows of ``docs``: about ``max_rows`` of the labels at most, those with the least hash of the id.

    Three quarters give the weights: each partition sums its part of the normal equations, and only these sums reach the
    driver. The rest gives the calibration, as counts of ``bins`` bins of score. Random Fourier features of width ``waves``
    stand for the kernel exp(-gamma |x - y|^2) of the standardised statistics.

    Labels that are null, or have a null id, don't count; an id labelled more than once has the mean. Repeated rows count as often as
    they occur. Without labels of both kinds, or without any that fit a document, there is nothing to learn: each text then has the mean
    label as its quality, 1 if there is none.
    """
    y = plain(labels, id=label_id_col, y=label_col).select("id", F.col("y").cast("double")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    y = y.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    if (n := y.count()) > max_rows:
        y = y.where(F.col("h") < int(max_rows / n * 2.0**64 - 2.0**63))
    sample = y.select("id", "y", F.pmod("h", F.lit(4)).cast("int").alias("fold"))
    text = plain(docs, id=id_col, text=text_col)
    # The sample is bounded by max_rows, whatever the tables hold, so it can be sent to all.
    held = text.join(F.broadcast(sample), "id").select("y", "fold", "text").mapInArrow(_statistics, "y double, fold int, x array<double>")
    # The scan keeps all its tasks; only the statistics of the sample go into partitions of even size.
    data = cut(held.hint("rebalance"))
    width = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width + 2))
        for b in batches:
            if b.num_rows:
                x, good = _matrix(b.column("x")), np.asarray(b.column("y"), float)
                total[0] += [*x.sum(0), len(x), good.sum()]
                total[1] += [*(x * x).sum(0), 0, 0]
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    total = sum((np.frombuffer(r.sums).reshape(2, -1) for r in data.mapInArrow(moments, "sums binary").collect()), np.zeros((2, width + 2)))
    rows, good = total[0, -2:]
    if not 0 < good < rows:
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([good / rows if rows else 1.0]))
    mean = total[0, :width] / rows
    scale = np.sqrt(np.maximum(total[1, :width] / rows - mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (width, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((waves + 1, waves + 2))
        for b in batches:
            use = np.asarray(b.column("fold")) != 0
            z = model.features(_matrix(b.column("x"))[use]) if use.any() else np.zeros((0, waves + 1))
            a[:, :-1] += z.T @ z
            a[:, -1] += z.T @ np.asarray(b.column("y"), float)[use]
        yield pa.RecordBatch.from_pydict({"sums": [a.tobytes()]})

    a = sum((np.frombuffer(r.sums).reshape(waves + 1, -1) for r in data.coalesce(8).mapInArrow(equations, "sums binary").collect()), np.zeros((waves + 1, waves + 2)))
    model = model._replace(weights=np.linalg.solve(a[:, :-1] + ridge * max(rows, 1) / waves * np.eye(waves + 1), a[:, -1]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.clip(model.features(_matrix(b.column("x"))) @ model.weights, -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(((s + 0.5) / 2 * (bins - 1)).astype(np.int32)), b.column("fold"), b.column("y")], ["bin", "fold", "y"])

    counts = data.mapInArrow(scored, "bin int, fold int, y double").groupBy("bin").agg(F.sum(F.expr("IF(fold = 0, 1.0D, 0.0D)")), F.sum(F.expr("IF(fold = 0, y, 0.0D)")), F.count("*"), F.sum("y")).orderBy("bin").collect()
    held_out = [r for r in counts if r[1]]
    use = [(r[0], r[1], r[2]) for r in held_out] if 0 < sum(r[2] for r in held_out) < sum(r[1] for r in held_out) else [(r[0], r[3], r[4]) for r in counts]
    at, n_bin, good_bin = (np.array(x, float) for x in zip(*use, strict=True))
    return model._replace(steps=at / (bins - 1) * 2 - 0.5, chances=isotonic(n_bin, good_bin))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """``doc_id``, ``quality`` and ``keep`` of every row: the calibrated chance that the whole text is good, and whether it reaches ``reject_below``.

    Null and empty texts have quality 0. Null ids stay. Repeated rows have equal scores. An empty table gives no rows. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array(p >= reject_below)], ["doc_id", "quality", "keep"])

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, quality double, keep boolean")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text has a lower quality; null and empty texts go. All columns stay, and nothing is shuffled."""

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(model.probability(text) >= reject_below)

    return numbered(docs).where(good(F.col(f"c{place(docs, text_col)}").cast("string"))).toDF(*docs.columns)
