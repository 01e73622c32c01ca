"""Language identification: known words first, then ever shorter character n-grams for unseen ones."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plain, slices
from .words import Words, letter_kinds, mix, raw, split

_PRIME = np.uint64(0x100000001B3)


def words(texts: pa.Array) -> Words:
    """Runs of letters in lower case; digits, underscores, marks and all else part them."""
    return split(texts, kinds=letter_kinds())


def spelt(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words given by their bytes, each between blanks, and where each begins and the last ends."""
    at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    buffer = np.ascontiguousarray(data[at])
    points = np.frombuffer(buffer.tobytes().decode().encode("utf-32-le"), np.uint32)
    head = (buffer & 0xC0) != 0x80
    count = np.add.reduceat(head.astype(np.int64), np.cumsum(length) - length) if len(length) else np.zeros(0, np.int64)
    out = np.full(len(points) + 2 * len(count), 32, np.uint32)
    out[np.arange(len(points)) + 2 * np.repeat(np.arange(len(count)), count) + 1] = points
    return out, np.concatenate((np.zeros(1, np.int64), np.cumsum(count + 2)))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` code points from each place on."""
    size = max(len(points) - n + 1, 0)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * _PRIME + points[k : k + size].astype(np.uint64) + np.uint64(1)
    return mix(out)


class Frequencies:
    """Keys and, as rows of ``table``, their log frequencies in each language; ``place`` says which row is whose.

    They are found by 64-bit hashes: of a million keys, none has another's in all but 3 of 10**8 cases.
    """

    def __init__(self, keys: list[str] | pa.Array, table: np.ndarray) -> None:
        self.keys = keys if isinstance(keys, pa.Array) else pa.array(keys, pa.string())
        self.table = table

    def __getstate__(self):
        return self.keys, self.table

    def __setstate__(self, state):
        self.keys, self.table = state

    @functools.cached_property
    def place(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self.keys.to_pylist())}

    @functools.cached_property
    def as_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the keys as ``words`` gives them, in order, and the rows that they stand for."""
        w = words(self.keys)
        order = np.argsort(w.hashes)
        return w.hashes[order], w.text[order]

    @functools.cached_property
    def as_grams(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The same by number of characters, of keys that are n-grams."""
        data, offsets = raw(self.keys)
        size = pc.utf8_length(self.keys).to_numpy(zero_copy_only=False)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = np.cumsum(size) - size
        out = {}
        for n in np.unique(size).tolist():
            row = np.flatnonzero(size == n)
            hashes = gram_hashes(points, n)[begin[row]]
            order = np.argsort(hashes)
            out[n] = hashes[order], row[order]
        return out


def _lookup(hashes: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The row of each hash, -1 where there is none."""
    known, rows = held
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, rows[at], -1)


class Model:
    """Log frequencies of words and of n-grams in each of ``languages``."""

    def __init__(self, languages: list[str], words: Frequencies, grams: Frequencies, longest: int) -> None:
        self.languages, self.words, self.grams, self.longest = languages, words, grams, longest

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean of those of its longest known n-grams; else zeros."""
        w = words(pa.array([word]))
        return self._rows(w)[0] if len(w.hashes) else np.zeros(len(self.languages))

    def _rows(self, w: Words) -> np.ndarray:
        """The log frequencies of each word."""
        at = _lookup(w.hashes, self.words.as_words)
        out = self.words.table[at] if len(self.words.table) else np.zeros((len(at), len(self.languages)))
        strange = np.flatnonzero(at < 0)
        if len(strange):
            _, one, which = np.unique(w.hashes[strange], return_index=True, return_inverse=True)
            out[strange] = self._backed_off(*spelt(w.data, w.start[strange[one]], w.length[strange[one]]))[which]
        return out

    def _backed_off(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each spelt word the mean of the rows of its longest known n-grams."""
        n_words = len(edges) - 1
        out, todo = np.zeros((n_words, len(self.languages))), np.ones(n_words, bool)
        owner = np.repeat(np.arange(n_words), np.diff(edges))
        for n in range(self.longest, 0, -1):
            if n not in self.grams.as_grams or not todo.any():
                continue
            at = np.flatnonzero(todo[owner[: len(points) - n + 1]] & (owner[: len(points) - n + 1] == owner[n - 1 :]))
            row = _lookup(gram_hashes(points, n)[at], self.grams.as_grams[n])
            at, row = owner[at[row >= 0]], row[row >= 0]
            if not len(at):
                continue
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[head]] = np.add.reduceat(self.grams.table[row], head, axis=0) / np.diff(np.append(head, len(at)))[:, None]
            todo[at] = False
        return out

    def identify_all(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The likeliest language of each text, and by how many nats a word it leads. Ties go to the first by name; without evidence, null and 0."""
        n, k = len(texts), len(self.languages)
        w = words(texts)
        if not len(w.hashes) or not k:
            return [None] * n, np.zeros(n)
        head = np.flatnonzero(np.append(True, w.text[1:] != w.text[:-1]))
        scores = np.zeros((n, k))
        scores[w.text[head]] = np.add.reduceat(self._rows(w), head, axis=0) / np.diff(np.append(head, len(w.text)))[:, None]
        known = scores.any(1)
        best = scores.argmax(1)
        lead = np.zeros(n)
        if k > 1:
            rest = scores.copy()
            rest[np.arange(n), best] = -np.inf
            lead = np.where(known, scores[np.arange(n), best] - rest.max(1), 0)
        return [self.languages[b] if ok else None for b, ok in zip(best.tolist(), known.tolist(), strict=True)], lead

    def identify(self, text: str | None) -> tuple[str | None, float]:
        """The same for one text."""
        found, lead = self.identify_all(pa.array([text], pa.string()))
        return found[0], float(lead[0])


def frequencies(counts: pa.Table, languages: list[str]) -> Frequencies:
    """From rows of key, lang and n. A key that a language lacks counts there as half an occurrence."""
    keys = counts["key"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    table = np.full((len(keys.dictionary), len(languages)), 0.5)
    lang = pc.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy() if counts.num_rows else []
    table[keys.indices.to_numpy(zero_copy_only=False), lang] = counts["n"].to_numpy()
    return Frequencies(keys.dictionary, np.log(table / table.sum(0)) if len(table) else table)


_COUNT = pa.schema([("key", pa.string()), ("lang", pa.string()), ("n", pa.int64())])


def _counted(key: pa.Array, lang: pa.Array, n: np.ndarray | None = None) -> pa.RecordBatch:
    t = pa.table({"key": key, "lang": lang, "n": np.ones(len(key), np.int64) if n is None else n})
    t = t.group_by(["key", "lang"]).aggregate([("n", "sum")]).select(["key", "lang", "n_sum"]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks().cast(f.type) for c, f in zip(t.columns, _COUNT, strict=True)], schema=_COUNT)


def _cuts(points: np.ndarray, start: np.ndarray, n: int) -> pa.Array:
    """The strings of ``n`` code points at these places."""
    text = points[(start[:, None] + np.arange(n)).ravel()].tobytes().decode("utf-32-le").encode()
    heads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[::n]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(heads, len(text)).astype(np.int64).tobytes()), pa.py_buffer(text)]).cast(pa.string())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"))
            at = np.repeat(w.start - np.cumsum(w.length) + w.length, w.length) + np.arange(int(w.length.sum()))
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(w.length)))
            key = pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(w.data[at].tobytes())]).cast(pa.string())
            yield _counted(key, part.column("lang").take(pa.array(w.text)))


def _grams(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = raw(batch.column("key"))
            points, edges = spelt(data, offsets[:-1], np.diff(offsets))
            owner, n = np.repeat(np.arange(batch.num_rows), np.diff(edges)), batch.column("n").to_numpy()
            for size in range(1, longest + 1):
                at = np.flatnonzero(owner[: len(points) - size + 1] == owner[size - 1 :])
                yield _counted(_cuts(points, at, size), batch.column("lang").take(pa.array(owner[at])), n[owner[at]])

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, max_words: int | None = None, max_grams: int | None = None, longest: int = 5, seed: int = 3) -> Model:
    """Count words and n-grams of labelled rows: of each language about ``max_rows`` divided by the number of languages at most, those with the least hash of id and text.

    All words of these rows, and all their n-grams of 1 to ``longest`` characters (a word's ends are blanks), make the model: its size is
    bounded by that of the sample. A caller who wants a smaller one may name the number of the commonest words and n-grams to
    keep, in ``max_words`` and ``max_grams``. Rows without a language, a null or an empty text don't count. Of repeated rows all are taken
    or none, and each counts. A model of no rows knows no language, and finds none.
    """
    named = plain(docs, id=id_col, text=text_col, lang=lang_col).select("id", "text", F.col("lang").cast("string").alias("lang")).where("lang != '' AND text != ''")
    each = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {lang: max_rows / len(each) / n for lang, n in each.items()}
    if small := {lang: s for lang, s in share.items() if s < 1}:
        limit = F.element_at(F.create_map(*(F.lit(x) for lang, s in small.items() for x in (lang, int(s * 2.0**64 - 2.0**63)))), F.col("lang"))
        named = named.where(limit.isNull() | (F.xxhash64(F.lit(seed), "id", "text") < limit))
    schema = "key string, lang string, n bigint"
    counted = cut(named.select("lang", "text").mapInArrow(_words, schema).groupBy("key", "lang").agg(F.sum("n").alias("n")))
    languages = sorted(each)

    def held(df: DataFrame, most: int | None) -> Frequencies:
        if most is not None:
            df = df.join(df.groupBy("key").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "key").limit(most).select("key"), "key", "left_semi")
        return frequencies(df.select("key", "lang", "n").orderBy("key", "lang").toArrow(), languages)

    grams = counted.mapInArrow(_grams(longest), schema).groupBy("key", "lang").agg(F.sum("n").alias("n"))
    return Model(languages, held(counted, max_words), held(grams if max_grams is None else cut(grams), max_grams), longest)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``language`` and ``lead`` of every row, from the whole text.

    Null and empty texts, and those without a letter or anything known, have a null language and lead 0. Null ids stay. Repeated rows have
    equal results. An empty table gives no rows. Other columns are left out. Nothing is shuffled. The model is sent to each executor once;
    its size is bounded by the rows that it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, lead = sent.value.identify_all(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.string()), pa.array(lead)], ["doc_id", "language", "lead"])

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, language string, lead double")
