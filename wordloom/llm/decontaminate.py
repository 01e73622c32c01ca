"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised text."""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, plain, slices
from .words import mix, powers, unspaced

SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, words int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32())])
_SPACE = ord(" ")


@functools.lru_cache(2)
def _folds(decompose: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each code point is compared as: how many characters, where they begin in the list of all, and that list.

    Lower-case letters, digits, or a space; nothing for marks. Decomposed, a letter is its letters without their marks, and one of a
    script without spaces has a space on either side.
    """
    flat, start, count = [_SPACE], np.zeros(0x110000, np.int32), np.ones(0x110000, np.int64)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or 0x323B0 <= c < 0xE0000:
            continue
        char = chr(c)
        kind = unicodedata.category(char)
        if kind[0] == "M" or kind == "Cf":
            count[c] = 0
        elif kind[0] in "LN":
            out = []
            for x in unicodedata.normalize("NFKD", char) if decompose else char:
                part = unicodedata.category(x)
                if not decompose or part[0] in "LN":
                    one = ord(x.lower()[0])
                    out += [_SPACE, one, _SPACE] if decompose and unspaced(one) else [one]
                elif part[0] != "M" and part != "Cf":
                    out.append(_SPACE)
            start[c], count[c] = len(flat), len(out)
            flat += out
    return count, start, np.array(flat, np.uint32)


def normalise(text: str, decompose: bool = False) -> tuple[str, np.ndarray]:
    """Words in lower case, each between single spaces, and for each character its place in ``text``.

    Marks and format characters vanish; all else that is no letter or digit parts words. ``decompose``, as for searching: letters
    lose their own marks too, ligatures and wide letters are taken apart (NFKD), and each character of a script without spaces is a word.
    """
    codes, at = _normalised(text, decompose)
    return codes.tobytes().decode("utf-32-le"), at


def _normalised(text: str, decompose: bool) -> tuple[np.ndarray, np.ndarray]:
    count, start, flat = _folds(decompose)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    many = count[points]
    at = np.repeat(np.arange(len(points)), many)
    codes = flat[start[points[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.uint32)
    at = np.concatenate(([-1], at, [len(points)]))
    stay = np.append(True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE))
    return codes[stay], at[stay]


def _word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the blanks of a normalised text, and a 64-bit hash of the word after each but the last."""
    gaps = np.flatnonzero(codes == _SPACE)
    up, down = powers(len(codes))
    run = np.cumsum(codes * up[: len(codes)])
    return gaps, mix((run[gaps[1:] - 1] - run[gaps[:-1]]) * down[gaps[:-1]])


class Passages:
    """What to search for, and what was found.

    An item of at most ``window`` words is one pattern; a longer one has a pattern for every run of ``window`` words.
    Items of fewer than ``least`` words are not searched for. The automaton's letters are the numbers of the items' words.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int, least: int) -> None:
        self.window = window
        self.items: list[int] = []
        numbers: dict[int, int] = {}
        self.patterns: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            hashes = _word_hashes(_normalised(text or "", True)[0])[1].tolist()
            if item is None or len(hashes) < max(least, 1):
                continue
            each = tuple(numbers.setdefault(h, len(numbers) + 1) for h in hashes)
            for k in range(max(1, len(each) - window + 1)):
                self.patterns[each[k : k + window]].append((len(self.items), k))
            self.items.append(item)
        self.shortest = min(map(len, self.patterns), default=0)
        self.words = np.array(sorted(numbers), np.uint64)
        self.numbers = np.array([numbers[h] for h in self.words.tolist()], np.int64)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for numbers, entries in self.patterns.items():
                self._automaton.add_word(numbers, (len(numbers), entries))
            self._automaton.make_automaton()
        return self._automaton

    def _hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, list[tuple[int, int]]]]:
        """The blanks, the last word, the number of words and the entries of each pattern found.

        A pattern lies within a run of the items' words, so the automaton sees only runs as long as the shortest pattern.
        """
        gaps, hashes = _word_hashes(codes)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = np.concatenate(([False], self.words[at] == hashes, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in edges.reshape(-1, 2)[np.diff(edges)[::2] >= self.shortest].tolist():
            for last, (n, entries) in self.automaton.iter(tuple(self.numbers[at[a:b]].tolist())):
                yield gaps, a + last, n, entries

    def touches(self, text: str | None) -> bool:
        return bool(text and self.patterns) and next(self._hits(_normalised(text, True)[0]), None) is not None

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Item, start, end and number of words of each passage. Windows that follow each other in both texts are one passage."""
        if not text or not self.patterns:
            return []
        codes, places = _normalised(text, True)
        open_: dict[tuple[int, int, int], list[int]] = {}
        out = []
        for gaps, last, n, entries in self._hits(codes):
            first = last - n + 1
            for item, k in entries:
                if run := open_.pop((item, first, k), None):
                    run[1] = last
                else:
                    run = [first, last]
                    out.append((item, run))
                open_[item, first + 1, k + 1] = run
        return sorted((self.items[item], int(places[gaps[a] + 1]), int(places[gaps[b + 1] - 1]) + 1, b - a + 1) for item, (a, b) in out)


def passages(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, least: int = 5, max_patterns: int = 1_000_000) -> Passages:
    """The patterns of a benchmark, a run of ``window`` words each. They go to every executor, so one of more than ``max_patterns`` is refused, not cut.

    A pattern takes about a kilobyte in each Python worker, once the automaton is made.
    """
    items = plain(benchmark, id=item_col, text=item_text_col).where("text IS NOT NULL")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > 16 * max_patterns:  # more runs than that, unless words have more than sixteen bytes; so much isn't fetched
        raise ValueError(f"the benchmark has {held} bytes; split it, or raise max_patterns")
    search = Passages(sorted(map(tuple, items.dropna().distinct().collect())), window, least)
    if len(search.patterns) > max_patterns:
        raise ValueError(f"the benchmark has {len(search.patterns)} patterns; split it, or raise max_patterns")
    return search


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end`` and ``words`` of every benchmark passage in ``docs``.

    With ``least=1`` items of any length are searched for, also an answer of one word; ``words`` says how much a row proves. By default those
    of fewer than 5 words are no evidence.

    Characters ``start`` to ``end`` of the original text hold the passage. Case, punctuation, white space and
    marks, composed or combining, don't matter; in scripts without spaces each character is a word. Each text is scanned once, whole, in the order read; nothing is shuffled.

    Null and empty texts, of documents or items, hold nothing; an item with a null id is left out. A document with a null id
    has its passages with a null ``doc_id``. Repeated rows have theirs as often as they occur; items with the same text are each reported.
    Empty tables give no rows. Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(passages(benchmark, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(doc, *hit) for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in sent.value.find(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage of 5 words or more (``least``).

    Null and empty texts stay, as do all columns; of repeated rows all go or stay. Empty tables are no special case: without
    items every row stays. An item with a null id is left out. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(passages(benchmark, **how))

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([not sent.value.touches(t) for t in text.to_pylist()], pa.bool_())

    return numbered(docs).where(clean(F.col(f"c{place(docs, text_col)}").cast("string"))).toDF(*docs.columns)
