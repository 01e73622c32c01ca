"""Token ids in wavelet matrices: one compressed file a shard, read by rank and select."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, slices
from .tokens import TOKENIZER, encode, id_kind

SCHEMA = "shard_id bigint, n_docs int, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, payload binary"
ARROW = pa.schema([("shard_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("payload", pa.binary())])
MAGIC = b"WLWM0002"
#: Bits between two entries of the rank directory.
BLOCK = 512
#: For a byte and a number k, the place of its one number k, from the left.
_PLACE = np.array([[*(j for j in range(8) if b >> (7 - j) & 1), *[8] * 8][:8] for b in range(256)], np.int64)


def build(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids of up to 32 bits.

    After the magic, the length and the number of bits, that of the highest id, for each bit from the highest: its number of zeros, the compressed
    plane, and the compressed directory of ones before each block. Ids with a zero bit go before the others for the next plane.
    """
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    x = np.ascontiguousarray(ids, "<u4")
    levels = int(x.max()).bit_length() if len(x) else 0
    x = x.astype("<u2") if levels <= 16 else x
    out = [MAGIC, struct.pack("<QI", len(x), levels)]
    for level in range(levels - 1, -1, -1):
        ones = (x & x.dtype.type(1 << level)) != 0
        plane = np.packbits(ones)
        words = np.zeros(-(-len(x) // BLOCK) * (BLOCK // 8), np.uint8)
        words[: len(plane)] = plane
        counts = np.bitwise_count(words.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        directory = np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32))).astype("<u4")
        a, b = squeeze(plane.tobytes()), squeeze(directory.tobytes())
        out += [struct.pack("<QII", len(x) - int(directory[-1]), len(a), len(b)), a, b]
        x = np.concatenate((x[~ones], x[ones]))
    return b"".join(out)


class WaveletMatrix:
    """Access, counts and positions from the bytes of one file; planes are unpacked when first used."""

    def __init__(self, payload: bytes) -> None:
        if payload[:8] != MAGIC:
            raise ValueError("this is no wavelet matrix")
        self.n, self.levels = struct.unpack_from("<QI", payload, 8)
        self.zeros, self._raw, self._planes, at = [], [], [None] * self.levels, 20
        for _ in range(self.levels):
            zeros, a, b = struct.unpack_from("<QII", payload, at)
            self.zeros.append(zeros)
            self._raw.append((payload[at + 16 : at + 16 + a], payload[at + 16 + a : at + 16 + a + b]))
            at += 16 + a + b

    def __len__(self) -> int:
        return self.n

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of plane k, the same as words of 64 bits, and its directory."""
        if self._planes[k] is None:
            import zstandard

            expand = zstandard.ZstdDecompressor().decompress
            plane, directory = (np.frombuffer(expand(x), t) for x, t in zip(self._raw[k], (np.uint8, "<u4"), strict=True))
            plane = np.concatenate((plane, np.zeros(2 * (BLOCK // 8) - len(plane) % (BLOCK // 8), np.uint8)))
            self._planes[k] = plane, plane.view(">u8").astype(np.uint64), directory
        return self._planes[k]

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        _, words, directory = self._plane(k)
        out = directory[at // BLOCK].astype(np.int64)
        word = at // 64
        for j in range(1, BLOCK // 64):
            if not (go := word % (BLOCK // 64) >= j).any():
                break
            out[go] += np.bitwise_count(words[word[go] - j])
        # A shift by 64 is no shift at all, hence the two steps.
        return out + np.bitwise_count(words[word] >> np.uint64(1) >> (63 - at % 64).astype(np.uint64))

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        i = np.atleast_1d(np.asarray(at, np.int64)).copy()
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("position outside the shard")
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            plane, _, _ = self._plane(k)
            bit = (plane[i // 8] >> (7 - i % 8).astype(np.uint8)) & 1
            ones = self._ones(k, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out

    def _find(self, k: int, which: np.ndarray, bit: int) -> np.ndarray:
        """Where plane k has its one, or zero, number ``which``: a binary search of the directory, then of a block's words and a word's bytes."""
        plane, words, directory = self._plane(k)
        before = directory.astype(np.int64) if bit else np.arange(len(directory)) * BLOCK - directory

        def into(held: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which column of each row has the bit, and the bit's number there."""
            sums = np.cumsum(np.bitwise_count(held if bit else ~held), 1, dtype=np.int64)
            column = (sums <= rest[:, None]).sum(1)
            return column, rest - np.where(column > 0, sums[np.arange(len(rest)), column - 1], 0)

        out = np.empty(len(which), np.int64)
        for a in range(0, len(which), 1 << 16):
            part = which[a : a + (1 << 16)]
            block = np.searchsorted(before, part, "right") - 1
            word, rest = into(words[block[:, None] * (BLOCK // 64) + np.arange(BLOCK // 64)], part - before[block])
            word += block * (BLOCK // 64)
            byte, rest = into(plane[word[:, None] * 8 + np.arange(8)], rest)
            byte += word * 8
            held = plane[byte] if bit else ~plane[byte]
            out[a : a + len(part)] = byte * 8 + _PLACE[held, rest]
        return out

    def _ranges(self, tokens: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, behind the last plane, the occurrences of each id between two positions lie."""
        lo, hi = np.full(len(tokens), start), np.full(len(tokens), stop)
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            one = (tokens >> (self.levels - 1 - k) & 1) == 1
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return lo, hi

    def _known(self, tokens) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.atleast_1d(np.asarray(tokens, np.int64))
        return tokens, (tokens >= 0) & (tokens < 1 << self.levels)

    def counts(self, tokens, start: int = 0, stop: int | None = None) -> np.ndarray:
        """How often each of these ids occurs from ``start`` to before ``stop``; 0 for ids that no plane can hold."""
        tokens, known = self._known(tokens)
        lo, hi = self._ranges(tokens[known], min(max(start, 0), self.n), self.n if stop is None else min(max(stop, 0), self.n))
        out = np.zeros(len(tokens), np.int64)
        out[known] = np.maximum(hi - lo, 0)
        return out

    def rank(self, token: int, stop: int) -> int:
        """How often the id occurs before ``stop``."""
        return self.count(token, 0, stop)

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        return int(self.counts([token], start, stop)[0])

    def selects(self, tokens: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Positions of occurrence number ``which``, from 0, of each id."""
        tokens, known = self._known(tokens)
        if not known.all():
            raise IndexError("no such occurrence")
        distinct, inverse = np.unique(tokens, return_inverse=True)
        lo, hi = (x[inverse] for x in self._ranges(distinct, 0, self.n))
        i = lo + which
        if len(i) and ((i < lo) | (i >= hi)).any():
            raise IndexError("no such occurrence")
        for k in range(self.levels - 1, -1, -1):
            one = (tokens >> (self.levels - 1 - k) & 1) == 1
            up = np.empty_like(i)
            up[one], up[~one] = self._find(k, i[one] - self.zeros[k], 1), self._find(k, i[~one], 0)
            i = up
        return i

    def select(self, token: int, which) -> np.ndarray:
        """Positions of the id's occurrences number ``which``, from 0."""
        which = np.atleast_1d(np.asarray(which, np.int64))
        return self.selects(np.full(len(which), token), which)

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the id, ascending."""
        return self.select(token, np.arange(self.count(token)))


def token_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 21, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents as token ids, in shards of about ``shard_tokens``, each a wavelet matrix in ``payload``.

    A shard closes with the document that brings it to ``shard_tokens``, so no document is cut. ``doc_ids`` and ``starts``
    say where each begins. Shards are made of each partition as it is read; ``shard_id`` holds the partition above bit 33.

    Null and empty texts have a place in a shard and no tokens. A null id stays null. Repeated rows are kept as
    often as they occur, in order of arrival. An empty table gives no rows. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        starts: list[int] = []
        parts: list = []
        n, seq, kind = 0, TaskContext.get().partitionId() << 33, {"H": "<u2", "I": "<u4"}[id_kind(tokenizer)]

        def row() -> pa.RecordBatch:
            nonlocal n, seq
            tokens = np.frombuffer(b"".join(p.tobytes() for p in parts), kind)
            out = pa.RecordBatch.from_pylist([{"shard_id": seq, "n_docs": len(ids), "n_tokens": n, "doc_ids": ids, "starts": starts, "payload": build(tokens)}], ARROW)
            ids.clear(), starts.clear(), parts.clear()
            n, seq = 0, seq + 1
            return out

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids.append(doc)
                    starts.append(n)
                    parts.append(encode(text, tokenizer))
                    n += len(parts[-1])
                    if n >= shard_tokens:
                        yield row()
        if ids:
            yield row()

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, SCHEMA)


def _over(shards: DataFrame, find, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(find(shard), arrow)

    return shards.select("shard_id", "doc_ids", "starts", "payload").mapInArrow(run, schema)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token_id`` and ``n`` over all shards, by rank alone; 0 for ids that don't occur.

    An id named twice has one row. Without shards there are no rows. Nulls of ``doc_ids`` don't matter.
    """
    wanted = sorted(set(tokens))

    def find(shard: dict) -> list[dict]:
        return [{"token_id": t, "n": n} for t, n in zip(wanted, WaveletMatrix(shard["payload"]).counts(wanted).tolist(), strict=True)]

    each = _over(shards, find, "token_id bigint, n bigint", pa.schema([("token_id", pa.int64()), ("n", pa.int64())]))
    return each.groupBy("token_id").agg(F.sum("n").alias("n"))


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``doc_id`` and the position in the document of every occurrence of an id, by select.

    A document with a null id has a null ``doc_id``; one that is held twice has its occurrences twice. Without shards, or where the id doesn't occur, there are no rows.
    """

    def find(shard: dict) -> list[dict]:
        at = WaveletMatrix(shard["payload"]).occurrences(token)
        starts = np.asarray(shard["starts"], np.int64)
        doc = np.searchsorted(starts, at, "right") - 1
        return [{"doc_id": shard["doc_ids"][d], "position": p} for d, p in zip(doc.tolist(), (at - starts[doc]).tolist(), strict=True)]

    return _over(shards, find, "doc_id bigint, position bigint", pa.schema([("doc_id", pa.int64()), ("position", pa.int64())]))


def document_tokens(shards: DataFrame) -> DataFrame:
    """``doc_id`` and ``tokens`` of every document, by access; a row for each time that it is held, with no tokens for null and empty texts.

    A null id stays null. Without shards there are no rows.
    """

    def find(shard: dict) -> list[dict]:
        matrix = WaveletMatrix(shard["payload"])
        ids = matrix.access(np.arange(len(matrix))).tolist()
        ends = [*shard["starts"][1:], len(ids)]
        return [{"doc_id": d, "tokens": ids[a:b]} for d, a, b in zip(shard["doc_ids"], shard["starts"], ends, strict=True)]

    return _over(shards, find, "doc_id bigint, tokens array<bigint>", pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))]))


_FOUND = pa.list_(pa.struct([("token_id", pa.int64()), ("positions", pa.list_(pa.int64()))]))


def searched(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``shards`` with ``found``: for each of ``tokens`` that occurs in the shard, in order of the ids, ``token_id`` and all its ``positions``, ascending.

    Each file is read back: rank counts the ids, select finds them, and access has to give them again. A null payload has a null ``found``,
    one without any of ``tokens`` an empty one; repeated rows are searched as often as they occur, and an empty table gives no rows. All columns stay.
    """
    wanted = np.array(sorted(set(tokens)), np.int64)

    @F.arrow_udf("array<struct<token_id: bigint, positions: array<bigint>>>")
    def find(payload: pa.Array) -> pa.Array:
        out = []
        for data in payload:
            if not data.is_valid:
                out.append(None)
                continue
            matrix = WaveletMatrix(data.as_py())
            n = matrix.counts(wanted)
            each = np.repeat(wanted, n)
            at = matrix.selects(each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
            if not np.array_equal(matrix.access(at), each):
                raise ValueError("the file contradicts itself")
            ends = np.cumsum(n)
            out.append([{"token_id": t, "positions": at[e - k : e].tolist()} for t, k, e in zip(wanted.tolist(), n.tolist(), ends.tolist(), strict=True) if k])
        return pa.array(out, _FOUND)

    return shards.withColumn("found", find("payload"))
