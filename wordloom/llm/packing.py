"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import plain, slices
from .tokens import END_ID, TOKENIZER, encode

SCHEMA = "bin_id bigint, doc_ids array<bigint>, pieces array<int>, lengths array<int>, n_tokens int, tokens binary"
ARROW = pa.schema([("bin_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("tokens", pa.binary())])


class Bins:
    """At most ``most`` open bins; bit f of ``free`` says that one has f free places.

    A piece goes into the bin with the least free space that holds it. Among bins with equal
    space, the one that reached it first. If none holds the piece and all bins are in use, the fullest closes.
    """

    def __init__(self, capacity: int, most: int, close: Callable[[list], None]) -> None:
        if capacity < 1 or most < 1:
            raise ValueError("capacity and the number of open bins must be positive")
        self.capacity, self.most, self.close = capacity, most, close
        self.free, self.used = 0, 0
        self.by_space: dict[int, deque[list]] = {}

    def _take(self, space: int) -> list:
        held = self.by_space[space]
        out = held.popleft()
        if not held:
            self.free ^= 1 << space
        return out

    def _put(self, space: int, held: list) -> None:
        if not (at := self.by_space.setdefault(space, deque())):
            self.free |= 1 << space
        at.append(held)

    def add(self, size: int, piece: object) -> None:
        if size >= self.capacity:
            self.close([piece])
            return
        if fits := self.free >> size:
            space = size + (fits & -fits).bit_length() - 1
            held = self._take(space)
        else:
            if self.used == self.most:
                self.close(self._take((self.free & -self.free).bit_length() - 1))
                self.used -= 1
            space, held = self.capacity, []
            self.used += 1
        held.append(piece)
        if space == size:
            self.close(held)
            self.used -= 1
        else:
            self._put(space - size, held)

    def finish(self) -> None:
        """Close what is open, the fullest first."""
        while self.free:
            self.close(self._take((self.free & -self.free).bit_length() - 1))
        self.used = 0


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, open_bins: int = 64, tokenizer: str = TOKENIZER, end_id: int | None = END_ID) -> DataFrame:
    """Sequences of at most ``capacity`` tokens, packed by bounded-space online best-fit.

    One row a sequence: ``bin_id``; ``doc_ids``, ``pieces`` and ``lengths`` of what it holds, in order;
    ``tokens``, the ids as little-endian integers of 16 bits, or of 32 if the vocabulary has more than 65,535. Every document is tokenised whole and ended by
    ``end_id`` (None: by nothing). A longer one is cut into pieces of ``capacity``, numbered from 0, and the
    last piece is packed. Each partition is packed as it is read, so nothing is shuffled and a lost task
    gives the same rows again; ``bin_id`` holds the partition above bit 33.

    Null and empty texts have no tokens and no place in a sequence. A null id stays null in ``doc_ids``.
    Repeated rows are packed as often as they occur; ties go by order of arrival. An empty table gives no rows.
    Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        bins = Bins(capacity, open_bins, done.append)
        seq = TaskContext.get().partitionId() << 33

        def rows() -> pa.RecordBatch:
            nonlocal seq
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(range(seq, seq + len(done)), pa.int64()),
                    *(pa.array([[piece[k] for piece in held] for held in done], ARROW.field(k + 1).type) for k in range(3)),
                    pa.array([sum(piece[2] for piece in held) for held in done], pa.int32()),
                    pa.array([b"".join(piece[3] for piece in held) for held in done], pa.binary()),
                ],
                schema=ARROW,
            )
            seq += len(done)
            done.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    ids = encode(text, tokenizer)
                    if end_id is not None:
                        ids.append(end_id)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece: array = ids[start : start + capacity]
                        bins.add(len(piece), (doc, k, len(piece), piece.tobytes()))
                yield rows()
        bins.finish()
        yield rows()

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, SCHEMA)
