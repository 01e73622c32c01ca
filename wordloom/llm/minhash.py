"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, perhaps, place, plain, slices
from .words import composed, mix, split

SIZE, ROWS, SHINGLE, THRESHOLD = 160, 4, 3, 0.5
#: How far from the threshold an estimate decides alone: 3 standard errors of 160 lanes at 0.5. Nearer ones are computed exactly.
MARGIN = 0.12
#: Steps that are kept as the places drawn; from then on elements have their permutation written out.
_SWAPS = 8
_STEP, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint32(0xFFFFFFFF)


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, each with its text's number, in order; and a key of each text's words, 0 where it has none.

    A text of fewer words is one shingle. Composed and decomposed letters are the same.
    """
    w = split(composed(texts))
    n = np.bincount(w.text, minlength=len(texts))
    begin = np.cumsum(n) - n
    place = np.arange(len(w.hashes)) - begin[w.text]
    keys = np.zeros(len(texts), np.uint64)
    np.add.at(keys, w.text, mix(w.hashes + place.astype(np.uint64) * _STEP))
    keys[n > 0] = mix(keys[n > 0]) | np.uint64(1)
    left = n[w.text] - place
    ok = (left >= width) | (place == 0)
    out, at = np.zeros(int(ok.sum()), np.uint64), np.flatnonzero(ok)
    for k in range(width):
        there = left[at] > k
        out[there] = mix(out[there] * np.uint64(3) + w.hashes[at[there] + k] + np.uint64(k + 1))
    return out, w.text[at], keys


def signatures(elements: np.ndarray, text: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of each text's set: ``n`` rows of ``size`` 16-bit lanes.

    An element draws a random permutation of the lanes, one place at a time, and a random rank at each; place j offers
    its lane the value j + rank, and the least value stays. Here all elements take step j together: a lane filled at an
    earlier step holds a lower value than any later step can offer, so only empty lanes take values, and a text leaves
    as soon as no lane is empty. The result is that of the element-wise algorithm with its early stopping.
    """
    out = np.zeros((n, size), np.uint32)
    rows, text = np.unique(text, return_inverse=True)  # only texts with an empty lane are worked on
    sig, empty = np.zeros((len(rows), size), np.uint32), np.ones((len(rows), size), bool)
    drawn: list[np.ndarray] = []
    each = np.arange(len(elements))
    for j in range(size):
        x = mix(elements + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        lane = (j + (((x >> np.uint64(32)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        if j == _SWAPS:  # what is left is little: each element's permutation as it stands
            places = np.tile(np.arange(size, dtype=np.int16), (len(elements), 1))
            for t, at in enumerate(drawn):
                places[each, at], places[each, t] = places[each, t], places[each, at]
        if j < _SWAPS:
            drawn.append(lane)
            for t in range(j - 1, -1, -1):  # what the swaps before have put at this place
                lane = np.where(drawn[t] == lane, np.int16(t), lane)
        else:
            at, lane = lane, places[each, lane]
            places[each, at] = places[:, j]
        best = np.full(len(rows) * size, _TOP, np.uint32)
        np.minimum.at(best, text * size + lane, np.minimum(x.astype(np.uint32), _TOP - np.uint32(1)))
        best = best.reshape(len(rows), size)
        new = empty & (best != _TOP)
        sig[new] = best[new]
        empty &= ~new
        active = empty.any(1)
        if not active.all():
            out[rows[~active]] = sig[~active]
            stay = active[text]
            elements, text, drawn = elements[stay], (np.cumsum(active) - 1)[text[stay]], [d[stay] for d in drawn]
            rows, sig, empty, each = rows[active], sig[active], empty[active], np.arange(len(elements))
            places = places[stay] if j >= _SWAPS else None
        if not len(rows):
            break
    out[rows] = sig
    return mix(out.astype(np.uint64)).astype(np.uint16)


_SKETCH = pa.schema([("id", pa.int64()), ("row_key", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])


def _sketch(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                elements, at, keys = shingles(text, width)
                sig = signatures(elements, at, len(text), size).astype("<u2")
                has = keys != 0
                flat = pa.array([s.tobytes() if h else None for s, h in zip(sig, has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row_key"), pa.array(keys.view(np.int64), mask=~has), flat], schema=_SKETCH)

    return run


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _lanes(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2") for x in column.to_pylist()]) if len(column) else np.zeros((0, 1), np.uint16)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(_similar(_lanes(batch.column("sig_a")), _lanes(batch.column("sig_b"))) >= sure)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], schema=_LINK)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                elements, at, _ = shingles(part.column("text"), width)
                order = np.lexsort((elements, at))
                elements, at = elements[order], at[order]
                new = np.append(True, (elements[1:] != elements[:-1]) | (at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
                ends = np.searchsorted(at[new], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements[new].view(np.int64)))], ["node", "shingles"])

    return run


def exact(pairs: DataFrame, source: DataFrame, sketch: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those of ``pairs`` whose sets of shingles have a Jaccard similarity of ``threshold`` at least, counted in full.

    Texts are read again, and of each node in question one goes on; the others stay where they are read, but for the few that ``perhaps`` lets pass.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = cut(sketch.join(nodes, "node").groupBy("node").agg(F.min("row_key").alias("row_key")))
    # A row that is repeated goes to the join once from each task that reads it.
    once = perhaps(source, "row_key", rows, among=True).groupBy("row_key").agg(F.first("text").alias("text"))
    texts = once.join(rows, "row_key").select("node", "text")
    sets = cut(texts.mapInArrow(_sets(width), "node bigint, shingles array<bigint>"))
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


class UnionFind:
    """Sets of numbered members; the least member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


_MAYBE = pa.schema([*_LINK, ("sure", pa.bool_())])
#: About how many rows of a bucket are compared with each other in one group; a larger bucket is split.
BLOCK = 4096


def blocks(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows of buckets (``bucket``, ``node``, ``n``: the bucket's rows) in groups of about ``2 * most`` rows at most, so that any two of a bucket meet in one.

    A bucket is cut into blocks by its nodes, and a group holds one block, or two. ``pair`` names the group, ``side`` says which of two blocks a row is
    of, and is null where the group is one block.
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / most).cast("int"))
    held = rows.withColumn("__of", F.pmod(F.xxhash64("node"), count.cast("bigint")).cast("int")).withColumn("__with", F.explode(F.sequence(F.lit(0), count - 1)))
    low, high = F.least("__of", "__with"), F.greatest("__of", "__with")
    side = F.when(low != high, F.col("__of") == high)
    return held.withColumns({"pair": F.xxhash64("bucket", low, high), "side": side}).drop("__of", "__with", "n")


def _rest(sure: float, maybe: float):
    """Links, sure and possible, between what is still apart in a group of ``blocks``. Rows come sorted by ``pair``."""

    def of(nodes: np.ndarray, groups: np.ndarray, sig: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int, bool]]:
        sets = UnionFind()
        doubt = []
        for k in range(1, len(nodes)):
            other = groups[:k] != groups[k]
            if side is not None:
                other &= side[:k] != side[k]
            at = np.flatnonzero(other)
            alike = _similar(sig[at], sig[k])
            for h, likeness in zip(at[alike >= maybe].tolist(), alike[alike >= maybe].tolist(), strict=True):
                if likeness < sure:
                    doubt.append((h, k))
                elif sets.union(int(groups[h]), int(groups[k])):
                    yield int(nodes[h]), int(nodes[k]), True
        for h, k in doubt:
            if sets.find(int(groups[h])) != sets.find(int(groups[k])):
                yield int(nodes[h]), int(nodes[k]), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            side = None if t["side"].null_count else t["side"].to_numpy(zero_copy_only=False).astype(bool)
            links = list(of(t["node"].to_numpy(), t["grp"].to_numpy(), _lanes(t["sig"]), side))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], f.type) for k, f in enumerate(_MAYBE)], schema=_MAYBE)

        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            edges = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1).tolist(), len(pairs)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if held and held[0].column("pair")[0].as_py() != pairs[a]:
                        yield flush()
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as one star for each of its sets."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.union(a, b)
    rows = [(x, sets.find(x)) for x in list(sets.up)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (1, 0)], schema=_LINK)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of the links ``a``, ``b`` that is no root.

    Union-find makes stars of each partition's links; large-star and small-star steps join them until nothing changes. A node's least neighbour is
    aggregated before the shuffle and joined, so that a node with a third of all links isn't one task's.
    """
    links = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = cut(links.mapInArrow(_forest, "a bigint, b bigint").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        near = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = cut(both.where("b > a").join(near, "a").where("m != b").select(F.col("m").alias("a"), "b").distinct())
        low = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        small = low.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        now = cut(small)
        if (after := state(now)) == before:
            break
        before = after
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, size: int = SIZE, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``row_key``, ``grp``, ``group_id``, ``group_rows``.

    Two texts are near copies if the Jaccard similarity of their sets of ``shingle``-word runs, in lower case, composed (NFC) and without
    punctuation of any script, is at least ``threshold``; in scripts without spaces each character is a word. ``size`` SuperMinHash lanes estimate it (standard error 0.04 at 0.5, less for short texts); where
    the estimate is within ``MARGIN`` of the threshold, the sets themselves are compared. Texts that agree on ``rows`` lanes of a band are compared: in each bucket all with one of them, then, where
    a bucket still holds more than one group, every pair from different groups, in groups of about ``2 * block`` rows. Groups are the connected components.
    ``group_id`` is the least id of a group, ``group_rows`` its number of rows.

    Texts with the same words are one node from the start, however many they are. Null texts and those without words
    are copies of nothing: ``grp``, ``group_id`` are null, ``group_rows`` is 1. Repeated rows are rows of one group;
    with null ids only, its ``group_id`` is null. An empty table gives no rows. Other columns are left out.
    ``row_key`` is a hash of id and text.
    """
    source = plain(docs, id=id_col, text=text_col).withColumn("row_key", F.xxhash64("id", "text"))
    sketch = cut(source.mapInArrow(_sketch(shingle, size), "id bigint, row_key bigint, node bigint, sig binary"))
    nodes = cut(sketch.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(size // rows - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * rows) + 1, F.lit(2 * rows))))
    bucket = nodes.select("node", F.explode(bands).alias("bucket"))
    # Aggregated before the shuffle and joined, so that a bucket with a third of all nodes isn't one task's.
    full = bucket.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    shared = cut(bucket.join(full.select("bucket", "centre"), "bucket"))
    pairs = shared.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    # Most nodes share no bucket: their signatures stay where they are.
    some = perhaps(nodes, "node", shared.select("node"), among=True)
    sig_a, sig_b = (some.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    first = cut(pairs.join(sig_b, "b").join(sig_a, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_verify(threshold + MARGIN), "a bigint, b bigint"))
    roots = cut(components(first))
    grouped = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("grp"))
    mixed = grouped.groupBy("bucket").agg(F.min("grp").alias("x"), F.max("grp").alias("y"), F.count("*").alias("n")).where("x != y").select("bucket", "n")
    open_ = cut(grouped.join(mixed, "bucket").select("bucket", "node", "grp", "n"))
    rest = blocks(open_, block).join(perhaps(nodes, "node", open_.select("node"), among=True), "node").select("pair", "side", "node", "grp", "sig")
    ordered = rest.repartition("pair").sortWithinPartitions("pair", "node")
    more = cut(ordered.mapInArrow(_rest(threshold + MARGIN, threshold - MARGIN), "a bigint, b bigint, sure boolean"))
    sure = cut(components(first.union(more.where("sure").select("a", "b"))))
    # Of the pairs in doubt only those count that nothing surer has put together.
    top = lambda df, k: df.join(sure.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    doubt = top(top(more.where("NOT sure").select("a", "b").distinct(), "a"), "b").where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")
    checked = exact(cut(doubt), source, sketch, threshold, shingle)
    stars = sure.select(F.col("root").alias("a"), F.col("node").alias("b"))
    final = components(stars.union(checked))
    out = sketch.select("id", "row_key", "node").join(final, "node", "left").select("id", "row_key", F.coalesce("root", "node").alias("grp"))
    sizes = out.where("grp IS NOT NULL").groupBy("grp").agg(F.min("id").alias("group_id"), F.count("*").alias("group_rows"))
    return out.join(sizes, "grp", "left").select("id", "row_key", "grp", "group_id", F.coalesce("group_rows", F.lit(1)).alias("group_rows"))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id``, ``group_id`` and ``group_rows`` of every row that has near copies; see ``near_groups``."""
    found = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    return found.where("group_rows > 1").select(F.col("id").alias("doc_id"), "group_id", "group_rows")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least id (nulls last), then of the least hash.

    Rows that are copies of nothing all stay, null and empty texts among them. Of repeated rows of a group one stays, whichever
    columns they differ in. All columns stay.
    """
    found = cut(near_groups(docs, id_col=id_col, text_col=text_col, **how).where("group_rows > 1"))
    best = found.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("best"))
    keys = found.groupBy("grp", "row_key").agg(F.count("*").alias("n")).join(best, "grp")
    keys = cut(keys.select(F.col("row_key").alias("__key"), "n", (F.col("row_key") == F.col("best.row_key")).alias("__stays")))
    keyed = numbered(docs)
    keyed = keyed.withColumn("__key", F.xxhash64(F.col(f"c{place(docs, id_col)}").cast("bigint"), F.col(f"c{place(docs, text_col)}").cast("string")))
    gone = cut(keys.where("NOT __stays OR n > 1").select("__key").distinct())
    # Only rows that may go cross the shuffle; the rest stay where they are read.
    out = perhaps(keyed, "__key", gone, among=False).unionByName(perhaps(keyed, "__key", gone, among=True).join(gone, "__key", "left_anti"))
    repeated = keys.where("__stays AND n > 1").select("__key")
    if not repeated.isEmpty():
        out = out.unionByName(perhaps(keyed, "__key", repeated, among=True).dropDuplicates(["__key"]).join(repeated, "__key", "left_semi"))
    return out.drop("__key").toDF(*docs.columns)
