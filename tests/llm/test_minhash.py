import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm.minhash import _STEP, UnionFind, blocks, components, duplicates, keep_one, near_groups, shingles, signatures
from wordloom.llm.words import mix, split


def slow_signature(elements, size):
    """The algorithm as published, element by element."""
    sig = [None] * size
    for e in elements:
        p = list(range(size))
        for j in range(size):
            with np.errstate(over="ignore"):
                x = int(mix(np.array([e], np.uint64) + np.uint64(j + 1) * _STEP)[0])
            k = j + (((x >> 32) * (size - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            v = (j, min(x & 0xFFFFFFFF, 0xFFFFFFFE))
            sig[p[j]] = min(sig[p[j]] or v, v)
    return mix(np.array([s[1] for s in sig], np.uint64)).astype(np.uint16)


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_steps_together_equal_element_by_element(n):
    rng = np.random.default_rng(n)
    e = rng.integers(1, 1 << 62, n).astype(np.uint64)
    both = signatures(np.concatenate([e, e[:1]]), np.array([0] * n + [2]), 3, 16)
    assert (both[0] == slow_signature(e, 16)).all() and (both[2] == slow_signature(e[:1], 16)).all()


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    errors = []
    for share in (100, 200, 250, 290):
        b = np.concatenate([a[:share], rng.integers(1, 1 << 62, 300 - share).astype(np.uint64)])
        s = signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
        errors.append((s[0] == s[1]).mean() - share / (600 - share))
    assert max(map(abs, errors)) < 0.12


def test_words():
    w = split(pa.array(["Hello, World", "", None, "naïve x1_y.", "..", " lead"]))
    assert [(t, bytes(w.data[s : s + n]).decode()) for t, s, n in zip(w.text, w.start, w.length)] == [(0, "hello"), (0, "world"), (3, "naïve"), (3, "x1_y"), (5, "lead")]
    one, two = (split(pa.array([t])).hashes.tolist() for t in ("a bc", "A! bc"))
    assert one == two and len(set(one)) == 2
    assert len(split(pa.array([], pa.string())).hashes) == 0
    assert shingles(pa.array(["a b", "a b c d"]))[1].tolist() == [0, 1, 1]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1200)]
    sets = UnionFind()
    for a, b in links:
        sets.union(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(got.get(x, x) == sets.find(x) for x in {x for link in links for x in link})


def shingle_set(text):
    w = split(pa.array([text])).hashes.tolist()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_query_against_all_pairs(spark, sf_dir):
    from wordloom.llm.queries import op1_minhash_near_dedup

    docs = {r.doc_id: shingle_set(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.group_id for r in op1_minhash_near_dedup(spark, sf_dir).collect()}
    ids = sorted(docs)
    pairs = [(a, b, jaccard(docs[a], docs[b])) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    true = [(a, b) for a, b, j in pairs if j >= 0.5]
    found = [got.get(a) is not None and got.get(a) == got.get(b) for a, b in true]
    assert len(true) > 10 and sum(found) >= 0.9 * len(found)
    sets = UnionFind()
    for a, b, j in pairs:
        if j >= 0.35:
            sets.union(a, b)
    assert all(sets.find(a) == sets.find(g) for a, g in got.items())
    assert all(n > 1 for n in collections.Counter(got.values()).values())


WORDS = [f"w{k}" for k in range(4000)]


def test_edges_cases(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    long = " ".join(rng.choice(WORDS) for _ in range(60000))
    rows = [
        (5, " ".join(base), "a", 1), (3, " ".join(near), "b", 2), (9, " ".join(base).upper() + "!", "c", 3),
        (20, None, "d", 4), (21, "", "e", 5), (22, "", "e", 5), (23, " .. ", "f", 6),
        (30, "ok", "g", 7), (30, "ok", "g", 8), (31, "tie", "g", 8), (32, "tie", "g", 8),
        (None, "no id here at all", "h", 9), (None, "no id here at all", "h", 9), (40, long, "i", 1), (41, long + " more", "i", 1), (50, "alone with these words", "j", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, grp int").repartition(3)
    got = {(r.doc_id, r.group_id, r.group_rows) for r in duplicates(docs).collect()}
    assert got == {(5, 3, 3), (3, 3, 3), (9, 3, 3), (30, 30, 2), (31, 31, 2), (32, 31, 2), (None, None, 2), (40, 40, 2), (41, 40, 2)}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 20, 21, 22, 23, 30, 31, None, 40, 50], key=str)
    empty = docs.limit(0)
    assert duplicates(empty).count() == 0 and keep_one(empty).count() == 0
    assert near_groups(docs.where("doc_id IN (20, 21)")).select("group_rows").distinct().collect()[0][0] == 1


def test_big_group_and_shared_passage(spark):
    """Hundreds of near copies form one group; documents that share a passage do not."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(200)]
    copies = []
    for k in range(400):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(200)] = f"x{rng.random()}"
        copies.append((k, " ".join(w)))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    sharing = [(1000 + k, passage + " " + " ".join(rng.choice(WORDS) for _ in range(150))) for k in range(100)]
    got = {r.doc_id: r.group_id for r in duplicates(spark.createDataFrame(copies + sharing, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(400)}


def test_pairs_near_the_threshold_are_counted(spark):
    """Similarities just above and just below one half, where signatures can't tell."""
    rows, want = [], set()
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(122)]  # 120 shingles
        change = 41 if k % 2 else 39
        near = base[: 122 - change] + [f"d{k}x{i}" for i in range(change)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        j = jaccard(shingle_set(rows[-2][1]), shingle_set(rows[-1][1]))
        assert (j >= 0.5) == (k % 2 == 0) and abs(j - 0.5) < 0.03
        if j >= 0.5:
            want |= {2 * k, 2 * k + 1}
    got = {r.doc_id for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.8 * len(want)


def test_recall_just_above_the_threshold(spark):
    """Many pairs a little above one half: nine in ten at least share a bucket and are found, and none below is."""
    rows, want = [], set()
    for k in range(300):
        base = [f"d{k}w{i}" for i in range(152)]  # 150 shingles
        change = 49 if k % 3 else 52
        near = base[: 152 - change] + [f"d{k}x{i}" for i in range(change)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        j = jaccard(shingle_set(rows[-2][1]), shingle_set(rows[-1][1]))
        assert (0.5 <= j < 0.51) == bool(k % 3) and j > 0.47
        if j >= 0.5:
            want |= {2 * k, 2 * k + 1}
    got = {r.doc_id for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_other_scripts_and_forms(spark):
    """Punctuation of any script doesn't matter, nor does the form of letters; where no spaces are, each character is a word."""
    import unicodedata

    rng = random.Random(4)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))
    plain = "he said hello there to the élan of the café and then he went “home” again, naïve as ever"
    rows = [(1, plain), (2, plain.replace("hello there", "“hello there”").replace("and then", "— and… then")), (3, unicodedata.normalize("NFD", plain)), (4, han), (5, han[:40] + "，" + han[40:] + "。"), (6, han[:70] + "变化十个字"), (7, han[::-1])]
    assert len({shingles(pa.array([t]))[2][0] for d, t in rows if d <= 3}) == 1
    got = {r.doc_id: r.group_id for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_word_kinds_and_lower_case():
    """Lower case neither parts nor joins words: the quality statistics and langid rely on it."""
    import pyarrow.compute as pc

    from wordloom.llm.words import letter_kinds, word_kinds

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low = pc.utf8_lower(pa.array([chr(c) for c in points])).to_pylist()
    for kinds in (word_kinds(), letter_kinds()):
        assert all(len(x) == 1 and kinds[c] == kinds[ord(x)] for c, x in zip(points, low))


def test_perhaps_and_surely_not(spark):
    """With few classes and with many: no key is missed, and each row is in one of the two parts."""
    from wordloom.llm.common import perhaps

    df = spark.range(2000).selectExpr("id", "xxhash64(id) AS key")
    keys = df.where("id % 50 = 3").select("key").union(df.where("id = 3").select("key"))
    want = {r.key for r in keys.collect()}
    for marks in (1, 7, 1 << 22):
        yes, no = ({r.key for r in perhaps(df, "key", keys, among=x, marks=marks).collect()} for x in (True, False))
        assert want <= yes and not yes & no and len(yes) + len(no) == 2000
    assert len(yes) < 60 and perhaps(df, "key", keys.limit(0), among=False).count() == 2000


def test_repeated_and_dropped_rows_stay_in_place(spark):
    """``keep_one`` over repeated rows, dropped ones and lone ones at once: each group leaves one, whatever its rows are."""
    rows = [(k % 7, f"group {k % 7} has these words in it") for k in range(70)] + [(100 + k, f"row {k} stands alone w{k} x{k} y{k}") for k in range(50)] + [(100 + k, f"row {k} stands alone w{k} x{k} y{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(7), *range(100, 150)]


def test_blocks_bring_any_two_together(spark):
    """Whatever the size of a bucket: every two of its rows share a group in which they may be compared, once, and groups are small."""
    rows = [(b, 1000 * b + k * k, n) for b, n in ((1, 1), (2, 7), (3, 40)) for k in range(n)]
    held = blocks(spark.createDataFrame(rows, "bucket long, node long, n long"), 5).collect()
    groups = collections.defaultdict(list)
    for r in held:
        groups[r.pair].append((r.node, r.side))
    met = collections.Counter(frozenset((a, b)) for g in groups.values() for k, (a, s) in enumerate(g) for b, t in g[:k] if s is None or s != t)
    want = {frozenset((a, b)) for x, a, _ in rows for y, b, _ in rows if x == y and a != b}
    assert set(met) == want and set(met.values()) == {1} and max(map(len, groups.values())) < 30


def test_split_buckets_give_the_same_groups(spark):
    """Documents with a long passage in common, in groups of near copies: as many groups with blocks of three rows as of thousands."""
    rng = random.Random(6)
    passage = " ".join(rng.choice(WORDS) for _ in range(110))
    rows = []
    for g in range(12):
        own = [rng.choice(WORDS) for _ in range(90)]
        for k in range(5):
            w = list(own)
            w[rng.randrange(90)] = f"x{g}y{k}"
            rows.append((10 * g + k, passage + " " + " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {d: shingle_set(t) for d, t in rows}
    true = UnionFind()
    for a, x in sets.items():
        for b, y in sets.items():
            if jaccard(x, y) >= 0.5:
                true.union(a, b)
    for block in (3, 4096):
        got = {r.doc_id: r.group_id for r in duplicates(docs, block=block).collect()}
        assert got == {d: true.find(d) for d, _ in rows}
