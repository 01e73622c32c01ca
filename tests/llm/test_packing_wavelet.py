import collections
import random

import numpy as np
import pytest

from wordloom.llm.packing import Bins, pack
from wordloom.llm.tokens import END_ID, PATTERN, TOKENIZER, decode, encode, encoder
from wordloom.llm.wavelet import WaveletMatrix, build, document_tokens, searched, token_counts, token_occurrences, token_shards

TEXTS = ["One two three.", "", None, "É" * 40, "tie one", "tie one", "a  b\n\n c ", "word " * 3000]


def slow_best_fit(sizes, capacity, most):
    """Looks at every open bin for each piece."""
    bins, closed, stamp = [], [], 0
    for k, size in enumerate(sizes):
        stamp += 1
        if size >= capacity:
            closed.append([k])
            continue
        fit = min((b for b in bins if b[0] >= size), key=lambda b: (b[0], b[1]), default=None)
        if fit is None:
            if len(bins) == most:
                full = min(bins, key=lambda b: (b[0], b[1]))
                bins.remove(full)
                closed.append(full[2])
            fit = [capacity, stamp, []]
            bins.append(fit)
        fit[0] -= size
        fit[1] = stamp
        fit[2].append(k)
        if fit[0] == 0:
            bins.remove(fit)
            closed.append(fit[2])
    return closed + [b[2] for b in sorted(bins, key=lambda b: (b[0], b[1]))]


@pytest.mark.parametrize("most", [1, 3, 16])
def test_bins_against_brute_force(most):
    rng = random.Random(most)
    sizes = [rng.choice([1, 5, 17, 40, 64, rng.randint(1, 64)]) for _ in range(3000)]
    done = []
    bins = Bins(64, most, done.append)
    for k, size in enumerate(sizes):
        bins.add(size, k)
    bins.finish()
    assert done == slow_best_fit(sizes, 64, most)
    assert sorted(k for b in done for k in b) == list(range(len(sizes)))


def test_bad_capacity():
    with pytest.raises(ValueError):
        Bins(0, 1, print)


def test_pack_holds_every_token(spark):
    docs = spark.createDataFrame([(k if k != 4 else None, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, bin_id string, tokens int").coalesce(1)
    rows = sorted(pack(docs, capacity=512, open_bins=2).collect(), key=lambda r: r.bin_id)
    got = collections.defaultdict(dict)
    for r in rows:
        assert r.n_tokens == sum(r.lengths) <= 512 and len(r.tokens) == 2 * r.n_tokens
        ids, at = np.frombuffer(r.tokens, "<u2"), 0
        for doc, piece, n in zip(r.doc_ids, r.pieces, r.lengths):
            got[doc][piece] = ids[at : at + n]
            at += n
    for k, t in enumerate(TEXTS):
        key = k if k != 4 else None
        if t:
            assert [*np.concatenate([got[key][p] for p in sorted(got[key])])] == [*encode(t), END_ID]
        else:
            assert key not in got
    want = slow_best_fit([n for t in TEXTS if t for n in [512] * ((len(encode(t)) + 1) // 512) + [(len(encode(t)) + 1) % 512] if n], 512, 2)
    assert [len(b) for b in want] == [len(r.pieces) for r in rows]


def test_pack_query_matches_brute_force(spark, sf_dir):
    from wordloom.llm.queries import op2_best_fit_packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = collections.Counter({r.doc_id: len(encode(r.text)) + 1 for r in docs.collect() if r.text})
    got = collections.Counter()
    for r in op2_best_fit_packing(spark, sf_dir).collect():
        assert r.n_tokens <= 2048
        for d, n in zip(r.doc_ids, r.lengths):
            got[d] += n
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs).count() == 0 and token_shards(docs).count() == 0


def test_split_pattern_is_the_vocabularys_own():
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder(TOKENIZER)._mergeable_ranks, special_tokens={})
    assert own._pat_str != PATTERN
    for t in [*TEXTS, "it's 12\t\tx!!  \n  y ", "日本語 テキスト", "  ", "\n", "a   "]:
        if t:
            assert own.encode_ordinary(t) == list(encode(t)) and decode(encode(t)) == t


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_against_lists(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 4, n), rng.integers(0, 65536, n))
    m = WaveletMatrix(build(ids))
    assert len(m) == n and m.access(np.arange(n)).tolist() == ids.tolist()
    for t in {0, 1, 2, 3, 65535, *ids[:5].tolist()}:
        where = np.flatnonzero(ids == t)
        assert m.count(t) == len(where) and m.occurrences(t).tolist() == where.tolist()
        for stop in (0, n // 3, n):
            assert m.rank(t, stop) == (where < stop).sum()
    assert m.count(70000) == 0
    with pytest.raises(IndexError):
        m.access([n])
    with pytest.raises(IndexError):
        m.select(3, [n])


def test_shards_round_trip(spark):
    docs = spark.createDataFrame([(k if k != 4 else None, t, b"x") for k, t in enumerate(TEXTS)], "doc_id long, text string, payload binary").coalesce(1)
    shards = token_shards(docs, shard_tokens=50).cache()
    assert shards.count() > 1
    got = collections.Counter((r.doc_id, tuple(r.tokens)) for r in document_tokens(shards).collect())
    assert got == collections.Counter((k if k != 4 else None, tuple(encode(t))) for k, t in enumerate(TEXTS))
    token = encode(" one")[0]
    want = [(k if k != 4 else None, p) for k, t in enumerate(TEXTS) for p, x in enumerate(encode(t)) if x == token]
    assert sorted(map(tuple, token_occurrences(shards, token).collect()), key=str) == sorted(want, key=str) != []
    assert {r.token_id: r.n for r in token_counts(shards, [token, 50000]).collect()} == {token: len(want), 50000: 0}
    with pytest.raises(ValueError):
        WaveletMatrix(b"something else")


def test_shard_query_round_trip(spark, sf_dir):
    from wordloom.llm.queries import op6_wavelet_tokens

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.tokens for r in document_tokens(op6_wavelet_tokens(spark, sf_dir)).collect()}
    assert got.keys() == texts.keys() and all(decode(got[d]) == t for d, t in texts.items())


@pytest.mark.parametrize("top", [1, 2, 1 << 16, 1 << 17, 1 << 32])
def test_wavelet_of_other_vocabularies(top):
    """As many planes as the highest id has bits; select against lists, over blocks of all ones, all zeros and both."""
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.integers(0, top, 3000), np.full(1100, top - 1), np.zeros(1100, np.int64), rng.integers(0, top, 50)])
    m = WaveletMatrix(build(ids))
    assert m.levels == (top - 1).bit_length() and m.access(np.arange(len(ids))).tolist() == ids.tolist()
    for t in {0, top - 1, *ids[:9].tolist()}:
        where = np.flatnonzero(ids == t)
        assert m.occurrences(t).tolist() == where.tolist() and m.count(t, 100, 4000) == ((where >= 100) & (where < 4000)).sum()
    assert m.count(top * 2) == 0 and m.count(-1) == 0
    with pytest.raises(IndexError):
        m.select(top * 2, [0])


def test_larger_vocabulary(spark, tmp_path):
    """Ids of more than 16 bits take four bytes, in sequences and in shards."""
    import base64

    ranks = {bytes([b]): 70_000 + b for b in range(256)} | {b"ab": 70_300}
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string").coalesce(1)
    assert encode("abc", str(path)).tolist() == [70_300, 70_099]
    row = pack(docs, tokenizer=str(path), end_id=None).first()
    assert np.frombuffer(row.tokens, "<u4").tolist() == [70_300, 70_099] and row.n_tokens == 2
    shards = token_shards(docs, tokenizer=str(path))
    assert [(r.doc_id, r.tokens) for r in document_tokens(shards).collect()] == [(1, [70_300, 70_099]), (2, [])]
    assert {r.token_id: r.n for r in token_counts(shards, [70_300, 5]).collect()} == {70_300: 1, 5: 0}


def test_search_query_against_lists(spark, sf_dir):
    """What op6 reads back from its files, against the tokens of the texts."""
    from wordloom.llm.queries import op6_wavelet_tokens

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    total = 0
    for r in op6_wavelet_tokens(spark, sf_dir).collect():
        ids = np.concatenate([np.frombuffer(encode(texts[d]), "<u2") for d in r.doc_ids])
        want = [(t, np.flatnonzero(ids == t).tolist()) for t in range(0, END_ID, 100)]
        assert [(f.token_id, f.positions) for f in r.found] == [(t, p) for t, p in want if p]
        total += len(r.found)
    assert total > 10


def test_search_edge_cases(spark):
    empty = build(np.zeros(0, np.int64))
    rows = [(1, bytearray(empty)), (2, None), (3, bytearray(build(np.array([5, 0, 5])))), (3, bytearray(build(np.array([5, 0, 5]))))]
    shards = spark.createDataFrame(rows, "found_in long, payload binary")
    got = sorted((r.found_in, r.found and [tuple(f) for f in r.found]) for r in searched(shards, [5, 0, 9, 5, 70_000]).collect())
    assert got == [(1, []), (2, None), (3, [(0, [1]), (5, [0, 2])]), (3, [(0, [1]), (5, [0, 2])])]
    assert searched(shards.limit(0), [1]).count() == 0


def test_pack_query_bins_against_search(spark, sf_dir):
    """Which pieces share a sequence, at the query's own capacity and number of bins: a search over all open bins for each piece."""
    from wordloom.llm.queries import op2_best_fit_packing

    by_part = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("spark_partition_id() AS p", "doc_id", "text").collect():
        n = len(encode(r.text)) + 1 if r.text else 0
        by_part[r.p] += [(r.doc_id, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    want = {p << 33 | k: [pieces[i] for i in held] for p, pieces in by_part.items() for k, held in enumerate(slow_best_fit([n for _, _, n in pieces], 2048, 64))}
    assert {r.bin_id: list(zip(r.doc_ids, r.pieces, r.lengths)) for r in op2_best_fit_packing(spark, sf_dir).collect()} == want
