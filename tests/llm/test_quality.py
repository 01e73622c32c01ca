import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from wordloom.llm.common import table
from wordloom.llm.quality import STATISTICS, fit, isotonic, keep_good, score, statistics


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    n, good = rng.integers(1, 9, 40).astype(float), np.zeros(40)
    good[:] = [rng.integers(0, k + 1) for k in n]
    got = isotonic(n, good)
    assert (np.diff(got) >= -1e-12).all()
    # the minimax formula: the largest over starts of the least mean over ends
    want = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    assert np.allclose(got, want)


def test_statistics_of_known_texts():
    x = statistics(pa.array(["Ab ab ab\nzz 12", "", None, "É É!! x|y", "a b\n\na b\nc"]))
    s = [dict(zip(STATISTICS, row)) for row in x]
    assert not x[1].any() and not x[2].any()
    assert s[0]["log_words"] == np.log1p(5) and s[0]["distinct_words"] == 3 / 5 and s[0]["top_word"] == 3 / 5 and s[0]["repeated_pairs"] == 2 / 5 and s[0]["digits"] == 2 / 14
    assert s[3]["bars"] == 1 / 11 and s[3]["exclamations"] == 2 / 11
    assert s[4]["repeated_lines"] == 1 / 4
    both = statistics(pa.array(["Other text.", "Ab ab ab\nzz 12"]))
    assert np.allclose(both[1], x[0])


def test_held_out_accuracy(spark, sf_dir):
    """Fit on even ids; the odd ones were never seen."""
    docs, labels = table(spark, sf_dir.replace("0.001", "0.01"), "documents"), table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    rows = score(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    right = [r.keep == (r.quality == 1) for r in rows_of(rows)]
    assert len(right) > 100 and np.mean(right) > 0.95
    kept_good = [r.keep for r in rows_of(rows) if r.quality == 1]
    assert np.mean(kept_good) > 0.98


def rows_of(rows):
    from collections import namedtuple

    row = namedtuple("row", "keep quality")
    return [row(r[2], r[3]) for r in rows]


def test_normal_equations_against_numpy(spark):
    """The partition sums give the ridge weights that one matrix gives."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "fine", "word", "more"], 30)) if k % 2 else "!!! " * int(rng.integers(5, 40)) for k in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    m = fit(docs, labels, waves=16)
    fold = {r.doc_id: r.f for r in labels.selectExpr("doc_id", "CAST(pmod(xxhash64(7, doc_id), 4) AS INT) AS f").collect()}
    train = np.array([fold[k] != 0 for k in range(200)])
    z = m.features(statistics(pa.array(texts)))[train]
    want = np.linalg.solve(z.T @ z + 1e-3 * 200 / 16 * np.eye(17), z.T @ (np.arange(200) % 2)[train])
    assert np.allclose(m.weights, want)


def test_edge_cases(spark):
    long = "fine words here and there again " * 40000
    rows = [(1, "fine words here", 9), (1, "fine words here", 9), (2, None, 9), (3, "", 9), (None, "!!!! !!!! !!!!", 9), (5, long, 9), (6, "!!! $$$ !!!", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (5, 1), (None, 1), (2, None), (77, 0)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = score(docs, model)
    assert got.columns == ["doc_id", "quality", "keep"] and got.count() == 7
    by = {(r.doc_id): r for r in got.collect()}
    assert by[2].quality == by[3].quality == 0 and not by[2].keep and by[1].keep and not by[6].keep
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 5]
    assert score(docs.limit(0), model).count() == 0 and keep_good(docs.limit(0), model).count() == 0
    nothing = score(docs, fit(docs, labels.limit(0)))
    assert sorted(r.quality for r in nothing.collect()) == [0, 0, 1, 1, 1, 1, 1]
    assert keep_good(docs, fit(docs, labels.where("quality = 0"))).count() == 0 and fit(docs.limit(0), labels).chances.tolist() == [1.0]


def test_bounded_sample(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, max_rows=60)
    assert np.isfinite(model.weights).all()


def test_query_scores_every_row(spark, sf_dir):
    from wordloom.llm.queries import op8_quality_classifier

    rows = op8_quality_classifier(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect())
    assert all(0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5) for r in rows)


def test_rows_do_not_depend_on_neighbours():
    """Letters whose lower case has another length, beside a text or in it."""
    texts = ["I'm here, I, A. (NASA)\n--\n--\nsame line!\nSame line?\n", "NASA and ESA\nNASA and ESA", None, "", "é NATO"]
    alone = np.concatenate([statistics(pa.array([t], pa.string())) for t in texts])
    by = dict(zip(STATISTICS, alone[0]))
    assert by["repeated_lines"] == 1 / 6 and by["caps_words"] == 1 / by_words(texts[0])
    for odd in ("\u0130", "\u1e9e", "\u2126", "\u212b", "\u023a", "\u0130 \u023a", "\u023a \u2126"):
        for beside in ([odd, *texts], [*texts, odd], [odd, *texts, f"A{odd}B CD\nA{odd}B CD"]):
            rows = statistics(pa.array(beside))
            at = beside.index(texts[0])
            assert np.array_equal(rows[at : at + len(texts)], alone)
        assert dict(zip(STATISTICS, rows[-1]))["repeated_lines"] == 1 / 2


def by_words(text):
    import re

    return len(re.findall(r"\w+", text))


def slow_statistics(text):
    """The definitions read plainly, for text whose scripts put spaces between words."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    words = re.findall(r"\w+", text.lower())
    own = re.findall(r"\w+", text)
    sizes = [len(w.encode()) for w in words]
    m, s = max(len(words), 1), len(data)
    upper = sum(65 <= b <= 90 for b in data)
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data)
    digits = sum(48 <= b <= 57 for b in data)
    spaces = sum(b == 32 or 9 <= b <= 13 for b in data)
    plain = sum(chr(b) in ".,;:'\"!?-()|" for b in data)
    lines = [tuple(re.findall(r"\w+", x.lower())) for x in text.split("\n")]
    filled = [x for x in lines if x]
    n_lines = len(lines)
    shout = sum(len(w.encode()) > 1 and all("A" <= c <= "Z" for c in w[:2]) and len(w) > 1 for w in own)
    return [
        math.log1p(s), math.log1p(len(words)), sum(sizes) / m / 8, sum(n > 15 for n in sizes) / m, len(set(words)) / m, max(Counter(words).values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        upper / max(letters, 1), digits / s, (s - letters - digits - spaces - plain) / s, data.count(b"!") / s, data.count(b"|") / s, spaces / s, sum(b >= 128 for b in data) / s, sum(b in b".?" for b in data) / m,
        (len(filled) - len(set(filled))) / n_lines, math.log1p(s / n_lines), shout / m,
    ]


def test_query_against_one_matrix(spark, sf_dir):
    """op8's query over all rows, against the whole method in one process: plain statistics, one matrix, one calibration."""
    from wordloom.llm.queries import op8_quality_classifier

    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    x = {d: np.array(slow_statistics(t)) for d, t in docs.items()}
    assert np.allclose(statistics(pa.array(list(docs.values()))), np.stack(list(x.values())))
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality", "CAST(pmod(xxhash64(7, doc_id), 4) AS INT) AS fold").dropna().collect()
    held = [(x[r.doc_id], float(r.quality), r.fold) for r in labels if r.doc_id in x]
    data, y, fold = np.stack([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])
    mean, scale = data.mean(0), np.sqrt(np.maximum(data.var(0), 1e-6))
    rng = np.random.default_rng(7)
    waves, shift = rng.normal(0, np.sqrt(2 * 0.05), (len(STATISTICS), 256)), rng.uniform(0, 2 * np.pi, 256)
    features = lambda v: np.append(np.cos(np.clip((v - mean) / scale, -8, 8) @ waves + shift) * np.sqrt(2 / 256), 1)
    z = np.stack([features(v) for v in data])
    train = fold != 0
    weights = np.linalg.solve(z[train].T @ z[train] + 1e-3 * len(y) / 256 * np.eye(257), z[train].T @ y[train])
    bins = ((np.clip(z @ weights, -0.5, 1.5) + 0.5) / 2 * 999).astype(int)
    use = ~train if 0 < y[~train].sum() < (~train).sum() else np.ones(len(y), bool)
    at = np.unique(bins[use])
    n, good = np.array([(bins[use] == b).sum() for b in at], float), np.array([y[use][bins[use] == b].sum() for b in at])
    chances = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    want = {d: np.interp(features(v) @ weights, at / 999 * 2 - 0.5, chances) if docs[d] else 0.0 for d, v in x.items()}
    rows = op8_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == len(want) and all(abs(r.quality - want[r.doc_id]) < 1e-6 for r in rows)
    assert len({r.keep for r in rows}) == 2 and all(r.keep == (want[r.doc_id] >= 0.5) for r in rows if abs(want[r.doc_id] - 0.5) > 1e-6)


def test_equal_texts_in_any_slice(spark):
    """Equal texts have equal scores, bit for bit, in whatever batch and beside whatever letters they are read."""
    odd = ["\u0130stanbul", "\u212a elvin \u212a", "\u023a\u0130", "", None]
    text = "I'm here. NASA says so.\nSame line\nsame line\n"
    rows = [(k, text if k % 3 == 0 else odd[k % 5], 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(7)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 300, 2)], "doc_id long, quality int")
    got = [r.quality for r in score(docs, fit(docs, labels)).collect() if r.doc_id % 3 == 0]
    assert len(got) == 100 and len(set(got)) == 1

