import numpy as np
import pytest

from wordloom.llm.audio import FILTERS, HOP, RATE, SILENCE, SPAN, STEPS, _boxes, align, bit_error, chroma, fingerprint, fingerprints, melodies, melody, recording_classes, recordings_alike

RNG = np.random.default_rng(4)


def song(seed, notes=64):
    return melody(np.random.default_rng(seed).normal(0, 0.25, notes))


def test_pitch_class_of_a_tone():
    for k, hz in ((0, 440), (3, 523.25), (0, 880), (7, 659.26)):
        image = chroma((10000 * np.sin(2 * np.pi * hz * np.arange(3 * RATE) / RATE)).astype("<i2"))
        assert (image.argmax(1) == k).all() and np.allclose(np.linalg.norm(image, axis=1), 1)


def test_integral_image_against_plain_sums():
    samples = song(1)
    image, got = chroma(samples), fingerprint(samples)
    assert len(got) == len(image) - SPAN + 1
    for t in (0, 7, len(got) - 1):
        want = 0
        for spec in FILTERS:
            a, b = (np.concatenate([image[t + s : t + e, p:q].ravel() for s, e, p, q in boxes]).mean() for boxes in _boxes(*spec))
            step = sum(np.log((1e-3 + a) / (1e-3 + b)) > s for s in STEPS)
            want = want << 2 | (0, 1, 3, 2)[step]
        assert got[t] == want
    for kind, low, height, width in FILTERS:
        assert low + height <= 12 and width <= SPAN and len(_boxes(kind, low, height, width)[0])


def slow_pairs(prints, most=0.15, least=20):
    """Every pair at every offset."""
    out = {}
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            need = min(least, len(prints[a]), len(prints[b]))
            found = [(e, o) for o in range(-len(prints[b]) + 1, len(prints[a])) for n, e in [bit_error(prints[a], prints[b], o)] if n >= max(need, 1) and e <= most]
            if found:
                out[a, b] = min(found)[1]
    return out


def test_noisy_and_shifted_copies_against_all_pairs(spark):
    """Copies with noise, cut at the front, or with something before; others are strangers."""
    rows, true = [], set()
    for k in range(25):
        s = song(k)
        rows.append((k, s))
        cut = s[int(RNG.integers(0, 2 * RATE)) :]
        rows.append((100 + k, cut + RNG.normal(0, 1500, len(cut))))
        late = np.concatenate([song(1000 + k, 16), s])
        rows.append((200 + k, late + RNG.normal(0, 300, len(late))))
        true |= {(k, 100 + k), (k, 200 + k)}
    prints = {k: fingerprint(np.clip(s, -32768, 32767).astype("<i2")) for k, s in rows}
    want = slow_pairs(prints)
    assert set(want) >= true and len(want) <= 75
    df = spark.createDataFrame([(k, bytearray(np.clip(s, -32768, 32767).astype("<i2").tobytes())) for k, s in rows], "rec_id long, audio binary")
    got = {(r.a, r.b): r for r in align(fingerprints(df)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert np.mean([abs(got[p].offset - want[p]) <= 1 for p in got]) > 0.95
    for (a, b), r in got.items():
        assert (r.overlap, pytest.approx(r.error)) == bit_error(prints[a], prints[b], r.offset)


def test_query_against_direct_computation(spark, sf_dir):
    from wordloom.llm.common import table
    from wordloom.llm.queries import op7_audio_fingerprints

    want = {r.vec_id: fingerprint(melody(r.embedding)).view(np.int32).tolist() for r in table(spark, sf_dir, "embeddings").collect()}
    rows = op7_audio_fingerprints(spark, sf_dir).collect()
    assert {r.rec_id: r.fingerprint for r in rows} == want and len(rows) == len(want)
    few = {r: np.array(want[r], np.int32).view(np.uint32) for r in sorted(want)[:60]}
    pairs = set(slow_pairs(few))
    assert {(r.rec_id, o) for r in rows for o in r.alike if r.rec_id < o and r.rec_id in few and o in few} <= pairs


def test_edge_cases(spark):
    s = bytearray(song(3).tobytes())
    long = bytearray(np.concatenate([song(3), *(song(50 + k) for k in range(40))]).tobytes())
    rows = [(1, s, 0), (1, s, 0), (2, None, 0), (3, bytearray(), 0), (None, s, 0), (4, s[:9001], 0), (5, bytearray(200000), 0), (6, long, 0), (7, s + bytearray(1), 0), (8, bytearray(200000), 0)]
    df = spark.createDataFrame(rows, "rec_id long, audio binary, value int")
    prints = fingerprints(df)
    got = {r.rec_id: r.fingerprint for r in prints.collect()}
    assert prints.count() == 10 and got[2] is None and got[3] == got[4] == [] and got[None] == got[1] == got[7] and set(got[5]) == {SILENCE}
    assert len(got[6]) == (len(long) // 2 - 4096) // HOP + 1 - 4 - SPAN + 1
    alike = [(r.rec_id, r.alike) for r in recordings_alike(prints).collect()]
    assert sorted(alike, key=str) == sorted([(1, [6, 7]), (1, [6, 7]), (2, []), (3, []), (None, []), (4, []), (5, []), (6, [1, 7]), (7, [1, 6]), (8, [])], key=str)
    assert recordings_alike(prints.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 1.0]), (3, [])], "vec_id long, embedding array<float>")
    assert {r.rec_id: r.audio and len(r.audio) for r in melodies(odd).collect()} == {1: None, 2: 2 * 2 * 1378, 3: bytearray()}


def test_long_repetitive_recordings_against_all_pairs(spark):
    """Recordings of a minute in which phrases recur, so that chance offsets have more votes than the true one, and op7's own against all offsets."""
    rng = np.random.default_rng(12)
    refrain = [rng.normal(0, 0.25, 24) for _ in range(6)]
    rows = []
    for k in range(12):
        verse = [rng.normal(0, 0.25, 40) for _ in range(6)]
        s = melody(np.concatenate([x for n in range(6) for x in (refrain[k % 3], verse[n], refrain[3 + k % 2])]))
        rows.append((k, s))
        part = s[int(rng.integers(20, 40)) * RATE :]
        rows.append((100 + k, part + rng.normal(0, 400, len(part))))
    prints = {k: fingerprint(np.clip(s, -32768, 32767).astype("<i2")) for k, s in rows}
    want = slow_pairs(prints)
    df = spark.createDataFrame([(k, p.view(np.int32).tolist()) for k, p in prints.items()], "rec_id long, fingerprint array<int>")
    got = {(r.a, r.b): r for r in align(df).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) >= 12
    assert np.mean([abs(got[p].offset - want[p]) <= 1 for p in got]) > 0.95


def test_outvoted_offset_is_tried(spark):
    """Two values in common at a wrong offset, one at the true one."""
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
    b = a[10:].copy()
    flips = rng.integers(0, 32, (len(b), 4))
    flips[7] = flips[7, 0]
    b ^= np.bitwise_or.reduce(np.uint32(1) << flips.astype(np.uint32), axis=1)
    b[7] = a[17]
    a[[2, 3]], b[[40, 41]] = (11, 12), (11, 12)
    df = spark.createDataFrame([(1, a.view(np.int32).tolist()), (2, b.view(np.int32).tolist())], "rec_id long, fingerprint array<int>")
    got = align(df).collect()
    n, e = bit_error(a, b, 10)
    assert [(r.a, r.b, r.offset, r.overlap) for r in got] == [(1, 2, 10, n)] and got[0].error == pytest.approx(e) and e > 0.1


def test_query_finds_all_pairs(spark, sf_dir, tmp_path):
    """op7's query over its vectors and noisy copies of some, against all pairs at all offsets."""
    from wordloom.llm.common import table
    from wordloom.llm.queries import op7_audio_fingerprints

    rng = np.random.default_rng(9)
    own = sorted(table(spark, sf_dir, "embeddings").collect(), key=lambda r: r.vec_id)[:60]
    first = [(r.vec_id, [float(x) for x in r.embedding]) for r in own]
    late = [(10**6 + k, [*rng.normal(0, 0.2, 8).tolist(), *(x + float(rng.normal(0, 0.004)) for x in v)]) for k, v in first[:30]]
    spark.createDataFrame(first + late, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = op7_audio_fingerprints(spark, str(tmp_path)).collect()
    want = set(slow_pairs({r.rec_id: np.array(r.fingerprint, np.int32).view(np.uint32) for r in rows}))
    got = {(r.rec_id, o) for r in rows for o in r.alike if r.rec_id < o}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 20


def test_classes_of_equal_recordings(spark):
    """Hundreds of copies are one class, aligned once; the rest as in ``recordings_alike``."""
    tone, other, quiet = fingerprint(song(3)).view(np.int32).tolist(), fingerprint(song(4)).view(np.int32).tolist(), [int(np.uint32(SILENCE).view(np.int32))] * 30
    near = list(tone)
    near[5] ^= 1
    rows = [(k, tone, 0) for k in range(10, 310)] + [(5, near, 0), (400, other, 0), (401, other, 0), (401, other, 0), (402, quiet, 0), (403, quiet, 0), (404, None, 0), (405, [], 0), (None, tone, 0)]
    prints = spark.createDataFrame(rows, "rec_id long, fingerprint array<int>, alike int").repartition(5)
    found = recording_classes(prints)
    assert found.columns == ["rec_id", "fingerprint", "class_id", "class_rows", "alike"]
    got = {(r.rec_id, r.class_id, r.class_rows, tuple(r.alike)) for r in found.collect()}
    assert got == {(k, 10, 300, (5,)) for k in range(10, 310)} | {(5, 5, 1, (10,)), (400, 400, 2, ()), (401, 400, 2, ())} | {(k, None, 0, ()) for k in (402, 403, 404, 405, None)}
    assert found.count() == len(rows) and recording_classes(prints.limit(0)).count() == 0


def test_an_hour_of_sound():
    """In blocks as at once, and with little memory beyond the samples."""
    import tracemalloc

    short = np.concatenate([song(k) for k in range(4)])
    n = (len(short) - 4096) // HOP + 1
    whole = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(short.astype(np.float32), 4096)[::HOP] * np.hamming(4096).astype(np.float32), axis=1)) ** 2
    hz = np.arange(2049) * RATE / 4096
    use = (hz >= 55) & (hz <= 3520)
    energy = np.stack([whole[:, use & (np.round(12 * np.log2(np.maximum(hz, 1) / 440)).astype(int) % 12 == k)].sum(1) for k in range(12)], 1)
    smooth = sum(w * energy[k : n - 4 + k] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    assert n > 256 / 4 and np.allclose(chroma(short), smooth / np.linalg.norm(smooth, axis=1, keepdims=True), atol=1e-4)
    hour = np.tile(short, 3600 * RATE // len(short) + 1)[: 3600 * RATE]
    tracemalloc.start()
    prints = fingerprint(hour)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(prints) == (len(hour) - 4096) // HOP + 1 - 4 - SPAN + 1 and peak < 100 << 20


def test_ties_between_offsets():
    """Of offsets with equal error the smallest counts."""
    import wordloom.llm.audio as audio

    a = np.tile(np.arange(1, 11, dtype=np.uint32), 4)
    assert audio._best(a, a[:20], np.array([20, 10, 0]), 20) == (0.0, 0, 20) and audio._best(a, a[:20], np.array([20, 10]), 20) == (0.0, 10, 20)
