import gzip
import random

import duckdb
import pytest

from wordloom.llm.warc import DAMAGE, TORN, VERSION, Bytes, read_files, read_pages, read_payloads, salvage, write_pages, write_record


def record(k, compress=True, body=None):
    return write_record({"WARC-Type": "resource", "WARC-Target-URI": f"http://a.org/{k}"}, body if body is not None else f"body {k} ".encode() * (k + 1), compress=compress)


def spans(data, **how):
    return [(f.offset, f.length, f.reason is None) for f in salvage(Bytes(data), **how)]


def slow(data):
    """Tries a whole record at every single byte."""
    out, at, gap = [], 0, None
    while at < len(data):
        end = None
        if data[at:].startswith((b"\x1f\x8b\x08", VERSION)):
            got = next(iter(salvage(Bytes(data[at:]))), None)
            if got and got.reason is None and got.offset == 0:
                end = at + got.length
        if end is None:
            gap = at if gap is None else gap
            at += 1
        else:
            if gap is not None:
                out.append((gap, at - gap, False))
            gap = None
            out.append((at, end - at, True))
            at = end
    return out + ([(gap, at - gap, False)] if gap is not None else [])


@pytest.mark.parametrize("seed", range(25))
def test_damage_against_brute_force(seed):
    rng = random.Random(seed)
    parts = [record(k, rng.random() < 0.6) for k in range(8)]
    data = bytearray(b"".join(parts))
    for _ in range(rng.randint(0, 4)):
        kind, at = rng.randrange(4), rng.randrange(len(data))
        if kind == 0:
            data[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del data[at : at + rng.randrange(60)]
        elif kind == 2:
            data[at:at] = rng.randbytes(30) + rng.choice((b"", b"\nWARC/1.0\r\n", b"\x1f\x8b\x08", TORN))
        else:
            del data[max(at, len(data) - 40) :]
    got = spans(bytes(data))
    assert got == slow(bytes(data))
    assert sum(n for _, n, _ in got) == len(data) and [a for a, _, _ in got] == [sum(n for _, n, _ in got[:k]) for k in range(len(got))]


def test_one_bad_record_costs_only_itself():
    parts = [record(k) for k in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    found = list(salvage(Bytes(b"".join([*parts[:2], bytes(broken), *parts[3:]]))))
    assert [f.headers.get("warc-target-uri") for f in found] == [f"http://a.org/{k}" if k != 2 else None for k in range(5)]
    assert found[2].reason and found[2].length == len(broken) and found[1].body == b"body 1 body 1 "


def test_checks():
    good = record(3, False)
    assert [x[2] for x in spans(good)] == [True]
    for bad in (good.replace(b"body 3", b"body 4", 1), good.replace(b"Content-Length: 28", b"Content-Length: 27"), good[:-1], good.replace(b"Content-Length", b"Content Length"), good.replace(b"WARC/1.1", b"WARC/9.1"), gzip.compress(b"no record"), gzip.compress(b""), good.replace(b"Content-Length: 28", b"Content-Length: -8")):
        assert [x[2] for x in spans(bad)] == [False] and sum(x[1] for x in spans(bad)) == len(bad)
    assert [x[2] for x in spans(gzip.compress(good + record(4, False)))] == [True, True]
    assert spans(b"") == [] and [x[2] for x in spans(good, max_record=5)] == [False]


def test_long_record_and_far_resync():
    """Bodies and damage longer than a read."""
    body = bytes(random.Random(1).randbytes(3 << 20))
    data = record(0, True, body) + b"\x00" * (2_500_000) + record(1, False, body) + b"junk"
    assert [(x[1], x[2]) for x in spans(data)][1] == (2_500_000, False) and [x[2] for x in spans(data)] == [True, False, True, False]


def test_query_against_sql(spark, sf_dir):
    from wordloom.llm.queries import op4_warc_salvage, oracle_sql

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rows = op4_warc_salvage(spark, sf_dir)
    want = con.sql(oracle_sql()["op4_warc_salvage"])
    assert rows.columns == want.columns
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {r.kind for r in rows.select("kind").distinct().collect()} == {"record", "gap"}


def test_edge_cases(spark, tmp_path):
    rows = [(1, "http://a.org/é", "<p>é</p>", "x"), (1, "http://a.org/é", "<p>é</p>", "x"), (None, None, None, "x"), (3, "", "", "x"), (4, " a\nb\r\nWARC/1.0\r\n", "WARC/1.0\r\n\r\n" * 3, "x"), (-5, "u" * 9000, "long " * 500_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, source string").coalesce(1)
    shards = write_pages(pages, shard_bytes=100, torn=lambda k: k == 3)
    back = read_pages(read_payloads(shards))
    want = sorted([("record", *r[:3], None) for r in rows] + [("gap", None, None, None, 64)], key=str)
    assert sorted(map(tuple, back.collect()), key=str) == want
    for s in shards.collect():
        (tmp_path / s.source).write_bytes(s.payload)
    (tmp_path / "none.warc.gz").write_bytes(b"")
    files = read_files(spark, [f"file://{tmp_path}/*.warc.gz"])
    assert sorted(map(tuple, read_pages(files).collect()), key=str) == want
    assert files.where("kind = 'gap'").first().reason == "bad gzip member"
    assert write_pages(pages.limit(0)).count() == 0 and read_payloads(shards.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, bytearray(record(1))), ("n", None), ("e", bytearray())], "source string, payload binary")
    assert [(r.source, r.uri) for r in read_payloads(odd).collect()] == [(None, "http://a.org/1")]


def uris(data, **how):
    found = list(salvage(Bytes(data), **how))
    assert [f.offset for f in found] == [sum(f.length for f in found[:k]) for k in range(len(found))] and sum(f.length for f in found) == len(data)
    return [f.headers["warc-target-uri"].rsplit("/", 1)[1] if f.reason is None else None for f in found]


def test_one_member_for_all_records():
    """Damage inside a member costs the records that it touches; a torn end, what comes after it."""
    rng = random.Random(5)
    parts = [record(k, False, rng.randbytes(rng.choice((9, 3000, 200_000)))) for k in range(30)]
    names = [str(k) for k in range(30)]
    whole = gzip.compress(b"".join(parts), 1)
    assert uris(whole) == names and uris(record(97) + whole + record(98, False)) == ["97", *names, "98"]
    bad = bytearray(parts[11])
    bad[-6] ^= 1
    some = gzip.compress(b"".join([b"junk", *parts[:11], bytes(bad), *parts[12:]]))
    assert uris(some + record(99)) == [None, *names[:11], None, *names[12:], "99"]
    for stop in (len(whole) // 3, len(whole) - 4, len(whole) - 9):
        got = uris(whole[:stop] + record(99))
        assert got[-2:] == [None, "99"] and got[:-2] == names[: len(got) - 2] and len(got) > 5
        assert [k for k in uris(whole[:stop]) if k] == got[:-2]  # no byte may be left for a gap
    flat = bytearray(whole)
    flat[len(flat) // 2] ^= 0x55
    got = [k for k in uris(bytes(flat)) if k]
    assert got == [k for k in names if k in got] and len(got) > 8
    plain = b"".join(p.replace(b"WARC-Block-Digest", b"X-Digest") for p in parts)
    assert uris(gzip.compress(plain)) == names
    wrong = bytearray(gzip.compress(plain))
    wrong[-6] ^= 1
    assert uris(bytes(wrong)) == [None]


def test_no_cap_on_size():
    """Members and plain records that inflate to more than 256 MB."""
    big = [record(k, False, bytes(64 << 20)) for k in range(5)]
    assert uris(gzip.compress(b"".join(big), 1)) == ["0", "1", "2", "3", "4"]
    assert uris(record(97, False, bytes(257 << 20)) + record(98)) == ["97", "98"]


def test_damage_of_every_kind():
    """Each kind is a gap of its own length, before, between and after sound records, in the file and inside a member."""
    assert len(DAMAGE) == len(set(DAMAGE)) == 9
    for bad in DAMAGE:
        for parts in ([bad, record(1)], [record(1), bad, record(2)], [record(1, False), bad, record(2, False)], [record(1), bad]):
            got = spans(b"".join(parts))
            assert [(n, ok) for _, n, ok in got] == [(len(p), p is not bad) for p in parts]
    inner = [record(k, False) for k in range(5)]
    for bad in DAMAGE:
        assert [u for u in uris(gzip.compress(b"".join([*inner[:3], bad, *inner[3:]]))) if u] == [str(k) for k in range(5)]


def test_versions_and_long_headers():
    old = record(3, False).replace(b"WARC/1.1", b"WARC/0.18")
    assert [x[2] for x in spans(old)] == [True] and [x[2] for x in spans(gzip.compress(old))] == [True]
    many = write_record({"WARC-Target-URI": "http://a.org/7", **{f"X-{k}": "v" * 200 for k in range(2000)}}, b"x", compress=False)
    one = write_record({"WARC-Target-URI": "http://a.org/8", "X": "v" * 300_000}, b"x", compress=False)
    assert uris(many + record(1) + one + gzip.compress(many + one)) == ["7", "1", "8", "7", "8"]
    assert [x[2] for x in spans(b"WARC/1.0\r\n" * 3000 + record(1))] == [False, True]


def test_odd_paths(spark, tmp_path):
    folder = tmp_path / "a b#c%20d"
    folder.mkdir()
    for name in ("x y.warc", "x#y.warc", "x%41y.warc", "é+&.warc"):
        (folder / name).write_bytes(record(1))
    assert sorted(r.uri for r in read_files(spark, [str(folder)]).collect()) == ["http://a.org/1"] * 4
