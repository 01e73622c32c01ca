import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm.common import table
from wordloom.llm.decontaminate import Passages, contaminations, drop_contaminated, normalise


def slow(text, items, window=13, least=5):
    """Compares every run of words with every run of each item."""
    spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text or "")]
    words, out = [w for _, _, w in spans], set()
    for item, body in items:
        want = [m.group().lower() for m in re.finditer(r"[^\W_]+", body or "")]
        n = min(window, len(want))
        if len(want) < least:
            continue
        hits = {(i, k) for i in range(len(words) - n + 1) for k in range(len(want) - n + 1) if words[i : i + n] == want[k : k + n]}
        for i, k in hits:
            if (i - 1, k - 1) not in hits:
                m = 0
                while (i + m + 1, k + m + 1) in hits:
                    m += 1
                out.add((item, spans[i][0], spans[i + m + n - 1][1], n + m))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=9), max_size=4), st.sampled_from([" ", ", ", "\n"]))
def test_against_brute_force(text, items, gap):
    items = [(k, " ".join(x)) for k, x in enumerate(items)]
    assert sorted(set(Passages(items, 4, 2).find(gap.join(text)))) == slow(gap.join(text), items, 4, 2)


def test_offsets_map_to_the_original():
    text = "  ¡Él—DIJO:\tqué No!  "
    flat, places = normalise(text)
    assert flat == " él dijo que no "
    assert [text[p] for p in places[1:-1]] == [*"Él", "—", *"DIJO", ":", *"que", " ", *"No"]
    assert Passages([(1, "dijo que no")], 13, 2).find(text) == [(1, text.index("D"), text.index("!"), 3)]
    assert normalise("")[0].strip() == ""


def test_query_against_brute_force(spark, sf_dir):
    from wordloom.llm.queries import op5_benchmark_decontamination

    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = table(spark, sf_dir, "documents").collect()
    grams = {tuple(w[k : k + 5]) for _, t in items for w in [normalise(t)[0].split()] for k in range(len(w) - 4)}
    want = set()
    for d in docs:
        w = normalise(d.text)[0].split()
        if any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)):
            want |= {(d.doc_id, *hit) for hit in slow(d.text, items)}
    got = [tuple(r) for r in op5_benchmark_decontamination(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_edge_cases(spark):
    rng = random.Random(1)
    question = " ".join(f"q{rng.randrange(90)}" for _ in range(30))
    bench = spark.createDataFrame([(1, question, 0), (2, None, 0), (3, "", 0), (4, "yes", 0), (5, "five words make an answer", 0), (None, "another one with enough words", 0), (6, "five words make an answer", 0)], "item_id long, text string, doc_id int")
    part = " ".join(question.split()[4:20])
    far = "long " * 100_000
    rows = [(1, f"x {part.upper()} y", 1), (1, f"x {part.upper()} y", 1), (2, None, 1), (3, "", 1), (None, "Five words, make an ANSWER.", 1), (5, "yes. another one with enough words", 1), (6, far + question, 1), (7, " ".join(question.split()[:12]), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((tuple(r) for r in contaminations(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 2, 2 + len(part), 16)] * 2 + [(None, k, 0, 26, 5) for k in (5, 6)] + [(6, 1, len(far), len(far) + len(question), 30)], key=str)
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 7]
    assert contaminations(docs.limit(0), bench).count() == 0 and contaminations(docs, bench.limit(0)).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == 8


def test_composed_against_decomposed(spark):
    """Passages in either form, with ligatures and wide letters, and in scripts without spaces; places are those of the original."""
    item = "l'été dernier à Málaga, où l'air était très doux, für alle schönen Gäste — ﬁn du café"
    texts = [unicodedata.normalize(f, item) for f in ("NFC", "NFD", "NFKC", "NFKD")] + ["".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in item)]
    words = re.findall(r"[^\W_]+", item)
    for x in texts:
        for y in texts:
            search = Passages([(1, x)], 13, 5)
            [(k, start, end, n)] = search.find(f"é. {y}! é")
            # A combining mark at the very end is not of the passage.
            assert (k, start, end) == (1, 3, 3 + len(y) - bool(unicodedata.combining(y[-1]))) and n == len(words) and search.touches(y)
    chinese, thai = "这个问题的答案是什么请你回答", "ประเทศไทยมีเมืองหลวงชื่ออะไร"
    items = [(1, chinese), (2, thai), (3, "十六夜")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"他说：{chinese}。好"), (2, f"ก่อน {thai} หลัง"), (3, "这个问题的答案不同"), (4, None), (5, unicodedata.normalize("NFD", "ガイド"))], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in contaminations(docs, bench).collect())
    assert got == [(1, 1, 3, 3 + len(chinese)), (2, 2, 5, 5 + len(thai))]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [3, 4, 5]


def test_short_items_are_searched_for(spark):
    """Every item with ``least=1``, on word boundaries; the number of words tells them apart. Items that share an id stay apart."""
    bench = spark.createDataFrame([(1, "Paris"), (2, "這個"), (3, "is the capital"), (4, "..."), (5, "one two three"), (5, "two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Paris is the capital; comparison, PARIS"), (2, "「這個」"), (3, "one two three four"), (4, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in contaminations(docs, bench, least=1).collect())
    assert got == [(1, 1, 0, 5, 1), (1, 1, 34, 39, 1), (1, 3, 6, 20, 3), (2, 2, 1, 3, 2), (3, 5, 0, 13, 3), (3, 5, 4, 18, 3)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, least=3).collect()) == [2, 4]


def test_runs_of_items_with_one_id_do_not_join(spark):
    a, b = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    mixed = " ".join([*a[:13], *b[1:14]])
    bench = spark.createDataFrame([(7, " ".join(a)), (7, " ".join(b))], "item_id long, text string")
    docs = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert sorted(r.words for r in contaminations(docs, bench).collect()) == [13, 13]


def test_too_large_a_benchmark_is_refused(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for most in (2, 20):
        with pytest.raises(ValueError):
            contaminations(docs, bench, max_patterns=most)
