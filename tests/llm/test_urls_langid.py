import math
import pickle
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import langid
from wordloom.llm.common import table
from wordloom.llm.urlfilter import RULES, Filters, filter_urls, parse, sql, token_frequency


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab1.*^|/-", min_size=1, max_size=8), max_size=5), st.text("ab1./-", max_size=14))
def test_index_misses_no_rule(rules, rest):
    url = "http://" + rest
    f = Filters(rules, Counter({"a": 3, "b": 1}))
    hits = [p for k, r in enumerate(rules) if re.search((p := parse(k, r)).regex, url, re.DOTALL)]
    best = min(hits, key=lambda p: (not p.passes, p.number), default=None)
    assert f.decide(url) == ((("pass" if best.passes else "block"), best.text) if best else (None, None))


def test_rule_syntax():
    f = Filters(["||bad.com^", "@@||good.bad.com^", "/ads/*", "|http://x", "end|"])
    say = {u: f.decide(u)[0] for u in ("http://bad.com", "https://a.bad.com/x", "http://notbad.com", "http://bad.com.org", "http://good.bad.com/", "http://q.org/ADS/1", "http://xy", "http://q.org/end", "http://q.org/ends", "", None)}
    assert [say[u] for u in say] == ["block", "block", None, None, "pass", "block", "block", "block", None, None, None]


def test_only_candidates_run():
    f = Filters([f"/rule{k}/" for k in range(500)])
    assert f.decide("http://a.org/rule7/")[0] == "block" and f.decide("http://a.org/x/y")[0] is None and f.tried == 1


def test_rarest_token_stands_for_a_rule(spark):
    urls = spark.createDataFrame([("http://common.org/rare/",), ("http://common.org/x/",), (None,)], "url string")
    n = token_frequency(urls, ["||common.org/rare/"])
    assert n == {"common": 2, "org": 2, "rare": 1}
    assert list(Filters(["||common.org/rare/"], n).by_token) == ["rare"]


def test_query_against_sql(spark, sf_dir):
    from wordloom.llm.queries import op3_url_filters, oracle_sql

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = Counter(con.sql(oracle_sql()["op3_url_filters"]).fetchall())
    assert Counter(tuple(r) for r in op3_url_filters(spark, sf_dir).collect()) == want
    assert len({w[2] for w in want}) > 1


def test_url_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "http://spam-farm.example.org/x", 1), (3, "http://a.org/" + "b/" * 50_000 + "x.exe", 1), (3, "http://a.org/q.zip\n", 1), (4, "http://a.org/sessionid=1", 1), (4, "http://a.org/sessionid=1", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, action int")
    got = filter_urls(pages)
    assert got.columns == ["page_id", "url", "action", "rule"]
    assert sorted([(r.page_id, r.action) for r in got.collect()], key=str) == sorted([(1, None), (2, None), (None, "block"), (3, "block"), (3, "block"), (4, "block"), (4, "block")], key=str)
    assert filter_urls(pages.limit(0)).count() == 0 and filter_urls(pages, []).where("action IS NULL").count() == 7
    assert sql("t", ["it's"]).count("it''s") == 2 and len(RULES) == len(set(RULES))


def test_word_first_backoff():
    """Scores against a plain reading of the rule."""
    words = {"the": np.log([0.9, 0.1])}
    grams = {" sch": np.log([0.1, 0.9]), "ch": np.log([0.4, 0.6]), "z": np.log([0.2, 0.8])}
    table = lambda d: langid.Frequencies(list(d), np.array(list(d.values())))
    m = pickle.loads(pickle.dumps(langid.Model(["de", "en"], table(words), table(grams), 4)))
    assert (m.word("the") == words["the"]).all()
    assert np.allclose(m.word("schach"), grams[" sch"])  # a longer n-gram is known, so the shorter don't count
    assert np.allclose(m.word("ich"), grams["ch"]) and np.allclose(m.word("zz"), grams["z"]) and not m.word("oo").any()
    assert m.identify("the the Zz")[0] == "de" and m.identify("12 --") == (None, 0.0) and m.identify("oo") == (None, 0.0)


def test_frequencies():
    f = langid.frequencies(pa.table({"key": ["x", "x", "y"], "lang": ["a", "b", "b"], "n": [3, 1, 4]}), ["a", "b"])
    assert f.place == {"x": 0, "y": 1} and np.allclose(np.exp(f.table), [[3 / 3.5, 1 / 5], [0.5 / 3.5, 4 / 5]])


def test_language_accuracy_held_out(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert len(rows) > 400 and np.mean([r.language == r.lang for r in rows]) > 0.97


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "", None, 1), (None, "und der", None, 1), (5, "123 !!", "", 1), (6, "the dog " * 60_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    model = langid.fit(docs)
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "language", "lead"]
    assert sorted([(r.doc_id, r.language) for r in got.collect()], key=str) == sorted([(1, "en"), (2, "de"), (2, "de"), (3, None), (4, None), (None, "de"), (5, None), (6, "en")], key=str)
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs, langid.fit(docs.limit(0))).where("language IS NULL").count() == 8
    tie = langid.Model(["a", "b"], langid.Frequencies(["x"], np.log([[0.5, 0.5]])), langid.Frequencies([], np.zeros((0, 2))), 3)
    assert tie.identify("x") == ("a", 0.0)
    assert len(langid.fit(docs, max_words=2, max_grams=3).words.place) == 2


def test_language_query_has_every_row(spark, sf_dir):
    from wordloom.llm.queries import op9_language_id

    rows = op9_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect())


def slow_languages(rows, longest=5):
    """The rule read plainly: counts of words and n-grams by language, each word looked up, then ever shorter n-grams of it."""
    word_of = re.compile(r"[^\W\d_]+")
    counts: dict = {}
    for _, text, lang in rows:
        if lang and text:
            for w in word_of.findall(text.lower()):
                counts.setdefault(lang, (Counter(), Counter()))[0][w] += 1
    for words, grams in counts.values():
        for w, k in words.items():
            for n in range(1, longest + 1):
                for i in range(len(w) + 2 - n + 1):
                    grams[f" {w} "[i : i + n]] += k
    langs = sorted(counts)
    tables = []
    for kind in (0, 1):
        keys = set().union(*(counts[lang][kind] for lang in langs))
        total = [sum(counts[lang][kind].values()) + 0.5 * len(keys - counts[lang][kind].keys()) for lang in langs]
        tables.append({k: np.array([math.log((counts[lang][kind][k] or 0.5) / t) for lang, t in zip(langs, total)]) for k in keys})

    def score(w):
        if w in tables[0]:
            return tables[0][w]
        for n in range(longest, 0, -1):
            if found := [tables[1][g] for i in range(len(w) + 2 - n + 1) if (g := f" {w} "[i : i + n]) in tables[1]]:
                return np.mean(found, 0)
        return np.zeros(len(langs))

    def decide(text):
        found = word_of.findall((text or "").lower())
        s = np.mean([score(w) for w in found], 0) if found else np.zeros(len(langs))
        if not s.any():
            return None, 0.0
        return langs[int(s.argmax())], float(s.max() - max(np.delete(s, int(s.argmax())), default=s.max()))

    return decide


def test_language_query_against_the_rule(spark, sf_dir):
    from wordloom.llm.queries import op9_language_id

    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()]
    decide = slow_languages(rows)
    got = {r.doc_id: (r.language, r.lead) for r in op9_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        language, lead = decide(text)
        assert got[d][0] == language and abs(got[d][1] - lead) < 1e-9


def test_unseen_words_against_the_rule(spark, sf_dir):
    """Fitted on half of the rows, so that words of the other half back off, in scripts of one to four bytes a letter."""
    extra = [(-1, "日本語のテキスト です", "ja"), (-2, "日本の語", None), (-3, "привет мир", "ru"), (-4, "приветы 𐐨𐐩 x", None), (-5, "𐐨𐐩𐐪 𐐨", "dsrt"), (-6, "𐐨𐐩𐐫", None)]
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()] + extra
    seen = [(d, t, lang if d % 2 == 0 or d < 0 else None) for d, t, lang in rows]
    docs = spark.createDataFrame(seen, "doc_id long, text string, lang string").repartition(5)
    decide = slow_languages(seen)
    got = {r.doc_id: (r.language, r.lead) for r in langid.identify(docs, langid.fit(docs)).collect()}
    for d, text, _ in rows:
        language, lead = decide(text)
        assert got[d][0] == language and abs(got[d][1] - lead) < 1e-9


def test_no_word_is_cut(spark, sf_dir):
    """The model holds every word and n-gram of the sampled rows, and a language of few rows is in it whole."""
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**9 + k, f"szó nyelv {k}", "hu") for k in range(3)], docs.schema)
    model = langid.fit(docs.unionByName(rare), max_rows=1_000_000)
    words = {w for r in docs.union(rare).select("text").collect() for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())}
    assert len(words) > 150_000 and model.words.keys.to_pylist() == sorted(words, key=str.encode)
    assert len(model.grams.keys) == len({g for w in words for n in range(1, 6) for i in range(len(w) + 3 - n) for g in [f" {w} "[i : i + n]]})
    few = langid.fit(docs.unionByName(rare), max_rows=400)
    assert "hu" in few.languages and {"szó", "nyelv"} <= few.words.place.keys() and len(few.words.place) < 60_000
