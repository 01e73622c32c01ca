"""URL filters: pattern rules found by their rarest literal token, and only then run as regular expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

_TOKEN = re.compile(r"[a-z0-9]+")
#: ``||`` a host or its parent, ``|`` an end, ``^`` a separator or the end, ``*`` anything; ``@@`` lets a URL pass whatever else matches.
RULES = (
    "||spam-farm.example.org^", "||cheap-pills.example.com^", "||cheap-pills.example.net^", "||casino-*.example.net^", "||ads-track.example.com^", "||free-bets.*^", "||adult-*.example.com^", "/adserver/", "/banner/*/click^", "&affiliate_id=",
    "?utm_source=feed|", "?utm_medium=*&utm_campaign=", "/wp-login.php", "/login?next=", "/cart/checkout^", "||blog.*/de/6*.html|", "-replica-watches-", "/tag/page/", "sessionid=", "/calendar/*/print|", ".exe|", ".zip|",
    "|ftp://", "||m.*.example.net^*#top|", "@@||spam-farm.example.org/en/1", "@@/about/", "?page=2&ref=x|", "/xx-adult-content^", "/fr/9*.html|", "_ad_frame^", "/print/*?view=print", "||therti.example.org/en^",
)


class Rule(NamedTuple):
    number: int
    text: str
    passes: bool
    regex: str
    tokens: tuple[str, ...]


def parse(number: int, text: str) -> Rule:
    """A rule's regular expression, and the tokens that every URL it matches holds whole.

    A run of letters and digits is such a token only if neither end of it is next to a ``*`` or to an open end of the pattern.
    """
    passes, body = text.startswith("@@"), text.removeprefix("@@").lower()
    head = tail = ""
    if body.startswith("||"):
        head, body, begins = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", body[2:], True
    elif body.startswith("|"):
        head, body, begins = "^", body[1:], True
    else:
        begins = False
    if ends := body.endswith("|"):
        tail, body = "$", body[:-1]
    regex = head + "".join(".*" if c == "*" else r"([^a-z0-9_.%\-]|$)" if c == "^" else re.escape(c) for c in body) + tail
    tokens = []
    for m in _TOKEN.finditer(body):
        left = begins if m.start() == 0 else body[m.start() - 1] != "*"
        right = ends if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m.group())
    return Rule(number, text, passes, regex, tuple(dict.fromkeys(tokens)))


class Filters:
    """Rules by token. A URL's own tokens fetch the rules that can match it; rules without a token are always tried."""

    def __init__(self, rules: Iterable[str], frequency: Counter[str] | None = None) -> None:
        self.rules = [parse(k, t) for k, t in enumerate(rules) if t]
        seen = frequency or Counter()
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for rule in self.rules:
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (seen[t], -len(t), t)), []).append(rule)
            else:
                self.always.append(rule)
        self._compiled: dict[int, re.Pattern] = {}
        self.tried = 0

    def __getstate__(self):
        return self.__dict__ | {"_compiled": {}}

    def decide(self, url: str | None) -> tuple[str | None, str | None]:
        """``block`` or ``pass`` and the rule that says so; two nulls where none matches. Passing rules come first, then the order given."""
        if not url:
            return None, None
        low = url.lower()
        rules = [r for t in set(_TOKEN.findall(low)) for r in self.by_token.get(t, ())] + self.always
        for rule in sorted(rules, key=lambda r: (not r.passes, r.number)):
            if rule.number not in self._compiled:
                self._compiled[rule.number] = re.compile(rule.regex, re.DOTALL)
            self.tried += 1
            if self._compiled[rule.number].search(low):
                return ("pass" if rule.passes else "block"), rule.text
        return None, None


def token_frequency(urls: DataFrame, rules: Iterable[str], *, url_col: str = "url") -> Counter[str]:
    """How many times each token of the rules occurs in all URLs; as many counts as the rules have tokens."""
    wanted = sorted({t for k, text in enumerate(rules) if text for t in parse(k, text).tokens})
    held = plain(urls, url=url_col)
    tokens = held.select(F.explode(F.regexp_extract_all(F.lower(F.col("url").cast("string")), F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    return Counter({r.t: r["count"] for r in tokens.where(F.col("t").isin(wanted)).groupBy("t").count().collect()})


def _decider(filters: Filters) -> Callable:
    @F.arrow_udf("action string, rule string")
    def decide(url: pa.Array) -> pa.Array:
        found = [filters.decide(u) for u in url.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["action", "rule"])

    return decide


def filter_urls(pages: DataFrame, rules: Iterable[str] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``action`` and ``rule`` of every row. Letters are compared in lower case.

    Which token stands for a rule follows counts over all the URLs. Only the URL is read, twice, and nothing but the counts of the
    rules' tokens is shuffled. The rules go to every task; they are a file's worth.

    Null and empty URLs have a null action, as do those that no rule matches. Null ids stay. Repeated rows have equal results. An
    empty table gives no rows, and without rules nothing matches. Other columns are left out.
    """
    rules = list(rules)
    decide = _decider(Filters(rules, token_frequency(pages, rules, url_col=url_col)))
    held = plain(pages, id=id_col, url=url_col).withColumn("found", decide(F.col("url").cast("string")))
    return held.select(F.col("id").alias("page_id"), "url", "found.action", "found.rule")


def sql(table: str = "pages", rules: Iterable[str] = RULES) -> str:
    """The same for DuckDB, with every rule tried on every URL."""
    parsed = [parse(k, t) for k, t in enumerate(rules) if t]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({r.number}, {quote(r.text)}, {r.passes}, {quote(r.regex)})" for r in parsed)
    return f"""WITH rules(number, rule, passes, regex) AS (VALUES {values}),
ids AS (SELECT row_number() OVER () AS row_id, page_id, url FROM {table}),
hits AS (SELECT row_id, rule, passes, row_number() OVER (PARTITION BY row_id ORDER BY NOT passes, number) AS k
         FROM ids JOIN rules ON regexp_matches(lower(url), regex, 's'))
SELECT page_id, url, CASE WHEN hits.row_id IS NULL THEN NULL WHEN passes THEN 'pass' ELSE 'block' END AS action, rule
FROM ids LEFT JOIN hits ON ids.row_id = hits.row_id AND k = 1"""
