"""Placeholders of nine notations as sorted arrays with repeats, and multiset differences of such arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: In this order; what one has matched is blank for the next.
PATTERNS = (
    r"\{\{[^}]+\}\}",
    r"\$t\([^)]+\)",
    r"%\{[^}]+\}",
    r"%\d+[$](?:@|[dfsx]|ll?[du])",
    r"%ll?[du]",
    r"%@",
    r"%[.]\d+f",
    r"%[sdfx]",
    r"\{[\w.]+\}",
)


def placeholders(x: str | Column) -> Column:
    """All placeholders of a string, sorted, each as often as it occurs; none for null.

    A match is blanked by as many spaces as it has characters before the next notation is searched, since the blanks can lie within a later match.
    """
    def step(held, number):
        # Each pattern is a literal in a branch of its own, so that it is compiled once.
        hits = F.lit(None).cast("array<string>")
        for k, pattern in reversed(list(enumerate(PATTERNS))):
            hits = F.when(number == k, F.regexp_extract_all(held["rest"], F.lit(pattern), F.lit(0))).otherwise(hits)

        def blanked(found):
            rest = F.aggregate(found, held["rest"], lambda text, hit: F.replace(text, hit, F.repeat(F.lit(" "), F.length(hit))))
            return F.struct(rest.alias("rest"), F.concat(held["found"], found).alias("found"))

        return F.transform(F.array(hits), blanked)[0]

    state = F.struct(F.coalesce(col(x), F.lit("")).alias("rest"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(F.array(*map(F.lit, range(len(PATTERNS)))), state, step, lambda held: F.array_sort(held["found"]))
    # Most strings hold none of the three characters that begin a placeholder.
    return F.when(col(x).rlike(r"[{$%]"), found).otherwise(F.array().cast("array<string>"))


def minus(a: str | Column, b: str | Column) -> Column:
    """What ``a`` has more often than ``b``, as often as it does; in order if ``a`` is."""
    a, b = col(a), col(b)
    surplus = lambda p: F.greatest(F.lit(0), F.size(F.filter(a, lambda q: q == p)) - F.size(F.filter(b, lambda q: q == p)))
    different = F.flatten(F.transform(F.array_distinct(a), lambda p: F.array_repeat(p, surplus(p))))
    return F.when(a == b, F.array().cast("array<string>")).otherwise(different)


def preserved(source: str | Column, target: str | Column) -> Column:
    """``ok``, ``missing`` and ``added`` of a translation's placeholders."""
    s, t = placeholders(source), placeholders(target)
    missing, added = minus(s, t), minus(t, s)
    return F.struct(((F.size(missing) == 0) & (F.size(added) == 0)).alias("ok"), missing.alias("missing"), added.alias("added"))
