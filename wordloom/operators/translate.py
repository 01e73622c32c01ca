"""Incremental translation, regional fallback, change detection and skips, on tables of entries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.placeholders import minus, placeholders
from ..functions.text import base_language, skip_regex
from .checks import in_each

KEY = ["lang", "ns", "path"]


def partition_work(source: DataFrame, existing: DataFrame | None, langs: DataFrame) -> DataFrame:
    """Every source entry in every language with what to do: ``pass`` (no text), ``reuse`` (not null and not empty, of any type) or ``translate``.

    Keys only in ``existing`` are dropped; a changed source is not noticed here, but by ``changed_keys`` and locks.
    """
    s = in_each(source.select("ns", "path", "value", "vtype"), langs.select("lang"))
    if existing is None:
        held = s.withColumns({"old": F.lit(None).cast("string"), "old_type": F.lit(None).cast("string")})
    else:
        held = s.join(existing.select(*KEY, F.col("value").alias("old"), F.col("vtype").alias("old_type")).hint("merge"), KEY, "left")
    usable = F.col("old").isNotNull() & ~((F.col("old_type") == "string") & (F.col("old") == ""))
    action = F.when(F.col("vtype") != "string", "pass").when(usable, "reuse").otherwise("translate")
    return held.select(*KEY, "value", "vtype", action.alias("action"), F.when(action == "pass", F.col("value")).when(action == "reuse", F.col("old")).alias("result"))


def parse_strings(text: str | None, n: int) -> list[str]:
    """A JSON array of ``n`` strings from an answer that may have prose around it."""
    held = None
    for part in (text or "", (text or "")[(text or "").find("[") : (text or "").rfind("]") + 1]):
        try:
            held = json.loads(part)
            break
        except ValueError:
            continue
    if not isinstance(held, list) or len(held) != n:
        raise ValueError(f"the translator's answer is no array of {n} strings")
    return [str(x) for x in held]


def by_prompt(complete: Callable[[str], str], source_lang: str = "en") -> Callable[[list[str], str], list[str]]:
    """A translator made of a function that answers a prompt: it is asked for a JSON array, and once more if its answer is none."""

    def translator(texts: list[str], lang: str) -> list[str]:
        question = f"Translate these {len(texts)} texts from {source_lang} into {lang}. Keep placeholders as they are. Answer with a JSON array of {len(texts)} strings only.\n{json.dumps(texts, ensure_ascii=False)}"
        try:
            return parse_strings(complete(question), len(texts))
        except ValueError:
            return parse_strings(complete(question + "\nThe last answer was no such array. Answer with the array alone."), len(texts))

    return translator


def translate(work: DataFrame, translator: Callable[[list[str], str], list[str]], *, batch: int = 40, isolate: bool = False) -> DataFrame:
    """``work`` with ``result`` filled where the action is translate: ``translator(texts, lang)`` gives as many texts, in order.

    Only rows to translate reach Python, in batches of ``batch`` of one language. With ``isolate`` a batch that fails has null
    results, for a fallback to fill, and the others go on.
    """
    names = [f.name for f in work.schema.fields]
    types = ", ".join(f"`{n}` {t}" for n, t in work.dtypes)
    lang_at, value_at, result_at = map(names.index, ("lang", "value", "result"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def ask(lang: str, rows: list[tuple]) -> list[tuple]:
            try:
                out = translator([r[value_at] for r in rows], lang)
                if len(out) != len(rows):
                    raise ValueError("the translator gave another number of texts")
            except Exception:
                if not isolate:
                    raise
                out = [None] * len(rows)
            return [(*r[:result_at], t, *r[result_at + 1 :]) for r, t in zip(rows, out, strict=True)]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

        for b in batches:
            done: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = held.setdefault(r[lang_at], [])
                rows.append(r)
                if len(rows) == batch:
                    done += ask(r[lang_at], held.pop(r[lang_at]))
            if done:
                yield made(done)
        for lang, rows in held.items():
            yield made(ask(lang, rows))

    return work.where("action != 'translate'").unionByName(work.where("action = 'translate'").mapInArrow(run, types))


def drift(done: DataFrame) -> DataFrame:
    """New translations that lost or gained placeholders."""
    s, t = placeholders("value"), placeholders("result")
    held = done.where("action = 'translate'").select(*KEY, minus(s, t).alias("missing"), minus(t, s).alias("added"))
    return held.where("size(missing) > 0 OR size(added) > 0")


def translation_stats(done: DataFrame) -> DataFrame:
    """Per language: translated, reused, passed, and new translations with placeholder drift."""
    n = done.groupBy("lang").agg(*(F.count_if(F.col("action") == a).alias(b) for a, b in (("translate", "translated"), ("reuse", "reused"), ("pass", "passed"))))
    w = drift(done).groupBy("lang").agg(F.count("*").alias("placeholder_warnings"))
    return n.join(w, "lang", "left").na.fill(0, ["placeholder_warnings"])


def regional_targets(langs: DataFrame, on: bool = True) -> DataFrame:
    """Requested languages (pos, lang) with the base of each regional one put before the first such, unless it was requested itself.

    ``base`` is the base language of a regional one, ``added`` says that it wasn't requested. Repeats go.
    """
    each = langs.groupBy("lang").agg(F.min("pos").alias("pos"))
    if not on:
        return each.select("lang", F.lit(None).cast("string").alias("base"), F.lit(False).alias("added"), F.col("pos").cast("double").alias("place"))
    regional = F.col("lang").contains("-")
    own = each.select("lang", F.when(regional, base_language("lang")).alias("base"), F.lit(False).alias("added"), F.col("pos").cast("double").alias("place"))
    bases = own.where("base IS NOT NULL").groupBy(F.col("base").alias("lang")).agg((F.min("place") - 0.5).alias("place"))
    new = bases.join(each.select("lang"), "lang", "left_anti").select("lang", F.lit(None).cast("string").alias("base"), F.lit(True).alias("added"), "place")
    return own.unionByName(new)


def missing_keys(source: DataFrame, target: DataFrame, langs: DataFrame) -> DataFrame:
    """Leaves of the source without a translation that is neither null nor empty, each under its topmost missing ancestor (``top``).

    Children of an array aren't looked at one by one: ``list.0`` is missing only if the whole list is.
    """
    usable = target.where("value IS NOT NULL AND NOT (vtype = 'string' AND value = '')")
    parts = lambda p: F.split(p, r"\.")
    first_number = lambda p: F.array_position(F.transform(parts(p), lambda x: x.rlike(r"\A[0-9]+\z")), F.lit(True))
    unit = lambda p: F.when(first_number(p) > 1, F.array_join(F.slice(parts(p), F.lit(1), first_number(p).cast("int") - 1), ".")).otherwise(p)
    prefixes = lambda p: F.transform(F.sequence(F.lit(1), F.size(parts(p))), lambda k: F.array_join(F.slice(parts(p), F.lit(1), k), "."))
    want = in_each(source.select("ns", unit(F.col("path")).alias("path")).distinct(), langs.select("lang"))
    have = usable.select("lang", "ns", F.explode(prefixes(F.col("path"))).alias("path")).distinct().hint("merge")
    lost = want.join(have, KEY, "left_anti")
    above = lost.select(*KEY, F.posexplode(prefixes(F.col("path"))).alias("depth", "prefix"))
    gone = above.join(have.withColumnRenamed("path", "prefix").hint("merge"), ["lang", "ns", "prefix"], "left_anti")
    return gone.groupBy(*KEY).agg(F.min_by("prefix", "depth").alias("top"))


def fill_from_fallbacks(source: DataFrame, target: DataFrame, targets: DataFrame, *, to_source: bool = True, regional: bool = True) -> DataFrame:
    """Every entry of each language with where its value is from: ``own``, ``regional`` (the base language) or ``source``.

    A language without any entry takes all of its base language's, else the source's. One with entries has its gaps (null, empty or absent) filled,
    from the base language first. Without ``to_source`` gaps stay, and only whole languages are taken from their base.
    Both joins stay merges, for the reason given at ``side_by_side``.
    """
    usable = target.where("value IS NOT NULL AND NOT (vtype = 'string' AND value = '')")
    own = usable.select(*KEY, F.struct("value", "vtype").alias("own")).hint("merge")
    base = usable.select(F.col("lang").alias("base"), "ns", "path", F.struct("value", "vtype").alias("base_value")).hint("merge")
    full = target.select("lang").distinct().withColumn("has", F.lit(True))
    langs = targets.select("lang", F.col("base") if regional else F.lit(None).cast("string").alias("base")).join(full, "lang", "left")
    langs = langs.join(full.select(F.col("lang").alias("base"), F.lit(True).alias("base_has")), "base", "left")
    want = in_each(source.select("ns", "path", F.struct("value", "vtype").alias("src")), langs)
    held = want.join(own, KEY, "left").join(base, ["base", "ns", "path"], "left")
    whole_base = F.col("has").isNull() & F.col("base_has").isNotNull()
    picked = (
        F.when(F.col("own").isNotNull(), F.struct("own.*", F.lit("own").alias("origin")))
        .when(whole_base | (F.col("has").isNotNull() & F.lit(to_source)), F.when(F.col("base_value").isNotNull(), F.struct("base_value.*", F.lit("regional").alias("origin"))).when(F.lit(to_source) & ~whole_base, F.struct("src.*", F.lit("source").alias("origin"))))
        .when(F.lit(to_source) & F.col("has").isNull(), F.struct("src.*", F.lit("source").alias("origin")))
    )
    return held.select(*KEY, picked.alias("x")).where("x IS NOT NULL").select(*KEY, "x.*")


def fallback_info(source: DataFrame, target: DataFrame, targets: DataFrame, *, to_source: bool = True, regional: bool = True) -> DataFrame:
    """What ``fill_from_fallbacks`` falls back to: a row for each language that does.

    ``kind`` is ``regional`` (the whole language is that of ``base``), ``source`` (all of it is the source) or ``keys``: the ``keys`` that had no usable translation,
    each under its topmost missing ancestor. Languages that need nothing have no row.
    """
    has = target.select("lang").distinct()
    langs = targets.select("lang", F.col("base") if regional else F.lit(None).cast("string").alias("base"))
    empty = langs.join(has, "lang", "left_anti").join(has.select(F.col("lang").alias("base"), F.lit(True).alias("there")), "base", "left")
    kind = F.when(F.col("there"), "regional").when(F.lit(to_source), "source")
    none = F.lit(None).cast("array<string>")
    whole = empty.select("lang", kind.alias("kind"), F.when(F.col("there"), F.col("base")).alias("base"), none.alias("keys")).where("kind IS NOT NULL")
    if not to_source:
        return whole
    held = missing_keys(source, target, langs.join(has, "lang", "left_semi").select("lang"))
    keys = held.groupBy("lang").agg(F.array_sort(F.collect_set("top")).alias("keys"))
    return whole.unionByName(keys.select("lang", F.lit("keys").alias("kind"), F.lit(None).cast("string").alias("base"), "keys"))


def changed_keys(old: DataFrame, new: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """What was added, modified or deleted between two snapshots."""
    both = old.select(*key, F.struct(F.col(value)).alias("o")).join(new.select(*key, F.struct(F.col(value)).alias("n")), key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.select(*key, change.alias("change"), F.col(f"o.{value}").alias("old"), F.col(f"n.{value}").alias("new")).where("change IS NOT NULL")


def split_skipped(entries: DataFrame, keys: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Entries with ``skipped``: the path is one of ``keys``, or a glob matches it (``*`` one segment, ``**`` any)."""
    pattern = skip_regex(globs)
    hit = F.col("path").isin(list(keys)) if keys else F.lit(False)
    return entries.withColumn("skipped", (hit | F.col("path").rlike(pattern)) if pattern else hit)


def only_keys(entries: DataFrame, paths: list[str]) -> DataFrame:
    return entries.where(F.col("path").isin(paths))


def without_keys(entries: DataFrame, paths: list[str]) -> DataFrame:
    """Parents that are left empty go with their last entry, since only leaves are rows."""
    return entries.where(~F.col("path").isin(paths))


def merged(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """All entries of both; where both have one, that of ``over``."""
    cols = [c for c in base.columns if c not in key]
    b, o = (df.select(*key, F.struct(*cols).alias(n)) for df, n in ((base, "b"), (over, "o")))
    return b.join(o, key, "full_outer").select(*key, F.coalesce("o", "b").alias("x")).select(*key, "x.*")


def verify(source: DataFrame, target: DataFrame, langs: DataFrame, *, shortest: float = 0.3, longest: float = 3.0, least: int = 10) -> DataFrame:
    """Issues of fresh translations: ``missing_keys`` and ``placeholder`` are errors, ``length_ratio`` a warning.

    The bounds of the length ratio, for sources of at least ``least`` characters, are this engine's own.
    """
    t = target.select(*KEY, F.col("value").alias("translation")).hint("merge")
    pairs = in_each(source.where("vtype = 'string'").select("ns", "path", F.col("value").alias("source")), langs.select("lang")).join(t, KEY, "left")
    return verify_pairs(pairs, shortest=shortest, longest=longest, least=least)


def verify_pairs(held: DataFrame, *, shortest: float = 0.3, longest: float = 3.0, least: int = 10) -> DataFrame:
    """The same for rows that have both texts; see ``verify``."""
    lost = minus(placeholders("source"), placeholders("translation"))
    ratio = F.length("translation") / F.length("source")
    say = lambda kind, severity, message: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"))
    issue = (
        F.when(F.col("translation").isNull(), say("missing_keys", "error", F.lit("no translation")))
        .when(F.size(lost) > 0, say("placeholder", "error", F.concat(F.lit("Missing placeholders: "), F.array_join(lost, ", "))))
        .when((F.length("source") >= least) & ~ratio.between(shortest, longest), say("length_ratio", "warning", F.concat(F.lit("length is "), F.round(ratio, 2).cast("string"), F.lit(" of the source's"))))
    )
    return held.select(*KEY, issue.alias("i")).where("i IS NOT NULL").select(*KEY, "i.*")


def language_table(spark: SparkSession, langs: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(langs)], "pos int, lang string")
