"""A whole check as one plan: read, compare, ignore, count, decide."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import shared_dir
from ..functions.text import is_ignored
from ..operators import semantic, stats
from ..operators.checks import checkable, pair_findings, side_by_side, text_pairs, without_ignored
from ..operators.glossary import glossary_findings
from ..operators.locks import lock_findings
from ..sources.locales import Tree, read_tree


class Result(NamedTuple):
    layout: str
    source_lang: str
    files: DataFrame
    pairs: DataFrame
    findings: DataFrame
    namespaces: DataFrame
    languages: DataFrame
    verdict: DataFrame
    review: DataFrame | None = None


def check_tables(source: DataFrame, target: DataFrame, langs: DataFrame | None = None, *, terms: DataFrame | None = None, locks: DataFrame | None = None) -> DataFrame:
    """All findings of source entries against target entries."""
    pairs = side_by_side(source, target, langs)
    found = pair_findings(pairs)
    if terms is not None:
        found = found.unionByName(glossary_findings(checkable(pairs).select("lang", "ns", "path", "source", "translation"), terms))
    if locks is not None:
        found = found.unionByName(lock_findings(text_pairs(pairs), locks))
    return found


def check_pairs(spark: SparkSession, source: dict, target: dict, lang: str = "target", *, glossary: dict | None = None) -> DataFrame:
    """Findings of one nested translation against its source."""
    from ..functions.nested import flat, typed
    from ..operators.glossary import glossary as terms_of

    table = lambda x: spark.createDataFrame([(lang, "translation", p, *typed(v)) for p, v in flat(x).items()], "lang string, ns string, path string, value string, vtype string")
    langs = spark.createDataFrame([(lang,)], "lang string")
    return check_tables(table(source).drop("lang"), table(target), langs, terms=terms_of(spark, glossary) if glossary else None)


def check_tree(spark: SparkSession, path: str | Tree, source_lang: str = "en", *, terms: DataFrame | None = None, locks: DataFrame | None = None, ignore: str | list[str] | None = None, fail_on: str = "error", min_coverage: float | None = None) -> Result:
    """Check a tree. Keys of files that are missing or broken are counted, not listed one by one. Locks count for JSON only."""
    tree = path if isinstance(path, Tree) else read_tree(spark, path, source_lang)
    langs = tree.files.where("NOT is_source").select("lang").distinct()
    present = tree.files.where("NOT is_source AND status = 'ok'").select("lang", "ns").distinct()
    # Catalogs and ARB bundles have one namespace for all, so every language has it.
    pairs = side_by_side(tree.source, tree.target, langs).join(present, ["lang", "ns"], "left_semi")
    found = pair_findings(pairs).unionByName(tree.findings)
    if terms is not None:
        found = found.unionByName(glossary_findings(checkable(pairs).select("lang", "ns", "path", "source", "translation"), terms))
    if locks is not None and tree.layout in ("flat", "nested"):
        found = found.unionByName(lock_findings(text_pairs(pairs), locks))
    found = without_ignored(found, ignore)
    # Ignored keys are not shown to reviewers either.
    return _result(tree.layout, tree.source_lang, tree.files, pairs.where(~is_ignored(ignore)), found, stats.key_counts(tree.source, tree.target, langs), fail_on, min_coverage)


def _result(layout, source_lang, files, pairs, found, counts, fail_on, min_coverage) -> Result:
    namespaces = stats.namespace_stats(counts, found)
    languages = stats.language_stats(namespaces)
    return Result(layout, source_lang, files, pairs, found, namespaces, languages, stats.verdict(languages, fail_on=fail_on, min_coverage=min_coverage))


def run_semantic(result: Result, judge, *, passes: int = 3, batch: int = 15, cache: DataFrame | None = None, fail: bool = False, model: str | None = None, glossary: str | None = None, fail_on: str = "error", min_coverage: float | None = None) -> tuple[Result, DataFrame, DataFrame]:
    """Add the reviewers' findings. Also returns the new verdicts, to be cached, and counts of what was judged. The result's ``review`` has these counts with
    those of ``call_stats``, and ``excluded``: pairs left out for their structural errors.

    Pairs with structural errors are left out, equal pairs are judged once, and cached ones not at all. The votes are written before
    use, since asking twice may give other answers: the session needs a checkpoint folder.
    """
    spark = result.findings.sparkSession
    shared_dir(spark)
    # Findings and pairs are each read several times below, and both cost joins of all entries.
    result = result._replace(findings=result.findings.checkpoint())
    texts = text_pairs(result.pairs)
    pairs = semantic.reviewable(texts, result.findings, source_lang=result.source_lang, model=model, glossary=glossary).checkpoint()
    votes = semantic.judge_votes(semantic.to_judge(pairs, cache), judge, source_lang=result.source_lang, passes=passes, batch=batch, glossary=glossary).checkpoint()
    new = semantic.majority(votes, passes=passes)
    known = semantic.cacheable(new)
    every = known if cache is None else known.unionByName(cache.select("pair_hash", "category", "note"))
    found = result.findings.unionByName(semantic.semantic_findings(pairs, every, fail=fail))
    counts = result.namespaces.select("lang", "ns", "source_keys", "target_keys")
    out = _result(result.layout, result.source_lang, result.files, result.pairs, found, counts, fail_on, min_coverage)
    calls = semantic.call_stats(votes)
    excluded = texts.agg((F.count("*") - pairs.agg(F.count("*")).scalar()).alias("n"))  # a text pair is reviewable or has an error
    judged = semantic.review_stats(pairs, known, cache)
    review = judged.select("*", calls.select("calls").scalar().alias("calls"), calls.select("parse_failures").scalar().alias("parse_failures"), excluded.scalar().alias("excluded"))
    return out._replace(review=review), known, judged
