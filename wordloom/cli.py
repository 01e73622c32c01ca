"""Command line: check, lock, diff, translate and action. Exit codes: 0 passed, 1 findings, 2 can't be run."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import files as fs
from .functions.text import split_list
from .operators.checks import side_by_side, text_pairs
from .operators.locks import merge_locks, new_locks
from .operators.translate import language_table, partition_work, translate
from .plans.build import action
from .plans.check import Result, check_tree, run_semantic
from .plans.tools import diff
from .sinks import reports
from .sources.locales import UsageError, read_cache, read_glossary, read_locks, read_tree

#: Where locks are looked for, if they aren't named.
LOCKS = ".wordloom/locks.json"


def _arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wordloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="compare translations with their source")
    c.add_argument("--glossary")
    c.add_argument("--locks", default=LOCKS)
    c.add_argument("--no-locks", action="store_true")
    c.add_argument("--ignore", help="globs, with commas between")
    c.add_argument("--semantic", action="store_true", help="ask a reviewer about meaning")
    c.add_argument("--judge", help="module:function of a prompt, giving the answer's text")
    c.add_argument("--semantic-fail", action="store_true", help="what the reviewer finds are errors")
    c.add_argument("--semantic-passes", type=int, default=3)
    c.add_argument("--semantic-model", help="the reviewer's name, as verdicts are kept under")
    c.add_argument("--semantic-cache", default=".wordloom/verdicts.json")
    c.add_argument("--json", action="store_const", const="json", dest="format", default=argparse.SUPPRESS)
    c.add_argument("--fail-on", choices=("error", "warning", "none"), default="error")
    c.add_argument("--min-coverage", type=float)
    c.add_argument("--format", choices=("text", "json", "sarif", "junit"), default="text")
    c.add_argument("--output")
    k = sub.add_parser("lock", help="record translations edited by hand")
    k.add_argument("--file", default=LOCKS)
    k.add_argument("--keys")
    k.add_argument("--lang")
    k.add_argument("--relock", action="store_true")
    d = sub.add_parser("diff", help="what needs to be translated")
    d.add_argument("--lang")
    t = sub.add_parser("translate", help="translate what is new")
    t.add_argument("--to", required=True)
    t.add_argument("--translator", required=True, help="module:function of (texts, language)")
    t.add_argument("--out", required=True)
    w = sub.add_parser("action", help="translate what changed in a source file or folder, as a workflow step")
    w.add_argument("--source-file")
    w.add_argument("--source-dir")
    w.add_argument("--target-languages", required=True)
    w.add_argument("--translator", required=True, help="module:function of (texts, language)")
    w.add_argument("--output-dir")
    w.add_argument("--before", help="the source file or folder as it was; without it only what has no translation is translated")
    w.add_argument("--skip-keys", default="")
    w.add_argument("--skip-paths", default="")
    for x in (c, k, d, t):
        x.add_argument("path")
        x.add_argument("--source", default="en")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = _arguments(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("wordloom").getOrCreate()
    try:
        return {"check": _check, "lock": _lock, "diff": _diff, "translate": _translate, "action": _action}[a.command](spark, a)
    except (UsageError, AnalysisException) as e:
        print(str(e).split("\n")[0], file=sys.stderr)
        return 2


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    terms = read_glossary(spark, a.glossary) if a.glossary else None
    locks = None if a.no_locks else read_locks(spark, a.locks)
    result = check_tree(spark, a.path, a.source, terms=terms, locks=locks, ignore=a.ignore, fail_on=a.fail_on, min_coverage=a.min_coverage)
    if a.semantic:
        try:
            result = _semantic(spark, a, result)
        except Exception as e:  # whatever a reviewer or its answers raise
            print(f"the semantic pass failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
            return 2
    found = result.findings.persist()  # the report and the verdict read it many times
    try:
        ok = result.verdict.first().ok
        if a.output and a.format in ("json", "sarif"):
            {"json": reports.write_json_report, "sarif": reports.write_sarif_report}[a.format](result, a.output)
            return 0 if ok else 1
        text = {"text": reports.text_report, "json": reports.json_report, "sarif": reports.sarif_report, "junit": reports.junit_report}[a.format](result)
    finally:
        found.unpersist()
    if a.output:
        fs.write_text(spark, a.output, text if text.endswith("\n") else text + "\n")
    else:
        print(text)
    return 0 if ok else 1


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _semantic(spark: SparkSession, a: argparse.Namespace, result: Result) -> Result:
    if not a.judge:
        raise UsageError("--semantic needs --judge")
    known = read_cache(spark, a.semantic_cache)
    terms = fs.read_text(spark, a.glossary) if a.glossary else None
    out, new, _ = run_semantic(result, _named(a.judge), passes=a.semantic_passes, cache=known, fail=a.semantic_fail, model=a.semantic_model, glossary=terms, fail_on=a.fail_on, min_coverage=a.min_coverage)
    reports.write_cache(known.unionByName(new).dropDuplicates(["pair_hash"]), a.semantic_cache)
    n = out.review.first()
    print(f"semantic: judged {n.judged} ({n.cached} cached), flagged {n.flagged}, {n.calls} call(s), {n.parse_failures} discarded pass(es)", file=sys.stderr)
    if not n.judged and n.excluded:
        print(f"note: nothing was judged, since all {n.excluded} translated key(s) have structural errors; mend those first", file=sys.stderr)
    return out


def _lock(spark: SparkSession, a: argparse.Namespace) -> int:
    tree = read_tree(spark, a.path, a.source)
    if tree.layout not in ("flat", "nested"):
        raise UsageError("locks are for JSON trees")
    pairs = text_pairs(side_by_side(tree.source, tree.target))
    held = merge_locks(None if a.relock else read_locks(spark, a.file), new_locks(pairs, keys=a.keys, langs=split_list(a.lang) or None)).cache()
    print(f"{held.where('added').count()} added, {held.count()} in all")
    reports.write_locks(held, a.file)
    return 0


def _diff(spark: SparkSession, a: argparse.Namespace) -> int:
    result = check_tree(spark, a.path, a.source)
    for r in diff(result.findings, result.languages, layout=result.layout, lang=a.lang).orderBy("lang").select(F.to_json(F.struct("*")).alias("j")).collect():
        print(r.j)
    return 0


def _translate(spark: SparkSession, a: argparse.Namespace) -> int:
    tree = read_tree(spark, a.path, a.source)
    work = partition_work(tree.source, tree.target, language_table(spark, split_list(a.to)).select("lang"))
    done = translate(work, _named(a.translator))
    reports.write_translations(done.withColumn("value", F.col("result")), a.out, nested=tree.layout == "nested")
    return 0


def _action(spark: SparkSession, a: argparse.Namespace) -> int:
    if bool(a.source_file) == bool(a.source_dir):
        raise UsageError("name either a source file or a source folder")
    out = action(spark, a.source_file or a.source_dir, split_list(a.target_languages), _named(a.translator), out=a.output_dir, before=a.before, skip_keys=split_list(a.skip_keys), skip_globs=split_list(a.skip_paths))
    print("\n".join(f"{k}={v}" for k, v in out.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
