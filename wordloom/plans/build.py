"""Translating as a build step: only files that changed, with fallbacks for what can't be had."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import read_text, shared_dir
from ..functions.nested import flat, flatten_files, nest, typed, untyped
from ..functions.text import content_key
from ..operators.checks import in_each
from ..operators.translate import changed_keys, fill_from_fallbacks, language_table, partition_work, regional_targets, split_skipped, translate, verify_pairs
from ..sinks.reports import write_translations
from ..sources.locales import read_tree

Translator = Callable[[list[str], str], list[str]]


def pending(files: DataFrame, cache: DataFrame | None, targets: list[str]) -> DataFrame:
    """Files (ns, text) with their ``key``, without those whose key the cache holds: an unchanged text for the same languages."""
    held = files.withColumn("key", content_key("text", targets))
    return held if cache is None else held.join(cache.select("key"), "key", "left_anti")


def build(spark: SparkSession, files: DataFrame, targets: list[str], translator: Translator, *, cache: DataFrame | None = None, to_source: bool = True, regional: bool = True) -> DataFrame:
    """Entries of all pending files in all languages, and where each is from: lang, ns, path, value, vtype, origin.

    Base languages of regional ones are translated too. A file that isn't valid JSON has no entries; a batch that the translator fails on
    is filled from the base language or the source. Entries and translations are written before use, since both are read several times and
    a translator may answer otherwise the second time: the session needs a checkpoint folder.
    """
    shared_dir(spark)
    langs = regional_targets(language_table(spark, targets), regional)
    # A file is read by one task; its entries are spread over all.
    source = flatten_files(pending(files, cache, targets), "text", "ns").repartition("ns", "path").checkpoint()
    work = partition_work(source, None, langs.select("lang"))
    made = translate(work, translator, isolate=True).where("result IS NOT NULL").select("lang", "ns", "path", F.col("result").alias("value"), "vtype").checkpoint()
    return fill_from_fallbacks(source, made, langs.select("lang", "base"), to_source=to_source, regional=regional)


def translate_json(spark: SparkSession, tree: dict, lang: str, translator: Translator, *, existing: dict | None = None) -> tuple[dict, dict]:
    """A nested source in another language, and the counts of texts translated and reused."""
    entry = "ns string, path string, value string, vtype string, pos int"
    source = spark.createDataFrame([("", p, *typed(v), k) for k, (p, v) in enumerate(flat(tree).items())], entry)
    old = spark.createDataFrame([(lang, "", p, *typed(v)) for p, v in flat(existing or {}).items()], "lang string, ns string, path string, value string, vtype string")
    work = partition_work(source.drop("pos"), old, language_table(spark, [lang]).select("lang"))
    rows = translate(work, translator).join(source.select("path", "pos"), "path").orderBy("pos").collect()
    kinds = {(r.path): r.vtype for r in old.collect()}
    out = nest({r.path: untyped(r.result, kinds.get(r.path, r.vtype) if r.action == "reuse" else r.vtype) for r in rows})
    return out, {a: sum(r.action == b for r in rows) for a, b in (("translated", "translate"), ("reused", "reuse"))}


def action(spark: SparkSession, source: str, targets: list[str], translator: Translator, *, out: str | None = None, before: str | None = None, skip_keys: list[str] = (), skip_globs: list[str] = ()) -> dict[str, str]:
    """Translate a source file, or a folder of one language, into its neighbours; what a workflow step reports, by name.

    With ``before``, the source as it was, keys that were added or changed since are translated anew; without, those that have no translation.
    Skipped keys keep the source's text, and keys that the source no longer has go. Files are written under ``out``, by default beside the source.
    """
    source = source.rstrip("/")
    root, name = os.path.split(source)
    nested = not source.endswith(".json")
    tree = read_tree(spark, root or ".", name) if nested else read_tree(spark, source)
    langs = language_table(spark, targets).select("lang")
    split = split_skipped(tree.source, skip_keys, skip_globs)
    entries, skipped = split.where("NOT skipped").drop("skipped"), split.where("skipped").drop("skipped")
    known = tree.target
    if before:
        old = before.rstrip("/")
        was = read_tree(spark, os.path.dirname(old) or ".", os.path.basename(old)) if nested else read_tree(spark, old)
        changed = changed_keys(was.source, tree.source, ["ns", "path"]).where("change != 'deleted'").select("ns", "path")
        known = known.join(changed, ["ns", "path"], "left_anti")
    done = translate(partition_work(entries, known, langs), translator)
    kept = in_each(skipped.select("ns", "path", "value", "vtype"), langs).withColumns({"action": F.lit("skip"), "result": F.col("value")})
    done = done.unionByName(kept).persist()  # read by the writer and by the checks
    try:
        made = done.where("action = 'translate'").select("lang", "ns", "path", F.col("result").alias("value"), "vtype")
        issues = verify_pairs(done.where("action = 'translate'").select("lang", "ns", "path", F.col("value").alias("source"), F.col("result").alias("translation")))
        n = {r.severity: r.n for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
        to = out or (root or ".")
        write_translations(done.withColumn("value", F.col("result")), to, nested=nested)
        touched = sorted(f"{to}/{r.lang}/{r.ns}.json" if nested else f"{to}/{r.lang}.json" for r in made.select("lang", "ns").distinct().collect())
        held = skipped.count()
    finally:
        done.unpersist()
    return {
        "files-changed": str(len(touched)), "files-list": json.dumps(touched), "languages": ",".join(targets), "verification-errors": str(n.get("error", 0)),
        "verification-warnings": str(n.get("warning", 0)), "skipped-keys-count": str(held),
    }


def translate_file(spark: SparkSession, path: str, targets: list[str], translator: Translator) -> dict[str, dict]:
    """A JSON file in each of several languages."""
    tree = json.loads(read_text(spark, path) or "")
    return {lang: translate_json(spark, tree, lang, translator)[0] for lang in targets}
