"""Locale trees: JSON files flat or by language, ARB bundles and string catalogs, as files and entries."""

from __future__ import annotations

import json
import os
import re
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files as fs
from ..functions.nested import flat, flatten_json, json_fault, typed
from ..functions.text import LOCALE
from ..operators.checks import in_each
from ..schema import CATALOG_FILE, FINDING_COLUMNS

FLAT_NS = "translation"
ARB_TAIL = r"_([a-z]{2,3}(?:_[A-Z][a-z]{3})?(?:_(?:[A-Z]{2}|[0-9]{3}))?)\.arb\z"


class UsageError(ValueError):
    """The tree can't be checked at all."""


class Tree(NamedTuple):
    """``files``: catalog-less rows of lang, ns, file, is_source, status; ``source`` and ``target`` entries; ``findings`` made while reading."""

    layout: str
    source_lang: str
    files: DataFrame
    source: DataFrame
    target: DataFrame
    findings: DataFrame


def _names(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files under a folder, relative to it; their content isn't read. Spark writes ``file:/x`` for ``file:///x``."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return held.select("path", F.substring_index("path", re.sub(r"\Afile:/+", "/", root).rstrip("/") + "/", -1).alias("rel"))


def json_files(paths: DataFrame) -> DataFrame:
    """Which files of a tree hold which language and namespace, in either layout; ``rel`` is the path below the root.

    Flat: ``<lang>.json`` with the namespace "translation". By language: ``<lang>/<ns>.json``. Names with a dot first, and folders that
    are no locale, don't count.
    """
    parts = F.split("rel", "/")
    depth, name, top = F.size(parts), F.element_at(parts, -1), F.element_at(parts, 1)
    stem = F.regexp_extract(name, r"\A([^.].*)\.json\z", 1)
    held = paths.withColumns({"stem": stem, "top": top, "depth": depth}).where("stem != '' AND depth <= 2")
    flat_lang, nested_lang = F.when(F.col("depth") == 1, F.col("stem")), F.when((F.col("depth") == 2) & ~F.col("top").startswith(".") & (F.col("top") != "node_modules"), F.col("top"))
    layout = F.when(F.col("depth") == 1, "flat").otherwise("nested")
    return held.select("*", layout.alias("layout"), F.coalesce(flat_lang, nested_lang).alias("lang"), F.when(F.col("depth") == 1, F.lit(FLAT_NS)).otherwise(F.col("stem")).alias("ns")).where("lang IS NOT NULL").drop("stem", "top", "depth")


def choose_layout(files: DataFrame, source_lang: str) -> tuple[str, DataFrame]:
    """The layout, flat before nested, and its files of the source and of languages with a locale's name."""
    held = {r.layout for r in files.where(F.col("lang") == source_lang).select("layout").distinct().collect()}
    if not held:
        raise UsageError(f"no source locale {source_lang!r} found")
    layout = "flat" if "flat" in held else "nested"
    mine = files.where((F.col("layout") == layout) & (F.col("lang").rlike(LOCALE) | (F.col("lang") == source_lang)))
    return layout, mine.withColumn("is_source", F.col("lang") == source_lang)


def _texts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The files with their content as ``text``."""
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return files.withColumn("text", F.lit(None).cast("string"))
    content = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("text"))
    plain = lambda c: F.regexp_replace(c, r"\Afile:/+", "file:/")
    return files.withColumn("at", plain("path")).join(content.withColumn("at", plain("at")), "at", "left").drop("at").withColumn("text", F.coalesce("text", F.lit("")))


def missing_files(files: DataFrame) -> DataFrame:
    """A finding for each source namespace that a language has no file for."""
    want = in_each(files.where("is_source").select("ns").distinct(), files.where("NOT is_source").select("lang"))
    lost = want.join(files.where("NOT is_source").select("lang", "ns"), ["lang", "ns"], "left_anti")
    message = F.concat(F.lit("file missing: "), "lang", F.lit("/"), "ns", F.lit(".json"))
    return _findings(lost.withColumn("path", F.col("ns")), "missing-file", "error", message)


def _findings(df: DataFrame, kind: str, severity: str, message: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.withColumns({"type": F.lit(kind), "severity": F.lit(severity), "message": message, "source": none, "translation": none}).select(FINDING_COLUMNS)


def read_tree(spark: SparkSession, path: str, source_lang: str = "en") -> Tree:
    """A file or folder of locales, by what it is: a string catalog, a folder with ARB files, or JSON.

    A JSON file names the source language, and stands with those beside it. A broken source file is a UsageError; a broken target
    is a finding, and so is a missing one.
    """
    if path.endswith(".xcstrings"):
        return read_catalog(spark, path, source_lang)
    if path.endswith(".json"):
        source_lang, path = os.path.basename(path)[: -len(".json")], os.path.dirname(path) or "."
        names = _names(spark, path)
        names = names.where(~F.col("rel").contains("/"))
    else:
        names = _names(spark, path)
        if not names.where(r"rel RLIKE '^[^/]+[.]arb$'").isEmpty():
            return read_arb(spark, path, source_lang)
    layout, files = choose_layout(json_files(names), source_lang)
    return _tree(spark, layout, source_lang, _texts(spark, files))


def _tree(spark: SparkSession, layout: str, source_lang: str, texts: DataFrame) -> Tree:
    held = texts.withColumn("leaves", flatten_json("text")).withColumn("status", F.when(F.col("leaves").isNull(), "invalid").otherwise("ok"))
    broken = texts.where("NOT is_source").withColumn("fault", json_fault("text")).where("fault IS NOT NULL")
    if bad := held.where("is_source AND status = 'invalid'").select("path").take(1):
        raise UsageError(f"the source file {bad[0].path} is not valid JSON")
    files = held.select("lang", "ns", F.col("rel").alias("file"), "is_source", "status", F.coalesce(F.size("leaves"), F.lit(0)).alias("keys"))
    entries = held.select("lang", "ns", "is_source", F.explode("leaves").alias("leaf")).select("lang", "ns", "is_source", "leaf.*")
    source_ns = files.where("is_source").select("ns")
    invalid = broken.select("lang", "ns", "fault").join(source_ns, "ns", "left_semi").withColumn("path", F.col("ns"))
    findings = _findings(invalid, "invalid-json", "error", F.concat(F.lit("invalid JSON: "), "fault")).unionByName(missing_files(files))
    return Tree(layout, source_lang, files, entries.where("is_source").drop("lang", "is_source"), entries.where("NOT is_source").drop("is_source").join(source_ns, "ns", "left_semi"), findings)


def read_arb(spark: SparkSession, path: str, source_lang: str = "en") -> Tree:
    """ARB files of a folder. The language is in the name, else in ``@@locale``; keys that begin with ``@`` are metadata."""
    names = _names(spark, path).where(r"rel RLIKE '^[^/]+[.]arb$'")
    texts = _texts(spark, names.withColumns({"is_source": F.lit(False), "ns": F.regexp_replace("rel", r"\.arb\z", "")}))
    parsed = texts.withColumn("meta", F.get_json_object("text", "$['@@locale']"))
    named = F.nullif(F.regexp_extract("rel", ARB_TAIL, 1), F.lit(""))
    lang = F.replace(F.coalesce(named, F.nullif("meta", F.lit(""))), F.lit("_"), F.lit("-"))
    held = parsed.withColumn("lang", lang).where("lang IS NOT NULL").withColumn("is_source", F.col("lang") == source_lang)
    one = held.groupBy("lang").agg(F.max_by(F.struct(*held.columns), "rel").alias("x")).select("x.*")
    if (source := one.where("is_source").first()) is None:
        raise UsageError(f"no ARB file for the source language {source_lang!r}")
    tree = _tree(spark, "arb", source_lang, one.withColumn("ns", F.lit(source.ns)))
    keep = lambda df: df.where(~F.col("path").startswith("@"))
    return tree._replace(source=keep(tree.source), target=keep(tree.target))


_CATALOG = "array<struct<kind:string,lang:string,path:string,value:string,vtype:string,message:string>>"


def parse_catalog(text: str | None) -> list[dict] | None:
    """A string catalog as rows: ``source`` and ``target`` entries, and states and extra plural forms to look at; None if it isn't JSON.

    A text without a localisation of its own is its key. Forms that are new or absent are left out. Plural forms have the path
    ``<key>.plural.<category>``. One whose category the source lacks is ``extra``, with the source form it is compared to in ``message``.
    """
    try:
        tree = json.loads(text or "")
    except ValueError:
        return None
    return _catalog_rows(tree)


def _catalog_rows(tree: dict) -> list[dict]:
    rows: list[dict] = []

    def put(kind: str, lang: str, path: str, value: Any, message: str | None = None) -> None:
        v, t = typed(value)
        rows.append({"kind": kind, "lang": lang, "path": path, "value": v, "vtype": t, "message": message})

    def form(node: Any) -> tuple[Any, Any]:
        unit = (node or {}).get("stringUnit") or {}
        return unit.get("value"), unit.get("state")

    base = tree.get("sourceLanguage") or "en"
    strings = tree.get("strings") or {}
    each = {k: (e or {}).get("localizations") or {} for k, e in strings.items()}
    langs = list(dict.fromkeys(lang for loc in each.values() for lang in loc if lang != base))
    rows.append({"kind": "base", "lang": base, "path": "", "value": None, "vtype": "object", "message": None})
    rows += [{"kind": "lang", "lang": lang, "path": "", "value": None, "vtype": "object", "message": None} for lang in langs]
    for key, locs in each.items():
        own = locs.get(base) or {}
        plural = (own.get("variations") or {}).get("plural") if not own.get("stringUnit") else None
        forms = {c: form(n)[0] for c, n in plural.items()} if plural else None
        value = form(own)[0] if own.get("stringUnit") else None
        value = key if value is None else value
        for path, v in flat({key: {"plural": forms} if forms else value}).items():
            put("source", base, path, v)
        against = (forms.get("other") or next(iter(forms.values()))) if forms else value
        for lang in langs:
            loc = locs.get(lang) or {}
            if loc.get("stringUnit"):
                v, state = form(loc)
                if state == "new" or v is None:
                    continue
                put("target", lang, key, v)
                if state in ("needs_review", "stale"):
                    put("state", lang, key, v, f'state is "{state}"')
            else:
                for cat, node in ((loc.get("variations") or {}).get("plural") or {}).items():
                    v, state = form(node)
                    if v is None or state == "new":
                        continue
                    if not forms or cat in forms:
                        put("target", lang, f"{key}.plural.{cat}", v)
                    elif isinstance(against, str):
                        put("extra", lang, f"{key}.plural.{cat}", v, against)
    return rows


_CATALOG_HEAD = re.compile(r'\A\{\n  "sourceLanguage" ?: ("(?:[^"\\\n]|\\.)+"),\n(?:  "version" ?: "[^"\\\n]*",\n)?  "strings" ?: \{\n(?=    ")')
_CATALOG_TAIL = re.compile(r'\n    \}\n  \}(?:,\n  "version" ?: "[^"\\\n]*")?\n\}\n?\Z')


def _laid_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """``rows`` of each entry of a catalog that has its entries on lines of their own; None for any other, one with a fault or with a key twice.

    A line end can't stand in a JSON string. Where every piece between the ends of entries is a list of members by itself, so is the whole.
    """
    if (held := fs.ends(spark, path)) is None or not (head := _CATALOG_HEAD.search(held[0])) or not (tail := _CATALOG_TAIL.search(held[1])):
        return None
    try:
        base = json.loads(head[1])
    except ValueError:
        return None
    if (laid := fs.read_rows(spark, path, head[0], CATALOG_FILE[1], tail[0])) is None:
        return None

    @F.arrow_udf(_CATALOG)
    def parse(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            try:
                strings = json.loads("{" + t + "}}")
            except ValueError:
                out.append(None)
            else:
                out.append(_catalog_rows({"sourceLanguage": base, "strings": strings}))
        fields = pa.struct([(k, pa.string()) for k in ("kind", "lang", "path", "value", "vtype", "message")])
        return pa.array(out, pa.list_(fields))

    @F.arrow_udf("array<string>")
    def keys(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            try:
                out.append([k for k, _ in json.loads("{" + t + "}}", object_pairs_hook=list)])
            except ValueError:
                out.append([None])
        return pa.array(out, pa.list_(pa.string()))

    each = laid.select(F.explode(keys("value")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return laid.select(parse("value").alias("rows")) if each.where("key IS NULL OR n > 1").isEmpty() else None


def read_catalog(spark: SparkSession, path: str, source_lang: str | None = None) -> Tree:
    """One string catalog. Its own source language counts; ``source_lang`` is a label only.

    A file laid out as Xcode and ``write_catalog`` do is read by all executors, any other by one task.
    """
    from ..functions.placeholders import minus, placeholders

    @F.arrow_udf(_CATALOG)
    def parse(text: pa.Array) -> pa.Array:
        fields = pa.struct([(k, pa.string()) for k in ("kind", "lang", "path", "value", "vtype", "message")])
        return pa.array([parse_catalog(t) for t in text.to_pylist()], pa.list_(fields))

    ns = os.path.basename(path)
    held = _laid_catalog(spark, path)
    if held is None:
        held = spark.read.text(path, wholetext=True).select(parse("value").alias("rows"))
        if held.where("rows IS NULL").count():
            raise UsageError(f"{path} is not valid JSON")
    rows = held.select(F.explode("rows").alias("r")).select("r.*", F.lit(ns).alias("ns"))
    entry = lambda kind: rows.where(F.col("kind") == kind).select("lang", "ns", "path", "value", "vtype")
    state = _findings(rows.where("kind = 'state'").withColumn("say", F.col("message")), "stale-translation", "warning", F.col("say"))
    lost = minus(placeholders("message"), placeholders("value"))
    extra = rows.where("kind = 'extra'").withColumn("lost", lost).where("size(lost) > 0")
    findings = state.unionByName(_findings(extra, "placeholder-missing", "error", F.concat(F.lit("dropped "), F.array_join("lost", ", "))))
    files = rows.where("kind IN ('base', 'lang')").select("lang", "ns", F.lit(ns).alias("file"), (F.col("kind") == "base").alias("is_source"), F.lit("ok").alias("status"), F.lit(0).alias("keys")).distinct()
    return Tree("catalog", source_lang or rows.where("kind = 'base'").first().lang, files, entry("source").drop("lang"), entry("target"), findings)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms from a JSON file; a broken one is a UsageError."""
    from ..operators.glossary import glossary

    text = fs.read_text(spark, path)
    try:
        return glossary(spark, json.loads(text or ""))
    except (ValueError, AttributeError) as e:
        raise UsageError(f"the glossary {path} can't be read") from e


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """Locks from a file ``{"version": 1, "locked": {"lang::ns::path": {...}}}``; none if it is absent, broken or of another version.

    A file laid out as ``write_locks`` does is read by all executors. Any other, as people edit them, passes through the driver.
    """
    from ..schema import LOCK, LOCK_FILE

    if (laid := fs.read_rows(spark, path, *LOCK_FILE)) is not None:
        text = r'("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
        whole = rf'\A    {text}: \{{\n      "sourceHash": ({text}|null),\n      "translationHash": ({text}|null)\z'
        part = lambda k: F.regexp_extract("value", whole, k)
        held = laid.withColumn("x", F.when(F.col("value").rlike(whole), F.from_json(F.concat(F.lit("["), F.concat_ws(",", part(1), part(2), part(4)), F.lit("]")), "array<string>")))
        fault = held.groupBy(F.col("x")[0].alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1")
        if fault.isEmpty():
            ids = F.split(F.col("x")[0], "::", 3)
            return held.withColumn("id", ids).where("size(id) = 3").select(*(F.col("id")[k].alias(c) for k, c in enumerate(("lang", "ns", "path"))), F.col("x")[1].alias("source_hash"), F.col("x")[2].alias("translation_hash"))
    rows = []
    held = _tolerant(spark, path)
    if isinstance(held, dict) and held.get("version") == 1 and isinstance(held.get("locked"), dict):
        for key, entry in held["locked"].items():
            parts = key.split("::", 2)
            if len(parts) == 3 and isinstance(entry, dict):
                rows.append((*parts, entry.get("sourceHash"), entry.get("translationHash")))
    return spark.createDataFrame(rows, LOCK)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts from ``{hash: {"category": ..., "note": ...}}``; none if it is absent or broken."""
    from ..schema import VERDICT

    held = _tolerant(spark, path)
    rows = [(k, v.get("category"), v.get("note")) for k, v in held.items() if isinstance(v, dict)] if isinstance(held, dict) else []
    return spark.createDataFrame(rows, VERDICT)


def _tolerant(spark: SparkSession, path: str) -> Any:
    try:
        return json.loads(fs.read_text(spark, path) or "")
    except ValueError:
        return None
