"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, langid, urlfilter, warc
from .common import table
from .decontaminate import contaminations
from .minhash import duplicates
from .packing import pack
from .quality import fit, score
from .secrets import scan
from .tokens import END_ID
from .wavelet import searched, token_shards


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files, damage of nine kinds in turn before every tenth record, and read back: every page and every gap."""
    shards = warc.write_pages(table(spark, sf_dir, "pages"), torn=lambda page: page is not None and page % 10 == 3 and warc.DAMAGE[page // 10 % len(warc.DAMAGE)])
    return warc.read_pages(warc.read_payloads(shards))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the benchmark, answers of one word included, in every document."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards, and in each, read back from its file, every place of every hundredth id of the vocabulary."""
    return searched(token_shards(table(spark, sf_dir, "documents")), list(range(0, END_ID, 100)))


def op7_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector played as a melody and fingerprinted; each class of equal ones aligned with all others."""
    return audio.recording_classes(audio.fingerprints(audio.melodies(table(spark, sf_dir, "embeddings"))))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_url_filters, op4_warc_salvage, op5_benchmark_decontamination, op6_wavelet_tokens, op7_audio_fingerprints, op8_quality_classifier, op9_language_id, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": urlfilter.sql(),
        "op4_warc_salvage": f"""SELECT 'record' AS kind, page_id, url, html, CAST(NULL AS BIGINT) AS gap_bytes FROM pages
UNION ALL SELECT 'gap', NULL, NULL, NULL, [{", ".join(str(len(d)) for d in warc.DAMAGE)}][page_id // 10 % {len(warc.DAMAGE)} + 1] FROM pages WHERE page_id % 10 = 3""",
    }
