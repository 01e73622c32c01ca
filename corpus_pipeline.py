"""From raw documents to packed training sequences: five of the corpus operators, one after the other."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from wordloom.files import shared_dir
from wordloom.llm.common import remove, table
from wordloom.llm.decontaminate import drop_contaminated
from wordloom.llm.minhash import keep_one
from wordloom.llm.packing import pack
from wordloom.llm.quality import fit, keep_good
from wordloom.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, null and empty texts among them.

    Of repeated rows all stay or go; a null id doesn't matter. An empty table stays empty; without labels of both kinds every text has the mean label as its
    quality, 1 if there is none. All columns stay, whatever their names.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the least id (nulls last), then of the least hash.

    Repeated rows are copies. Null and empty texts are copies of nothing, and stay. An empty table stays empty. All columns stay, whatever their names.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of five words or more go.

    Null and empty texts stay; of repeated rows all stay or go; a null id doesn't matter. Empty tables, of documents or items, are no special case. All
    columns stay, whatever their names.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten, and ``n_chars`` follows; every document stays, null and empty texts and repeated rows among them.

    An empty table stays empty. All columns stay, whatever their names.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token sequences of equal capacity.

    Null and empty texts have no tokens and no place in a sequence; a null id stays null; repeated rows are packed as often as they occur; ties go by order
    of arrival. An empty table gives no sequences. Other columns are left out.
    """
    return pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]

#: Neither the classifier, nor the signatures, nor a tokenizer can be written in SQL; a test compares the rows with a brute-force pipeline.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again by the next, which then replaces it.

    The table that the last stage reads stays, since its rows are not made before the caller asks for them; it lies in the shared folder under
    ``pipeline-``. What ``checkpoint()`` wrote goes with its references if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := os.path.join(root, str(k)))
        docs = spark.read.schema(out.schema).parquet(path)
        if k:
            remove(spark, os.path.join(root, str(k - 1)))
    return STAGES[-1][1](spark, docs, sf_dir)
