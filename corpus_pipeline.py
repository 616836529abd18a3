"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept; all but the last return the columns of
``documents``.  Stages are written as Parquet and read again, so each one starts from a stored table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import exact, language, mixing, near, packing
from stepweave.llm.common import remove_folder, shared_folder, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters at all, or a score below the calibrated one.

    A null, empty or letterless text goes; a null language or id only keeps a row out of training.  Equal rows share their fate.
    An empty table, or one without a labelled text, leaves no rows.  All columns pass as they are.
    """
    found = language.fit(docs).predict(docs)
    return found.where(~F.col("rejected")).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: that with the largest doc_id, null being smallest; of rows equal in id and text, one.

    A null text counts as empty.  An empty table stays empty, and all columns pass as they are.
    """
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (5-word shingles, similarity of 0.8 or more): that with the smallest doc_id.

    Texts without words (null, empty, blank) are near nothing and stay; a null id counts as largest; of rows equal in id and text, one
    stays.  An empty table stays empty, and all columns pass as they are.
    """
    return near.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as their source's target takes them, by quality labels.

    A null source is a source of its own; texts without words weigh nothing and come once for each complete epoch of their source.  Equal
    rows share the sum of their passes.  An empty table stays empty, and all columns pass as they are.
    """
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents and their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone; repeated rows are documents of their own.  An empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: The first stage learns a model and the third samples hash functions: SQL cannot express them (tests/llm/test_pipeline.py has a brute-force version).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; the pieces of the last."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
