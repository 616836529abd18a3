"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, one is made if the session runs on this machine alone, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="stepweave-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that one task handles in a second or so.
NARROW = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder: later steps start from it, whatever executors are lost.

    With ``rows``, the table is read again in as many parts as that many rows each make, so that shuffles of what
    has become small do not write a file for each part of what was large.  More rows mean more parts, up to those written.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out if rows is None else out.coalesce(max(1, -(-out.count() // rows)))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(value: Column) -> Column:
    """A number in (0, 1) that depends on the value's text alone (52 bits of its MD5); a null value counts as the text ``null``."""
    hexed = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
