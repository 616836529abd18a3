"""MinHash near-deduplication with sequential Bayesian verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, cut
from .exact import keep_rows
from .nearcore import linked_classes


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, step: int = 32, miss: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, txt (the text's xxhash64).

    Words are lower-cased (A-Z) and cut into ``shingle``-word shingles.  Band keys of the signatures give
    candidates; their signatures are compared ``step`` hashes at a time, and a pair goes as soon as the posterior chance of enough
    similarity is below ``miss``; the rest is checked on full sets.  component_id is the smallest
    doc_id that links reach (null ids count as largest).  Texts without words are alone: their component is their own id.
    Of rows with the same id in one component, one is kept.  Other columns are ignored; an empty table gives an empty result.
    """
    members, roots = linked_classes(docs, shingle=shingle, percent=percent, bands=bands, rows=rows, step=step, miss=miss)
    whole = cut(members.join(roots, "digest", "left").select("doc_id", "txt", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")).withColumn("uid", F.monotonically_increasing_id()), NARROW)
    some = whole.where("root is not null")
    least = cut(some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid")).alias("l")), NARROW)
    grouped = some.join(least, "root").select("doc_id", "txt", "n_shingles", F.col("l.doc_id").alias("component_id"), (F.col("uid") == F.col("l.uid")).alias("kept"))
    alone = whole.where("root is null").select("doc_id", "txt", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component."""
    return keep_rows(docs, near_duplicates(docs, **options))
