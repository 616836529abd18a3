"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, ``-ln(u) / quality``; in the order of the
keys, the first documents of a source are a weighted sample without replacement
of any length.  A source's target is first served by complete epochs, and the
rest by the documents whose prefix sum of sizes, in that order, fits the budget.

No source is sorted as a whole.  Its keys fall into ``CELLS`` ranges, whose sizes
are added up before any shuffle; only the documents of the one range in which the
budget ends are ordered row by row.  So a source with a third of all rows costs
one row a range and task, not one task.  Weights and targets are a matter of the list of sources, which one task sorts: a row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, cut, n_words, packed, unit_hash

#: Ranges of keys for each source.
CELLS = 2048
#: So many sources are broadcast at most; parts of a source's rows where there are more.
SOURCES, SALTS = 50_000, 64
#: Weights that sources get in turn, by code point.
WEIGHTS = (5, 2, 1)


def quality_weights(labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """(doc_id, quality_weight) of labelled documents, from the best of a document's quality flags."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_best"))
    return best.where("_best is not null").select("doc_id", F.when(F.col("_best") >= 1, F.lit(good)).otherwise(F.lit(poor)).alias("quality_weight"))


def source_targets(sizes: DataFrame, *, budget: float = 1.5, most_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table (source, source_size) with a row for each source.

    The budget is a multiple of all sizes.  Shares go by weight; no target is above
    ``most_epochs`` times its source's size, and what is cut off is shared anew, by weight, among
    the others.  The fixed point of that is ``least(cap, level * weight)``, with one level for all.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    kinds = F.array(*[F.lit(int(x)) for x in weights])
    s = sizes.withColumn("_no", F.row_number().over(order) - 1).withColumn("weight", F.element_at(kinds, (F.col("_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_cap = W.orderBy(F.col("_cap") / F.col("weight"), "_no")
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget))
    s = s.withColumn("_level", (total - before) / rest).withColumn("_at", F.row_number().over(by_cap))
    s = s.withColumn("_level", F.min_by(F.when(F.col("_cap") / F.col("weight") >= F.col("_level"), F.col("_level")), F.when(F.col("_cap") / F.col("weight") >= F.col("_level"), F.col("_at"))).over(W.partitionBy()))
    return s.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap"))).drop("_no", "_cap", "_level", "_at")


def _with_targets(base: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with their source's targets, without sending the rows of a source to one task.

    One row a source is broadcast, if there are at most ``SOURCES`` of them; otherwise each is repeated for all ``SALTS`` salts, and so a source's rows
    fall into as many parts.
    """
    targets = cut(targets, NARROW)
    if targets.count() <= SOURCES:
        return base.join(F.broadcast(targets), "_s")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return base.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(targets.withColumn("_salt", salts), ["_s", "_salt"]).drop("_salt")


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", quality: DataFrame | None = None, budget: float = 1.5, most_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, epochs, sampled, taken (and the columns to carry).

    ``epochs`` is the number of complete passes, ``sampled`` whether the fractional pass takes the
    document, ``taken`` its words in the mix.  The document in which a budget ends is taken if that
    brings the source nearer to its target, so the error is at most half of that document.

    Null text: size 0, never sampled.  Null source: a source of its own, last in order.  ``quality`` is a table
    (doc_id, quality_weight); without a weight above 0 there, a document has weight 1.  Equal keys go by doc_id and size, and rows equal in all of
    these are interchangeable.  Other columns are ignored, whatever their names.  An empty table gives
    an empty result.
    """
    own = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")]
    base = docs.select(*own, *[F.col(c).alias(f"_c_{c}") for c in carry])  # texts go no further
    if quality is None:
        base = base.withColumn("_w", F.lit(1.0))
    else:
        of = quality.groupBy(F.col("doc_id").alias("_q")).agg(F.max("quality_weight").cast("double").alias("_w"))
        base = base.join(of, F.col("doc_id") == F.col("_q"), "left").drop("_q").withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0)))
    base = base.withColumn("_key", -F.log(unit_hash(F.col("doc_id"))) / F.col("_w")).drop("_w")
    base = base.withColumn("_cell", F.least(F.floor((1 - F.exp(-F.col("_key"))) * CELLS), F.lit(CELLS - 1)).cast("int"))
    base = cut(base.withColumn("_s", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))), NARROW)

    cells = base.groupBy("_s", "source", "_cell").agg(F.sum("size").alias("_words"))
    cells = cut(cells, NARROW)  # at most CELLS rows for each source
    targets = source_targets(cells.groupBy("_s", "source").agg(F.sum("_words").alias("source_size")), budget=budget, most_epochs=most_epochs, weights=weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", whole).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")).drop("source", "weight")

    upto = F.sum("_words").over(W.partitionBy("_s").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))
    ends = cells.select("_s", "_cell", "_words", upto.alias("_upto")).join(targets.select("_s", "_rest"), "_s")
    ends = ends.where("_rest > 0 and _upto >= _rest").groupBy("_s").agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_end"))
    targets = targets.join(ends.select("_s", F.col("_end._cell").alias("_last"), F.col("_end._before").alias("_before")), "_s", "left")

    rows = _with_targets(base, targets)
    clear = rows.where("_last is null or _cell <> _last").withColumn("sampled", F.coalesce(F.col("_cell") < F.col("_last"), F.lit(False)))
    order = W.partitionBy("_s").orderBy("_key", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0)
    last = rows.where("_cell = _last").withColumn("_upto", F.col("_before") + F.sum("size").over(order))
    last = last.withColumn("sampled", (F.col("_upto") <= F.col("_rest")) | ((F.col("_upto") - F.col("_rest") < F.col("_rest") - (F.col("_upto") - F.col("size"))))).drop("_upto")
    out = clear.unionByName(last)
    taken = F.col("size") * (F.col("epochs") + F.col("sampled").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "epochs", "sampled", taken.alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def apply_mix(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it (complete epochs and the fractional pass).

    Rows are told apart by (doc_id, source, text); where several are equal in these, the sum of their
    passes is dealt out among them evenly.
    """
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    rows = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    takes = mix_sources(rows, quality=None if labels is None else quality_weights(labels), carry=("sha", "source"), **options)
    passes = takes.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("o"), F.col("sha").alias("h")).agg(F.sum(F.col("epochs") + F.col("sampled").cast("long")).alias("passes"), F.count(F.lit(1)).alias("n"))
    one = passes.where("passes > 0")
    rows = rows.drop("text")
    mixed = rows.join(one, rows["doc_id"].eqNullSafe(one["d"]) & rows["source"].eqNullSafe(one["o"]) & (rows["sha"] == one["h"]))
    plain = mixed.where("n = 1")
    again = mixed.where("n > 1").withColumn("no", F.row_number().over(W.partitionBy("d", "o", "h").orderBy(F.lit(0))))
    again = again.withColumn("passes", F.floor(F.col("passes") / F.col("n")) + (F.col("no") <= F.col("passes") % F.col("n")).cast("long")).drop("no")
    out = plain.unionByName(again).where("passes > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("passes").cast("int"))))
    return out.select("row.*")
