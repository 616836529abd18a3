"""Operators on ordered rows of a group: latest qualifying row, boundaries, prefixes, projections, crossings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def thresholds(df: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """Each row for each threshold: a generator, so no join is needed."""
    return df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))


def latest_above(df: DataFrame, keys: list[str], score: str, taus: tuple[float, ...], order: str = "ordinal") -> DataFrame:
    """For each group and threshold, the last place with a score of at least the threshold (null: none).

    One aggregate with a conditional maximum per threshold; thresholds become rows only afterwards.
    """
    parts = [F.struct(F.lit(float(t)).alias("tau"), F.max(F.when(F.col(score) >= t, F.col(order))).alias("chosen")) for t in taus]
    return df.groupBy(*keys).agg(F.array(*parts).alias("_all")).select(*keys, F.explode("_all").alias("_one")).select(*keys, "_one.tau", "_one.chosen")


def boundary_table(df: DataFrame, *, gamma: float, keys: tuple[str, ...] = ("trace_id", "domain"), truth: Column | None = None) -> DataFrame:
    """One row per trace: the predicted boundary (last place at or above gamma, else 0) and the true one."""
    truth = F.col("success_count") >= 2 if truth is None else truth
    return df.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("p") >= gamma, F.col("ordinal"))), F.lit(0)).alias("pred"),
        F.coalesce(F.max(F.when(truth, F.col("ordinal"))), F.lit(0)).alias("truth"),
        F.max("total_tokens").alias("total_tokens"),
    )


def retained_share(pred: Column, truth: Column) -> Column:
    return F.when(truth == 0, (pred == 0).cast("double")).otherwise(F.least(pred, truth) / truth)


def project_nonincreasing(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The closest non-increasing sequence in weighted least squares: blocks are pooled while they rise."""
    w = np.ones(len(values)) if weights is None else np.asarray(weights, float)
    means, sizes, counts = [], [], []
    for v, x in zip(values, w, strict=True):
        means.append(float(v))
        sizes.append(float(x))
        counts.append(1)
        while len(means) > 1 and means[-2] < means[-1]:
            total = sizes[-2] + sizes[-1]
            means[-2] = (means[-2] * sizes[-2] + means[-1] * sizes[-1]) / total
            sizes[-2] = total
            counts[-2] += counts[-1]
            del means[-1], sizes[-1], counts[-1]
    return np.repeat(means, counts)


def monotone_projection(df: DataFrame, *, keys: list[str], score: str = "p", order: str = "ordinal", out: str = "p_mono") -> DataFrame:
    """Adds the non-increasing projection of a score along each group.

    A group is collected to an array of (order, score) and projected by an Arrow function on arrays, so groups
    need no Python call each and no second shuffle.
    """

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        return values.map(lambda v: project_nonincreasing(np.asarray(v, float)))

    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s"))))
    arrays = df.groupBy(*keys).agg(own.alias("_a"))
    arrays = arrays.select(*keys, F.transform("_a", lambda x: x["o"]).alias("_o"), F.transform("_a", lambda x: x["s"]).alias("_s"))
    zipped = arrays.withColumn("_m", project("_s"))
    return zipped.select(*keys, F.explode(F.arrays_zip("_o", "_s", "_m")).alias("_z")).select(*keys, F.col("_z._o").alias(order), F.col("_z._s").alias(score), F.col("_z._m").alias(out))


def centred(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumns({f"{c}_centred": F.col(c) - F.avg(c).over(w) for c in columns})


def differences(df: DataFrame, keys: list[str], order: str, column: str, out: str = "diff") -> DataFrame:
    """Difference to the row before; 0 for the first."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0.0)))


def nested_prefixes(df: DataFrame, *, key: str, index: str, outcome: str, ks: tuple[int, ...]) -> DataFrame:
    """(key, k, success): successes among the first k outcomes, for groups with at least max(ks) of them."""
    some = df.where(F.col(index) < max(ks))
    parts = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col(index) < k, F.col(outcome)).otherwise(0)).alias("success")) for k in ks]
    whole = some.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array(*parts).alias("_all")).where(F.col("_n") == max(ks))
    return whole.select(key, F.explode("_all").alias("_x")).select(key, "_x.k", "_x.success")


def crossings(df: DataFrame, keys: list[str], order: str, value: str, level: float) -> DataFrame:
    """Per group: crossings of a level, re-entries after an exit, largest adjacent drop and gain, first downward crossing."""
    w = W.partitionBy(*keys).orderBy(order)
    flagged = df.withColumn("_in", (F.col(value) >= level).cast("int")).withColumn("_was", F.lag((F.col(value) >= level).cast("int")).over(w)).withColumn("_step", F.col(value) - F.lag(value).over(w))
    flagged = flagged.withColumn("_left", F.max(F.when((F.col("_was") == 1) & (F.col("_in") == 0), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return flagged.groupBy(*keys).agg(
        F.count_if(F.col("_in") != F.col("_was")).alias("crossings"),
        F.count_if((F.col("_in") == 1) & (F.col("_was") == 0) & (F.col("_left") == 1)).alias("reentries"),
        F.coalesce(-F.least(F.min("_step"), F.lit(0.0)), F.lit(0.0)).alias("largest_drop"),
        F.coalesce(F.greatest(F.max("_step"), F.lit(0.0)), F.lit(0.0)).alias("largest_gain"),
        F.min(F.when((F.col("_was") == 1) & (F.col("_in") == 0), F.col(order) - 1)).alias("first_down"),
    )
