"""Bootstrap, sign flips and permutations with hashed draws.

Draws come from hashes of (seed, replicate, slot), so every engine and every run sees the same ones.  Resampling works on one row per
cluster with its sufficient statistics, never on the rows below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(n: Column, *parts: Column) -> Column:
    """A hashed draw from 0 to n - 1: 52 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % n


#: Chances that a unit is drawn 0, 0 to 1, 0 to 2, ... times: the Poisson law of mean 1.
DRAWN = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12))


def spread(units: DataFrame, unit: str) -> DataFrame:
    """The units in as many parts as the session works on: each becomes a row for every replicate, so that even few of them are work for all."""
    spark = units.sparkSession
    return units.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), unit)


def cluster_bootstrap(units: DataFrame, stratum: str, unit: str, columns: list[str], replicates: int, seed: str) -> DataFrame:
    """(stratum, rep, *columns): means of resampled units, by stratum.

    How often a replicate draws a unit follows the Poisson law of mean 1, from a hash of (seed, stratum, replicate, unit).  So no
    unit has to know of any other: units are read once, and each task only passes on its sums for every stratum and replicate.
    """
    reps = spread(units, unit).select(stratum, unit, *columns, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    u = draw(F.lit(1 << 52), F.lit(seed), F.col(stratum), F.col("rep"), F.col(unit)) / F.lit(float(1 << 52))
    times = sum((F.when(F.col("_u") >= p, 1).otherwise(0) for p in DRAWN), F.lit(0))
    drawn = reps.withColumn("_u", u).withColumn("_k", times)
    return drawn.groupBy(stratum, "rep").agg(*[(F.sum(F.col("_k") * F.col(c)) / F.sum("_k")).alias(c) for c in columns])


def interval(reps: DataFrame, by: list[str], column: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a replicate column."""
    tail = (1 - level) / 2
    q = F.percentile(column, [tail, 1 - tail])
    return reps.groupBy(*by).agg(q.alias("_q")).select(*by, F.round(F.col("_q")[0], 6).alias("lo"), F.round(F.col("_q")[1], 6).alias("hi"))


def sign_flip_p(units: DataFrame, unit: str, value: str, replicates: int, seed: str) -> DataFrame:
    """One-sided p of the mean under random signs, with the +1 correction."""
    flips = spread(units, unit).select(unit, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    sign = 1 - 2 * draw(F.lit(2), F.lit(seed), F.col("rep"), F.col(unit))
    means = flips.groupBy("rep").agg(F.sum(sign * F.col(value)).alias("m"))
    observed = units.agg(F.sum(value).alias("o"))
    j = means.crossJoin(F.broadcast(observed))  # one row
    return j.agg(F.count_if(F.col("m") >= F.col("o") - 1e-12).alias("at_least"), ((F.count_if(F.col("m") >= F.col("o") - 1e-12) + 1) / (F.lit(replicates) + 1)).alias("p"))


def permutation_null(df: DataFrame, group: str, unit: str, x: str, y: str, replicates: int, seed: str) -> DataFrame:
    """(rep, stat): the mean of x * y with y permuted within groups; replicate -1 is the observed one.

    A permutation orders a group's rows by a hash; x keeps its own order, and the two meet by rank.
    """
    own = W.partitionBy(group).orderBy(unit)
    base = df.select(group, unit, x, y).withColumn("_rank", F.row_number().over(own))
    reps = base.select(group, unit, y, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    mixed = reps.withColumn("_rank", F.row_number().over(W.partitionBy(group, "rep").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col(unit))), unit)))
    j = mixed.select(group, "rep", "_rank", y).join(base.select(group, "_rank", x), [group, "_rank"])
    null = j.groupBy("rep").agg(F.avg(F.col(x) * F.col(y)).alias("stat"))
    return null.unionByName(base.agg(F.lit(-1).alias("rep"), F.avg(F.col(x) * F.col(y)).alias("stat")))


def holm(ps: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p values: the running maximum of (m - rank + 1) p, at most 1."""
    w = W.orderBy(p, name)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(W.partitionBy()) - F.row_number().over(w) + 1) * F.col(p))
    return ps.withColumn("_s", scaled).withColumn("adjusted", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")
