"""Losses, calibration, ranks and agreement as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nll(p: Column, y: Column, clip: float = 1e-8) -> Column:
    """Bernoulli loss of a fractional outcome."""
    q = F.greatest(F.lit(clip), F.least(p, F.lit(1 - clip)))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def nll_from_logit(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z)))


def two_level_mean(df: DataFrame, by: list[str], unit: str, columns: dict[str, Column]) -> DataFrame:
    """Means over the rows of a unit, then over the units of each group."""
    low = df.groupBy(*by, unit).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    return low.groupBy(*by).agg(*[F.avg(n).alias(n) for n in columns])


def average_rank(column: str, by: list[str]) -> Column:
    """Ranks from 1, equal values sharing their mean rank."""
    return F.rank().over(W.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(W.partitionBy(*by, column)) - 1) / 2


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null if a side is constant."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group. Ranks come from counts of distinct values, so ties are aggregated before anything is ordered."""
    ranked = df.select(*by, x, y)
    for c in (x, y):
        counts = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, 0))
        ranks = counts.select(*by, c, (upto - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"_r_{c}"))
        ranked = ranked.join(ranks, [*by, c])
    return ranked.groupBy(*by).agg(F.round(safe_corr(f"_r_{x}", f"_r_{y}"), 6).alias("rho"))


def auc_ap(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """ROC AUC and average precision by group, from counts at each distinct score; null with a single class."""
    at = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    down = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    x = at.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down)).withColumn("below", F.sum(F.col("n") - F.col("pos")).over(up) - (F.col("n") - F.col("pos")))
    g = x.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum(F.col("n") - F.col("pos")).alias("_q"), F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)).alias("_u"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_a"))
    return g.select(*by, F.round(F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_u") / (F.col("_p") * F.col("_q"))), 6).alias("auc"), F.round(F.when(F.col("_p") > 0, F.col("_a") / F.col("_p")), 6).alias("ap"))


def equal_count_bins(df: DataFrame, by: list[str], order: list[str], bins: int, out: str = "bin") -> DataFrame:
    """Bins of equal counts; the first ones get one more where they do not divide."""
    return df.withColumn(out, F.ntile(bins).over(W.partitionBy(*by).orderBy(*order)))


def reliability(df: DataFrame, by: list[str], p: str, y: str, order: list[str], bins: int = 10) -> DataFrame:
    b = equal_count_bins(df, by, [p, *order], bins)
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def ece(df: DataFrame, by: list[str], p: str, y: str, order: list[str], bins: int = 10) -> DataFrame:
    b = equal_count_bins(df, by, [p, *order], bins).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("c"), F.avg(y).alias("a"))
    return b.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


def cohens_d(df: DataFrame, value: str, left: Column) -> Column:
    """Difference of two means over the pooled sample deviation, as an aggregate."""
    a, b = F.when(left, F.col(value)), F.when(~left, F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    return F.try_divide(F.avg(a) - F.avg(b), pooled)
