"""Bundles of metrics: models of one outcome side by side, and what holds within traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins, metrics, resampling

#: A denominator up to this counts as zero.
EPSILON = 1e-12


def concordance(df: DataFrame, by: list[str], unit: str, order: str, score: str, outcome: str) -> DataFrame:
    """Share of a unit's pairs of different outcomes that the score orders alike (ties of the score: half), averaged over units."""
    pairs = joins.ordered_pairs(df, [*by, unit], order, [score, outcome]).where(F.col(f"l.{outcome}") != F.col(f"r.{outcome}"))
    alike = (F.col(f"l.{score}") > F.col(f"r.{score}")) == (F.col(f"l.{outcome}") > F.col(f"r.{outcome}"))
    one = F.when(F.col(f"l.{score}") == F.col(f"r.{score}"), 0.5).when(alike, 1.0).otherwise(0.0)
    return metrics.two_level_mean(pairs, by, unit, {"concordance": one})


def model_contrasts(df: DataFrame, *, models: dict[str, str], unit: str, order: str, outcome: str, axis: str, control: str, best: list[str], replicates: int, seed: str) -> DataFrame:
    """One row per model of ``models`` (name: logit column): losses, rank correlation, concordance, and how it compares with the axis.

    Losses are means of unit means.  ``eta`` is the share of the gain from control to the best of ``best`` (the first of equal ones) that the axis
    has, null without a gain.  ``gap`` is the axis's loss less the model's, with a bootstrap interval over units; all models share its draws.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("logit")) for n, c in models.items()]))
    long = df.select(unit, order, F.col(outcome).alias("y"), each.alias("m")).select(unit, order, "y", "m.model", "m.logit")
    loss = metrics.nll_from_logit(F.col("logit"), F.col("y"))
    scores = metrics.two_level_mean(long, ["model"], unit, {"nll": loss, "brier": F.pow(1 / (1 + F.exp(-F.col("logit"))) - F.col("y"), 2)})
    scores = scores.join(metrics.spearman(long, ["model"], "logit", "y"), "model").join(concordance(long, ["model"], unit, order, "logit", "y"), "model", "left")

    name, place = F.col("model"), F.array_position(F.array(*[F.lit(b) for b in best]), F.col("model"))
    ends = scores.agg(F.max(F.when(name == axis, F.col("nll"))).alias("a"), F.max(F.when(name == control, F.col("nll"))).alias("c"), F.min(F.when(place > 0, F.struct("nll", place.alias("place"), "model"))).alias("b"))
    gain = F.col("c") - F.col("b.nll")
    eta = F.when(F.abs(gain) > EPSILON, (F.col("c") - F.col("a")) / gain)

    others = [n for n in models if n != axis]
    own = lambda n: metrics.nll_from_logit(F.col(models[n]), F.col(outcome))
    units = df.groupBy(unit).agg(*[F.avg(own(axis) - own(n)).alias(f"d{i}") for i, n in enumerate(others)]).withColumn("all", F.lit("all"))
    reps = resampling.cluster_bootstrap(units, "all", unit, [f"d{i}" for i in range(len(others))], replicates, seed)
    tails = reps.agg(*[F.percentile(f"d{i}", [0.025, 0.975]).alias(f"d{i}") for i in range(len(others))])
    tails = tails.select(F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"d{i}").alias("q")) for i, n in enumerate(others)])).alias("t")).select("t.model", "t.q")

    r = lambda c: F.round(c, 6)
    out = scores.crossJoin(F.broadcast(ends)).join(tails, "model", "left")  # one row
    gap = F.when(name != axis, F.col("a") - F.col("nll"))
    return out.select("model", r("nll").alias("nll"), r("brier").alias("brier"), "rho", r("concordance").alias("concordance"), (name == F.col("b.model")).alias("best"), r(eta).alias("eta"), r(gap).alias("gap"), r(F.col("q")[0]).alias("lo"), r(F.col("q")[1]).alias("hi"))


def within_unit(df: DataFrame, *, by: list[str], unit: str, order: str, score: str, outcome: str) -> DataFrame:
    """By group: units, rows, correlations and slope of score and outcome less their unit's means, agreement of adjacent steps, median rank correlation of a unit.

    Centred values are rounded to nine digits, so that equal ones are ties.  Steps without a change of the outcome say nothing.
    """
    whole, steps = W.partitionBy(*by, unit), W.partitionBy(*by, unit).orderBy(order)
    centred = lambda c: F.round(F.col(c) - F.avg(c).over(whole), 9)
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(steps))
    rows = df.select(*by, unit, score, outcome, centred(score).alias("x"), centred(outcome).alias("z"), step(score).alias("dx"), step(outcome).alias("dz"))
    moved = F.col("dz") != 0
    low = rows.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("z")).alias("xz"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.count_if(moved).alias("moved"), F.count_if(moved & (F.col("dx") == F.col("dz"))).alias("agree"))
    g = low.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *[F.sum(c).alias(c) for c in ("n", "xx", "xz", "zz", "moved", "agree")])
    median = metrics.spearman(rows, [*by, unit], score, outcome).groupBy(*by).agg(F.percentile("rho", 0.5).alias("median_rho"))
    out = g.join(metrics.spearman(rows, by, "x", "z"), by).join(median, by)
    some = lambda c: F.col(c) > EPSILON
    return out.select(
        *by, "units", F.col("n").alias("rows"), F.round(F.when(some("xx") & some("zz"), F.col("xz") / F.sqrt(F.col("xx") * F.col("zz"))), 6).alias("pearson"), "rho",
        F.round(F.when(some("xx"), F.col("xz") / F.col("xx")), 6).alias("slope"), F.round(F.try_divide("agree", "moved"), 6).alias("adjacent"), F.round("median_rho", 6).alias("median_rho"),
    )
