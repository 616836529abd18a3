"""Threshold policies: which checkpoint to continue from, what it costs, and which threshold to choose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import boundary_table, latest_above, retained_share

#: Columns that a selection must not see.
OUTCOMES = frozenset({"success_count", "num_rollouts", "binary_outcome", "success", "outcome", "verifier_outcome"})


def blind(df: DataFrame) -> DataFrame:
    """Raises if an outcome column is in reach of a selection."""
    seen = sorted(OUTCOMES & set(df.columns))
    if seen:
        raise ValueError(f"the selection can see outcomes: {seen}")
    return df


def select_actions(ck: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """(trace_id, tau, chosen): the latest checkpoint whose probability reaches the threshold; a threshold of 1 always falls back."""
    inputs = blind(ck.select("trace_id", "ordinal", "p"))
    chosen = latest_above(inputs, ["trace_id"], "p", taus)
    return chosen.withColumn("chosen", F.when(F.col("tau") < 1, F.col("chosen")))


def evaluate(actions: DataFrame, ck: DataFrame) -> DataFrame:
    """Actions with their outcome: success, retained share and fresh tokens; without a checkpoint, the whole trace is done again.

    The chosen checkpoint is looked up from the trace's array, so the join is on the trace alone.
    """
    per_trace = ck.groupBy("trace_id", "base_model", "domain", "total_tokens").agg(
        F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct("prefix_tokens", "success_count")))).alias("_at"), F.min_by("success_count", "ordinal").alias("full_success")
    )
    j = actions.join(per_trace, "trace_id").withColumn("_c", F.try_element_at("_at", "chosen"))
    return j.select(
        "tau", "base_model", "trace_id", "domain", "chosen", "total_tokens", F.col("chosen").isNull().alias("fallback"), F.col("_c.prefix_tokens").alias("kept_tokens"),
        (F.coalesce("_c.success_count", "full_success") / 4).alias("success"), (F.coalesce("_c.prefix_tokens", F.lit(0.0)) / F.col("total_tokens")).alias("retained"),
        (F.col("total_tokens") - F.coalesce("_c.prefix_tokens", F.lit(0.0))).alias("fresh"),
    )


def evaluate_thresholds(ck: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """``evaluate(select_actions(...))`` in one aggregate: the choice still depends on places and probabilities alone, and its outcome is carried along.

    One shuffle by trace, and no join.
    """
    row = F.struct("ordinal", "prefix_tokens", "success_count")  # ordinals differ, so the maximum is that of the ordinal
    parts = [F.struct(F.lit(float(t)).alias("tau"), (F.max(F.when(F.col("p") >= t, row)) if t < 1 else F.max(F.when(F.lit(False), row))).alias("c")) for t in taus]
    per = ck.groupBy("trace_id", "base_model", "domain", "total_tokens").agg(F.array(*parts).alias("_a"), F.min_by("success_count", "ordinal").alias("_full"))
    x = per.select("trace_id", "base_model", "domain", "total_tokens", "_full", F.explode("_a").alias("_x")).select("*", F.col("_x.tau").alias("tau"), F.col("_x.c").alias("_c"))
    return x.select(
        "tau", "base_model", "trace_id", "domain", F.col("_c.ordinal").alias("chosen"), "total_tokens", F.col("_c").isNull().alias("fallback"), F.col("_c.prefix_tokens").alias("kept_tokens"),
        (F.coalesce("_c.success_count", "_full") / 4).alias("success"), (F.coalesce("_c.prefix_tokens", F.lit(0.0)) / F.col("total_tokens")).alias("retained"),
        (F.col("total_tokens") - F.coalesce("_c.prefix_tokens", F.lit(0.0))).alias("fresh"),
    )


def macro_curve(ev: DataFrame) -> DataFrame:
    """By threshold: means of the models' means."""
    by_model = ev.groupBy("tau", "base_model").agg(F.avg("success").alias("s"), F.avg("fresh").alias("t"), F.avg(F.col("fallback").cast("int")).alias("f"))
    return by_model.groupBy("tau").agg(F.avg("s").alias("macro_success"), F.avg("t").alias("macro_tokens"), F.avg("f").alias("fallback_rate"))


def weighted_lower_median(ev: DataFrame, by: str, model: str, value: str, models: int = 4) -> DataFrame:
    """(by, median): the first value at which the weights, equal for each model, reach a half."""
    weighted = ev.select(by, value, (F.lit(1.0 / models) / F.count(F.lit(1)).over(W.partitionBy(by, model))).alias("_w"))
    sums = weighted.groupBy(by, value).agg(F.sum("_w").alias("_w"))
    upto = F.sum("_w").over(W.partitionBy(by).orderBy(value))
    return sums.withColumn("_c", upto).where(F.col("_c") >= 0.5 - 1e-9).groupBy(by).agg(F.min(value).alias("median"))


def cheapest_threshold(curve: DataFrame, *, within: float) -> DataFrame:
    """The highest threshold whose cost is within a share of the least."""
    least = curve.agg(F.min("macro_tokens").alias("min_tokens"))
    return curve.join(F.broadcast(least), F.col("macro_tokens") <= F.col("min_tokens") * (1 + within)).agg(F.max("tau").alias("selected_tau"), F.max("min_tokens").alias("min_tokens"))


def pareto(curve: DataFrame, key: str, gain: str, cost: str, eps: float = 1e-12) -> DataFrame:
    """Adds ``nondominated``: no other point is at least as good in both and better in one.

    Points are sorted by cost: a point is dominated if a cheaper or equally cheap one gains as much and one of
    the two is strict, which running maxima show; no pairs are formed.
    """
    cheaper = F.expr(f"max({gain}) over (order by {cost} range between unbounded preceding and {eps!r}D preceding)")
    as_cheap = F.expr(f"max({gain}) over (order by {cost} range between unbounded preceding and {eps!r}D following)")
    return curve.withColumn("nondominated", ~(F.coalesce(cheaper >= F.col(gain) - eps, F.lit(False)) | (as_cheap > F.col(gain) + eps)))


def fixed_baselines(ck: DataFrame, rewinds: tuple[float, ...]) -> DataFrame:
    """(baseline, trace_id, success_count, prefix_tokens, total_tokens): latest, earliest, and the last checkpoint after a rewind."""
    at = F.struct("success_count", "prefix_tokens")
    kinds = [F.struct(F.lit("latest").alias("b"), F.max_by(at, "ordinal").alias("v")), F.struct(F.lit("earliest").alias("b"), F.min_by(at, "ordinal").alias("v"))]
    for r in rewinds:
        inside = F.when(F.col("prefix_tokens") <= (1 - r) * F.col("total_tokens"), F.col("ordinal"))
        kinds.append(F.struct(F.lit(f"rewind_{round(100 * r)}").alias("b"), F.max_by(F.when(inside.isNotNull(), at), inside).alias("v")))
    out = ck.groupBy("trace_id", "total_tokens").agg(F.array(*kinds).alias("_k")).select("trace_id", "total_tokens", F.explode("_k").alias("_x"))
    return out.select(F.col("_x.b").alias("baseline"), "trace_id", F.col("_x.v.success_count").alias("success_count"), F.col("_x.v.prefix_tokens").alias("prefix_tokens"), "total_tokens")


def sweep(ck: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """(tau, trace_id, chosen, kept, best, total_tokens): the choice at each threshold and the latest checkpoint that ever succeeded."""
    at = [F.struct(F.lit(float(t)).alias("tau"), F.max(F.when(F.col("p") >= t, F.struct("ordinal", "prefix_tokens"))).alias("c")) for t in taus]
    out = ck.groupBy("trace_id", "total_tokens").agg(F.array(*at).alias("_a"), F.max(F.when(F.col("success_count") > 0, F.col("ordinal"))).alias("best"))
    return out.select("trace_id", "total_tokens", "best", F.explode("_a").alias("_x")).select("_x.tau", "trace_id", F.col("_x.c.ordinal").alias("chosen"), F.col("_x.c.prefix_tokens").alias("kept"), "best", "total_tokens")


def variant_agreement(chosen: DataFrame, keys: list[str], variant: str, value: str) -> DataFrame:
    """By pair of variants and threshold: how often both make the same choice.

    Variants of a key meet in one aggregate; pairs are formed in its array of a few variants.
    """
    own = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(variant).alias("v"), F.col(value).alias("c")))).alias("_a"))
    pairs = F.flatten(F.transform("_a", lambda x: F.transform(F.filter("_a", lambda y: y["v"] > x["v"]), lambda y: F.struct(x["v"].alias("l"), y["v"].alias("r"), x["c"].eqNullSafe(y["c"]).cast("int").alias("same")))))
    flat = own.select(*keys, F.explode(pairs).alias("_p"))
    return flat.groupBy(F.col("_p.l").alias("left_variant"), F.col("_p.r").alias("right_variant"), "tau").agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg("_p.same"), 6).alias("exact_agreement"))


def boundary_metrics(table: DataFrame, by: str) -> DataFrame:
    off = F.col("pred") - F.col("truth")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table.groupBy(by).agg(
        F.count(F.lit(1)).alias("traces"), share(off == 0).alias("exact"), share(F.abs(off) <= 1).alias("within_one"), F.round(F.avg(F.abs(off)), 6).alias("mae"),
        share(off > 0).alias("late"), share(off < 0).alias("early"), F.round(F.avg(retained_share(F.col("pred"), F.col("truth"))), 6).alias("retained"),
    )


def gate_cutoffs(ck: DataFrame, *, max_late: float) -> DataFrame:
    """For each two-digit cutoff: late rate and retained share; the feasible one that retains most (the highest, if equal) is selected.

    Probabilities are cut to two digits, so there are at most 101 cutoffs; the grid is theirs.
    """
    gammas = F.broadcast(ck.select(F.round("p", 2).alias("gamma")).distinct())
    # a trace is an array of its checkpoints, so that the grid multiplies traces and not their rows
    per = ck.groupBy("trace_id").agg(F.collect_list(F.struct("p", "ordinal")).alias("_a"), F.coalesce(F.max(F.when(F.col("success_count") >= 2, F.col("ordinal"))), F.lit(0)).alias("truth"))
    t = per.crossJoin(gammas).withColumn("pred", F.coalesce(F.array_max(F.transform(F.filter("_a", lambda x: x["p"] >= F.col("gamma")), lambda x: x["ordinal"])), F.lit(0)))
    m = t.groupBy("gamma").agg(F.round(F.avg((F.col("pred") > F.col("truth")).cast("int")), 6).alias("late_rate"), F.round(F.avg(retained_share(F.col("pred"), F.col("truth"))), 6).alias("retained"))
    best = F.max(F.when(F.col("late_rate") <= max_late, F.struct("retained", "gamma"))).over(W.partitionBy())
    return m.withColumn("selected", F.col("gamma") == best["gamma"])


def unsafe_spans(ck: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """First unsafe place (fewer than half succeed) against the first place below each threshold; the end if there is none."""
    end = F.max("ordinal") + 1
    parts = [F.struct(F.lit(float(t)).alias("tau"), F.coalesce(F.min(F.when(F.col("p") < t, F.col("ordinal"))), end).alias("pred"), (F.count_if(F.col("p") < t) == 0).alias("none")) for t in taus]
    per = ck.groupBy("trace_id").agg(F.coalesce(F.min(F.when(F.col("success_count") < 2, F.col("ordinal"))), end).alias("truth"), F.array(*parts).alias("_a"))
    t = per.select("truth", F.explode("_a").alias("_x")).select("truth", "_x.*")
    off = F.col("pred") - F.col("truth")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return t.groupBy("tau").agg(share(off == 0).alias("exact"), share(F.abs(off) <= 1).alias("within_one"), F.round(F.avg(F.abs(off)), 6).alias("mae"), share(off < 0).alias("early"), share(off > 0).alias("late"), share(F.col("none")).alias("no_crossing"))


def traces_with_boundary(ck: DataFrame, gamma: float) -> DataFrame:
    return boundary_table(ck, gamma=gamma)
