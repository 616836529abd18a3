"""Threshold policies over ordered checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, policy
from ..registry import query
from .views import CK, checkpoints

#: Thresholds of the study.
TAUS = (0.0, 0.5, 0.75, 1.0)

_ACTIONS = CK + """, taus as (select unnest([0e0, 0.5e0, 0.75e0, 1e0]) as tau),
actions as (
  select tau, base_model, trace_id, any_value(domain) as domain, any_value(total_tokens) as total_tokens,
    max(ordinal) filter (where p >= tau and tau < 1) as selected,
    max_by(prefix_tokens, ordinal) filter (where p >= tau and tau < 1) as kept_tokens,
    max_by(success_count, ordinal) filter (where p >= tau and tau < 1) as success_count,
    min_by(success_count, ordinal) as full_success
  from ck cross join taus group by tau, base_model, trace_id),
ev as (
  select *, selected is null as fallback, coalesce(success_count, full_success) / 4e0 as success,
    coalesce(kept_tokens, 0e0) / total_tokens as retained, total_tokens - coalesce(kept_tokens, 0e0) as fresh
  from actions)
"""


def actions(spark, d):
    return policy.evaluate_thresholds(checkpoints(spark, d), TAUS)


@query("policy_by_threshold", "WIN01 JOI14 JOI03 MET21 FIL12", f"""with {_ACTIONS}
select tau, base_model, count(*) as traces, round(avg(fallback::int), 6) as fallback_rate, round(avg(success), 6) as policy_success,
  round(avg(retained), 6) as retained from ev group by tau, base_model""")
def policy_by_threshold(spark, d):
    return (
        actions(spark, d).groupBy("tau", "base_model")
        .agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"), F.round(F.avg("success"), 6).alias("policy_success"), F.round(F.avg("retained"), 6).alias("retained"))
    )


_MACRO = _ACTIONS + """, by_model as (select tau, base_model, avg(success) as s, avg(fresh) as t, avg(fallback::int) as f, count(*) as n from ev group by tau, base_model),
curve as (select tau, avg(s) as macro_success, avg(t) as macro_tokens, avg(f) as fallback_rate from by_model group by tau)
"""


@query("policy_macro_curve", "AGG15 AGG16 MET21", f"""with {_MACRO}, wm as (
  select tau, fresh, sum(w) over (partition by tau order by fresh, w rows between unbounded preceding and current row) as c
  from (select tau, fresh, 0.25e0 / n as w from ev join by_model using (tau, base_model)) x),
med as (select tau, min(fresh) as weighted_median_tokens from wm where c >= 0.5e0 - 1e-9 group by tau)
select tau, round(macro_success, 6) as macro_success, round(macro_tokens, 6) as macro_tokens, weighted_median_tokens,
  fallback_rate <= 0.25e0 as coverage_pass from curve join med using (tau)""")
def policy_macro_curve(spark, d):
    ev = actions(spark, d)
    curve = policy.macro_curve(ev)
    median = policy.weighted_lower_median(ev, "tau", "base_model", "fresh")
    return curve.join(median, "tau").select("tau", F.round("macro_success", 6).alias("macro_success"), F.round("macro_tokens", 6).alias("macro_tokens"), F.col("median").alias("weighted_median_tokens"), (F.col("fallback_rate") <= 0.25).alias("coverage_pass"))


@query("policy_select_tau", "TOP14", f"""with {_MACRO}, least as (select min(macro_tokens) as m from curve)
select max(tau) as selected_tau, round(any_value(m), 6) as min_tokens from curve, least where macro_tokens <= m * 1.01e0""")
def policy_select_tau(spark, d):
    return policy.cheapest_threshold(policy.macro_curve(actions(spark, d)), within=0.01).select("selected_tau", F.round("min_tokens", 6).alias("min_tokens"))


@query("pareto_frontier", "MET22", f"""with {_MACRO}
select tau, round(macro_success, 6) as success, round(macro_tokens, 6) as tokens, not exists (
  select 1 from curve o where o.macro_success >= c.macro_success - 1e-12 and o.macro_tokens <= c.macro_tokens + 1e-12
    and (o.macro_success > c.macro_success + 1e-12 or o.macro_tokens < c.macro_tokens - 1e-12)) as nondominated
from curve c""")
def pareto_frontier(spark, d):
    out = policy.pareto(policy.macro_curve(actions(spark, d)), "tau", "macro_success", "macro_tokens")
    return out.select("tau", F.round("macro_success", 6).alias("success"), F.round("macro_tokens", 6).alias("tokens"), "nondominated")


@query("fixed_baselines", "WIN02", f"""with {CK}, t as (select trace_id, any_value(total_tokens) as total_tokens,
  max_by(success_count, ordinal) as latest, max_by(prefix_tokens, ordinal) as latest_t, min_by(success_count, ordinal) as earliest, min_by(prefix_tokens, ordinal) as earliest_t,
  max_by(success_count, ordinal) filter (where prefix_tokens <= 0.75e0 * total_tokens) as r25, max_by(prefix_tokens, ordinal) filter (where prefix_tokens <= 0.75e0 * total_tokens) as r25_t,
  max_by(success_count, ordinal) filter (where prefix_tokens <= 0.5e0 * total_tokens) as r50, max_by(prefix_tokens, ordinal) filter (where prefix_tokens <= 0.5e0 * total_tokens) as r50_t,
  max_by(success_count, ordinal) filter (where prefix_tokens <= 0.25e0 * total_tokens) as r75, max_by(prefix_tokens, ordinal) filter (where prefix_tokens <= 0.25e0 * total_tokens) as r75_t
  from ck group by trace_id),
l as (select 'latest' as baseline, latest as s, latest_t as k, total_tokens from t union all select 'earliest', earliest, earliest_t, total_tokens from t
  union all select 'rewind_25', r25, r25_t, total_tokens from t union all select 'rewind_50', r50, r50_t, total_tokens from t union all select 'rewind_75', r75, r75_t, total_tokens from t)
select baseline, count(*) as traces, count(s) as found, round(avg(s / 4e0), 6) as success, round(avg(coalesce(k, 0) / total_tokens), 6) as retained from l group by baseline""")
def fixed_baselines(spark, d):
    return policy.fixed_baselines(checkpoints(spark, d), rewinds=(0.25, 0.5, 0.75)).groupBy("baseline").agg(
        F.count(F.lit(1)).alias("traces"), F.count("success_count").alias("found"), F.round(F.avg(F.col("success_count") / 4), 6).alias("success"), F.round(F.avg(F.coalesce("prefix_tokens", F.lit(0.0)) / F.col("total_tokens")), 6).alias("retained")
    )


@query("threshold_sweep_oracle", "WIN03", f"""with {CK}, taus as (select unnest([0e0, 0.5e0, 0.75e0, 1e0]) as tau),
t as (select tau, trace_id, any_value(total_tokens) as total, max(ordinal) filter (where p >= tau) as chosen, max(ordinal) filter (where success_count > 0) as best,
  max_by(prefix_tokens, ordinal) filter (where p >= tau) as kept from ck cross join taus group by tau, trace_id)
select tau, round(avg((chosen is not null)::int), 6) as selection_fraction, round(avg((coalesce(chosen, -1) > coalesce(best, -1))::int), 6) as dangerous_late,
  round(avg((total - coalesce(kept, 0)) / total), 6) as rewind from t group by tau""")
def threshold_sweep_oracle(spark, d):
    t = policy.sweep(checkpoints(spark, d), TAUS)
    return t.groupBy("tau").agg(
        F.round(F.avg(F.col("chosen").isNotNull().cast("int")), 6).alias("selection_fraction"), F.round(F.avg((F.coalesce("chosen", F.lit(-1)) > F.coalesce("best", F.lit(-1))).cast("int")), 6).alias("dangerous_late"),
        F.round(F.avg((F.col("total_tokens") - F.coalesce("kept", F.lit(0.0))) / F.col("total_tokens")), 6).alias("rewind"),
    )


@query("seed_agreement", "JOI12", f"""with {CK}, v as (select trace_id, ordinal, base_model, unnest(['a', 'b', 'c']) as variant, unnest([raw_logit, logit_b, logit_c]) as z from ck),
taus as (select unnest([0.5e0, 0.75e0]) as tau),
s as (select base_model, trace_id, variant, tau, max(ordinal) filter (where 1 / (1 + exp(-z)) >= tau) as chosen from v cross join taus group by all)
select l.variant as left_variant, r.variant as right_variant, l.tau, count(*) as traces, round(avg((l.chosen is not distinct from r.chosen)::int), 6) as exact_agreement
from s l join s r on l.trace_id = r.trace_id and l.tau = r.tau and l.variant < r.variant group by all""")
def seed_agreement(spark, d):
    ck = checkpoints(spark, d)
    v = ck.select("trace_id", "ordinal", F.explode(F.create_map(F.lit("a"), "raw_logit", F.lit("b"), "logit_b", F.lit("c"), "logit_c")).alias("variant", "z"))
    chosen = ordered.latest_above(v.withColumn("p", 1 / (1 + F.exp(-F.col("z")))), ["trace_id", "variant"], "p", (0.5, 0.75))
    return policy.variant_agreement(chosen, ["trace_id", "tau"], "variant", "chosen")


@query("policy_consistency", "MET24", f"""with {_ACTIONS}, latest as (select trace_id, max_by(prefix_tokens, ordinal) as kept from ck group by trace_id)
select count(*) as traces, count(*) filter (where abs(coalesce(kept_tokens, 0) - kept) > 1e-9) as violations from ev join latest using (trace_id) where tau = 0""")
def policy_consistency(spark, d):
    zero = actions(spark, d).where("tau = 0").select("trace_id", F.coalesce("kept_tokens", F.lit(0.0)).alias("kept_tokens"))
    latest = checkpoints(spark, d).groupBy("trace_id").agg(F.max_by("prefix_tokens", "ordinal").alias("kept"))
    return zero.join(latest, "trace_id").agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.abs(F.col("kept_tokens") - F.col("kept")) > 1e-9).alias("violations"))


@query("boundary_records_metrics", "WIN04 MET09", f"""with {CK}, t as (select trace_id, any_value(domain) as domain, any_value(total_tokens) as total, coalesce(max(ordinal) filter (where p >= 0.5e0), 0) as pred,
  coalesce(max(ordinal) filter (where success_count >= 2), 0) as truth from ck group by trace_id)
select domain, count(*) as traces, round(avg((pred = truth)::int), 6) as exact, round(avg((abs(pred - truth) <= 1)::int), 6) as within_one, round(avg(abs(pred - truth)), 6) as mae,
  round(avg((pred > truth)::int), 6) as late, round(avg((pred < truth)::int), 6) as early,
  round(avg(case when truth = 0 then (pred = 0)::int::double else least(pred, truth) / truth::double end), 6) as retained from t group by domain""")
def boundary_records_metrics(spark, d):
    return policy.boundary_metrics(ordered.boundary_table(checkpoints(spark, d), gamma=0.5), "domain")


@query("gate_cutoff_audit", "TOP14 WIN04", f"""with {CK}, g as (select distinct round(p, 2) as gamma from ck),
t as (select gamma, trace_id, coalesce(max(ordinal) filter (where p >= gamma), 0) as pred, coalesce(max(ordinal) filter (where success_count >= 2), 0) as truth from ck cross join g group by all),
m as (select gamma, round(avg((pred > truth)::int), 6) as late_rate, round(avg(case when truth = 0 then (pred = 0)::int::double else least(pred, truth) / truth::double end), 6) as retained from t group by gamma)
select *, gamma = (select max_by(gamma, (retained, gamma)) from m where late_rate <= 0.2e0) as selected from m""")
def gate_cutoff_audit(spark, d):
    return policy.gate_cutoffs(checkpoints(spark, d), max_late=0.2)


@query("unsafe_span_metrics", "AGG18", f"""with {CK}, taus as (select unnest([0.3e0, 0.5e0]) as tau),
t as (select tau, trace_id, coalesce(min(ordinal) filter (where success_count < 2), max(ordinal) + 1) as truth, coalesce(min(ordinal) filter (where p < tau), max(ordinal) + 1) as pred,
 count(*) filter (where p < tau) = 0 as uncrossed from ck cross join taus group by all)
select tau, round(avg((pred = truth)::int), 6) as exact, round(avg((abs(pred - truth) <= 1)::int), 6) as within_one, round(avg(abs(pred - truth)), 6) as mae, round(avg((pred < truth)::int), 6) as early,
 round(avg((pred > truth)::int), 6) as late, round(avg(uncrossed::int), 6) as no_crossing from t group by tau""")
def unsafe_span_metrics(spark, d):
    return policy.unsafe_spans(checkpoints(spark, d), (0.3, 0.5))
