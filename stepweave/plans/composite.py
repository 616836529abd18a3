"""Bundles of metrics on the checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite
from ..registry import query
from .selection import _TIMES, _draw
from .views import CK, checkpoints

_MODELS = {"axis_only": "raw_logit", "control": "logit_c", "full_state": "logit_b", "axis_plus_residual": "mixed"}
_LONG = " union all ".join(f"select trace_id, ordinal, success_count / 4e0 as y, '{n}' as model, {'raw_logit * 0.5e0 + logit_b * 0.25e0' if c == 'mixed' else c} as z from ck" for n, c in _MODELS.items())


@query("model_contrasts", "MET15", f"""with {CK}, lg as ({_LONG}),
 l as (select model, trace_id, avg(greatest(z, 0) - y * z + ln(1 + exp(-abs(z)))) as n, avg(pow(1 / (1 + exp(-z)) - y, 2)) as b from lg group by all), s as (select model, avg(n) as n, avg(b) as b from l group by model),
 r as (select model, rank() over (partition by model order by z) + (count(*) over (partition by model, z) - 1) / 2e0 as a, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2e0 as b from lg), rh as (select model, corr(a, b) as rho from r group by model),
 pr as (select a.model, a.trace_id, case when a.z = b.z then 0.5e0 when (a.z > b.z) = (a.y > b.y) then 1e0 else 0e0 end as c from lg a join lg b on a.model = b.model and a.trace_id = b.trace_id and a.ordinal < b.ordinal and a.y <> b.y),
 ct as (select model, trace_id, avg(c) as c from pr group by all), cc as (select model, avg(c) as c from ct group by model),
 e as (select max(n) filter (where model = 'axis_only') as a, max(n) filter (where model = 'control') as c, min(n) filter (where model in ('axis_plus_residual', 'full_state')) as f from s),
 d as (select l.model, l.trace_id, a.n - l.n as d from l join l a using (trace_id) where a.model = 'axis_only' and l.model <> 'axis_only'),
 dr as (select model, rep, d, {_draw('4503599627370496', "'gap'", "'all'", 'rep', 'trace_id')} / 4503599627370496e0 as u from (select *, unnest(range(40)) as rep from d)), k as (select model, rep, d, {_TIMES} as k from dr),
 m as (select model, rep, sum(k * d) / sum(k) as g from k group by all), q as (select model, quantile_cont(g, 0.025e0) as lo, quantile_cont(g, 0.975e0) as hi from m group by model)
select model, round(n, 6) as nll, round(s.b, 6) as brier, round(rho, 6) as rho, round(cc.c, 6) as concordance, n = f and model in ('axis_plus_residual', 'full_state') as best, round((e.c - a) / (e.c - f), 6) as eta,
 case when model <> 'axis_only' then round(a - n, 6) end as gap, round(lo, 6) as lo, round(hi, 6) as hi from s join rh using (model) left join cc using (model) left join q using (model) cross join e""")
def model_contrasts(spark, d):
    ck = checkpoints(spark, d).withColumn("y", F.col("success_count") / 4).withColumn("mixed", F.col("raw_logit") * 0.5 + F.col("logit_b") * 0.25)
    return composite.model_contrasts(ck, models=_MODELS, unit="trace_id", order="ordinal", outcome="y", axis="axis_only", control="control", best=["axis_plus_residual", "full_state"], replicates=40, seed="gap")


@query("within_trace_suite", "MET15 MET05 WIN06 WIN07", f"""with {CK}, c as (select base_model, trace_id, raw_logit, success_count / 4e0 as y, round(raw_logit - avg(raw_logit) over t, 9) as x, round(success_count / 4e0 - avg(success_count / 4e0) over t, 9) as z,
  sign(raw_logit - lag(raw_logit) over o) as dx, sign(success_count - lag(success_count) over o) as dz from ck window t as (partition by trace_id), o as (partition by trace_id order by ordinal)),
 g as (select base_model, count(distinct trace_id) as units, count(*) as n, sum(x * x) as xx, sum(x * z) as xz, sum(z * z) as zz, avg((dx = dz)::int) filter (where dz <> 0) as adjacent from c group by base_model),
 r as (select base_model, rank() over (partition by base_model order by x) + (count(*) over (partition by base_model, x) - 1) / 2e0 as a, rank() over (partition by base_model order by z) + (count(*) over (partition by base_model, z) - 1) / 2e0 as b from c), p as (select base_model, corr(a, b) as rho from r group by base_model),
 tr as (select base_model, trace_id, rank() over (partition by trace_id order by raw_logit) + (count(*) over (partition by trace_id, raw_logit) - 1) / 2e0 as a, rank() over (partition by trace_id order by y) + (count(*) over (partition by trace_id, y) - 1) / 2e0 as b from c),
 o as (select base_model, trace_id, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 6) end as rho from tr group by all), m as (select base_model, quantile_cont(rho, 0.5e0) as median_rho from o group by base_model)
select base_model, units, n as rows, round(xz / sqrt(xx * zz), 6) as pearson, round(rho, 6) as rho, round(xz / xx, 6) as slope, round(adjacent, 6) as adjacent, round(median_rho, 6) as median_rho from g join p using (base_model) join m using (base_model)""")
def within_trace_suite(spark, d):
    ck = checkpoints(spark, d).withColumn("y", F.col("success_count") / 4)
    return composite.within_unit(ck, by=["base_model"], unit="trace_id", order="ordinal", score="raw_logit", outcome="y")
