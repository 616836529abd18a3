"""Source operators on JSON texts and vectors, audits, and probe matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting, integrity
from ..registry import query
from ..sources import sinks, tables
from .views import CK, TR, checkpoints, table, traces


def _lines(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 15, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return sinks.strict_json(e, "value")


@query("strict_json_lines", "SRC01 SRC13 SRC11", "select count(*) as n, count(value) filter (where value <= 15) as present, round(sum(value) filter (where value <= 15), 6) as total from events")
def strict_json_lines(spark, d):
    rows = tables.decode_lines(_lines(spark, d), "event_id long, user_id long, value double")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.round(F.sum("value"), 6).alias("total"))


@query("selected_json_lines", "SRC07", "select user_id, count(*) as n from events where user_id % 7 = 0 group by user_id")
def selected_json_lines(spark, d):
    ids = table(spark, d, "events").where("user_id % 7 = 0").select("user_id")
    rows = tables.decode_lines(tables.selected_lines(_lines(spark, d), ids, "user_id"), "event_id long, user_id long, value double")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("indexed_vectors", "SRC17 JOI17", "select count(*) as n, min(vec_id) as lo, max(vec_id) as hi, min(len(embedding))::int as width from embeddings")
def indexed_vectors(spark, d):
    e = tables.index_vectors(table(spark, d, "embeddings"), "vec_id")
    return e.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.min(F.size("embedding")).alias("width"))


@query("audit_checks", "INT07 INT08 FIL03", f"with {CK}, c as (select count(*) as n, count(*) filter (where not (p > 0 and p < 1)) as a, count(*) filter (where not (success_count between 0 and 3)) as b, count(*) filter (where not (ordinal < n_checkpoints)) as c from ck) select unnest(['probability', 'below_four', 'ordinal']) as \"check\", n as rows, unnest([a, b, c]) as failures, case when unnest([a, b, c]) = 0 then 'PASS' else 'FAIL' end as status from c")
def audit_checks(spark, d):
    ck = tables.require_columns(checkpoints(spark, d), ["p", "success_count", "ordinal"])
    return integrity.audit(ck, {"probability": (F.col("p") > 0) & (F.col("p") < 1), "below_four": F.col("success_count").between(0, 3), "ordinal": F.col("ordinal") < F.col("n_checkpoints")})


@query("registry_snapshot", "REG01 REG05", f"""with {TR}, j as (select trace_id, case status when 'F' then 'complete' when 'O' then 'pending' else 'running' end as s, case when status = 'P' then trace_id % 10 end as lease from tr),
x as (select case when s = 'running' and lease < 5 then 'pending' else s end as status from j) select status, count(*) as n from x group by status""")
def registry_snapshot(spark, d):
    t = traces(spark, d)
    running = F.col("status") == "P"
    jobs = t.select(F.col("trace_id").alias("job_id"), F.col("base_model").alias("model"), F.when(F.col("status") == "F", "complete").when(F.col("status") == "O", "pending").otherwise("running").alias("status"), F.when(running, F.lit("w")).alias("worker"), F.when(running, F.col("trace_id") % 10).alias("lease_until"))
    return integrity.expire_leases(jobs, F.lit(5)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("probe_matrix", "FIT06 FIT08 CUB06")
def probe_matrix(spark, d):
    ck = checkpoints(spark, d).withColumn("y", F.col("success_count") / 4)
    w = fitting.train_matrix(ck, domain="domain", x=["raw_logit", "logit_b"], target="y")
    return fitting.evaluate_matrix(ck, w, domain="domain", x=["raw_logit", "logit_b"], target="y")


@query("metric_bootstrap", "RES03")
def metric_bootstrap(spark, d):
    ck = checkpoints(spark, d).withColumn("y", F.col("success_count") / 4)
    reps = fitting.metric_bootstrap(ck, unit="trace_id", p="p", y="y", replicates=40, seed="suite")
    q = lambda c: F.percentile(c, [0.025, 0.975])
    out = reps.agg(q("nll").alias("n"), q("brier").alias("b"))
    return out.select(F.round(F.col("n")[0], 6).alias("nll_lo"), F.round(F.col("n")[1], 6).alias("nll_hi"), F.round(F.col("b")[0], 6).alias("brier_lo"), F.round(F.col("b")[1], 6).alias("brier_hi"))
