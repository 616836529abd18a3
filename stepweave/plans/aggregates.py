"""Aggregates, metrics, slices and ordered operators on the stand-in views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, ordered
from ..registry import query
from .views import CK, RO, TR, checkpoints, outcomes, table, traces

def _y():
    """Share of a checkpoint's outcomes that succeed."""
    return F.col("success_count") / 4


@query("distribution_6num", "AGG01 AGG02 MET20", "select lang, count(*) as n, round(avg(n_chars), 6) as mean, min(n_chars) as lo, quantile_cont(n_chars, 0.25e0) as q25, quantile_cont(n_chars, 0.5e0) as median, quantile_cont(n_chars, 0.75e0) as q75, max(n_chars) as hi from documents group by lang")
def distribution_6num(spark, d):
    q = F.percentile("n_chars", [0.25, 0.5, 0.75])
    out = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("lo"), q.alias("q"), F.max("n_chars").alias("hi"))
    return out.select("lang", "n", "mean", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "hi")


@query("condition_rates", "AGG03 AGG25", f"with {CK} select base_model, flag, grouping(base_model, flag)::int as gid, count(*) as n, round(avg(success_count / 4e0), 6) as rate, round(avg((p >= 0.5e0)::int), 6) as above, count(*) filter (where success_count = 0) as none from ck group by grouping sets ((base_model, flag), (flag))")
def condition_rates(spark, d):
    ck = checkpoints(spark, d)
    g = ck.groupingSets([["base_model", "flag"], ["flag"]], "base_model", "flag")
    return g.agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.avg(_y()), 6).alias("rate"), F.round(F.avg((F.col("p") >= 0.5).cast("int")), 6).alias("above"), F.count_if(F.col("success_count") == 0).alias("none"))


@query("repair_conditional", "AGG04", "select lang, count(*) as n, count(*) filter (where quality = 0) as failures, round(avg((toxic = 0)::int) filter (where quality = 0), 6) as success_among_failures from labels join documents using (doc_id) group by lang")
def repair_conditional(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    bad = F.col("quality") == 0
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failures"), F.round(F.avg(F.when(bad, (F.col("toxic") == 0).cast("int"))), 6).alias("success_among_failures"))


@query("k_rollup_exact", "AGG05", f"with {RO} select user_id, list(y order by rollout_index)::varchar as outcomes, sum(y)::bigint as success_count from ro where rollout_index < 4 group by user_id having count(*) = 4")
def k_rollup_exact(spark, d):
    g = outcomes(spark, d).where("rollout_index < 4").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rollout_index", "y"))).alias("a"), F.sum("y").alias("success_count"))
    g = g.where(F.transform("a", lambda x: x["rollout_index"]) == F.sequence(F.lit(0), F.lit(3)))
    return g.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["y"].cast("string")), ", "), F.lit("]")).alias("outcomes"), "success_count")


@query("dense_rollup", "AGG06 AGG07 AGG08", f"""with {RO} select user_id, sum(y)::bigint as successes, round(avg(value), 6) as mean_value, median(value) as median_value, round(avg(value) filter (where y = 1), 6) as mean_if_success,
 (sum(y) - sum(y) filter (where rollout_index >= 4))::bigint as original, sum(y) / 16e0 as rate, (sum(y) + 0.5e0) / 17 as jeffreys from ro where rollout_index < 16 group by user_id having count(*) = 16""")
def dense_rollup(spark, d):
    g = outcomes(spark, d).where("rollout_index < 16").groupBy("user_id").agg(
        F.sum("y").alias("successes"), F.round(F.avg("value"), 6).alias("mean_value"), F.percentile("value", 0.5).alias("median_value"), F.round(F.avg(F.when(F.col("y") == 1, F.col("value"))), 6).alias("mean_if_success"),
        (F.sum("y") - F.sum(F.when(F.col("rollout_index") >= 4, F.col("y")))).alias("original"), (F.sum("y") / 16).alias("rate"), ((F.sum("y") + 0.5) / 17).alias("jeffreys"), F.count(F.lit(1)).alias("n"),
    )
    return g.where("n = 16").drop("n")


@query("beta_posterior_mean", "AGG09", f"with {CK} select domain, 0.5e0 + sum(success_count) as alpha, 0.5e0 + sum(4 - success_count) as beta, round((0.5e0 + sum(success_count)) / (1 + 4 * count(*)), 6) as mean from ck group by domain")
def beta_posterior_mean(spark, d):
    a, b = 0.5 + F.sum("success_count"), 0.5 + F.sum(4 - F.col("success_count"))
    return checkpoints(spark, d).groupBy("domain").agg(a.alias("alpha"), b.alias("beta"), F.round(a / (a + b), 6).alias("mean"))


@query("waterfall", "AGG11", f"""with {CK}, s as (select *, n_checkpoints >= 3 as a, n_checkpoints >= 3 and success_count > 0 as b, n_checkpoints >= 3 and success_count > 0 and p >= 0.5e0 as c from ck)
select stage, count(*) as rows, count(distinct problem_group) as groups, count(distinct trace_id) as traces from (select 'all' as stage, * from s union all select 'long', * from s where a union all select 'solved', * from s where b union all select 'likely', * from s where c) group by stage""")
def waterfall(spark, d):
    a = F.col("n_checkpoints") >= 3
    b = a & (F.col("success_count") > 0)
    c = b & (F.col("p") >= 0.5)
    stages = F.array_compact(F.array(F.lit("all"), F.when(a, F.lit("long")), F.when(b, F.lit("solved")), F.when(c, F.lit("likely"))))
    return checkpoints(spark, d).select(F.explode(stages).alias("stage"), "problem_group", "trace_id").groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("problem_group").alias("groups"), F.count_distinct("trace_id").alias("traces"))


@query("fr_pf_metrics", "AGG12", f"with {RO}, t as (select user_id, user_id % 3 as stratum, sum(y)::bigint as s from ro where rollout_index < 4 group by user_id having count(*) = 4) select stratum, count(*) as traces, round(avg(s / 4e0), 6) as fr1, round(avg((s > 0)::int), 6) as fr4, round(avg((s = 0)::int), 6) as pf4, count(*) filter (where s = 2) as twos from t group by rollup (stratum)")
def fr_pf_metrics(spark, d):
    t = outcomes(spark, d).where("rollout_index < 4").groupBy("user_id").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).where("n = 4").withColumn("stratum", F.col("user_id") % 3)
    return t.rollup("stratum").agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg(F.col("s") / 4), 6).alias("fr1"), F.round(F.avg((F.col("s") > 0).cast("int")), 6).alias("fr4"), F.round(F.avg((F.col("s") == 0).cast("int")), 6).alias("pf4"), F.count_if(F.col("s") == 2).alias("twos"))


@query("source_bucket_crosstab", "AGG13", "select source, count(*) as attempted, count(*) filter (where quality = 1) as valid, round(count(*) filter (where toxic = 1) / greatest(count(*) filter (where quality = 1), 1)::double, 6) as yield from labels join documents using (doc_id) group by rollup (source)")
def source_bucket_crosstab(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    v = F.count_if(F.col("quality") == 1)
    return j.rollup("source").agg(F.count(F.lit(1)).alias("attempted"), v.alias("valid"), F.round(F.count_if(F.col("toxic") == 1) / F.greatest(v, F.lit(1)), 6).alias("yield"))


@query("production_totals", "AGG14 AGG20", f"with {TR} select base_model, status, count(*) as traces, round(sum(work), 2) as work, max(work) as largest, count(*) filter (where status = 'F') as finished from tr group by all")
def production_totals(spark, d):
    return traces(spark, d).groupBy("base_model", "status").agg(F.count(F.lit(1)).alias("traces"), F.round(F.sum("work"), 2).alias("work"), F.max("work").alias("largest"), F.count_if(F.col("status") == "F").alias("finished"))


@query("trace_weighted_nll_brier", "MET01 MET02 AGG15 AGG17", f"""with {CK}, r as (select base_model, domain, trace_id, -(success_count / 4e0 * ln(p) + (1 - success_count / 4e0) * ln(1 - p)) as n, pow(p - success_count / 4e0, 2) as b from ck),
t as (select base_model, domain, trace_id, avg(n) as n, avg(b) as b from r group by all) select base_model, domain, round(avg(n), 6) as nll, round(avg(b), 6) as brier from t group by all""")
def trace_weighted_nll_brier(spark, d):
    out = metrics.two_level_mean(checkpoints(spark, d), ["base_model", "domain"], "trace_id", {"nll": metrics.nll(F.col("p"), _y()), "brier": F.pow(F.col("p") - _y(), 2)})
    return out.select("base_model", "domain", F.round("nll", 6).alias("nll"), F.round("brier", 6).alias("brier"))


@query("logit_nll", "MET01", f"with {CK} select base_model, round(avg(greatest(raw_logit, 0) - success_count / 4e0 * raw_logit + ln(1 + exp(-abs(raw_logit)))), 6) as nll from ck group by base_model")
def logit_nll(spark, d):
    return checkpoints(spark, d).groupBy("base_model").agg(F.round(F.avg(metrics.nll_from_logit(F.col("raw_logit"), _y())), 6).alias("nll"))


@query("reliability_bins", "WIN10 MET03", f"with {CK}, b as (select base_model, p, success_count / 4e0 as y, ntile(10) over (partition by base_model order by p, trace_id, ordinal) as bin from ck) select base_model, bin::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from b group by all")
def reliability_bins(spark, d):
    return metrics.reliability(checkpoints(spark, d).withColumn("y", _y()), ["base_model"], "p", "y", ["trace_id", "ordinal"])


@query("expected_calibration_error", "MET03", f"with {CK}, b as (select base_model, p, success_count / 4e0 as y, ntile(10) over (partition by base_model order by p, trace_id, ordinal) as bin from ck), g as (select base_model, bin, count(*) as n, avg(p) as c, avg(y) as a from b group by all) select base_model, round(sum(n * abs(c - a)) / sum(n), 6) as ece from g group by base_model")
def expected_calibration_error(spark, d):
    return metrics.ece(checkpoints(spark, d).withColumn("y", _y()), ["base_model"], "p", "y", ["trace_id", "ordinal"])


@query("spearman_by_model", "MET05", f"""with {CK}, r as (select base_model, rank() over (partition by base_model order by p) + (count(*) over (partition by base_model, p) - 1) / 2e0 as a,
 rank() over (partition by base_model order by success_count) + (count(*) over (partition by base_model, success_count) - 1) / 2e0 as b from ck) select base_model, round(corr(a, b), 6) as rho from r group by base_model""")
def spearman_by_model(spark, d):
    return metrics.spearman(checkpoints(spark, d), ["base_model"], "p", "success_count")


@query("auc_ap", "MET07", f"""with {CK}, x as (select base_model, p, (success_count >= 2)::int as y from ck), g as (select base_model, p, count(*) as n, sum(y) as pos from x group by all),
w as (select *, sum(pos) over (partition by base_model order by p desc) as tp, sum(n) over (partition by base_model order by p desc) as seen, sum(n - pos) over (partition by base_model order by p) - (n - pos) as below from g)
select base_model, round(sum(pos * (below + (n - pos) / 2e0)) / (sum(pos) * sum(n - pos)), 6) as auc, round(sum(pos * tp / seen::double) / sum(pos), 6) as ap from w group by base_model""")
def auc_ap(spark, d):
    return metrics.auc_ap(checkpoints(spark, d).withColumn("y", (F.col("success_count") >= 2).cast("int")), ["base_model"], "p", "y")


@query("balanced_accuracy", "MET08", f"with {CK}, x as (select base_model, (p >= 0.5e0)::int as h, (success_count >= 2)::int as y from ck) select base_model, round(avg((h = y)::int), 6) as acc, round((avg(h) filter (where y = 1) + avg(1 - h) filter (where y = 0)) / 2, 6) as bal_acc from x group by base_model")
def balanced_accuracy(spark, d):
    x = checkpoints(spark, d).select("base_model", (F.col("p") >= 0.5).cast("int").alias("h"), (F.col("success_count") >= 2).cast("int").alias("y"))
    return x.groupBy("base_model").agg(F.round(F.avg((F.col("h") == F.col("y")).cast("int")), 6).alias("acc"), F.round((F.avg(F.when(F.col("y") == 1, F.col("h"))) + F.avg(F.when(F.col("y") == 0, 1 - F.col("h")))) / 2, 6).alias("bal_acc"))


@query("slice_cube", "CUB01 WIN09", f"with {CK}, q as (select *, ntile(4) over (partition by base_model order by ordinal, prefix_tokens, trace_id) as quartile from ck) select base_model, domain, quartile::int as quartile, grouping(base_model, domain, quartile)::int as gid, count(*) as n, round(avg(success_count / 4e0), 6) as mean from q group by cube (base_model, domain, quartile)")
def slice_cube(spark, d):
    q = metrics.equal_count_bins(checkpoints(spark, d), ["base_model"], ["ordinal", "prefix_tokens", "trace_id"], 4, "quartile")
    return q.cube("base_model", "domain", "quartile").agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.avg(_y()), 6).alias("mean"))


@query("strata_grouping_sets", "CUB02", f"""with {CK} select case when grouping(domain) = 0 then 'domain' when grouping(flag) = 0 then 'flag' when grouping(success_count) = 0 then 'success' else 'overall' end as stratum, coalesce(domain, flag, success_count::varchar, 'all') as value, count(*) as n, round(avg(p), 6) as mean_p
from ck group by grouping sets ((), (domain), (flag), (success_count))""")
def strata_grouping_sets(spark, d):
    ck = checkpoints(spark, d)
    g = ck.groupingSets([[], ["domain"], ["flag"], ["success_count"]], "domain", "flag", "success_count").agg(F.grouping("domain").alias("a"), F.grouping("flag").alias("b"), F.grouping("success_count").alias("c"), F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))
    stratum = F.when(F.col("a") == 0, "domain").when(F.col("b") == 0, "flag").when(F.col("c") == 0, "success").otherwise("overall")
    return g.select(stratum.alias("stratum"), F.coalesce("domain", "flag", F.col("success_count").cast("string"), F.lit("all")).alias("value"), "n", "mean_p")


@query("model_domain_cube", "CUB03", f"with {CK} select base_model, domain, grouping(base_model, domain)::int as gid, count(*) as n, round(avg(success_count / 4e0), 6) as success from ck group by cube (base_model, domain)")
def model_domain_cube(spark, d):
    return checkpoints(spark, d).cube("base_model", "domain").agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.avg(_y()), 6).alias("success"))


@query("seed_macro_rollup", "CUB04", f"""with {CK}, v as (select base_model, trace_id % 3 as seed, avg(greatest(raw_logit, 0) - success_count / 4e0 * raw_logit + ln(1 + exp(-abs(raw_logit)))) as nll from ck group by all), m as (select base_model, avg(nll) as nll from v group by 1)
select 'seed' as aggregation, base_model || '/' || seed as key, round(nll, 6) as nll from v union all select 'model', base_model, round(nll, 6) from m union all select 'macro', 'all', round(avg(nll), 6) from m""")
def seed_macro_rollup(spark, d):
    v = checkpoints(spark, d).groupBy("base_model", (F.col("trace_id") % 3).alias("seed")).agg(F.avg(metrics.nll_from_logit(F.col("raw_logit"), _y())).alias("nll"))
    m = v.groupBy("base_model").agg(F.avg("nll").alias("nll"))
    r = F.round("nll", 6).alias("nll")
    return v.select(F.lit("seed").alias("aggregation"), F.concat_ws("/", "base_model", F.col("seed").cast("string")).alias("key"), r).unionByName(m.select(F.lit("model").alias("aggregation"), F.col("base_model").alias("key"), r)).unionByName(m.agg(F.avg("nll").alias("nll")).select(F.lit("macro").alias("aggregation"), F.lit("all").alias("key"), r))


@query("slot_pivot", "CUB05", f"with {RO} select user_id, " + ", ".join(f"max(y) filter (where rollout_index = {i}) as s{i}" for i in range(8)) + " from ro where rollout_index < 8 group by user_id")
def slot_pivot(spark, d):
    p = outcomes(spark, d).where("rollout_index < 8").groupBy("user_id").pivot("rollout_index", list(range(8))).agg(F.max("y"))
    return p.select("user_id", *[F.col(f"`{i}`").alias(f"s{i}") for i in range(8)])


@query("transfer_matrix", "CUB06", f"""with {CK}, m as (select base_model as train, domain as test, avg(pow(p - success_count / 4e0, 2)) as v from ck group by all)
select round(avg(v) filter (where right(train, 1) = left(test, 1)), 6) as diagonal, round(avg(v) filter (where right(train, 1) <> left(test, 1)), 6) as off_diagonal, max_by(train || ':' || test, v) as worst from m""")
def transfer_matrix(spark, d):
    m = checkpoints(spark, d).groupBy(F.col("base_model").alias("train"), F.col("domain").alias("test")).agg(F.avg(F.pow(F.col("p") - _y(), 2)).alias("v"))
    same = F.substring("train", -1, 1) == F.substring("test", 1, 1)
    return m.agg(F.round(F.avg(F.when(same, F.col("v"))), 6).alias("diagonal"), F.round(F.avg(F.when(~same, F.col("v"))), 6).alias("off_diagonal"), F.max_by(F.concat_ws(":", "train", "test"), "v").alias("worst"))


@query("probe_contrast", "CUB07", f"with {CK}, m as (select base_model, avg(abs(1 / (1 + exp(-logit_b)) - success_count / 4e0)) as b, avg(abs(1 / (1 + exp(-logit_c)) - success_count / 4e0)) as c from ck group by 1) select base_model, round(b, 6) as hidden, round(c, 6) as position, round(b - c, 6) as hidden_minus_position from m")
def probe_contrast(spark, d):
    e = lambda z: F.avg(F.abs(1 / (1 + F.exp(-F.col(z))) - _y()))
    m = checkpoints(spark, d).groupBy("base_model").agg(e("logit_b").alias("b"), e("logit_c").alias("c"))
    return m.select("base_model", F.round("b", 6).alias("hidden"), F.round("c", 6).alias("position"), F.round(F.col("b") - F.col("c"), 6).alias("hidden_minus_position"))


@query("margin_counts", "CUB08", f"with {TR} select status, count(*) as n from tr group by status")
def margin_counts(spark, d):
    return traces(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_NEST = f"{RO}, n as (select user_id, k, (sum(y) filter (where rollout_index < k))::bigint as success from ro cross join (select unnest([1, 2, 4, 8, 16]) as k) where rollout_index < 16 group by user_id, k having count(*) = 16)"


@query("nested_k_labels", "WIN08", f"with {_NEST} select user_id, k::int as k, success from n")
def nested_k_labels(spark, d):
    return ordered.nested_prefixes(outcomes(spark, d), key="user_id", index="rollout_index", outcome="y", ks=(1, 2, 4, 8, 16))


@query("label_reliability", "MET10 MET18", f"""with {_NEST}, j as (select n.k, n.success / n.k::double as q, f.success / 16e0 as dense from n join n f using (user_id) where f.k = 16)
select k::int as k, round(avg(abs(q - dense)), 6) as mae, round(sqrt(avg(pow(q - dense, 2))), 6) as rmse, round(avg(((q >= 0.5e0) = (dense >= 0.5e0))::int), 6) as agreement,
 round(avg(abs((q * k + 0.5e0) / (k + 1) - (dense * 16 + 0.5e0) / 17)), 6) as posterior_diff from j group by k""")
def label_reliability(spark, d):
    ks = (1, 2, 4, 8, 16)
    n = ordered.nested_prefixes(outcomes(spark, d), key="user_id", index="rollout_index", outcome="y", ks=ks)
    q, dense = F.col("success") / F.col("k"), F.max(F.when(F.col("k") == max(ks), F.col("success"))).over(W.partitionBy("user_id")) / max(ks)
    j = n.select("k", q.alias("q"), dense.alias("dense"))
    post = F.abs((F.col("q") * F.col("k") + 0.5) / (F.col("k") + 1) - (F.col("dense") * 16 + 0.5) / 17)
    return j.groupBy("k").agg(F.round(F.avg(F.abs(F.col("q") - F.col("dense"))), 6).alias("mae"), F.round(F.sqrt(F.avg(F.pow(F.col("q") - F.col("dense"), 2))), 6).alias("rmse"), F.round(F.avg(((F.col("q") >= 0.5) == (F.col("dense") >= 0.5)).cast("int")), 6).alias("agreement"), F.round(F.avg(post), 6).alias("posterior_diff"))


@query("monotone_projection", "WIN05", f"""with {CK}, a as (select a.trace_id, a.base_model, a.ordinal as i, b.ordinal as j, c.ordinal as k, b.p as x from ck a join ck b on a.trace_id = b.trace_id join ck c on a.trace_id = c.trace_id where b.ordinal <= a.ordinal and c.ordinal >= a.ordinal),
s as (select a.trace_id, a.base_model, a.ordinal as i, j.ordinal as j, k.ordinal as k, avg(x.p) as m from ck a join ck j on j.trace_id = a.trace_id and j.ordinal <= a.ordinal join ck k on k.trace_id = a.trace_id and k.ordinal >= a.ordinal join ck x on x.trace_id = a.trace_id and x.ordinal between j.ordinal and k.ordinal group by all),
u as (select trace_id, base_model, i, j, max(m) as m from s group by all), f as (select trace_id, base_model, i, min(m) as f from u group by all)
select base_model, round(sum(f), 4) as sum_mono, count(*) as n from f group by base_model""")
def monotone_projection(spark, d):
    m = ordered.monotone_projection(checkpoints(spark, d), keys=["base_model", "trace_id"])
    return m.groupBy("base_model").agg(F.round(F.sum("p_mono"), 4).alias("sum_mono"), F.count(F.lit(1)).alias("n"))


@query("within_group_centring", "WIN06 WIN07", f"with {CK}, c as (select domain, p - avg(p) over (partition by trace_id) as c, coalesce(p - lag(p) over (partition by trace_id order by ordinal), 0) as diff from ck) select domain, round(sum(abs(c)), 6) as centred, round(sum(diff), 6) as drift, round(max(diff), 6) as largest from c group by domain")
def within_group_centring(spark, d):
    c = ordered.differences(ordered.centred(checkpoints(spark, d), ["trace_id"], ["p"]), ["trace_id"], "ordinal", "p")
    return c.groupBy("domain").agg(F.round(F.sum(F.abs("p_centred")), 6).alias("centred"), F.round(F.sum("diff"), 6).alias("drift"), F.round(F.max("diff"), 6).alias("largest"))


@query("rank_quartile_edges", "WIN11 WIN12 WIN13 WIN14 WIN15", f"""with {CK}, r as (select *, row_number() over (partition by base_model order by p, trace_id, ordinal) as rn, count(*) over (partition by base_model) as n from ck)
select base_model, case when rn <= 1 + (n - 1) * 0.25e0 then 1 when rn <= 1 + (n - 1) * 0.5e0 then 2 when rn <= 1 + (n - 1) * 0.75e0 then 3 else 4 end as quartile, least(floor((rn / n::double - 1e-12) * 5), 4)::int as quintile,
 case when rn - 1 < n / 3e0 then 'short' when rn - 1 < 2 * n / 3e0 then 'medium' else 'long' end as tercile, count(*) as n, round(avg(p), 6) as mean_p from r group by all""")
def rank_quartile_edges(spark, d):
    w = W.partitionBy("base_model")
    r = checkpoints(spark, d).withColumn("rn", F.row_number().over(w.orderBy("p", "trace_id", "ordinal"))).withColumn("n", F.count(F.lit(1)).over(w))
    edge = lambda q: F.col("rn") <= 1 + (F.col("n") - 1) * q
    tercile = F.when(F.col("rn") - 1 < F.col("n") / 3, "short").when(F.col("rn") - 1 < 2 * F.col("n") / 3, "medium").otherwise("long")
    return r.groupBy("base_model", F.when(edge(0.25), 1).when(edge(0.5), 2).when(edge(0.75), 3).otherwise(4).alias("quartile"), F.least(F.floor((F.col("rn") / F.col("n") - 1e-12) * 5), F.lit(4)).cast("int").alias("quintile"), tercile.alias("tercile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query("contiguous_prefix", "WIN16 WIN17 PAK05", f"with {TR}, r as (select base_model, trace_id, row_number() over (partition by base_model order by sha256('[' || trace_id || ']')) - 1 as idx from tr), x as (select *, idx % 37 <> 36 as done from r) select base_model, coalesce(min(idx) filter (where not done), count(*)) as prefix, count(*) filter (where done) as done, max(idx) as last_rank from x group by base_model")
def contiguous_prefix(spark, d):
    from ..functions.hashing import stable_hash

    r = traces(spark, d).withColumn("idx", (F.row_number().over(W.partitionBy("base_model").orderBy(stable_hash(F.col("trace_id")))) - 1).cast("long")).withColumn("done", F.col("idx") % 37 != 36)
    return r.groupBy("base_model").agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("idx"))), F.count(F.lit(1))).alias("prefix"), F.count_if("done").alias("done"), F.max("idx").alias("last_rank"))


@query("trajectory_stats", "WIN18 WIN19 TRJ03", f"""with {CK}, f as (select *, (p >= 0.5e0)::int as i, lag((p >= 0.5e0)::int) over w as was, p - lag(p) over w as step from ck where n_checkpoints >= 5 window w as (partition by trace_id order by ordinal)),
g as (select *, max(case when was = 1 and i = 0 then 1 else 0 end) over (partition by trace_id order by ordinal) as lft from f)
select trace_id, count(*) filter (where i <> was) as crossings, count(*) filter (where i = 1 and was = 0 and lft = 1) as reentries, round(-least(min(step), 0), 6) + 0 as largest_drop, round(greatest(max(step), 0), 6) as largest_gain, min(ordinal - 1) filter (where was = 1 and i = 0) as first_down from g group by trace_id""")
def trajectory_stats(spark, d):
    out = ordered.crossings(checkpoints(spark, d).where("n_checkpoints >= 5"), ["trace_id"], "ordinal", "p", 0.5)
    return out.select("trace_id", "crossings", "reentries", (F.round("largest_drop", 6) + 0.0).alias("largest_drop"), F.round("largest_gain", 6).alias("largest_gain"), "first_down")


@query("sequence_invariants", "WIN20 TRJ04", f"with {CK}, x as (select trace_id, ordinal, n_checkpoints, row_number() over (partition by trace_id order by ordinal) - 1 as rn, success_count <= lag(success_count) over (partition by trace_id order by ordinal) as falling from ck) select n_checkpoints, count(*) as n, count(*) filter (where rn <> ordinal) as broken, count(*) filter (where falling) as falling, count(*) filter (where ordinal <= 2) as safe_labels from x group by n_checkpoints")
def sequence_invariants(spark, d):
    w = W.partitionBy("trace_id").orderBy("ordinal")
    x = checkpoints(spark, d).withColumn("rn", F.row_number().over(w) - 1).withColumn("falling", F.col("success_count") <= F.lag("success_count").over(w))
    return x.groupBy("n_checkpoints").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") != F.col("ordinal")).alias("broken"), F.count_if("falling").alias("falling"), F.count_if(F.col("ordinal") <= 2).alias("safe_labels"))


@query("local_mean", "WIN21", f"with {RO}, m as (select user_id, avg(value) over (partition by user_id order by rollout_index rows between 8 preceding and 7 following) as m from ro) select user_id, round(max(m), 6) as largest, round(avg(m), 6) as mean from m group by user_id")
def local_mean(spark, d):
    m = outcomes(spark, d).select("user_id", F.avg("value").over(W.partitionBy("user_id").orderBy("rollout_index").rowsBetween(-8, 7)).alias("m"))
    return m.groupBy("user_id").agg(F.round(F.max("m"), 6).alias("largest"), F.round(F.avg("m"), 6).alias("mean"))


@query("checkpoint_regret", "AGG19", f"""with {CK}, t as (select trace_id, any_value(base_model) as base_model, max(success_count) as best, max_by(success_count, (p, ordinal)) as got, max_by(ordinal, (p, ordinal)) as at, list(ordinal order by ordinal) as os, list(success_count order by ordinal) as ss from ck group by trace_id)
select base_model, round(avg(best - got), 6) as regret, round(avg((best = got)::int), 6) as agreement from t group by base_model""")
def checkpoint_regret(spark, d):
    t = checkpoints(spark, d).groupBy("base_model", "trace_id").agg(F.max("success_count").alias("best"), F.max_by("success_count", F.struct("p", "ordinal")).alias("got"))
    return t.groupBy("base_model").agg(F.round(F.avg(F.col("best") - F.col("got")), 6).alias("regret"), F.round(F.avg((F.col("best") == F.col("got")).cast("int")), 6).alias("agreement"))


@query("share_within_group", "AGG22 AGG23", f"with {CK}, g as (select domain, ordinal, count(*) as n, count(distinct trace_id) as traces from ck group by all) select domain, ordinal, n, round(n / (sum(n) over (partition by domain))::double, 6) as share, traces >= 2 as eligible from g")
def share_within_group(spark, d):
    g = checkpoints(spark, d).groupBy("domain", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))
    return g.select("domain", "ordinal", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("domain")), 6).alias("share"), (F.col("traces") >= 2).alias("eligible"))


@query("pre_post_contrast", "AGG24 MET12", f"with {CK}, m as (select base_model, avg(p) filter (where ordinal = 0) as pre, avg(p) filter (where ordinal > 0) as post, stddev_samp(p) as sd, count(*) filter (where ordinal = 0) as na, count(*) filter (where ordinal > 0) as nb, var_samp(p) filter (where ordinal = 0) as va, var_samp(p) filter (where ordinal > 0) as vb from ck group by 1) select base_model, round(post - pre, 6) as change, round(sd, 6) as sd, round((pre - post) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as effect from m")
def pre_post_contrast(spark, d):
    ck = checkpoints(spark, d)
    first = F.col("ordinal") == 0
    return ck.groupBy("base_model").agg(F.round(F.avg(F.when(~first, F.col("p"))) - F.avg(F.when(first, F.col("p"))), 6).alias("change"), F.round(F.stddev_samp("p"), 6).alias("sd"), F.round(metrics.cohens_d(ck, "p", first), 6).alias("effect"))


@query("scan_pushdown", "SRC05 SRC06 SRC08 SRC09", "select l_linenumber, count(*) as n, round(sum(l_quantity), 6) as qty from lineitem where l_returnflag = 'A' group by l_linenumber")
def scan_pushdown(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("qty"))
