"""Selections, splits, packs, resampling, vectors, fits, trajectories and job queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import digest_modulo, stable_hash, unit_interval
from ..operators import fitting, metrics, resampling, selection, vectors
from ..registry import query
from .views import CK, EMB, TR, checkpoints, table, traces, vectors as vector_view


def H(*names):
    return stable_hash(*[F.col(n) for n in names])


@query("split_hash", "SPL01 STR07", f"""with {TR}, g as (select distinct problem_group, ('0x' || substr(sha256('[7,' || problem_group || ']'), 1, 13))::bigint / pow(16e0, 13) as u from tr),
s as (select problem_group, case when u < 0.7e0 then 'train' when u < 0.85e0 then 'dev' else 'test' end as split from g) select split, count(distinct problem_group) as groups, count(*) as traces from tr join s using (problem_group) group by split""")
def split_hash(spark, d):
    u = unit_interval(stable_hash(7, F.col("problem_group")))
    return traces(spark, d).groupBy(selection.hash_split(u, {"train": 0.7, "dev": 0.15, "test": 0.15}).alias("split")).agg(F.count_distinct("problem_group").alias("groups"), F.count(F.lit(1)).alias("traces"))


@query("split_403030", "SPL02 SPL03", f"""with {TR}, g as (select distinct domain, problem_group from tr), r as (select *, row_number() over (partition by domain order by sha256('[' || problem_group || ']')) - 1 as i, count(*) over (partition by domain) as n from g)
select domain, case when i < floor(n * 0.4e0) then 'calibration' when i < floor(n * 0.4e0) + floor(n * 0.3e0) then 'validation' else 'test' end as split, count(*) as n from r group by all""")
def split_403030(spark, d):
    g = selection.group_positions(traces(spark, d), "problem_group", H("problem_group"), ["domain"])
    a, b = F.floor(F.col("size") * 0.4), F.floor(F.col("size") * 0.3)
    return g.groupBy("domain", F.when(F.col("position") < a, "calibration").when(F.col("position") < a + b, "validation").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("fold_round_robin", "SPL06", f"with {TR}, g as (select distinct problem_group from tr), r as (select problem_group, (row_number() over (order by sha256('[' || problem_group || ']')) - 1) % 5 as fold from g) select fold, count(*) as groups, min(problem_group) as first_group from r group by fold")
def fold_round_robin(spark, d):
    g = selection.group_positions(traces(spark, d), "problem_group", H("problem_group"), [])
    return g.groupBy((F.col("position") % 5).cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("groups"), F.min("problem_group").alias("first_group"))


@query("fold_mod5", "SPL07 STR08", f"with {TR}, g as (select distinct problem_group, sha256('[' || problem_group || ']') as h from tr), f as (select problem_group, list_reduce(list_prepend(0::bigint, list_transform(string_split(h, ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint)), lambda a, x: a + x) % 5 as fold from g) select fold::int as fold, count(*) as groups from f group by fold")
def fold_mod5(spark, d):
    g = traces(spark, d).select("problem_group").distinct()
    return g.groupBy(digest_modulo(H("problem_group"), 5).alias("fold")).agg(F.count(F.lit(1)).alias("groups"))


@query("leakage_check", "SPL08", f"with {TR}, s as (select problem_group, problem_group % 3 as split from tr) select count(*) as groups, count(*) filter (where k > 1) as violations from (select problem_group, count(distinct split) as k from s group by 1)")
def leakage_check(spark, d):
    s = traces(spark, d).groupBy("problem_group").agg(F.count_distinct(F.col("problem_group") % 3).alias("k"))
    return s.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") > 1).alias("violations"))


@query("quota_topn", "TOP01 TOP04 TOP05", f"with {TR}, r as (select domain, trace_id, row_number() over (partition by domain order by sha256('[\"train\",' || trace_id || ']'), trace_id) as rank from tr) select domain, trace_id, rank::int as rank from r where rank <= 20")
def quota_topn(spark, d):
    return selection.top_by_hash(traces(spark, d), ["domain"], stable_hash("train", F.col("trace_id")), 20, "trace_id").select("domain", "trace_id", "rank")


@query("role_carving", "TOP02 TOP03 TOP19", f"""with {TR}, a as (select trace_id, problem_group from tr order by sha256('["final",' || trace_id || ']'), trace_id limit 100), b as (select trace_id, problem_group from tr where problem_group not in (select problem_group from a) order by sha256('["train",' || trace_id || ']'), trace_id limit 300)
select 'final' as role, count(*) as n, min(trace_id) as min_id, count(distinct problem_group) as groups from a union all select 'train', count(*), min(trace_id), count(distinct problem_group) from b""")
def role_carving(spark, d):
    t = traces(spark, d).select("trace_id", "problem_group")
    a = t.orderBy(stable_hash("final", F.col("trace_id")), "trace_id").limit(100)
    b = t.join(a.select("problem_group"), "problem_group", "left_anti").orderBy(stable_hash("train", F.col("trace_id")), "trace_id").limit(300)
    own = lambda x, r: x.agg(F.lit(r).alias("role"), F.count(F.lit(1)).alias("n"), F.min("trace_id").alias("min_id"), F.count_distinct("problem_group").alias("groups"))
    return own(a, "final").unionByName(own(b, "train"))


@query("round_robin_strata", "TOP06 TOP07 TOP18", f"with {TR}, r as (select trace_id, domain, base_model, row_number() over (partition by domain, base_model order by work desc, trace_id) as rn from tr), o as (select *, row_number() over (order by rn, domain, base_model) as turn from r) select trace_id, turn::int as turn from o where turn <= 50")
def round_robin_strata(spark, d):
    return selection.round_robin(traces(spark, d), ["domain", "base_model"], [F.desc("work"), "trace_id"], 50).select("trace_id", "turn")


@query("deficit_transfer", "TOP09", f"""with {TR}, c as (select count(*) filter (where domain = '1-URGENT') as a, count(*) filter (where domain = '2-HIGH') as b, count(*) filter (where domain = '3-MEDIUM') as c from tr where status = 'P'),
t as (select least(a, 200) as ta, least(b, 100 + greatest(200 - a, 0)) as tb, a, b, c from c), u as (select ta, tb, least(c, 50 + greatest(100 + greatest(200 - a, 0) - b, 0)) as tc from t)
select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) as stratum, unnest([ta, tb, tc])::bigint as target from u""")
def deficit_transfer(spark, d):
    p = traces(spark, d).where("status = 'P'")
    c = p.agg(*[F.count_if(F.col("domain") == x).alias(n) for n, x in (("a", "1-URGENT"), ("b", "2-HIGH"), ("c", "3-MEDIUM"))])
    short = F.greatest(200 - F.col("a"), F.lit(0))
    c = c.select("c", F.least(F.col("a"), F.lit(200)).alias("ta"), F.least(F.col("b"), 100 + short).alias("tb"), F.greatest(100 + short - F.col("b"), F.lit(0)).alias("s"))
    rows = F.array(*[F.struct(F.lit(n).alias("stratum"), v.cast("long").alias("target")) for n, v in (("1-URGENT", F.col("ta")), ("2-HIGH", F.col("tb")), ("3-MEDIUM", F.least(F.col("c"), 50 + F.col("s"))))])
    return c.select(F.explode(rows).alias("x")).select("x.*")


@query("stratified_halves", "TOP11", f"with {TR}, r as (select domain, trace_id, row_number() over (partition by domain order by sha256('[' || trace_id || ']')) as rn, count(*) over (partition by domain) as n from tr) select domain, count(*) filter (where rn <= ceil(n / 2e0)) as dev, min(trace_id) filter (where rn <= ceil(n / 2e0)) as first_dev from r group by domain")
def stratified_halves(spark, d):
    g = selection.group_positions(traces(spark, d), "trace_id", H("trace_id"), ["domain"])
    dev = F.col("position") + 1 <= F.ceil(F.col("size") / 2)
    return g.groupBy("domain").agg(F.count_if(dev).alias("dev"), F.min(F.when(dev, F.col("trace_id"))).alias("first_dev"))


@query("sentinel_positions", "TOP12 TOP13", f"with {CK}, t as (select trace_id, max(n_checkpoints) as n from ck group by 1 having max(n_checkpoints) >= 4), s as (select trace_id, n, unnest(range(4)) as slot from t) select trace_id, round_even(slot * (n - 1) / 3e0, 0)::int as position from s")
def sentinel_positions(spark, d):
    t = checkpoints(spark, d).groupBy("trace_id").agg(F.max("n_checkpoints").alias("n")).where("n >= 4")
    return t.select("trace_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.bround(i * (F.col("n") - 1) / 3).cast("int"))).alias("position"))


@query("median_variant", "TOP14 TOP15", f"""with {CK}, v as (select base_model, 's' || (trace_id % 3) as variant, avg(pow(p - success_count / 4e0, 2)) as loss from ck group by all), r as (select *, row_number() over (partition by base_model order by loss, variant) as rn from v),
o as (select min(loss) + (stddev_samp(loss) / sqrt(count(*))) as bound from v) select base_model, variant, round(loss, 6) as loss, loss <= bound as within_one_se from r cross join o where rn = 2""")
def median_variant(spark, d):
    v = checkpoints(spark, d).groupBy("base_model", F.concat(F.lit("s"), (F.col("trace_id") % 3).cast("string")).alias("variant")).agg(F.avg(F.pow(F.col("p") - F.col("success_count") / 4, 2)).alias("loss"))
    bound = F.min("loss").over(W.partitionBy()) + F.stddev_samp("loss").over(W.partitionBy()) / F.sqrt(F.count(F.lit(1)).over(W.partitionBy()))
    r = v.withColumn("within_one_se", F.col("loss") <= bound).withColumn("rn", F.row_number().over(W.partitionBy("base_model").orderBy("loss", "variant")))
    return r.where("rn = 2").select("base_model", "variant", F.round("loss", 6).alias("loss"), "within_one_se")


@query("medoid", "TOP16 TOP17", f"""with {CK}, t as (select domain, trace_id, avg(p) as a, max(prefix_tokens) as b from ck group by all), m as (select *, median(a) over (partition by domain) as ma, median(b) over (partition by domain) as mb from t),
z as (select *, median(abs(a - ma)) over (partition by domain) as da, median(abs(b - mb)) over (partition by domain) as db from m), k as (select domain, trace_id, pow((a - ma) / da, 2) + pow((b - mb) / db, 2) as dist from z)
select domain, min_by(trace_id, (round(dist, 9), trace_id)) as medoid, round(min(dist), 6) as dist from k group by domain""")
def medoid(spark, d):
    t = checkpoints(spark, d).groupBy("domain", "trace_id").agg(F.avg("p").alias("a"), F.max("prefix_tokens").alias("b"))
    m = t.groupBy("domain").agg(F.percentile("a", 0.5).alias("ma"), F.percentile("b", 0.5).alias("mb"))
    z = t.join(m, "domain")
    s = z.groupBy("domain").agg(F.percentile(F.abs(F.col("a") - F.col("ma")), 0.5).alias("da"), F.percentile(F.abs(F.col("b") - F.col("mb")), 0.5).alias("db"))
    k = z.join(s, "domain").withColumn("dist", F.pow((F.col("a") - F.col("ma")) / F.col("da"), 2) + F.pow((F.col("b") - F.col("mb")) / F.col("db"), 2))
    return k.groupBy("domain").agg(F.min_by("trace_id", F.struct(F.round("dist", 9), "trace_id")).alias("medoid"), F.round(F.min("dist"), 6).alias("dist"))


@query("fixed_packs", "PAK03 INT02", f"with {TR}, r as (select base_model, trace_id, row_number() over (partition by base_model order by trace_id) - 1 as i from tr) select base_model, (i // 64)::int as pack, count(*) as n, sha256(string_agg(trace_id::varchar, ',' order by i)) as pack_hash from r group by all")
def fixed_packs(spark, d):
    return selection.fixed_packs(traces(spark, d), ["base_model"], ["trace_id"], 64, "trace_id")


@query("unfinished_packs", "PAK04 INT09", f"with {TR}, r as (select base_model, trace_id, work, (row_number() over (partition by base_model order by trace_id) - 1) // 64 as pack from tr), p as (select base_model, pack, sum(work) as work, count(*) as n from r group by all) select base_model, count(*) as packs, count(*) filter (where pack % 3 <> 0) as unfinished, round(sum(work) filter (where pack % 3 <> 0), 2) as remaining from p group by base_model")
def unfinished_packs(spark, d):
    r = traces(spark, d).withColumn("pack", F.floor((F.row_number().over(W.partitionBy("base_model").orderBy("trace_id")) - 1) / 64))
    p = r.groupBy("base_model", "pack").agg(F.sum("work").alias("work"))
    todo = F.col("pack") % 3 != 0
    return p.groupBy("base_model").agg(F.count(F.lit(1)).alias("packs"), F.count_if(todo).alias("unfinished"), F.round(F.sum(F.when(todo, F.col("work"))), 2).alias("remaining"))


@query("lpt_packs", "PAK01")
def lpt_packs(spark, d):
    return selection.lpt_packs(traces(spark, d), "base_model", "trace_id", "work", 64)


@query("balanced_folds", "SPL05 SPL04")
def balanced_folds(spark, d):
    return selection.balanced_folds(traces(spark, d).groupBy("problem_group", F.col("problem_group").cast("string").alias("k")).agg(F.min("domain").alias("domain")), "problem_group", "domain", 5, H("problem_group"))


_UNITS = f"{CK}, u as (select domain, trace_id, avg(success_count / 4e0) as a, avg(p) as b from ck group by all)"


def _units(spark, d):
    return checkpoints(spark, d).groupBy("domain", "trace_id").agg(F.avg(F.col("success_count") / 4).alias("a"), F.avg("p").alias("b"))


def _draw(n, *parts):
    return f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::bigint % {n}"


_TIMES = " + ".join(f"(u >= {p!r})::int" for p in resampling.DRAWN)


@query("bootstrap_cluster_ci", "RES01 RES02 RES04 RES05 RES11", f"""with {_UNITS}, r as (select domain, trace_id, a - b as d, unnest(range(40)) as rep from u),
dr as (select domain, rep, d, {_draw('4503599627370496', "'boot'", 'domain', 'rep', 'trace_id')} / 4503599627370496e0 as u from r), k as (select domain, rep, d, {_TIMES} as k from dr),
m as (select domain, rep, sum(k * d) / sum(k) as diff from k group by all)
select domain, round(quantile_cont(diff, 0.025e0), 6) as lo, round(quantile_cont(diff, 0.975e0), 6) as hi, abs(quantile_cont(diff, 0.025e0)) <= 0.1e0 and abs(quantile_cont(diff, 0.975e0)) <= 0.1e0 as equivalent from m group by domain""")
def bootstrap_cluster_ci(spark, d):
    reps = resampling.cluster_bootstrap(_units(spark, d).withColumn("diff", F.col("a") - F.col("b")), "domain", "trace_id", ["diff"], 40, "boot")
    return resampling.interval(reps, ["domain"], "diff").withColumn("equivalent", (F.abs("lo") <= 0.1) & (F.abs("hi") <= 0.1))


@query("sign_flip_p", "RES07 RES06", f"with {_UNITS}, f as (select rep, sum((1 - 2 * ({_draw('2', chr(39) + 'flip' + chr(39), 'rep', 'trace_id')})) * (a - b)) as m from (select trace_id, a, b, unnest(range(50)) as rep from u) group by rep), o as (select sum(a - b) as o from u) select count(*) filter (where m >= o - 1e-12) as at_least, (count(*) filter (where m >= o - 1e-12) + 1) / 51e0 as p from f cross join o")
def sign_flip_p(spark, d):
    return resampling.sign_flip_p(_units(spark, d).withColumn("v", F.col("a") - F.col("b")), "trace_id", "v", 50, "flip")


@query("permutation_null", "RES08 RES12", f"""with {_UNITS}, b as (select domain, trace_id, a, b, row_number() over (partition by domain order by trace_id) as rank from u), r as (select domain, trace_id, a, unnest(range(10)) as rep from b),
x as (select domain, rep, a, row_number() over (partition by domain, rep order by md5('perm' || ':' || rep || ':' || trace_id), trace_id) as rank from r), n as (select rep, avg(x.a * b.b) as stat from x join b using (domain, rank) group by rep)
select rep::int as rep, round(stat, 6) as stat from n union all select -1, round(avg(a * b), 6) from u""")
def permutation_null(spark, d):
    out = resampling.permutation_null(_units(spark, d), "domain", "trace_id", "b", "a", 10, "perm")
    return out.select("rep", F.round("stat", 6).alias("stat"))


@query("holm", "RES10 MET23", "with p as (select unnest(['a', 'b', 'c', 'd']) as name, unnest([0.01e0, 0.02e0, 0.5e0, 1e0]) as p), s as (select *, row_number() over (order by p, name) as rn, count(*) over () as m from p) select name, p, max(least(1e0, (m - rn + 1) * p)) over (order by p, name rows between unbounded preceding and current row) as adjusted from s")
def holm(spark, d):
    return resampling.holm(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5), ("d", 1.0)], "name string, p double"), "name", "p")


@query("mcnemar_counts", "RES09", f"with {CK} select base_model, count(*) filter (where p >= 0.5e0 and success_count < 2) as left_only, count(*) filter (where p < 0.5e0 and success_count >= 2) as right_only from ck group by base_model")
def mcnemar_counts(spark, d):
    left, right = F.col("p") >= 0.5, F.col("success_count") >= 2
    return checkpoints(spark, d).groupBy("base_model").agg(F.count_if(left & ~right).alias("left_only"), F.count_if(~left & right).alias("right_only"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"


@query("layernorm_logit", "VEC01 VEC02 FIT02 FIT07", f"""with {EMB}, m as (select vec_id, parent, x, list_avg(x) as mu, list_sum(list_transform(x, lambda v: v * v)) / 64e0 - pow(list_avg(x), 2) as va from emb),
z as (select parent, list_sum(list_transform(range(1, 65), lambda i: (x[i] - mu) / sqrt(va + 1e-5) * (i - 32.5e0) / 64)) + 0.1e0 as logit from m) select parent, round(avg(logit), 5) as mean_logit, round(avg(1 / (1 + exp(-2 * logit))), 5) as mean_p from z group by parent""")
def layernorm_logit(spark, d):
    w = F.array(*[F.lit((i - 32.5) / 64) for i in range(1, 65)])
    z = vector_view(spark, d).select("parent", vectors.affine(vectors.layer_norm(F.col("x")), w, 0.1).alias("logit"))
    return z.groupBy("parent").agg(F.round(F.avg("logit"), 5).alias("mean_logit"), F.round(F.avg(1 / (1 + F.exp(-2 * F.col("logit")))), 5).alias("mean_p"))


@query("axis_decompose", "VEC03 MET13 MET17", f"with {EMB}, z as (select parent, {_DOT.format(a='x', b='list_transform(range(1, 65), lambda j: 0.125e0)')} as c, {_DOT.format(a='x', b='x')} as n from emb) select parent, round(sum(c * c) / sum(n), 6) as eta, round(avg(c), 6) as along from z group by parent")
def axis_decompose(spark, d):
    z = vector_view(spark, d).select("parent", "x", vectors.decompose(F.col("x"), F.array(*[F.lit(2.0)] * 64)).alias("p"))
    return z.groupBy("parent").agg(F.round(F.sum(F.pow("p.along", 2)) / F.sum(vectors.dot(F.col("x"), F.col("x"))), 6).alias("eta"), F.round(F.avg("p.along"), 6).alias("along"))


@query("centroid_separation", "VEC05 VEC10 VEC04 MET14", f"""with {EMB}, e as (select parent, unnest(range(1, 65)) as i, unnest(x) as v from emb), c as (select parent, i, avg(v) as m from e group by all)
select l.parent as left_label, r.parent as right_label, round(sqrt(sum(pow(l.m - r.m, 2))), 6) as distance, round(sum(l.m * r.m) / sqrt(sum(l.m * l.m) * sum(r.m * r.m)), 6) as cosine from c l join c r on l.i = r.i and l.parent < r.parent group by all""")
def centroid_separation(spark, d):
    c = vectors.mean_vectors(vector_view(spark, d), ["parent"], "x", 64)
    pairs = c.select(F.col("parent").alias("left_label"), F.col("mean").alias("a")).join(c.select(F.col("parent").alias("right_label"), F.col("mean").alias("b")), F.col("left_label") < F.col("right_label"))
    return pairs.select("left_label", "right_label", F.round(vectors.norm(vectors.minus(F.col("a"), F.col("b"))), 6).alias("distance"), F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("knn_matched_control", "JOI13", f"""with {EMB}, j as (select a.vec_id, b.vec_id as neighbor, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.x[i] - b.x[i], 2)))), 9) as dist from emb a join emb b on a.fold = b.fold and a.parent <> b.parent),
r as (select *, row_number() over (partition by vec_id order by dist, neighbor) as rank from j) select vec_id, neighbor, rank::int as rank, round(dist, 5) as dist from r where rank <= 3""")
def knn_matched_control(spark, d):
    from ..operators.joins import nearest_with_control

    out = nearest_with_control(vector_view(spark, d), id_="vec_id", block=["fold"], other="parent", vector="x", k=3, tie=F.col("neighbor"))
    return out.select("vec_id", "neighbor", "rank", F.round("dist", 5).alias("dist"))


@query("adherence_loo", "VEC08 VEC09 VEC07 VEC15", f"""with {EMB}, u as (select vec_id, parent, (vec_id % 5) / 4e0 as y, list_transform(x, lambda v: v / sqrt({_DOT.format(a='x', b='x')})) as u from emb), e as (select vec_id, parent, y, unnest(range(1, 65)) as i, unnest(u) as v from u),
s as (select parent, i, sum(v * (y - 0.5e0)) as t from e group by all), a as (select e.vec_id, e.parent, sum(e.v * (s.t - e.v * (e.y - 0.5e0))) as adh from e join s using (parent, i) group by all) select parent, round(avg(adh), 5) as mean_adherence from a group by parent""")
def adherence_loo(spark, d):
    y = F.col("vec_id") % 5 / 4 - 0.5
    u = vector_view(spark, d).select("vec_id", "parent", y.alias("w"), vectors.unit(F.col("x")).alias("u"))
    sums = u.groupBy("parent").agg(*[F.sum(F.get("u", i) * F.col("w")).alias(f"_{i}") for i in range(64)]).select("parent", F.array(*[F.col(f"_{i}") for i in range(64)]).alias("t"))
    own = vectors.dot(F.col("u"), F.zip_with("t", "u", lambda t, v: t - v * F.col("w")))
    return u.join(sums, "parent").groupBy("parent").agg(F.round(F.avg(own), 5).alias("mean_adherence"))


@query("feature_equivalence", "VEC11 VEC12", f"with {EMB}, p as (select vec_id, x, lag(x) over (partition by parent order by vec_id) as y from emb), c as (select {_DOT.format(a='x', b='y')} / sqrt({_DOT.format(a='x', b='x')} * {_DOT.format(a='y', b='y')}) as c from p where y is not null) select count(*) as n, round(min(c), 6) as min_cosine, count(*) filter (where c >= 0.99e0) as same from c")
def feature_equivalence(spark, d):
    p = vector_view(spark, d).withColumn("y", F.lag("x").over(W.partitionBy("parent").orderBy("vec_id"))).where("y is not null")
    c = p.select(vectors.cosine(F.col("x"), F.col("y")).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c"), 6).alias("min_cosine"), F.count_if(F.col("c") >= 0.99).alias("same"))


@query("nucleus_mass", "VEC13 VEC14", "with f as (select event_type, count(*) / (sum(count(*)) over ())::double as p from events group by 1), b as (select *, sum(p) over (order by p desc, event_type) - p as before from f), k as (select event_type, p / sum(p) over () as kept_p from b where before < 0.7e0), c as (select event_type, kept_p, sum(kept_p) over (order by event_type) as c from k) select event_type, round(kept_p, 6) as kept_p, event_type = (select event_type from c where c >= 0.5e0 order by c limit 1) as sampled from c")
def nucleus_mass(spark, d):
    f = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    f = f.select("event_type", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("p"))
    k = vectors.nucleus(f, "p", "event_type", 0.7)
    drawn = vectors.inverse_cdf(k, "kept_p", "event_type", spark.range(1).select(F.lit(0.5).alias("u")), "u").select(F.col("sampled").alias("s"))
    return k.crossJoin(F.broadcast(drawn)).select("event_type", F.round("kept_p", 6).alias("kept_p"), (F.col("event_type") == F.col("s")).alias("sampled"))


@query("plateau_bic", "TRJ01 TRJ02", f"""with {CK}, t as (select trace_id, ordinal, n_checkpoints as n, sum(success_count) over (partition by trace_id order by ordinal) as s, sum(success_count) over (partition by trace_id) as total from ck where n_checkpoints >= 5),
g as (select trace_id, ordinal + 1 as cut, n, s::double as a, (ordinal + 1) * 4e0 as na, (total - s)::double as b, (n - ordinal - 1) * 4e0 as nb from t where ordinal >= 1 and ordinal + 1 <= n - 2),
l as (select trace_id, cut, n, case when a > 0 then a * ln(a / na) else 0 end + case when na > a then (na - a) * ln(1 - a / na) else 0 end + case when b > 0 then b * ln(b / nb) else 0 end + case when nb > b then (nb - b) * ln(1 - b / nb) else 0 end as ll from g)
select trace_id, min_by(cut, (round(-2 * ll, 6), cut))::int as best_cut, round(min(-2 * ll + 3 * ln(n)), 6) as bic from l group by trace_id""")
def plateau_bic(spark, d):
    w = W.partitionBy("trace_id")
    t = checkpoints(spark, d).where("n_checkpoints >= 5").select("trace_id", "ordinal", F.col("n_checkpoints").alias("n"), F.sum("success_count").over(w.orderBy("ordinal")).alias("s"), F.sum("success_count").over(w).alias("total"))
    g = t.where("ordinal >= 1 and ordinal + 1 <= n - 2").select("trace_id", (F.col("ordinal") + 1).alias("cut"), "n", F.col("s").cast("double").alias("a"), ((F.col("ordinal") + 1) * 4.0).alias("na"), (F.col("total") - F.col("s")).cast("double").alias("b"), ((F.col("n") - F.col("ordinal") - 1) * 4.0).alias("nb"))
    part = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / F.col(n))).otherwise(0.0) + F.when(F.col(n) > F.col(k), (F.col(n) - F.col(k)) * F.log(1 - F.col(k) / F.col(n))).otherwise(0.0)
    ll = g.withColumn("ll", part("a", "na") + part("b", "nb"))
    return ll.groupBy("trace_id").agg(F.min_by("cut", F.struct(F.round(-2 * F.col("ll"), 6), "cut")).alias("best_cut"), F.round(F.min(-2 * F.col("ll") + 3 * F.log("n")), 6).alias("bic"))


@query("registry_claim", "REG02 REG03 REG04", f"""with {TR}, j as (select *, status = 'F' as done, status = 'P' as running from tr), r as (select base_model, count(*) filter (where not done and not running) as pending, round(sum(work) filter (where not done and not running), 2) as remaining from j group by base_model),
c as (select base_model, min_by(trace_id, (-work, trace_id)) as next_job from j where not done and not running and problem_group not in (select problem_group from j where running) group by base_model) select base_model, pending, remaining, next_job from r left join c using (base_model)""")
def registry_claim(spark, d):
    j = traces(spark, d)
    open_ = F.col("status") == "O"
    r = j.groupBy("base_model").agg(F.count_if(open_).alias("pending"), F.round(F.sum(F.when(open_, F.col("work"))), 2).alias("remaining"))
    free = j.where(open_).join(j.where("status = 'P'").select("problem_group"), "problem_group", "left_anti")
    c = free.groupBy("base_model").agg(F.min_by("trace_id", F.struct(-F.col("work"), "trace_id")).alias("next_job"))
    return r.join(c, "base_model", "left")


@query("gate_table", "MET19 REP03 MET16", f"with {CK}, m as (select base_model, avg(success_count / 4e0) as s, avg(p) as p from ck group by 1), g as (select base_model, unnest(['success', 'confidence']) as gate, unnest([s >= 0.4e0, p >= 0.6e0]) as ok from m) select gate, count(*) filter (where ok) as passed, case when bool_and(ok) then 'GO' else 'NO_GO' end as verdict from g group by gate")
def gate_table(spark, d):
    m = checkpoints(spark, d).groupBy("base_model").agg(F.avg(F.col("success_count") / 4).alias("s"), F.avg("p").alias("p"))
    g = m.select(F.explode(F.array(F.struct(F.lit("success").alias("gate"), (F.col("s") >= 0.4).alias("ok")), F.struct(F.lit("confidence").alias("gate"), (F.col("p") >= 0.6).alias("ok")))).alias("x")).select("x.*")
    return g.groupBy("gate").agg(F.count_if("ok").alias("passed"), F.when(F.bool_and("ok"), "GO").otherwise("NO_GO").alias("verdict"))


@query("variant_stability", "MET11", f"with {CK} select base_model, round(corr(raw_logit, logit_b), 6) as ab, round(corr(raw_logit, logit_c), 6) as ac, round(corr(logit_b, logit_c), 6) as bc from ck group by base_model")
def variant_stability(spark, d):
    c = lambda a, b: F.round(metrics.safe_corr(a, b), 6)
    return checkpoints(spark, d).groupBy("base_model").agg(c("raw_logit", "logit_b").alias("ab"), c("raw_logit", "logit_c").alias("ac"), c("logit_b", "logit_c").alias("bc"))


@query("calibrate_oof", "FIT01 FIT03 MET04")
def calibrate_oof(spark, d):
    ck = checkpoints(spark, d).withColumn("fold", F.pmod(F.xxhash64("problem_group"), F.lit(5)).cast("int")).withColumn("y", F.col("success_count") / 4)
    params = fitting.crossfit_calibration(ck, model="base_model", fold="fold", trace="trace_id", logit="raw_logit", target="y", folds=5)
    scored = fitting.apply_calibration(ck, params.withColumnRenamed("model", "base_model"), ["base_model", "fold"], "raw_logit", "oof")
    return scored.groupBy("base_model", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("oof"), 6).alias("mean_oof"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("glm_cluster", "FIT04")
def glm_cluster(spark, d):
    return fitting.binomial_glm(checkpoints(spark, d), by="base_model", x=["raw_logit", "ordinal"], success="success_count", trials=4, cluster="trace_id")


@query("ridge_cv", "FIT05")
def ridge_cv(spark, d):
    return fitting.grouped_ridge(checkpoints(spark, d).withColumn("y", F.col("success_count") / 4), x=["raw_logit", "logit_b", "ordinal"], target="y", group="trace_id", folds=5)


@query("pca_whiten", "VEC06")
def pca_whiten(spark, d):
    v = vector_view(spark, d)
    fits = fitting.whitenings(v, by="parent", fold="fold", column="x")
    held = fitting.whiten(v, fits, by="parent", fold="fold", column="x", out="w").groupBy("parent", "fold").agg(F.count(F.lit(1)).alias("heldout_rows"), F.round(F.avg(vectors.dot(F.col("w"), F.col("w")) / F.size("w")), 5).alias("mean_square"))
    return fits.select("parent", "fold", "fit_rows", "dimensions", F.round("explained", 6).alias("explained"), F.round("ridge", 9).alias("ridge")).join(held, ["parent", "fold"])
