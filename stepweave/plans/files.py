"""Queries that write files to the shared folder and read them back, and snapshots of the job registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import integrity, selection
from ..registry import query
from ..sources import config, sinks, tables
from .views import CK, TR, checkpoints, table, traces

_NATION = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])


@query("container_rows", "SRC02", "select n_regionkey, count(*) as n, max(n_name) as last from nation group by n_regionkey")
def container_rows(spark, d):
    path = sinks.scratch(spark)
    rows = table(spark, d, "nation").select(F.struct("n_nationkey", "n_name", "n_regionkey").alias("r"))
    rows.agg(F.to_json(F.struct(F.collect_list("r").alias("examples"))).alias("value")).coalesce(1).write.text(path)
    return tables.read_container(spark, path, _NATION).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last"))


@query("annotated_files", "SRC04", "select 'region=' || n_regionkey as folder, count(*) as n, min(n_name) as first from nation where n_regionkey in (1, 3) group by 1")
def annotated_files(spark, d):
    path = sinks.scratch(spark)
    table(spark, d, "nation").withColumn("region", F.col("n_regionkey")).write.partitionBy("region").json(path)
    found = tables.read_globbed(spark, path, _NATION, "*.json", ("region=1", "region=3"))
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("first"))


@query("table_formats", "SRC08 SRC09", "select f.format, n_regionkey::varchar as region, count(*) as n from nation cross join (select unnest(['csv', 'jsonl', 'parquet']) as format) f group by all")
def table_formats(spark, d):
    path, n = sinks.scratch(spark), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.parquet(f"{path}.parquet")
    n.write.json(f"{path}.jsonl")
    n.write.option("header", True).csv(f"{path}.csv")
    read = [tables.read_table(spark, f"{path}.{x}", ["n_regionkey"]).select(F.lit(x).alias("format"), F.col("n_regionkey").cast("string").alias("region")) for x in ("csv", "jsonl", "parquet")]
    return integrity.union_all(read).groupBy("format", "region").agg(F.count(F.lit(1)).alias("n"))


@query("marked_packs", "SRC10 INT06", "select s_nationkey % 3 as pack, count(*) as n, round(sum(s_acctbal), 4) as balance from supplier group by 1")
def marked_packs(spark, d):
    path = sinks.scratch(spark)
    s = table(spark, d, "supplier").withColumn("pack", F.col("s_nationkey") % 3)
    for k in range(3):  # a pack is one file with a marker
        s.where(F.col("pack") == k).coalesce(1).write.parquet(f"{path}/{k}")
    files = tables.file_manifest(spark, path).where("path like '%.parquet'").withColumn("pack_id", F.regexp_extract("path", r"/(\d)/[^/]+$", 1))
    markers = files.select("pack_id", F.lit("complete").alias("status"), "sha256")
    rows = tables.read_packs(spark, files.select("pack_id", "path"), markers, "")
    return rows.groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("balance"))


@query("published_rows", "SRC11 SRC12 SRC14 REP03", "select c_nationkey, count(*) as n, round(sum(c_acctbal), 4) as balance from customer group by c_nationkey")
def published_rows(spark, d):
    path, c = sinks.scratch(spark), table(spark, d, "customer")
    first, second = (sinks.publish(c, path, ["c_custkey"], ["c_custkey", "c_nationkey", "c_acctbal"]) for _ in range(2))
    assert (first, second) == ("written", "kept") and sinks.resume(spark, path, ["c_acctbal"])
    return spark.read.parquet(path).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("configured_rows", "SRC16", "select n_regionkey, count(*) as n from nation where n_regionkey >= 1 and n_name > 'E' group by n_regionkey having count(*) >= 2")
def configured_rows(spark, d):
    """A selection whose bounds come from a configuration: a file, what it includes, and an override."""
    path = sinks.scratch(spark)
    for name, tree in {"base": {"keep": {"region": 0, "name": "A"}, "least": 9}, "own": {"include": "base.json", "keep": {"region": 1}, "least": 2}}.items():
        sinks.shared_json(spark, f"{path}/{name}.json", tree)
    c = config.load(f"{path}/own.json", ["keep.name=E"], lambda p: sinks.shared_text(spark, p))
    rows = table(spark, d, "nation").where((F.col("n_regionkey") >= c["keep"]["region"]) & (F.col("n_name") > c["keep"]["name"]))
    return rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= c["least"])


@query("stage_manifests", "SRC15", f"select 'load' as stage, 'COMPLETE' as status, count(*) as rows, true as traced, '{config.digest({'seed': 7})}' as config from nation union all select 'refused', 'FAILED', null, true, '{config.digest({'seed': 7})}'")
def stage_manifests(spark, d):
    """Manifests of two stages, one of which may not read its input."""
    path = sinks.scratch(spark)
    write = lambda p, value: sinks.shared_json(spark, p, value)
    with config.stage(path, "load", {"seed": 7}, write) as state:
        state["rows"] = table(spark, d, "nation").count()
    try:
        with config.stage(path, "refused", {"seed": 7}, write):
            tables.read_jsonl(spark, f"{path}/free_running")
    except tables.AccessError:
        pass
    found = spark.read.schema("stage string, status string, rows long, seed long, config string, started double, ended double, versions map<string, string>").json(path)
    return found.select("stage", "status", "rows", ((F.col("ended") >= F.col("started")) & (F.col("seed") == 7) & F.col("versions.pyspark").isNotNull()).alias("traced"), "config")


@query("guarded_paths", "FIL11", """with p as (select case n_regionkey % 3 when 0 then 'runs/teacher_forced/' when 1 then 'runs/Free_Running/' else 'runs/final_test_outcomes/free_running/' end || n_name as path from nation)
select array_to_string(list_filter(['free_running', 'final_test_outcomes'], lambda x: contains(lower(path), x)), ',') as refused, count(*) as n, min(path) as first from p group by 1""")
def guarded_paths(spark, d):
    k = F.col("n_regionkey") % 3
    folder = F.when(k == 0, "runs/teacher_forced/").when(k == 1, "runs/Free_Running/").otherwise("runs/final_test_outcomes/free_running/")
    p = table(spark, d, "nation").select(F.concat(folder, "n_name").alias("path"))
    return p.groupBy(F.array_join(tables.refused(F.col("path")), ",").alias("refused")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("report_lines", "REP01", f"""with {TR}, g as (select base_model, status, count(*) as n, min(domain) as d from tr group by all), x as (select 1 + row_number() over (order by base_model, status) as line, '| ' || base_model || ' | ' || status || ' | ' || n || ' | ' || d || ' |' as text from g)
select 0::bigint as line, '| base_model | status | n | domain |' as text union all select 1, '|---|---|---|---|' union all select * from x""")
def report_lines(spark, d):
    """The lines of a Markdown report of a small result."""
    g = traces(spark, d).groupBy("base_model", "status").agg(F.count(F.lit(1)).alias("n"), F.min("domain").alias("domain")).orderBy("base_model", "status")
    return spark.createDataFrame(list(enumerate(sinks.markdown(g).split("\n"))), "line long, text string")


_JOBS = f"""with {TR}, j as (select trace_id as job_id, base_model as model, case status when 'F' then 'complete' when 'O' then 'pending' when 'P' then case when trace_id % 5 = 0 then 'lost' else 'running' end end as status,
 case when (status = 'P' and trace_id % 3 <> 0) or (status = 'O' and trace_id % 7 = 0) then 'w' || trace_id % 4 end as worker, case when status = 'P' then trace_id % 10 end as lease_until from tr)"""


def _jobs(spark, d):
    k, s = F.col("trace_id"), F.col("status")
    status = F.when(s == "F", "complete").when(s == "O", "pending").when(s == "P", F.when(k % 5 == 0, "lost").otherwise("running"))
    worker = F.when(((s == "P") & (k % 3 != 0)) | ((s == "O") & (k % 7 == 0)), F.concat(F.lit("w"), (k % 4).cast("string")))
    return traces(spark, d).select(k.alias("job_id"), F.col("base_model").alias("model"), status.alias("status"), worker.alias("worker"), F.when(s == "P", k % 10).alias("lease_until"))


@query("registry_audit", "REG01", f"""{_JOBS}, c as (select count(*) as n, count(*) filter (where status not in ('pending', 'running', 'complete', 'failed')) as a, count(*) filter (where status = 'running' and (worker is null or lease_until is null)) as b, count(*) filter (where status = 'pending' and worker is not null) as c from j)
select unnest(['status_known', 'running_has_worker', 'pending_has_none']) as "check", n as rows, unnest([a, b, c]) as failures, case when unnest([a, b, c]) = 0 then 'PASS' else 'FAIL' end as status from c""")
def registry_audit(spark, d):
    return integrity.registry_constraints(_jobs(spark, d))


@query("registry_reports", "REG05 REG02", f"""{_JOBS}, r as (select job_id, 'w' || (job_id // 8) % 4 as w, case when job_id % 3 = 1 then 'failed' else 'complete' end as outcome from j where job_id % 2 = 0),
 x as (select j.*, r.outcome, case when r.job_id is not null then coalesce(status = 'running' and worker = r.w, false) end as accepted from j left join r using (job_id))
 select case when accepted and outcome = 'failed' then 'pending' when accepted then 'complete' else status end as status, coalesce(accepted::varchar, 'none') as accepted, count(*) as n, count(case when not coalesce(accepted and outcome = 'failed', false) then worker end) as held from x group by all""")
def registry_reports(spark, d):
    jobs, k = _jobs(spark, d), F.col("job_id")
    reports = jobs.where(k % 2 == 0).select("job_id", F.concat(F.lit("w"), (F.floor(k / 8) % 4).cast("string")).alias("worker"), F.when(k % 3 == 1, "failed").otherwise("complete").alias("outcome"))
    done = integrity.finish_jobs(jobs, reports)
    return done.groupBy("status", F.coalesce(F.col("accepted").cast("string"), F.lit("none")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"), F.count("worker").alias("held"))


@query("registry_lease", "REG02 REG03 REG04 REG05", f"""with {TR}, j as (select trace_id as job_id, problem_group as checkpoint, base_model as model, work, trace_id % 3 as prefix, trace_id % 2 as priority, case when status = 'F' then 'complete' when status = 'P' and trace_id % 10 >= 5 then 'running' else 'pending' end as status from tr),
 f as (select checkpoint, model, min(priority) as p, sum(work) as w, min(prefix) as x from j where status = 'pending' and checkpoint not in (select checkpoint from j where status = 'running') group by all),
 b as (select checkpoint, model from f where model = 'm1' order by p, w desc, x, checkpoint limit 1)
 select job_id, checkpoint, model, 'running' as status, 'w9' as worker, 35 as lease_until, 1 as attempts from j join b using (checkpoint, model) where status = 'pending'""")
def registry_lease(spark, d):
    k = F.col("trace_id")
    held = F.col("status") == "P"
    status = F.when(F.col("status") == "F", "complete").when(held, "running").otherwise("pending")
    jobs = traces(spark, d).select(k.alias("job_id"), F.col("problem_group").alias("checkpoint"), F.col("base_model").alias("model"), "work", (k % 3).alias("prefix"), (k % 2).alias("priority"), status.alias("status"), F.when(held, F.lit("w")).alias("worker"), F.when(held, (k % 10).cast("int")).alias("lease_until"), F.lit(0).alias("attempts"))
    return integrity.claim_checkpoint(jobs, worker="w9", model="m1", now=5, lease=30).where("claimed").select("job_id", "checkpoint", "model", "status", "worker", "lease_until", "attempts")


@query("registry_keys", "REG01", """select 'slot' as rule, count(*) as violations from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
 union all select 'seed', count(*) from (select 1 from lineitem group by l_orderkey, l_partkey having count(*) > 1) union all select 'checkpoint', count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)
 union all select 'parent', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def registry_keys(spark, d):
    slots = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("checkpoint"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("seed"))
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("checkpoint"), "o_orderstatus")
    keys = {"slot": (slots, ["checkpoint", "slot"]), "seed": (slots, ["checkpoint", "seed"]), "checkpoint": (parents, ["checkpoint"])}
    return integrity.key_violations(keys, {"parent": (slots, parents.where("o_orderstatus <> 'P'"), ["checkpoint"])})


@query("worker_loads", "PAK02")
def worker_loads(spark, d):
    """Packs of a model's work on eight workers; compared with a plain loop in tests."""
    packs = checkpoints(spark, d).groupBy("base_model", (F.col("trace_id") % 40).alias("pack")).agg(F.sum("prefix_tokens").cast("double").alias("work"))
    return selection.lpt_workers(packs, "base_model", "pack", "work", 8)
