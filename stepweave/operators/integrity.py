"""Audits: named checks over tables, with their failures counted in one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, rows, failures, status): how many rows fail each condition; null counts as failing. One aggregate for all."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col("_n").alias("rows"), F.col(f"c{i}").alias("failures")) for i, name in enumerate(checks)])
    return agg.select(F.explode(rows).alias("_x")).select("_x.*").withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def reasons(checks: dict[str, Column]) -> Column:
    """The sorted names of the conditions a row fails, joined by semicolons."""
    found = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]
    return F.array_join(F.array_sort(F.array_compact(F.array(*found))), ";")


def split_by(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded with reason): nothing is dropped without a reason."""
    named = df.withColumn("reason", reasons(checks))
    return named.where("reason = ''").drop("reason"), named.where("reason <> ''")


def registry_constraints(jobs: DataFrame) -> DataFrame:
    """Constraints of a snapshot of the job table (job_id, model, status, worker, lease_until): as an audit."""
    return audit(jobs, {
        "status_known": F.col("status").isin("pending", "running", "complete", "failed"),
        "running_has_worker": (F.col("status") != "running") | (F.col("worker").isNotNull() & F.col("lease_until").isNotNull()),
        "pending_has_none": (F.col("status") != "pending") | F.col("worker").isNull(),
    })


def expire_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """The snapshot after leases that have ended are given back."""
    gone = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "worker": F.when(~gone, F.col("worker")), "lease_until": F.when(~gone, F.col("lease_until"))})


def finish_jobs(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """The snapshot after reports (job_id, worker, outcome: complete or failed) of the workers that hold the jobs; ``accepted`` is null without a report.

    A report only counts if its worker holds the job and the job is running; others leave the job as it is and are marked.  A complete
    job keeps its worker; a failed one is pending again, without one.
    """
    first = reports.groupBy("job_id").agg(F.min(F.struct("worker", "outcome")).alias("_r"))
    j = jobs.join(first, "job_id", "left")
    held = (F.col("status") == "running") & (F.col("worker") == F.col("_r.worker"))
    accepted = F.when(F.col("_r").isNotNull(), F.coalesce(held, F.lit(False)))
    j = j.withColumn("accepted", accepted)
    done = F.coalesce("accepted", F.lit(False))
    failed = done & (F.col("_r.outcome") != "complete")
    return j.withColumns({"status": F.when(failed, "pending").when(done, "complete").otherwise(F.col("status")), "worker": F.when(~failed, F.col("worker")), "lease_until": F.when(~done, F.col("lease_until"))}).drop("_r")


def claim_checkpoint(jobs: DataFrame, *, worker: str, model: str, now: int, lease: int) -> DataFrame:
    """The snapshot (job_id, checkpoint, model, status, worker, lease_until, priority, work, prefix, attempts) after a worker's claim, with ``claimed``.

    Ended leases are given back first.  The claim takes all pending jobs of one checkpoint of one model, of which no job is running: of
    the worker's model, or else of the model with most pending work; the smallest priority first, then the most work, the shortest
    prefix, the smallest key.  Aggregates find it, and one row is broadcast.
    """
    jobs = expire_leases(jobs, F.lit(now))
    pending = F.col("status") == "pending"
    load = jobs.where(pending).groupBy("model").agg(F.sum("work").alias("_load"))
    active = jobs.where("status = 'running'").select("checkpoint")
    free = jobs.where(pending).groupBy("checkpoint", "model").agg(F.min("priority").alias("_p"), F.sum("work").alias("_w"), F.min("prefix").alias("_x")).join(active, "checkpoint", "left_anti").join(load, "model")
    best = free.agg(F.min_by(F.struct("checkpoint", "model"), F.struct(F.col("model") != model, -F.col("_load"), "model", "_p", -F.col("_w"), "_x", "checkpoint")).alias("_best"))
    mine = pending & F.coalesce((F.col("checkpoint") == F.col("_best.checkpoint")) & (F.col("model") == F.col("_best.model")), F.lit(False))
    j = jobs.crossJoin(F.broadcast(best)).withColumn("claimed", mine).drop("_best")
    won = F.col("claimed")
    return j.withColumns({
        "status": F.when(won, "running").otherwise(F.col("status")), "worker": F.when(won, worker).otherwise(F.col("worker")),
        "lease_until": F.when(won, now + lease).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + won.cast("int"),
    })


def key_violations(keys: dict[str, tuple[DataFrame, list[str]]], references: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """(rule, violations): keys that repeat or hold a null, for each (table, columns); rows without a parent, for each (child, parent, columns)."""
    found = []
    for name, (table, columns) in keys.items():
        bad = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)))
        found.append(bad.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations")))
    for name, (child, parent, columns) in references.items():
        found.append(child.join(parent.select(*columns), columns, "left_anti").agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations")))
    return union_all(found)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
