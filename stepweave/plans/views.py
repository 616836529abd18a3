"""Stand-in views over the driver tables: ordered checkpoints of traces, traces, ordered outcomes, vectors.

Each view has a DataFrame form and the same definition as a DuckDB CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: an ordered checkpoint of its order's trace, with 4 outcomes.

    The join and the windows share one partitioning, the order key.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = W.partitionBy("l_orderkey")
    logit = (F.col("l_quantity") - 25.5) / 10
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("trace_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("base_model"),
        F.col("o_custkey").alias("problem_group"),
        F.col("o_orderpriority").alias("domain"),
        (F.row_number().over(order) - 1).alias("ordinal"),
        F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("prefix_tokens"),
        F.sum("l_quantity").over(whole).alias("total_tokens"),
        F.count(F.lit(1)).over(whole).alias("n_checkpoints"),
        (F.round(F.col("l_discount") * 100).cast("int") % 5).alias("success_count"),
        F.lit(4).alias("num_rollouts"),
        logit.alias("raw_logit"),
        (1 / (1 + F.exp(-logit))).alias("p"),
        ((F.col("l_discount") - 0.05) * 40).alias("logit_b"),
        ((F.col("l_tax") - 0.04) * 40).alias("logit_c"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"),
    )


CK = """ck as (
  select l_orderkey as trace_id, 'm' || (o_custkey % 4)::varchar as base_model, o_custkey as problem_group, o_orderpriority as domain,
    (row_number() over w - 1)::int as ordinal,
    sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and current row) as prefix_tokens,
    sum(l_quantity) over (partition by l_orderkey) as total_tokens, count(*) over (partition by l_orderkey) as n_checkpoints,
    (round(l_discount * 100)::int % 5)::int as success_count, 4 as num_rollouts, (l_quantity - 25.5e0) / 10 as raw_logit,
    1 / (1 + exp(-(l_quantity - 25.5e0) / 10)) as p, (l_discount - 0.05e0) * 40 as logit_b, (l_tax - 0.04e0) * 40 as logit_c,
    l_returnflag as flag, l_partkey as part
  from lineitem join orders on l_orderkey = o_orderkey
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("trace_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("base_model"),
        F.col("o_custkey").alias("problem_group"),
        F.col("o_orderpriority").alias("domain"),
        F.col("o_totalprice").alias("work"),
        F.col("o_orderstatus").alias("status"),
    )


TR = """tr as (select o_orderkey as trace_id, 'm' || (o_custkey % 4)::varchar as base_model, o_custkey as problem_group, o_orderpriority as domain,
  o_totalprice as work, o_orderstatus as status from orders)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered binary outcomes of their user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(order) - 1).alias("rollout_index"), (F.col("value") > 10).cast("int").alias("y"), "event_id", "event_type", "value")


RO = """ro as (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as rollout_index, (value > 10)::int as y, event_id, event_type, value from events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("parent"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.col("embedding").cast("array<double>").alias("x"))


EMB = """emb as (select vec_id, label::int as parent, (vec_id % 5)::int as fold, embedding::double[] as x from embeddings)"""
