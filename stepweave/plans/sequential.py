"""Order-dependent and sequential operators, without SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import segments
from ..functions.hashing import stable_hash
from ..operators import greedy
from ..registry import query
from .views import checkpoints, table


@query("boxed_regions", "STR13")
def boxed_regions(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" \\boxed{\\frac{1}{"), F.col("turn").cast("string"), F.lit("}} \\boxed{open")).alias("t"))
    return c.select("conv_id", "turn", F.explode(segments.boxed_udf()("t")).alias("b")).select("conv_id", "turn", "b.content")


@query("segment_documents", "STR32 STR33")
def segment_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = docs.select("doc_id", segments.paragraphs_udf()("text").alias("p"), segments.fixed_udf(64)("text").alias("f"), segments.hybrid_udf()("text").alias("h"))
    return s.select("doc_id", F.size("p").alias("paragraphs"), F.size("f").alias("fixed"), F.size("h").alias("hybrid"))


@query("legacy_lists", "STR28")
def legacy_lists(spark, d):
    lit = F.concat(F.lit("['"), F.col("n_name"), F.lit("'\n 'it\\'s' \"two\"]"))
    return table(spark, d, "nation").select("n_nationkey", segments.legacy_udf()(lit).alias("items"))


def _rated(spark, d):
    ck = checkpoints(spark, d)
    return ck.withColumn("rate", F.col("success_count") / 4).withColumn("tie", stable_hash(F.col("trace_id"), F.col("ordinal")))


@query("balanced_parents", "WIN22")
def balanced_parents(spark, d):
    return greedy.balanced_parents(_rated(spark, d), model="base_model", trace="trace_id", domain="domain", rate="rate", tie="tie", quotas=(("near", 0.35, 0.65, 24), ("high", 0.75, 1.0, 8), ("low", 0.0, 0.25, 8)))


@query("quartile_quota", "TOP08")
def quartile_quota(spark, d):
    w = W.partitionBy("base_model", "domain")
    q = _rated(spark, d).withColumn("quartile", F.ntile(4).over(w.orderBy("p", "tie"))).withColumn("grp", F.concat_ws("/", "base_model", "domain"))
    return greedy.quartile_quota(q, by="grp", quartile="quartile", trace="trace_id", order="tie", each=4)


@query("margin_sample", "TOP10")
def margin_sample(spark, d):
    o = table(spark, d, "orders").withColumn("tie", stable_hash(F.col("o_orderkey")))
    return greedy.margin_sample(o, id_="o_orderkey", margins=["o_orderpriority", "o_orderstatus"], count=40, tie="tie")
