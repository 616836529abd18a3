"""Small-vector geometry on array columns, with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used below (lambdas would compute it for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column, eps: float = 1e-12) -> Column:
    """The direction; null for a vector of no length."""
    return let(F.struct(x.alias("x"), norm(x).alias("n")), lambda s: F.when(s["n"] > eps, F.transform(s["x"], lambda v: v / s["n"])))


def cosine(x: Column, y: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(x, y), norm(x) * norm(y))))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, v: F.struct((s["a"] + v).alias("a"), (s["b"] + v * v).alias("b")))
    scaled = lambda s: F.struct(s["x"].alias("x"), (s["t"]["a"] / F.size(s["x"])).alias("m"), (s["t"]["b"] / F.size(s["x"])).alias("q"))
    own = let(F.struct(x.alias("x"), sums.alias("t")), scaled)
    return let(own, lambda s: let(F.struct(s["x"].alias("x"), s["m"].alias("m"), F.sqrt(s["q"] - s["m"] * s["m"] + eps).alias("d")), lambda r: F.transform(r["x"], lambda v: (v - r["m"]) / r["d"])))


def affine(x: Column, w: Column, b: Column | float) -> Column:
    return dot(x, w) + b


def decompose(x: Column, w: Column) -> Column:
    """(along, across, error): coefficient on the unit axis, orthogonal rest, and the largest reconstruction error."""

    def parts(s: Column) -> Column:
        rest = F.zip_with(s["x"], s["u"], lambda a, b: a - s["c"] * b)
        back = F.zip_with(F.zip_with(rest, s["u"], lambda a, b: a + s["c"] * b), s["x"], lambda a, b: F.abs(a - b))
        return F.struct(s["c"].alias("along"), rest.alias("across"), F.array_max(back).alias("error"))

    return let(F.struct(x.alias("x"), unit(w).alias("u")), lambda s: let(F.struct(s["x"].alias("x"), s["u"].alias("u"), dot(s["x"], s["u"]).alias("c")), parts))


def mean_vectors(df: DataFrame, by: list[str], column: str, size: int) -> DataFrame:
    """Element-wise means: one aggregate with a sum for each element, combined before the shuffle."""
    means = [F.avg(F.get(F.col(column), i)).alias(f"_{i}") for i in range(size)]
    return df.groupBy(*by).agg(*means).select(*by, F.array(*[F.col(f"_{i}") for i in range(size)]).alias("mean"))


def nucleus(df: DataFrame, p: str, name: str, top: float) -> DataFrame:
    """The most probable values whose mass before them is below ``top``, with renormalised probabilities."""
    from pyspark.sql import Window as W

    before = F.sum(p).over(W.orderBy(F.desc(p), name)) - F.col(p)
    kept = df.withColumn("_b", before).where(F.col("_b") < top).drop("_b")
    return kept.withColumn("kept_p", F.col(p) / F.sum(p).over(W.partitionBy()))


def inverse_cdf(values: DataFrame, p: str, name: str, draws: DataFrame, u: str) -> DataFrame:
    """For each draw, the first value (by name) whose cumulated probability reaches it."""
    from pyspark.sql import Window as W

    cdf = values.select(F.col(name).alias("_v"), F.sum(p).over(W.orderBy(name)).alias("_c"))
    ladder = cdf.agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_l"))  # one row: the values of a distribution
    j = draws.crossJoin(F.broadcast(ladder))
    return j.withColumn("sampled", F.coalesce(F.try_element_at(F.filter("_l", lambda x: x["_c"] >= F.col(u)), F.lit(1))["_v"], F.element_at("_l", -1)["_v"])).drop("_l")
