"""Iterative fits of many groups at once: each step is one aggregate of sums of products, so no task holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

#: Most groups that are fitted together: what the driver and a broadcast hold are a few numbers for each; more are an error.
GROUPS = 10_000


def _stored(rows: DataFrame) -> DataFrame:
    """The narrow table of a fit, written once and read at each step; dealt evenly, so that each step is work for all tasks."""
    spark = rows.sparkSession
    folder = sinks.scratch(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(parts).write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _with_parameters(rows: DataFrame, by: list[str], found: dict[tuple, list]) -> DataFrame:
    """Rows of the groups in ``found`` with their coefficients as ``_b``; there are at most ``GROUPS`` of them."""
    types = ", ".join(f"`_k{i}` {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    own = rows.sparkSession.createDataFrame([(*k, [float(v) for v in b]) for k, b in found.items()], f"{types}, _b array<double>")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return rows.join(F.broadcast(own), on).drop(*[f"_k{i}" for i in range(len(by))])


def _score(x: list[str]) -> Column:
    z = sum((F.col("_b")[i + 1] * F.col(c) for i, c in enumerate(x)), F.col("_b")[0])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def _symmetric(values: list[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = values
    return m + np.triu(m, 1).T


def logistic_fits(rows: DataFrame, *, by: list[str], x: list[str], y: str, w: str, ridge: float = 0.0, steps: int = 50) -> dict[tuple, np.ndarray]:
    """Coefficients (intercept first) of a weighted logistic regression of fractions for each group, by Newton steps.

    ``rows`` is read once a step; each reading sums the gradients and Hessians of all groups that still move.  The columns must not be null.
    """
    k = len(x) + 1
    keys = [tuple(r) for r in rows.select(*by).distinct().limit(GROUPS + 1).collect()]
    if len(keys) > GROUPS:
        raise ValueError(f"fits of more than {GROUPS} groups")
    beta = {key: np.zeros(k) for key in keys}
    moving = set(keys)
    terms = [F.lit(1.0), *[F.col(c) for c in x]]
    p, curve = F.col("_p"), F.col(w) * F.col("_p") * (1 - F.col("_p"))
    sums = [*[F.sum(F.col(w) * (p - F.col(y)) * t) for t in terms], *[F.sum(curve * terms[i] * terms[j]) for i in range(k) for j in range(i, k)]]
    for _ in range(steps):
        if not moving:
            break
        step = _with_parameters(rows, by, {g: beta[g] for g in moving}).withColumn("_p", _score(x)).groupBy(*by).agg(*[c.alias(f"_s{i}") for i, c in enumerate(sums)])
        for r in step.collect():  # a row a group
            key, values = tuple(r)[: len(by)], list(r)[len(by) :]
            move = np.linalg.solve(_symmetric(values[k:], k) + (ridge + 1e-10) * np.eye(k), np.array(values[:k]) + ridge * beta[key])
            beta[key] = beta[key] - move
            if np.abs(move).max() < 1e-10:
                moving.discard(key)
    return beta


def crossfit_calibration(df: DataFrame, *, model: str, fold: str, trace: str, logit: str, target: str, folds: int) -> DataFrame:
    """(model, fold, a, b): a calibrator (slope above 0, intercept) for each fold, fitted on the traces of the other folds.

    Rows go to each fold that they do not belong to; a trace's rows share its weight.  A negative optimum, or a single logit, ends
    at a slope of almost 0 and the logit of the mean.
    """
    own = df.select(F.col(model).alias("model"), F.col(fold).alias("_own"), F.col(trace).alias("_t"), F.col(logit).cast("double").alias("z"), F.col(target).cast("double").alias("y"))
    weights = own.groupBy("model", "_t").agg((1 / F.count(F.lit(1))).alias("w"))
    others = own.join(weights, ["model", "_t"]).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("fold") != F.col("_own"))
    rows = _stored(others.select("model", "fold", "z", "y", "w").dropna())
    fits, out = logistic_fits(rows, by=["model", "fold"], x=["z"], y="y", w="w"), []
    flat = {(r["model"], r["fold"]): r for r in rows.groupBy("model", "fold").agg((F.min("z") == F.max("z")).alias("one"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("rate")).collect()}  # a row a fit
    for key, r in flat.items():
        b, a = map(float, fits[key])
        if r["one"] or a <= 0:
            rate = min(max(r["rate"], 1e-6), 1 - 1e-6)
            a, b = 1e-8, float(np.log(rate / (1 - rate)))
        out.append((*key, a, b))
    return df.sparkSession.createDataFrame(out, "model string, fold int, a double, b double")


def apply_calibration(df: DataFrame, params: DataFrame, on: list[str], logit: str, out: str) -> DataFrame:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("a") * F.col(logit) + F.col("b")))
    return df.join(params, on).withColumn(out, 1 / (1 + F.exp(-z))).drop("a", "b")


def binomial_glm(df: DataFrame, *, by: str, x: list[str], success: str, trials: int, cluster: str) -> DataFrame:
    """(by, term, estimate, se): binomial regression by group with a cluster-robust covariance; rows with a null take no part.

    What is collected is the bread and the meat of each group: sums over rows, and over clusters of their scores.
    """
    k = len(x) + 1
    cols = [F.col(by).alias("g"), F.col(cluster).alias("c"), (F.col(success) / F.lit(float(trials))).alias("y"), F.lit(float(trials)).alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]]
    rows = _stored(df.select(*cols).dropna())
    names = [f"x{i}" for i in range(len(x))]
    fits = logistic_fits(rows, by=["g"], x=names, y="y", w="w")
    terms = [F.lit(1.0), *[F.col(c) for c in names]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    curve, gap = F.col("w") * F.col("_p") * (1 - F.col("_p")), F.col("w") * (F.col("y") - F.col("_p"))
    scored = _with_parameters(rows, ["g"], fits).withColumn("_p", _score(names))
    clusters = scored.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(gap * t).alias(f"s{i}") for i, t in enumerate(terms)], *[F.sum(curve * terms[i] * terms[j]).alias(f"h{i}_{j}") for i, j in pairs])
    total = clusters.groupBy("g").agg(F.count(F.lit(1)), F.sum("n"), *[F.sum(F.col(f"h{i}_{j}")) for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs])
    out = []
    for r in total.collect():  # a row a group
        key, g, n, values = r[0], r[1], r[2], list(r)[3:]
        bread = np.linalg.inv(_symmetric(values[: len(pairs)], k) + 1e-12 * np.eye(k))
        cov = bread @ _symmetric(values[len(pairs) :], k) @ bread * (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1))
        out += [(key, term, float(b), float(v)) for term, b, v in zip(["intercept", *x], fits[(key,)], np.sqrt(np.maximum(np.diag(cov), 0)), strict=True)]
    return df.sparkSession.createDataFrame(out, f"{by} {df.schema[by].dataType.simpleString()}, term string, estimate double, se double")


def grouped_ridge(df: DataFrame, *, x: list[str], target: str, group: str, folds: int, alpha: float = 1.0) -> DataFrame:
    """(fold, n, rmse): ridge on standardised features of the other folds, scored on the held-out one.

    Each fit needs only sums of products, which one aggregate gives for each fold; the training sums of a fold are the total less its own.
    """
    terms = [F.lit(1.0), *[F.col(c) for c in x], F.col(target)]
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")).groupBy("fold").agg(*sums).toPandas()  # a row a fold

    def gram(r) -> np.ndarray:
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        return g

    grams = {int(r["fold"]): gram(r) for _, r in rows.iterrows()}
    total, out = sum(grams.values()), []
    for f, held in sorted(grams.items()):
        g = total - held
        n = g[0, 0]
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-12))
        a = cov[:-1, :-1] / np.outer(sd, sd)
        w = np.linalg.solve(a * n + alpha * np.eye(k - 2), (cov[:-1, -1] / sd) * n) / sd
        c = np.concatenate([[mean[-1] - mean[:-1] @ w], w, [-1.0]])
        out.append((f, int(held[0, 0]), float(np.sqrt(max(c @ held @ c, 0) / held[0, 0]))))
    return df.sparkSession.createDataFrame(out, "fold int, n long, rmse double")


def _moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count, sums and products of the vectors of a partition, by group and fold, as (g, fold, at, value)."""
    found: dict = {}
    for p in parts:
        for key, own in p.groupby(["g", "fold"], dropna=False, sort=False):
            v = np.column_stack([np.ones(len(own)), np.stack(own["v"].to_numpy())])
            found[key] = found.get(key, 0) + v.T @ v
    for (g, fold), m in found.items():
        yield pd.DataFrame({"g": g, "fold": fold, "at": np.arange(m.size), "value": m.ravel()})


def whitenings(df: DataFrame, *, by: str, fold: str, column: str, share: float = 0.95, most: int = 64, ridge: float = 1e-3) -> DataFrame:
    """(by, fold, fit_rows, dimensions, explained, ridge, mean, components): for each fold, principal directions of the other folds' vectors.

    Directions are kept up to a share of the variance, ``most`` and the fitted rows less one, and divided by the root of their variance
    plus ``ridge`` times the mean kept variance.  Tasks pass on sums of products, width squared of them a group and fold; one task holds
    those of a group.  Vectors are of one width without nulls; a fold whose others have fewer than two rows is left out.
    """
    kind = df.schema[by].dataType.simpleString()
    rows = df.where(F.col(column).isNotNull()).select(F.col(by).alias("g"), F.col(fold).cast("int").alias("fold"), F.col(column).cast("array<double>").alias("v"))
    sums = rows.mapInPandas(_moments, f"g {kind}, fold int, at long, value double").groupBy("g", "fold", "at").agg(F.sum("value").alias("value"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        grams = {f: own.sort_values("at")["value"].to_numpy() for f, own in frame.groupby("fold")}
        total, out = sum(grams.values()), []
        width = round(len(total) ** 0.5)
        for f, held in sorted(grams.items()):
            m = (total - held).reshape(width, width)
            n = round(m[0, 0])
            if n < 2:
                continue
            mean = m[0, 1:] / n
            values, vectors = np.linalg.eigh((m[1:, 1:] - n * np.outer(mean, mean)) / (n - 1))
            values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
            cum = np.cumsum(values) / max(values.sum(), 1e-30)
            k = min(int(np.searchsorted(cum, share - 1e-12)) + 1, most, n - 1, width - 1)
            extra = max(ridge * values[:k].mean(), 1e-12)
            directions = vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-12) + extra)
            out.append((frame["g"].iloc[0], f, n, k, float(cum[k - 1]), float(extra), mean.tolist(), directions.T.tolist()))
        return pd.DataFrame(out, columns=["g", "fold", "fit_rows", "dimensions", "explained", "ridge", "mean", "components"])

    schema = f"g {kind}, fold int, fit_rows long, dimensions int, explained double, ridge double, mean array<double>, components array<array<double>>"
    return sums.groupBy("g").applyInPandas(fit, schema).withColumnsRenamed({"g": by, "fold": fold})


def whiten(df: DataFrame, fits: DataFrame, *, by: str, fold: str, column: str, out: str) -> DataFrame:
    """Adds the coordinates of each vector in the whitening of its own fold, which was fitted without it."""
    dot = lambda c: F.aggregate(F.zip_with(F.zip_with(F.col(column), F.col("mean"), lambda a, b: a - b), c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(fits.select(by, fold, "mean", "components"), [by, fold]).withColumn(out, F.transform("components", dot)).drop("mean", "components")


#: Most domains of a probe matrix, which has two fits for each; more are an error.
DOMAINS = 1000


def train_matrix(df: DataFrame, *, domain: str, x: list[str], target: str, ridge: float = 1.0) -> DataFrame:
    """(train, weights): a linear probe for each domain and for all but each domain.

    A row goes to its own domain's fit and to the other domains' leave-one-out fits; rows with a null take no part.
    """
    names = sorted(r[0] for r in df.select(domain).where(F.col(domain).isNotNull()).distinct().limit(DOMAINS + 1).collect())
    if len(names) > DOMAINS:
        raise ValueError(f"a matrix of more than {DOMAINS} domains")
    specs = F.array(F.col(domain), *[F.when(F.col(domain) != n, F.lit(f"without {n}")) for n in names])
    own = [f"x{i}" for i in range(len(x))]
    rows = df.select(F.explode(F.array_compact(specs)).alias("train"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, own, strict=True)], F.col(target).cast("double").alias("y"), F.lit(1.0).alias("w"))
    fits = logistic_fits(_stored(rows.dropna()), by=["train"], x=own, y="y", w="w", ridge=ridge)
    return df.sparkSession.createDataFrame([(k[0], b.tolist()) for k, b in sorted(fits.items())], "train string, weights array<double>")


def evaluate_matrix(df: DataFrame, weights: DataFrame, *, domain: str, x: list[str], target: str) -> DataFrame:
    """(train, test, nll): each probe on each domain; there are at most two probes for each of ``DOMAINS`` domains."""
    z = sum((F.col("weights")[i + 1] * F.col(c) for i, c in enumerate(x)), F.col("weights")[0])
    loss = F.greatest(F.col("_z"), F.lit(0.0)) - F.col(target) * F.col("_z") + F.log1p(F.exp(-F.abs("_z")))
    return df.crossJoin(F.broadcast(weights)).withColumn("_z", z).groupBy("train", F.col(domain).alias("test")).agg(F.round(F.avg(loss), 6).alias("nll"))


def metric_bootstrap(units: DataFrame, *, unit: str, p: str, y: str, replicates: int, seed: str) -> DataFrame:
    """(rep, nll, brier): a metric suite on resampled clusters, from the clusters' sums."""
    from .metrics import nll
    from .resampling import cluster_bootstrap

    per = units.groupBy(unit).agg(F.avg(nll(F.col(p), F.col(y))).alias("nll"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")).withColumn("stratum", F.lit("all"))
    return cluster_bootstrap(per, "stratum", unit, ["nll", "brier"], replicates, seed).drop("stratum")
