"""Order-dependent selections: one small group a task, in a fixed order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def balanced_parents(df: DataFrame, *, model: str, trace: str, domain: str, rate: str, tie: str, quotas: tuple[tuple[str, float, float, int], ...]) -> DataFrame:
    """Per model: for each bucket (name, low, high, quota), the rows nearest to it, one a trace, domains in balance.

    Buckets with the fewest distinct traces for their quota go first; a deficit is filled by the nearest rows that are left.
    Of each domain and rate, as many traces meet in one task as all buckets take: one of them is always left.
    """
    kinds = {name: f"n{i}" for i, (name, *_) in enumerate(quotas)}

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for name, lo, hi, quota in sorted(quotas, key=lambda q: (frame[kinds[q[0]]].iloc[0] / max(q[3], 1), q[0])):
            count: dict = {}
            pool = frame[[model, trace, domain, rate, tie]].assign(_d=(lo - frame[rate]).clip(lower=0) + (frame[rate] - hi).clip(lower=0)).sort_values(["_d", tie], kind="stable")
            for _ in range(quota):
                best = None
                for r in pool.itertuples(index=False):
                    if getattr(r, trace) in taken:
                        continue
                    key = (r._d if hasattr(r, "_d") else r[-1], count.get(getattr(r, domain), 0), getattr(r, tie))
                    if best is None or key < best[0]:
                        best = (key, r)
                if best is None:
                    break
                r = best[1]
                taken.add(getattr(r, trace))
                count[getattr(r, domain)] = count.get(getattr(r, domain), 0) + 1
                out.append((getattr(r, model), name, getattr(r, trace), getattr(r, rate), bool(best[0][0] > 0)))
        return pd.DataFrame(out, columns=[model, "bucket", "trace", "rate", "substitute"])

    cols = df.select(F.col(model).alias("model"), F.col(trace).alias("trace"), F.col(domain).alias("domain"), F.col(rate).alias("rate"), F.col(tie).alias("tie"))
    model, trace, domain, rate, tie = "model", "trace", "domain", "rate", "tie"
    scarcity = cols.groupBy("model").agg(*[F.countDistinct(F.when(F.col("rate").between(lo, hi), F.col("trace"))).alias(kinds[name]) for name, lo, hi, _ in quotas])
    first = cols.groupBy("model", "domain", "rate", "trace").agg(F.min("tie").alias("tie"))
    near = first.withColumn("rn", F.row_number().over(W.partitionBy("model", "domain", "rate").orderBy("tie", "trace"))).where(F.col("rn") <= sum(q[3] for q in quotas)).drop("rn")
    return near.join(scarcity, "model").groupBy("model").applyInPandas(pick, "model string, bucket string, trace long, rate double, substitute boolean")


def quartile_quota(df: DataFrame, *, by: str, quartile: str, trace: str, order: str, each: int) -> DataFrame:
    """Per group: ``each`` rows a quartile, first with traces that are new, then with any.

    Of each quartile, the first rows of as many traces meet in one task as all quartiles take, and its first ``each`` rows.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["quartile", "ord"], kind="stable")
        used, chosen, need = set(), [], {q: each for q in sorted(rows["quartile"].unique())}
        for fresh in (True, False):
            taking = True
            while taking:
                taking = False
                for q in need:
                    if not need[q]:
                        continue
                    for i, r in rows[rows["quartile"] == q].iterrows():
                        if i not in chosen and (not fresh or r["trace"] not in used):
                            chosen.append(i)
                            used.add(r["trace"])
                            need[q] -= 1
                            taking = True
                            break
        out = rows.loc[chosen]
        return pd.DataFrame({"grp": out["grp"], "quartile": out["quartile"], "trace": out["trace"], "place": range(1, len(out) + 1)})

    cols = df.select(F.col(by).alias("grp"), F.col(quartile).cast("int").alias("quartile"), F.col(trace).alias("trace"), F.col(order).alias("ord"))
    places = cols.groupBy("grp").agg((F.countDistinct("quartile") * each).alias("places"))
    first = cols.groupBy("grp", "quartile", "trace").agg(F.min("ord").alias("ord")).withColumn("rn", F.row_number().over(W.partitionBy("grp", "quartile").orderBy("ord", "trace")))
    fresh = first.join(places, "grp").where("rn <= places").select("grp", "quartile", "trace", "ord")
    again = cols.withColumn("rn", F.row_number().over(W.partitionBy("grp", "quartile").orderBy("ord", "trace"))).where(F.col("rn") <= each).drop("rn")
    return fresh.unionByName(again).distinct().groupBy("grp").applyInPandas(pick, "grp string, quartile int, trace long, place int")


def margin_sample(df: DataFrame, *, id_: str, margins: list[str], count: int, tie: str) -> DataFrame:
    """A sample whose margins stay near the population's: each pick lowers the sum of deviations most, ties by hash.

    Rows are reduced to one candidate a combination of margins and rank before they meet in one task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*margins).orderBy(tie))).where(F.col("_rank") <= count)
    totals = df.groupBy(*margins).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(totals, margins).select(F.col(id_).alias("id"), *[F.col(m).cast("string").alias(f"m{i}") for i, m in enumerate(margins)], F.col(tie).alias("tie"), "_n", "_rank").withColumn("one", F.lit(1))
    k = len(margins)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame[frame["_rank"] == 1]
        total = first["_n"].sum()
        want = [first.groupby(f"m{i}")["_n"].sum() / total * count for i in range(k)]
        have: list[dict] = [{} for _ in range(k)]
        pool = frame.sort_values(["_rank", "tie"], kind="stable").to_dict("records")
        out = []
        while len(out) < count and pool:
            gain = lambda r: sum(abs(want[i][r[f"m{i}"]] - have[i].get(r[f"m{i}"], 0)) - abs(want[i][r[f"m{i}"]] - have[i].get(r[f"m{i}"], 0) - 1) for i in range(k))
            best = max(pool, key=lambda r: (gain(r), [-ord(c) for c in str(r["tie"])]))
            pool.remove(best)
            for i in range(k):
                have[i][best[f"m{i}"]] = have[i].get(best[f"m{i}"], 0) + 1
            out.append((best["id"], len(out) + 1))
        return pd.DataFrame(out, columns=["id", "place"])

    return rows.groupBy("one").applyInPandas(pick, "id long, place int")
