"""Quotas, strata, splits, folds and packs: all by hash order, so input order never matters."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_by_hash(df: DataFrame, bucket: list[str], order: Column, n: Column | int, tie: str) -> DataFrame:
    """The first n rows of each bucket by hash, with their rank."""
    rank = F.row_number().over(W.partitionBy(*bucket).orderBy(order, tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def round_robin(df: DataFrame, strata: list[str], order: list, n: int) -> DataFrame:
    """The first n rows when strata take turns, each in its own order; ``turn`` is the position."""
    inner = F.row_number().over(W.partitionBy(*strata).orderBy(*order))
    some = df.withColumn("_rn", inner).where(F.col("_rn") <= n).orderBy("_rn", *strata).limit(n)
    return some.withColumn("turn", F.row_number().over(W.orderBy("_rn", *strata))).drop("_rn")


def hash_split(u: Column, edges: dict[str, float]) -> Column:
    """The first split whose cumulative share exceeds u."""
    out, total = None, 0.0
    for name, share in edges.items():
        total += share
        out = F.when(u < total, F.lit(name)) if out is None else out.when(u < total, F.lit(name))
    return out.otherwise(F.lit(list(edges)[-1]))


def group_positions(df: DataFrame, group: str, order: Column, by: list[str]) -> DataFrame:
    """(group, *by, position, size): distinct groups in hash order within each stratum."""
    g = df.select(group, *by).distinct().withColumn("_h", order)
    w = W.partitionBy(*by) if by else W.partitionBy()
    return g.withColumn("position", F.row_number().over(w.orderBy("_h", group)) - 1).withColumn("size", F.count(F.lit(1)).over(w)).drop("_h")


def fixed_packs(df: DataFrame, by: list[str], order: list, size: int, id_: str) -> DataFrame:
    """Packs of consecutive rows: (by, pack, n, pack_hash of the ids)."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    rows = df.select(*by, F.col(id_).alias("_id"), at.alias("_at"))
    packs = rows.groupBy(*by, F.floor(F.col("_at") / size).cast("int").alias("pack")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_ids"))
    return packs.select(*by, "pack", "n", F.sha2(F.array_join(F.transform("_ids", lambda x: x["_id"].cast("string")), ","), 256).alias("pack_hash"))


def lpt_packs(df: DataFrame, by: str, id_: str, work: str, capacity: int) -> DataFrame:
    """Longest work first into the least loaded pack that has room: (by, id, pack, load after).

    Groups of ``by`` are independent and meant to be small (a model's manifest); each is one pandas call.
    """

    def deal(frame):
        rows = frame.sort_values([work, id_], ascending=[False, True], kind="stable")
        n = -(-len(rows) // capacity)
        heap, count, out = [(0.0, i) for i in range(n)], [0] * n, []
        for group, one, size in zip(rows[by].tolist(), rows[id_].tolist(), rows[work].tolist(), strict=True):
            load, i = heapq.heappop(heap)
            count[i] += 1
            load += float(size)
            out.append((group, one, i, load))
            if count[i] < capacity:
                heapq.heappush(heap, (load, i))
        import pandas as pd

        return pd.DataFrame(out, columns=[by, id_, "pack", "load"])

    return df.select(by, id_, work).groupBy(by).applyInPandas(deal, f"{by} string, {id_} long, pack int, load double")


def balanced_folds(df: DataFrame, group: str, domain: str, folds: int, order: Column) -> DataFrame:
    """(group, fold): the largest groups first, each to the fold with the fewest rows of its domain, then in all.

    Greedy, so one task places the groups; what it holds is a row a group.
    """
    g = df.groupBy(group, domain).agg(F.count(F.lit(1)).alias("n")).withColumn("h", order).withColumn("_one", F.lit(1))

    def place(frame):
        import pandas as pd

        own, total, out = {}, [0] * folds, []
        for _, r in frame.sort_values([domain, "n", "h"], ascending=[True, False, True], kind="stable").iterrows():
            at = own.setdefault(r[domain], [0] * folds)
            f = min(range(folds), key=lambda i: (at[i], total[i], i))
            at[f] += int(r["n"])
            total[f] += int(r["n"])
            out.append((r[group], f))
        return pd.DataFrame(out, columns=["grp", "fold"])

    return g.groupBy("_one").applyInPandas(place, "grp long, fold int")


def lpt_workers(packs: DataFrame, by: str, pack: str, work: str, workers: int) -> DataFrame:
    """(by, pack, worker, load, load_ratio): longest pack first to the least loaded worker, ties to the smallest one.

    ``load`` is the worker's whole load, ``load_ratio`` the greatest load over the smallest (null if that is 0).  Packs of a group of ``by`` are few.
    """

    def deal(frame):
        import pandas as pd

        rows = frame.assign(_p=frame[pack].astype(str)).sort_values([work, "_p"], ascending=[False, True], kind="stable")
        heap, place = [(0.0, i) for i in range(workers)], []
        for size in rows[work].tolist():
            load, i = heapq.heappop(heap)
            place.append(i)
            heapq.heappush(heap, (load + float(size), i))
        loads = {i: load for load, i in heap}
        low, high = min(loads.values()), max(loads.values())
        return pd.DataFrame({by: rows[by].to_numpy(), pack: rows[pack].to_numpy(), "worker": place, "load": [loads[i] for i in place], "load_ratio": high / low if low else None})

    return packs.select(by, pack, work).groupBy(by).applyInPandas(deal, f"{by} string, {pack} long, worker int, load double, load_ratio double")
