"""Joins with declared cardinality, match indicators, two-sided differences, pairs and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A side that was declared unique on its keys is not."""


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one", mandatory: bool = False) -> DataFrame:
    """An equi-join whose declared cardinality is checked first; ``mandatory``: each left row must have a match.

    The check is an aggregate with partial sums on the keys alone; broadcasting is left to the engine's own
    estimate of a side's size.
    """
    for side, df in (("left", left), ("right", right)):
        if validate.startswith("one" if side == "left" else "") and (validate.split("_to_")[0 if side == "left" else 1] == "one") and not repeated_keys(df, keys).isEmpty():
            raise CardinalityError(f"{side} side is not unique on {keys}")
    if mandatory and not left.join(right, keys, "left_anti").isEmpty():
        raise CardinalityError(f"rows without a match on {keys}")
    return left.join(right, keys, how)


def outer_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with ``_merge``: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    j = a.join(b, keys, "full")
    return j.withColumn("_merge", F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")).drop("_l", "_r")


def key_differences(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(side, *keys): missing and unexpected keys, and observed ones that repeat; one aggregate over both sides."""
    both = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_o")).unionByName(observed.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_o")))
    sums = both.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_o").alias("_o"))
    side = F.array_compact(F.array(F.when(F.col("_o") == 0, F.lit("missing")), F.when(F.col("_e") == 0, F.lit("unexpected")), F.when(F.col("_o") > 1, F.lit("duplicate"))))
    return sums.select(F.explode(side).alias("side"), *keys)


def unambiguous_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys with a single value; conflicting keys are left out."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")


def ordered_pairs(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """All pairs of rows (l, r) of a group with l before r, from the group's array: one shuffle, no self-join."""
    own = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_a"))
    pairs = F.flatten(F.transform("_a", lambda x, i: F.transform(F.slice("_a", i + 2, F.greatest(F.size("_a") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("l"), y.alias("r")))))
    return own.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.l", "_p.r")


def reconcile_alias(df: DataFrame, name: str, alias: str) -> DataFrame:
    """Both names with one content: a missing one is made, differing ones raise when read."""
    if alias not in df.columns:
        return df.withColumn(alias, F.col(name))
    if name not in df.columns:
        return df.withColumn(name, F.col(alias))
    same = F.col(name).cast("string").eqNullSafe(F.col(alias).cast("string"))
    return df.withColumn(name, F.when(same, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} differs from {alias}"))))


#: Members of a tile: this many at least and at most; between them, a quarter of the block.
MEMBERS = (2048, 131_072)


def _rounded(d: np.ndarray) -> np.ndarray:
    """To nine decimals, halves away from zero."""
    y = d * 1e9
    whole = np.trunc(y)
    return (whole + (y - whole >= 0.5)) / 1e9


class _Nearest:
    """The k nearest guests of each member of a tile, by rounded distance and tie."""

    def __init__(self, ids: np.ndarray, other: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(other, kind="stable")
        self.ids, self.other, self.x, self.k = ids[order], other[order], x[order], k
        self.centre = self.x.mean(0)
        y = self.x - self.centre
        self.low, self.norm = y.astype(np.float32), (y * y).sum(1)
        self.dist, self.tie, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k), np.int64)

    def meet(self, other: str, ids: np.ndarray, tie: np.ndarray, x: np.ndarray) -> None:
        """Guests of one ``other``; members of the same one do not count them."""
        y = x - self.centre
        norm = (y * y).sum(1)
        low = np.concatenate([y, norm[:, None], np.ones((len(y), 1))], 1).astype(np.float32).T
        a, b = np.searchsorted(self.other, other, "left"), np.searchsorted(self.other, other, "right")
        for start, end in ((0, a), (b, len(self.ids))):
            for i in range(start, end, 1024):
                self._screen(i, min(i + 1024, end), ids, tie, x, low, float(norm.max()))

    def _screen(self, i: int, j: int, ids: np.ndarray, tie: np.ndarray, x: np.ndarray, low: np.ndarray, most: float) -> None:
        bound = (self.dist[i:j, -1] + 1e-9) ** 2
        left = np.concatenate([-2 * self.low[i:j], np.ones((j - i, 1), np.float32), np.zeros((j - i, 1), np.float32)], 1)
        slack = lambda t: (x.shape[1] + 64) * 6e-7 * (3 * self.norm[i:j] + 3 * most + t) + 1e-30  # noqa: E731 - several times the error of single precision
        if np.isinf(bound).any():  # some k guests give a bound for the others
            first = left @ low[:, :512]
            if first.shape[1] >= self.k:
                kth = np.partition(first, self.k - 1, axis=1)[:, self.k - 1] + self.norm[i:j]
                bound = np.minimum(bound, np.maximum(kth, 0) + 2 * slack(np.maximum(kth, 0)))
        finite = np.isfinite(bound)
        left[:, -1] = np.where(finite, self.norm[i:j] - bound - slack(np.where(finite, bound, 0)), -1e37)
        rows, cols = np.nonzero(left @ low <= 0)
        if not len(rows):
            return
        total = np.zeros(len(rows))
        for c in range(x.shape[1]):  # in order, as a sum over the elements
            step = self.x[i + rows, c] - x[cols, c]
            total += step * step
        dist = _rounded(np.sqrt(total))
        well = dist <= self.dist[i + rows, -1]
        rows, cols, dist = rows[well], cols[well], dist[well]
        own = np.unique(rows)
        at = np.concatenate([np.repeat(own, self.k), rows])
        d, t, n = (np.concatenate([held[i + own].reshape(-1), new]) for held, new in ((self.dist, dist), (self.tie, tie[cols]), (self.near, ids[cols])))
        order = np.lexsort((t, d, at))
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        take = (first[:, None] + np.arange(self.k)).reshape(-1)
        for held, new in ((self.dist, d), (self.tie, t), (self.near, n)):
            held[i + own] = new[order][take].reshape(-1, self.k)

    def rows(self, id_: str) -> pa.RecordBatch:
        found = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, found.sum(1))), pa.array(self.near[found]), pa.array(self.dist[found])], [id_, "neighbor", "dist"])


def nearest_with_control(left: DataFrame, *, id_: str, block: list[str], other: str, vector: str, k: int, tie: Column) -> DataFrame:
    """(id, neighbour, rank, distance) of the k nearest rows of the same block and another ``other``.

    All pairs of a block are looked at: its rows are dealt to tiles of members, and every row passes by each tile.  Products in single
    precision leave out what is surely further than the k nearest so far, and the rest is measured in double precision.  Ranks are by
    distance to nine decimals, then by ``tie``, a whole number that depends on the neighbour.  Rows with a missing or infinite element, or
    with another number of elements than most, are joined plainly.
    """
    size = left.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("_n")).agg(F.count(F.lit(1)).alias("_c")).agg(F.max_by("_n", F.struct("_c", "_n")).alias("_n"))
    plain = F.forall(vector, lambda v: F.coalesce(F.abs(v) < 1e15, F.lit(False)))  # NaN is larger than any number
    flagged = left.join(F.broadcast(size)).withColumn("_odd", ~F.coalesce((F.size(vector) == F.col("_n")) & (F.col("_n") > 0) & plain, F.lit(False))).drop("_n")
    a = flagged.select(*block, F.col(id_), F.col(other).alias("_oa"), F.col(vector).alias("_xa"), F.col("_odd").alias("_da"))
    b = flagged.select(*block, F.col(id_).alias("neighbor"), F.col(other).alias("_ob"), F.col(vector).alias("_xb"), F.col("_odd").alias("_db"))
    j = a.where("_da").join(b, block).unionByName(a.where("not _da").join(b.where("_db"), block)).where("_oa <> _ob")
    d = F.sqrt(F.aggregate(F.zip_with("_xa", "_xb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    odd = j.select(F.col(id_), "neighbor", F.round(d, 9).alias("dist"))

    even = flagged.where(~F.col("_odd") & F.col(other).isNotNull()).where(" and ".join(f"`{c}` is not null" for c in [id_, *block]))
    even = even.select(F.to_json(F.struct(*block)).alias("_b"), F.col(id_).cast("long").alias("neighbor"), F.col(other).cast("string").alias("_o"), F.col(vector).cast("array<double>").alias("_x"))
    even = even.withColumn("_t", tie.cast("long"))
    sizes = even.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).select("_b", F.ceil(F.col("n") / F.least(F.lit(MEMBERS[1]), F.greatest(F.lit(MEMBERS[0]), F.ceil(F.col("n") / 4)))).cast("int").alias("m"))
    placed = even.join(sizes, "_b").withColumn("_home", F.pmod(F.xxhash64("neighbor"), "m").cast("int"))
    dealt = placed.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("_guest", F.col("_tile") != F.col("_home"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("_b", "_tile", "_guest", "_o", "_t", "neighbor", "_x").repartition(parts, "_b", "_tile").sortWithinPartitions("_b", "_tile", "_guest", "_o", "_t")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, home, tile = None, [], None

        def open_tile() -> _Nearest:
            ids, o, x = ([part[c] for part in home] for c in (0, 1, 3))
            found = _Nearest(np.concatenate(ids), np.concatenate(o), np.concatenate(x), k)
            for part in home:
                met(found, part)
            return found

        def met(found: _Nearest, part: tuple) -> None:
            ids, o, t, x = part
            cuts = [0, *(np.flatnonzero(o[1:] != o[:-1]) + 1).tolist(), len(o)]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                found.meet(o[p], ids[p:q], t[p:q], x[p:q])

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("_b", "_tile", "_guest")), strict=True))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                ids, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("neighbor", "_t"))
                o = np.array(batch.column("_o").to_pylist())
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
                for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                    if keys[p][:2] != name:
                        if home or tile:
                            yield (tile or open_tile()).rows(id_)
                        name, home, tile = keys[p][:2], [], None
                    part = (ids[p:q], o[p:q], t[p:q], x[p:q])
                    if not keys[p][2]:
                        home.append(part)
                    elif home or tile:
                        if tile is None:
                            tile, home = open_tile(), []
                        met(tile, part)
        if home or tile:
            yield (tile or open_tile()).rows(id_)

    found = dealt.mapInArrow(search, f"`{id_}` long, neighbor long, dist double")
    rank = F.row_number().over(W.partitionBy(id_).orderBy(F.asc_nulls_last("dist"), tie))
    return found.unionByName(odd).withColumn("rank", rank).where(F.col("rank") <= k)


def all_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
