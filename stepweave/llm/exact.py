"""Exact deduplication by deterministic block naming.

Texts are split into blocks of a fixed number of characters.  Equal blocks get equal
integer names, their places among the distinct blocks sorted by hash, then text; then neighbouring names of
a text are paired, equal pairs get equal names in the same way, and so on, until each text has one name.
Two texts of as many blocks have the same name exactly if they are identical: names
stand for contents, so nothing rests on a hash having no collisions.

Blocks travel once, and equal ones are joined before the shuffle; from then on all tables hold
integers alone.  A name that many texts share is a skewed key of a join against a
unique table, which adaptive execution splits.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, cut, packed

BLOCK = 1024


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct rows with an integer ``name`` each: their place in the sorted table, from 0, however it is partitioned.

    Rows are dealt by ranges of their order, and a row's place is that in its partition after the sizes of those before; the
    sizes, a number a partition, are all that is collected.
    """
    dealt = keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = cut(dealt, NARROW).withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    begins = [0, *accumulate(n for _, n in sizes)]
    first = keys.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins, strict=False)], "part long, first long")
    place = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(first), "part").select(*keys.columns, place.alias("name"))  # a row a partition


def block_names(docs: DataFrame, *, block: int = BLOCK, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, doc_id, sha, n_blocks) and the names (uid, names) of their blocks.

    Blocks meet by a hash; all distinct texts below a hash are compared as texts, and where there are several each has a
    name of its own.  ``hash_bits`` makes hashes worse on purpose, for tests.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    hashed = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits)
    own = docs.select(F.col("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("txt"), blocks.alias("blocks"))
    rows = cut(own.select("doc_id", "sha", "txt", F.transform("blocks", hashed).alias("hashes")).withColumn("uid", F.monotonically_increasing_id()), NARROW)

    found = own.select(F.explode("blocks").alias("b")).select(hashed(F.col("b")).alias("h"), "b").groupBy("h").agg(F.sort_array(F.collect_set("b")).alias("texts"))
    found = found.select("h", F.size("texts").alias("n"), F.posexplode("texts").alias("no", "b"))
    names = _named(found.select("h", "no", "n", F.when(F.col("n") > 1, F.col("b")).alias("b")), "h", "no")

    places = rows.select("uid", "doc_id", "sha", F.posexplode("hashes").alias("pos", "h"))
    placed = places.join(names.where("n = 1").select("h", "name"), "h").select("uid", "pos", "name")
    shared = names.where("n > 1")
    if not shared.isEmpty():  # different blocks with one hash: those go by their texts
        texts = own.select("doc_id", "sha", F.posexplode("blocks").alias("pos", "b")).withColumn("h", hashed(F.col("b")))
        texts = texts.join(shared, ["h", "b"]).select("doc_id", "sha", "pos", "name").distinct()
        same = texts["doc_id"].eqNullSafe(places["doc_id"]) & (texts["sha"] == places["sha"]) & (texts["pos"] == places["pos"])
        placed = placed.unionByName(places.join(texts, same).select("uid", places["pos"], "name"))
    return rows.select("uid", "doc_id", "sha", "txt", F.size("hashes").alias("n_blocks")), cut(_in_order(placed), NARROW)


def _in_order(placed: DataFrame) -> DataFrame:
    listed = placed.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_all"))
    return listed.select("uid", F.transform("_all", lambda x: x["name"]).alias("names"))


def _pairs(names: Column) -> Column:
    """Neighbouring names two by two; the last one alone (-1) where their number is odd."""
    at = F.sequence(F.lit(1), F.size(names), F.lit(2))
    return F.transform(at, lambda i: F.struct(F.element_at(names, i).alias("a"), F.coalesce(F.get(names, i), F.lit(-1)).cast("long").alias("b")))


def text_names(docs: DataFrame, *, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """Rows (uid, doc_id, sha, n_blocks, name): equal (n_blocks, name) means equal texts, and the other way round."""
    rows, state = block_names(docs, block=block, hash_bits=hash_bits)
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    done = state.where(F.size("names") == 1).select("uid", F.element_at("names", 1).alias("name"))
    width = 1
    while width < longest:
        width *= 2
        open_ = state.where(F.size("names") > 1)
        pairs = open_.select("uid", F.posexplode(_pairs(F.col("names"))).alias("pos", "p")).select("uid", "pos", "p.a", "p.b")
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        state = cut(_in_order(pairs.join(names, ["a", "b"])), NARROW)
        done = done.unionByName(state.where(F.size("names") == 1).select("uid", F.element_at("names", 1).alias("name")))
    return rows.join(done, "uid")


def exact_duplicates(docs: DataFrame, *, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, txt (the text's xxhash64).

    Of equal texts the row with the largest doc_id stays (null ids are smallest); of rows equal in
    that too, one.  A null text counts as empty, and empty texts are equal.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    named = cut(text_names(docs, block=block, hash_bits=hash_bits), NARROW)
    best = F.max(F.struct("doc_id", (-F.col("uid")).alias("u"))).alias("best")
    groups = cut(named.groupBy("n_blocks", "name").agg(best, F.count(F.lit(1)).alias("group_size")), NARROW)
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == -F.col("best.u")).alias("kept"), F.col("sha").alias("text_sha256"), "txt")


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a decision (doc_id, txt, kept) keeps, with their own columns; txt is the xxhash64 of the text.

    Rows equal in id and text are interchangeable: as many of them stay as are kept.
    """
    kept = decided.groupBy(F.col("doc_id").alias("d"), F.col("txt").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay")).where("stay > 0")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("txt"))
    found = rows.join(kept, rows["doc_id"].eqNullSafe(kept["d"]) & (rows["txt"] == kept["h"]))
    some = found.where("stay < n").withColumn("no", F.row_number().over(W.partitionBy("d", "h").orderBy(F.lit(0)))).where("no <= stay").drop("no")
    return found.where("stay = n").unionByName(some).select("row.*")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text."""
    return keep_rows(docs, exact_duplicates(docs))
