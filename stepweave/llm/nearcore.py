"""Shared parts of near-duplicate search: signatures, bands, sequential tests, exact checks, components.

Documents with equal shingle sets are one class from the start, so copies never meet in pairs.
Within a band's bucket every class is first compared with one representative
(its smallest member), which costs as many rows as there are classes; checked links
give components.  Only buckets whose classes are then still in different
components are read again, and their members compared by signature in blocks; pairs whose
estimate leaves a link possible are checked on full sets.  So a bucket of near copies costs a row a
member, and no pair of different texts in a common bucket goes unseen, whatever the bucket's size.  Of a block only its members are held
in memory; the members of other blocks pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, cut
from .textarrays import Words, minhash, mix, portions, shingle_sets

#: Members of one block of a bucket that is compared pair by pair.
BLOCK = 1024


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digests of sorted shingle sets."""
    import hashlib

    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    at = (offsets * 8).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame, *, shingle: int, hashes: int, lower: bool, seed: int = 1) -> DataFrame:
    """Rows (doc_id, txt, n_shingles, digest, sig) of the whole texts: set size, digest of the set, signature of the low 16 bits of the minima.

    ``txt`` is the xxhash64 of the text; it only tells rows of one doc_id apart.
    """
    schema = "doc_id long, txt long, n_shingles long, digest binary, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                values, offsets = shingle_sets(Words(part.column("t"), lower=lower), shingle)
                raw = (minhash(values, offsets, hashes, seed) & np.uint32(0xFFFF)).astype("<u2").tobytes()
                size = 2 * hashes
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("txt"), pa.array(np.diff(offsets)), pa.array(_digests(values, offsets), pa.binary()), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())],
                    ["doc_id", "txt", "n_shingles", "digest", "sig"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("txt"), text.alias("t")).mapInArrow(run, schema)


def band_keys(classes: DataFrame, *, bands: int, rows: int) -> DataFrame:
    """(digest, key): a key for each band of a class's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(batch.num_rows, bands, rows).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (batch.num_rows, bands))
            for j in range(rows):
                keys = mix(keys ^ sig[:, :, j])
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(np.repeat(np.arange(batch.num_rows), bands))), pa.array(keys.reshape(-1).view(np.int64))], ["digest", "key"])

    return classes.select("digest", "sig").mapInArrow(run, "digest binary, key long")


def full_sets(docs: DataFrame, wanted: DataFrame, *, shingle: int, lower: bool) -> DataFrame:
    """(digest, set) of the wanted (doc_id, txt, digest): their texts are read again, so that sets of other documents are never stored."""
    schema = "digest binary, set binary"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    need = wanted.select(F.col("doc_id").alias("d"), F.col("txt").alias("h"), "digest")
    found = keyed.join(need, keyed["doc_id"].eqNullSafe(need["d"]) & (F.xxhash64("t") == need["h"])).select("digest", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                values, offsets = shingle_sets(Words(part.column("t"), lower=lower), shingle)
                raw = memoryview(np.ascontiguousarray(values)).cast("B")
                at = (offsets * 8).tolist()
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["digest", "set"])

    return found.mapInArrow(run, schema).dropDuplicates(["digest"])


@cache
def least_matches(total: int, step: int, percent: int, miss: float) -> tuple[int, ...]:
    """For each batch end (step, 2 step, ... total): the fewest matches with which a pair may still be similar enough.

    With a uniform prior on the similarity, the posterior after m of n matches is Beta(m + 1, n - m + 1); a pair goes when
    the posterior chance of ``percent`` or more is below its batch's share of ``miss``.  No limit drops a pair at ``percent`` with
    more than that share, so all batches together drop it with ``miss`` at most.
    """
    share = miss / (total // step)
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= percent / 100
    out = []
    for n in range(step, total + 1, step):
        least = 0
        for m in range(n + 1):
            logs = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log(1 - grid)
            if np.exp(logs - log(20_000))[high].sum() >= share:
                least = m
                break
        below = np.cumsum([comb(n, m) * (percent / 100) ** m * (1 - percent / 100) ** (n - m) for m in range(n + 1)])
        out.append(min(least, int(np.searchsorted(below, share, "right"))))
    return tuple(out)


def possible(left: np.ndarray, right: np.ndarray, step: int, percent: int, miss: float) -> np.ndarray:
    """Which pairs of signatures (row by row) survive the sequential test; later batches are only read for pairs still open."""
    open_ = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches(left.shape[1], step, percent, miss)):
        part = slice(i * step, (i + 1) * step)
        matches = matches + (left[open_, part] == right[open_, part]).sum(1)
        stay = matches >= least
        open_, matches = open_[stay], matches[stay]
    out = np.zeros(len(left), bool)
    out[open_] = True
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = len(large) - 1
    return int((large[at] == small).sum()) if len(large) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets share ``percent`` per cent or more of their union."""
    if not len(a) or not len(b):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def sequential_test(pairs: DataFrame, sigs: DataFrame, *, step: int, percent: int, miss: float) -> DataFrame:
    """Of pairs (a, b), those that the sequential test leaves."""
    s = sigs.select("digest", "sig")
    both = pairs.join(s.select(F.col("digest").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("digest").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(possible(left, right, step, percent, miss)))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def exact_test(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("set").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, root): the smallest digest that links reach, for every node of (digest).

    Labels take the smallest among the neighbours and then jump to their label's label, so long chains close in
    few rounds; each round is a checkpoint, and minima are combined before the shuffle.  Ends when a round changes nothing.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(edges, NARROW)
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("digest"), F.least("a", "m").alias("root")), NARROW)
    while True:
        near = edges.join(labels.select(F.col("digest").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels["digest"] == near["a"]).select("digest", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        low = cut(low, NARROW)
        jump = low.select(F.col("digest").alias("root"), F.col("root").alias("far"))
        new = cut(low.join(jump, "root", "left").select("digest", "old", F.coalesce("far", "root").alias("root")), NARROW)
        changed = not new.where("root <> old").isEmpty()
        labels = new.select("digest", "root")
        if not changed:
            break
    return nodes.select("digest").join(labels, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch | None]]:
    """The members of each (key, block), first alone and then with its guests, a batch at a time; only the members are held."""
    home: list[pa.RecordBatch] = []
    now, members = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        guest = batch.column("guest").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            name = (int(key[a]), int(block[a]))
            if name != now:
                if home and members is None:
                    yield pa.Table.from_batches(home), None
                home, now, members = [], name, None
            part = batch.slice(a, b - a)
            if not guest[a]:
                home.append(part)
            elif home:  # guests come after all members
                if members is None:
                    members = pa.Table.from_batches(home)
                    yield members, None
                yield members, part
    if home and members is None:
        yield pa.Table.from_batches(home), None


class _Side:
    """Members of a block, or some of its guests."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.name = table.column("digest").to_pylist()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(self.name), -1)
        self.roots = table.column("root").to_pylist()
        self.root = np.frombuffer(b"".join(self.roots), "<u8").reshape(len(self.name), -1)
        self.size = table.column("n_shingles").to_numpy()


def _pairs(members: _Side, guests: _Side | None, percent: int, step: int, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member (or guest, if there are any): its possible partners among later members (all members), the likeliest first.

    Possible are those of another component whose sizes and signatures allow a link.
    """
    own = members if guests is None else guests
    every = np.arange(len(members.name))
    for i in range(len(own.name)):
        js = every[i + 1 :] if guests is None else every
        js = js[(members.root[js] != own.root[i]).any(1) & (100 * np.minimum(members.size[js], own.size[i]) >= percent * np.maximum(members.size[js], own.size[i]))]
        if len(js):
            js = js[possible(np.broadcast_to(own.sig[i], (len(js), own.sig.shape[1])), members.sig[js], step, percent, miss)]
        if len(js):
            yield i, js[np.argsort(-(members.sig[js] == own.sig[i]).sum(1), kind="stable")]


def _flagged(dealt: DataFrame, percent: int, step: int, miss: float) -> DataFrame:
    """(key, block, digest) of those with a possible partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "digest"]
        found = members = table = None

        def ended() -> Iterator[pa.RecordBatch]:
            if found is not None and found.any():
                yield from table.select(names).filter(pa.array(found)).to_batches()

        for home, part in _blocks(batches):
            if part is None:
                yield from ended()
                table, members = home, _Side(home)
                found = np.zeros(len(members.name), bool)
                for i, js in _pairs(members, None, percent, step, miss):
                    found[i] = found[js] = True
            else:
                near = np.zeros(part.num_rows, bool)
                for i, js in _pairs(members, _Side(part), percent, step, miss):
                    near[i] = found[js] = True
                if near.any():
                    yield part.select(names).filter(pa.array(near))
        yield from ended()

    return dealt.mapInArrow(run, "key long, block int, digest binary")


def _checked(dealt: DataFrame, percent: int, step: int, miss: float) -> DataFrame:
    """(a, b): checked links between components of a block, the likeliest first, and none between what they have already joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held, parent = None, [], {}

        def find(x: bytes) -> bytes:
            while x in parent:
                x = parent[x]
            return x

        for home, part in _blocks(batches):
            table = home if part is None else part
            sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            if part is None:
                members, held, parent = _Side(home), sets, {}
            own = members if part is None else _Side(part)
            links = []
            for i, js in _pairs(members, None if part is None else own, percent, step, miss):
                for j in js.tolist():
                    x, y = find(own.roots[i]), find(members.roots[j])
                    if x != y and similar(sets[i], held[j], percent):
                        parent[x] = y
                        links.append((own.name[i], members.name[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _by_block(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "guest", "digest")


def linked_classes(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, step: int = 32, miss: float = 1e-4, lower: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, roots): rows (doc_id, txt, n_shingles, digest) of all documents, and (digest, root) of all classes.

    Classes are documents with equal shingle sets; those whose sets share ``percent`` per cent of their union are linked, and
    linked classes have one root.  Documents without words are in no class.
    A link is missed if no band agrees, of which the chance at the threshold is (1 - (percent/100) ** rows) ** bands
    (5e-8 as set), or if the sequential test drops it (``miss`` at most, over all its batches); what is reported as linked is
    linked.  ``block`` only sets what one task holds: of a bucket of n classes in several components, those outside its
    largest component are met by n / ``block`` blocks.
    """
    sigs = cut(signatures(docs, shingle=shingle, hashes=bands * rows, lower=lower))
    members = sigs.select("doc_id", "txt", "n_shingles", "digest")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "txt")).alias("f")
    classes = sigs.where("n_shingles > 0").groupBy("digest").agg(F.first("n_shingles").alias("n_shingles"), one, F.first("sig").alias("sig"))
    classes = cut(classes.select("digest", "n_shingles", "f.doc_id", "f.txt", "sig"), NARROW // 10)

    # one representative a bucket
    spread = band_keys(classes, bands=bands, rows=rows)
    buckets = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("rep")).where("n > 1"), NARROW)
    placed = cut(spread.join(buckets, "key").select("key", "digest", "n", "rep"), NARROW)
    pairs = placed.where("digest <> rep").select(F.col("rep").alias("a"), F.col("digest").alias("b")).distinct()
    pairs = cut(sequential_test(pairs, classes, step=step, percent=percent, miss=miss), NARROW)
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    sets = cut(full_sets(docs, classes.join(wanted, "digest").select("doc_id", "txt", "digest"), shingle=shingle, lower=lower))
    links = cut(exact_test(pairs, sets, percent=percent), NARROW)
    roots = cut(components(classes.select("digest"), links), NARROW)

    # larger buckets of more than one component: compared in blocks
    rooted = placed.where("n > 2").select("key", "digest", "n").join(roots, "digest")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("n")).where("lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    left = cut(rooted.drop("n").join(cut(mixed, NARROW), "key"), NARROW)
    if left.isEmpty():
        return members, roots
    sizes = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    main = cut(sizes.groupBy("key").agg(F.max(F.struct("k", "root")).alias("m")).select("key", F.col("m.root").alias("main")), NARROW)
    own = left.join(main, "key").withColumn("at", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    home = own.select("key", F.col("at").alias("block"), "digest", "root", F.lit(False).alias("guest"))
    guests = own.where("root <> main and blocks > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "digest", "root", "at").where("block <> at").select("key", "block", "digest", "root", F.lit(True).alias("guest"))
    dealt = home.unionByName(guests).join(classes.select("digest", "n_shingles", "sig"), "digest").select("key", "block", "digest", "root", "guest", "n_shingles", "sig")
    flags = cut(_flagged(_by_block(dealt), percent, step, miss), NARROW)
    if flags.isEmpty():
        return members, roots
    more = classes.join(flags.select("digest").distinct(), "digest").join(sets.select("digest"), "digest", "left_anti").select("doc_id", "txt", "digest")
    allsets = sets.unionByName(cut(full_sets(docs, more, shingle=shingle, lower=lower)))
    chosen = dealt.join(flags, ["key", "block", "digest"]).join(allsets, "digest").select("key", "block", "digest", "root", "guest", "n_shingles", "sig", "set")
    extra = cut(_checked(_by_block(chosen), percent, step, miss).distinct(), NARROW)
    if not extra.isEmpty():
        roots = cut(components(classes.select("digest"), links.unionByName(extra)), NARROW)
    return members, roots
