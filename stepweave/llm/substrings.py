"""Substring deduplication by compaction of a de Bruijn graph.

Edges of the graph are runs of ``length`` words.  Each edge belongs to its minimizer, the word ``ANCHOR``-mer with the smallest hash in it, and
neighbouring edges with one minimizer travel as one row (a super-edge), keyed by it; so equal
edges meet in one partition wherever they come from, at about five bytes an edge.  There, edges that occur
twice are found.  An edge and the one after it are compacted if neither branches: every place of the one is followed by the other, and
every place of the other follows the one (the ends of texts count as branches).  Within a bucket that makes pieces; over the
buckets, a Spark join of neighbouring pieces with the counts of pieces and of neighbours glues pieces to paths.
So all places of a path are whole.

Paths are verified at their source coordinates: where the words of the texts are at hand again, each place gives the digest of
its words, and the digests of a path must agree.  Where they do not (edges meet by a part of their hash), the windows of
these paths are counted by their own digests, and their texts are done again.

A minimizer that very many texts share would be one large bucket.  Such minimizers are found in a sample (this only steers the work); their
edges are keyed by the whole edge instead, and each task first joins equal ones of its own: what occurs twice in
a task is settled there, and one row tells the other tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, cut
from .textarrays import Words, mix, portions, rolling

LENGTH = 35
ANCHOR = 8
#: Of one text in so many, minimizers seen so often are hot, if they also have this share of all seen (which bounds their number).
SAMPLE, HOT, SHARE = 64, 40, 1e-6
#: Edges that a task works on at once, about.
HELD = 1 << 21
#: Bytes of an edge's hash that travel.
BYTES = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Edges:
    """Edges of the texts of a column, grouped into super-edges: row, first edge, number of edges, key; and the hash of each edge."""

    def __init__(self, col: pa.Array, length: int):
        words = Words(col)
        counts = words.counts()
        n = np.maximum(counts - length + 1, 0)
        row = np.repeat(np.arange(len(counts)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = words.first[:-1][row] + inner
        if not len(row):
            self.row = self.start = self.n = np.zeros(0, np.int64)
            self.key = self.edge = np.zeros(0, np.uint64)
            return
        anchor = min(ANCHOR, length)
        mers = rolling(words.hash, anchor)
        low = np.uint64((1 << 20) - 1)
        lowest = _minima((mers & ~low) | (np.arange(len(mers), dtype=np.uint64) & low), length - anchor + 1)[place]
        at = (place & ~int(low)) | (lowest & low).astype(np.int64)  # the low bits are the place
        at = np.where(at < place, at + (1 << 20), at)
        self.edge = rolling(words.hash, length)[place]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        self.row, self.start, self.key = row[first], inner[first], mers[at[first]]
        self.n = np.diff(np.append(first, len(row)))


def _low(edge: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(edge.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES])


def _binary(raw: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` entries of ``raw`` each."""
    offsets = np.concatenate([[0], np.cumsum(counts * raw.shape[1])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _names(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The names by which edges meet: their bucket and the bytes of their hash that travel."""
    return mix(mix(key) + low * _ODD)


_ROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("txt", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("kind", pa.int8()), ("edges", pa.binary())])
_PIECE = pa.schema([("doc_id", pa.int64()), ("txt", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("piece", pa.int64())])
_NEEDS, _TWICE, _KNOWN = 0, 1, 2


def _hot_minimizers(texts: DataFrame, length: int) -> np.ndarray:
    """Keys of very common minimizers, from a sample of the texts; it only decides how their edges travel.  At most 1 / ``SHARE`` keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(Edges(part.column("t"), length).key.view(np.int64))], ["key"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "txt", F.lit("hot")), F.lit(SAMPLE)) == 0)
    found = cut(some.mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")), NARROW)
    total = found.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["key"] for r in found.where(F.col("n") >= max(HOT, total * SHARE)).collect()], np.int64))


def _found(table: pa.Table) -> pa.RecordBatch:
    """Pieces of repeated edges in the super-edges of whole buckets."""
    n = table["n"].to_numpy().astype(np.int64)
    kind = table["kind"].to_numpy()
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    col = table["edges"].combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    wide[:, :BYTES] = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BYTES)
    name = _names(np.repeat(table["key"].to_numpy().view(np.uint64), n), wide.view("<u8").reshape(-1))
    row = np.repeat(np.arange(len(n)), n)
    _, ids, counts = np.unique(name, return_inverse=True, return_counts=True)
    told = (kind == _TWICE)[row]
    many = (counts >= 2) | (np.bincount(ids, told, len(counts)) > 0)
    flag = many[ids] & ~told
    # neighbours that do not branch
    left = np.flatnonzero(flag[:-1] & flag[1:] & (row[:-1] == row[1:]))
    _, pair, times = np.unique(ids[left] * len(counts) + ids[left + 1], return_inverse=True, return_counts=True)
    glued = np.zeros(len(row) + 1, bool)  # whether an edge belongs to the piece of the one before it
    glued[left + 1] = (times[pair] == counts[ids[left]]) & (times[pair] == counts[ids[left + 1]])
    begin = np.flatnonzero(flag & ~glued[:-1])
    end = np.flatnonzero(flag & ~glued[1:])
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    take = pa.array(row[begin])
    pos = table["pos"].to_numpy()[row[begin]] + inner[begin]
    one = lambda c: table[c].take(take).combine_chunks()
    return pa.RecordBatch.from_arrays([one("doc_id"), one("txt"), pa.array(pos.astype(np.int32)), pa.array((end - begin + 1).astype(np.int32)), pa.array(name[begin].view(np.int64))], schema=_PIECE)


def repeated_pieces(texts: DataFrame, *, length: int) -> DataFrame:
    """(doc_id, txt, pos, n, piece) of (doc_id, txt, t): n repeated edges that do not branch, from word pos on; ``piece`` is the first one's name."""
    hot_keys = texts.sparkSession.sparkContext.broadcast(_hot_minimizers(texts, length))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys.value
        kept: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            """Edges of hot minimizers, joined as far as they have come."""
            edge, pos = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            doc, txt = (pa.concat_arrays([k[i] for k in kept]) for i in (2, 3))
            kept.clear()
            _, first, inverse, counts = np.unique(edge, return_index=True, return_inverse=True, return_counts=True)
            twice = counts >= 2
            settled = np.flatnonzero(twice[inverse])
            for rows, kind in ((first[twice], _TWICE), (first[~twice], _NEEDS), (settled, _KNOWN)):
                for low in range(0, len(rows), 50_000):
                    own = rows[low : low + 50_000]
                    raw, keys = _low(edge[own]), mix(edge[own])
                    if kind == _KNOWN:  # done: these carry their name, and go anywhere
                        bare = np.zeros((len(own), 8), np.uint8)
                        bare[:, :BYTES] = raw
                        raw = _names(keys, bare.view("<u8").reshape(-1)).view(np.uint8).reshape(-1, 8)
                        keys = mix(keys + own.astype(np.uint64))
                    ones = np.ones(len(own), np.int32)
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), doc.take(take), txt.take(take), pa.array(pos[own].astype(np.int32)), pa.array(ones), pa.array(np.full(len(own), kind, np.int8)), _binary(raw, ones)], schema=_ROW)

        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                e = Edges(part.column("t"), length)
                doc, txt = part.column("doc_id"), part.column("txt")
                key = e.key.view(np.int64)
                common = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                raw = _low(e.edge)
                if common.any():
                    each = np.repeat(common, e.n)
                    inner = np.arange(int(e.n.sum())) - np.repeat(np.cumsum(e.n) - e.n, e.n)
                    rows = np.repeat(e.row, e.n)[each]
                    kept.append((e.edge[each], (np.repeat(e.start, e.n) + inner)[each], doc.take(pa.array(rows)), txt.take(pa.array(rows))))
                    raw = raw[~each]
                own = np.flatnonzero(~common)
                take = pa.array(e.row[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own]), doc.take(take), txt.take(take), pa.array(e.start[own].astype(np.int32)), pa.array(e.n[own].astype(np.int32)), pa.array(np.full(len(own), _NEEDS, np.int8)), _binary(raw, e.n[own])], schema=_ROW
                )
                if sum(len(k[0]) for k in kept) > HELD:
                    yield from settle()
        if kept:
            yield from settle()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = pa.compute.equal(batch.column("kind"), pa.scalar(_KNOWN, pa.int8()))
            answered = batch.filter(known)
            if answered.num_rows:
                names = np.frombuffer(b"".join(answered.column("edges").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*(answered.column(c) for c in ("doc_id", "txt", "pos", "n")), pa.array(names)], schema=_PIECE)
            batch = batch.filter(pa.compute.invert(known))
            if not batch.num_rows:
                continue
            if size > HELD and batch.column("key")[-1] != rest[-1].column("key")[-1]:  # all buckets but the last one are whole
                key = batch.column("key").to_numpy()
                begin = int(np.searchsorted(key, key[-1]))
                yield _found(pa.Table.from_batches([*rest, batch.slice(0, begin)]))
                rest, size = [], 0
                batch = batch.slice(begin)
            rest.append(batch)
            size += pa.compute.sum(batch.column("n")).as_py()
        if rest:
            yield _found(pa.Table.from_batches(rest))

    rows = texts.select("doc_id", "txt", "t").mapInArrow(edges, "key long, doc_id long, txt long, pos int, n int, kind tinyint, edges binary")
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(pieces, "doc_id long, txt long, pos int, n int, piece long")


def repeated_paths(texts: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(doc_id, txt, spans) of (doc_id, txt, t): for each text with a repeated run of ``length`` words, its pieces by place, as
    (pos, n, piece, glued): n repeated runs that start at word pos and after, and whether the piece continues the path of the one before it.

    ``txt`` is the xxhash64 of the text; rows equal in both have equal spans.  A run counts as repeated if its words also
    start anywhere else, in the same text or another.
    """
    own = repeated_pieces(texts, length=length).groupBy("doc_id", "txt").agg(F.array_sort(F.collect_set(F.struct("pos", "n", "piece"))).alias("all"))
    own = cut(own)
    previous = F.transform("all", lambda x, i: F.when((i > 0) & (F.get("all", i - 1)["pos"] + F.get("all", i - 1)["n"] == x["pos"]), F.get("all", i - 1)["piece"]))
    placed = own.select("doc_id", "txt", F.explode(F.arrays_zip("all", previous.alias("before"))).alias("x")).select("doc_id", "txt", "x.all.*", "x.before")
    places = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("k"))
    links = placed.where("before is not null").groupBy("before", "piece").agg(F.count(F.lit(1)).alias("n"))
    # the graph's nonbranching nodes: all places of either piece are at the link
    links = links.join(places, "piece").where("n = k").drop("k").join(places.withColumnRenamed("piece", "before"), "before").where("n = k")
    links = cut(links.select("before", "piece", F.lit(True).alias("glued")), NARROW)
    glued = placed.join(links, ["before", "piece"], "left").select("doc_id", "txt", "pos", "n", "piece", F.coalesce("glued", F.lit(False)).alias("glued"))
    return glued.groupBy("doc_id", "txt").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "piece", "glued"))).alias("spans"))


def _digest(data: memoryview) -> tuple[int, int]:
    raw = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class _Texts:
    """The words of a column's texts, joined by single spaces, and its spans."""

    def __init__(self, col: pa.Array, spans: pa.Array, length: int):
        words = Words(col)
        self.first = words.first
        size = words.end - words.start
        self.place = np.concatenate([[0], np.cumsum(size + 1)])
        begin = np.repeat(words.start - self.place[:-1], size + 1)
        at = np.arange(self.place[-1]) + begin
        self.bytes = np.append(words.raw, np.uint8(0x20))[at] if len(at) else np.zeros(0, np.uint8)
        self.bytes[self.place[1:] - 1] = 0x20
        self.size = size
        sizes = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = spans.flatten()
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.pos, self.n, self.piece = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "piece"))
        self.low = words.first[self.row] + self.pos
        self.high = self.low + self.n + length - 1
        cover = np.zeros(len(size) + 1, np.int64)
        np.add.at(cover, self.low, 1)
        np.add.at(cover, self.high, -1)
        self.keep = np.cumsum(cover)[:-1] == 0
        glued = flat.field("glued").to_numpy(zero_copy_only=False).astype(bool)
        self.path = np.flatnonzero(~glued)  # the first piece of each path

    def words_of(self, low: int, high: int) -> memoryview:
        """Words number low to high (exclusive), joined by spaces."""
        return memoryview(self.bytes[self.place[low] : self.place[high] - 1])

    def paths(self) -> list[list[dict]]:
        """Of each row: its paths with their digests."""
        out: list[list[dict]] = [[] for _ in range(len(self.first) - 1)]
        last = np.append(self.path[1:], len(self.row))[: len(self.path)] - 1
        for i, j in zip(self.path.tolist(), last.tolist(), strict=True):
            d1, d2 = _digest(self.words_of(self.low[i], self.high[j]))
            out[self.row[i]].append({"path": int(self.piece[i]), "pos": int(self.pos[i]), "n": int(self.pos[j] + self.n[j] - self.pos[i]), "d1": d1, "d2": d2})
        return out

    def kept(self) -> tuple[np.ndarray, np.ndarray, list[str], list[bytes]]:
        """Of each row: number of words, number removed, digest of the kept words, kept words."""
        left = memoryview(self.bytes[np.repeat(self.keep, self.size + 1)])
        ends = np.concatenate([[0], np.cumsum((self.size + 1) * self.keep)])[self.first]
        texts = [bytes(left[a : max(a, b - 1)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        before = np.concatenate([[0], np.cumsum(self.keep)])[self.first]
        n = np.diff(self.first)
        return n, n - np.diff(before), [hashlib.sha256(x).hexdigest() for x in texts], texts


_PATHS = "array<struct<path:bigint,pos:int,n:int,d1:bigint,d2:bigint>>"


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    right = spans.select(F.col("doc_id").alias("d"), F.col("txt").alias("x"), "spans")
    return texts.join(right, texts["doc_id"].eqNullSafe(right["d"]) & (texts["txt"] == right["x"]), how).select("doc_id", "txt", "t", "spans")


def _stripped(joined: DataFrame, *, length: int, keep_text: bool) -> DataFrame:
    """Texts without the words of their spans, and the digests of their paths."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))
        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                found = _Texts(part.column("t"), part.column("spans"), length)
                n, gone, digest, kept = found.kept()
                cols = [part.column("doc_id"), part.column("txt"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                cols += [pa.array([x.decode() for x in kept], pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found.paths(), kind)], ["doc_id", "txt", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text, "paths"])

    return joined.mapInArrow(strip, "doc_id long, txt long, n_words long, n_removed long, kept_sha256 string, " + "kept_text string, " * keep_text + f"paths {_PATHS}")


def _windows(joined: DataFrame, *, length: int) -> DataFrame:
    """(doc_id, txt, pos, d1, d2): the single windows of the spans, by the digests of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 2 << 20):
                found = _Texts(part.column("t"), part.column("spans"), length)
                rows, pos, one, two = [], [], [], []
                for row, at, low, n in zip(found.row.tolist(), found.pos.tolist(), found.low.tolist(), found.n.tolist(), strict=True):
                    for k in range(n):
                        d1, d2 = _digest(found.words_of(low + k, low + k + length))
                        for to, x in zip((rows, pos, one, two), (row, at + k, d1, d2), strict=True):
                            to.append(x)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("txt").take(take), pa.array(pos, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "txt", "pos", "d1", "d2"])

    return joined.mapInArrow(run, "doc_id long, txt long, pos int, d1 long, d2 long")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and kept_text): the texts without the words of repeated runs.

    All places of a run go, the first included.  Null text counts as empty: no words, the digest of the
    empty text.  Rows with the same doc_id are separate texts.  Texts of fewer than ``length`` words stay as they are.  Other columns are
    ignored, and an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("txt", F.xxhash64("t"))
    found = cut(_stripped(_with_spans(texts, repeated_paths(texts, length=length), "left"), length=length, keep_text=keep_text))
    columns = [c for c in found.columns if c not in ("txt", "paths")]

    # verification: all places of a path must have the same words
    placed = found.select("doc_id", "txt", F.explode("paths").alias("p")).select("doc_id", "txt", "p.*")
    differ = placed.groupBy("path").agg(*[f(c).alias(f"{k}{c}") for c in ("d1", "d2") for k, f in (("lo", F.min), ("hi", F.max))]).where("lod1 <> hid1 or lod2 <> hid2")
    differ = cut(differ.select("path"), NARROW)
    if differ.isEmpty():
        return found.select(*columns)
    once = placed.select("doc_id", "txt", "path", "pos", "n").distinct()
    again = cut(once.join(differ, "path", "left_semi").select("doc_id", "txt").distinct(), NARROW)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["txt"] == b["txt"])
    spans = lambda rows: rows.groupBy("doc_id", "txt").agg(F.array_sort(F.collect_set(F.struct("pos", "n", F.lit(0).cast("long").alias("piece"), F.lit(False).alias("glued")))).alias("spans"))
    windows = cut(_windows(_with_spans(texts, spans(once.join(differ, "path", "left_semi")), "inner"), length=length), NARROW)
    true = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d1", "d2")
    single = windows.join(true, ["d1", "d2"], "left_semi").select("doc_id", "txt", "pos", F.lit(1).alias("n"))
    sound = once.join(again, same(once, again), "left_semi").join(differ, "path", "left_anti").select("doc_id", "txt", "pos", "n")
    redone = _stripped(_with_spans(texts.join(again, same(texts, again), "left_semi"), spans(sound.unionByName(single)), "left"), length=length, keep_text=keep_text)
    return found.join(again, same(found, again), "left_anti").select(*columns).unionByName(redone.select(*columns))
