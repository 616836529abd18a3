"""Document fingerprints: MinHash signatures of word shingles.

A fingerprint is the signature of a text's shingle set under ``HASHES`` universal hash
permutations, the low 16 bits of each minimum, written in hexadecimal.  (The minimum of many shingles is small, so its
high bits would be zero in every long text.)  The likeness of two fingerprints is the
share of equal places, which estimates the Jaccard similarity of the sets.  Near pairs come from
bands of the signature, joined in Spark, and are verified on full sets (``near_groups``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .nearcore import linked_classes
from .textarrays import Words, minhash, shingle_sets

HASHES = 128
SHINGLE = 5


def fingerprints_of(texts: list[str | None], *, shingle: int = SHINGLE, hashes: int = HASHES, lower: bool = True) -> np.ndarray:
    """16-bit signatures of texts, a row each; a text without words has the largest value throughout."""
    out = np.empty((len(texts), hashes), ">u2")
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 1 << 21):
            size += len(texts[to] or "")
            to += 1
        values, offsets = shingle_sets(Words(pa.array([x or "" for x in texts[at:to]], pa.large_string()), lower=lower), shingle)
        out[at:to] = minhash(values, offsets, hashes, seed=7) & np.uint32(0xFFFF)
        at = to
    return out


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = 80, bands: int = 32) -> DataFrame:
    """(doc_id, txt, class, group): documents with equal sets share a class, and linked classes a group.

    Signature bands are joined, and links verified by the Jaccard similarity of full shingle sets; see ``nearcore``.
    """
    members, roots = linked_classes(docs, shingle=shingle, percent=percent, bands=bands, rows=HASHES // bands)
    out = members.join(roots, "digest", "left")
    return out.select("doc_id", "txt", F.hex("digest").alias("class"), F.hex("root").alias("group"))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they travel."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [packer.compress(x.encode()) for x in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("txt"), pa.array(data, pa.binary())], ["doc_id", "txt", "z"])


_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("own", pa.binary()), ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DONE, _LAST, _FIRST = 0, 1, 2


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter (floor) of characters replaced by the first as many of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _rows(part: int, ids: list, texts: list[str], shingle: int) -> Iterator[pa.RecordBatch]:
    """Results of all texts but the last, which only serves as the next of the one before it."""
    if len(texts) < 2:
        return
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = fingerprints_of(texts, shingle=shingle), fingerprints_of(changed, shingle=shingle)
    n = len(changed)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()), pa.array([_DONE] * n, pa.int8()), pa.array(ids[:n], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).digest() for x in changed]), pa.array([x.tobytes() for x in own[:-1]]), pa.array([x.tobytes() for x in other]),
            pa.array((own[:-1] == other).mean(1)), pa.array((own[:-1] == own[1:]).mean(1)), pa.array([None] * n, pa.string()),
        ], schema=_OUT,
    )


def _end(part: int, kind: int, doc: int | None, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "doc_id": doc, "text": text}], schema=_OUT)


def edited_fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next
    document; next is by ascending doc_id (null first), of equal ids by the text's xxhash64 and compressed bytes, and after the last comes the first.  near_edited and near_next are
    the likeness of the fingerprint to that of the edited text and of the next document.

    Texts travel once, compressed, to ranges of the id; there each meets the next one.  Of each range the first and the
    last text stay open, and are matched afterwards: one row for each range.  A null text counts
    as empty; a text without words has the fingerprint of the empty set.  Other columns are ignored, and an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("txt", F.xxhash64("t"))
    order = (F.asc_nulls_first("doc_id"), F.asc("txt"))  # rows of one id (null) fall into several ranges
    dealt = rows.mapInArrow(_zipped, "doc_id long, txt long, z binary").repartitionByRange(parts, *order).sortWithinPartitions(*order, "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        part, ids, texts, size, begun = TaskContext.get().partitionId(), [], [], 0, False
        for batch in batches:
            for doc, z in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), strict=True):
                text = unpack.decompress(z).decode()
                if not begun:
                    begun = True
                    yield _end(part, _FIRST, doc, text)
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size > 1 << 21 and len(texts) > 1:
                    yield from _rows(part, ids, texts, shingle)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        yield from _rows(part, ids, texts, shingle)
        if begun:
            yield _end(part, _LAST, ids[-1], texts[-1])

    kinds = "part int, kind tinyint, doc_id long, n_chars long, sha binary, own binary, edited binary, near_edited double, near_next double, text string"
    found = cut(dealt.mapInArrow(run, kinds))
    follows = sorted(r[0] for r in found.where(F.col("kind") == _FIRST).select("part").collect())  # a number for each range
    follow = spark.createDataFrame([(p, follows[(i + 1) % len(follows)]) for i, p in enumerate(follows)], "part int, after int")
    last = found.where(F.col("kind") == _LAST).select("part", "doc_id", "text").join(follow, "part")
    ends = last.join(found.where(F.col("kind") == _FIRST).select(F.col("part").alias("after"), F.col("text").alias("next")), "after").select("part", "doc_id", "text", "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _rows(r["part"], [r["doc_id"]], [r["text"], r["next"]], shingle)

    whole = found.where(F.col("kind") == _DONE).unionByName(ends.mapInArrow(close, kinds))
    hexed = lambda c: F.lower(F.hex(c))
    return whole.select("doc_id", "n_chars", hexed("sha").alias("edited_sha256"), hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", "near_next")
