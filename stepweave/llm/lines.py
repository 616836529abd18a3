"""Line deduplication with a log-template tree of fixed depth.

A line is parsed by its number of tokens, then by its leading tokens, to a leaf; variable fields become ``<*>``.  Tokens
with a digit, ``@`` or ``://`` are variable by their form.  A leaf knows in how many documents each token stands at each place.  A
line's generalised template keeps the leading tokens and those that are the most frequent at their places, ``SIMILAR`` per cent of all, and
frees the rest; so lines meet whatever their length and the number of fields that vary, and no order of arrival
decides, as it would if templates were grown line by line.
Templates in enough documents are recurring, as lines have them or generalised, and their lines are dropped.  A line with fewer than
``CONSTANT`` constant tokens has no template but itself.

Templates travel as 64-bit hashes, once for each document, and are counted before the shuffle; texts meet only the numbers of the lines to drop.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textarrays import Words, mix, portions

#: Documents that make a template recurring; leading tokens; fewest constant tokens.
MIN_DOCS, LEAD, CONSTANT = 8, 2, 2
#: Per cent of the tokens of merged lines that are constant.
SIMILAR = 60
#: Tokens of a leaf that are held in memory at once; a larger leaf is spooled.
HELD = 1 << 20
_ANY = np.uint64(0xA0761D6478BD642F)


def _line_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over runs of values, each mixed with its place in the run."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(start, end - start).astype(np.uint64)
    return np.add.reduceat(mix(values + place * _ANY), start)


class Lines:
    """Templates of the lines of a column: owner row, line number in the row, template; and what can be merged at the leaves."""

    def __init__(self, col: pa.Array, lead: int = LEAD, constant: int = CONSTANT):
        words = Words(col)
        data = words.raw
        odd = np.zeros(len(data) + 1, np.int64)
        form = (data >= 0x30) & (data <= 0x39) | (data == 0x40)
        if len(data) > 2:
            form[:-2] |= (data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F)
        np.cumsum(form, out=odd[1:])
        variable = odd[words.end] > odd[words.start]
        value = np.where(variable, _ANY, mix(words.hash))
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x0A, out=breaks[1:])
        row = np.repeat(np.arange(len(words.first) - 1), words.counts())
        number = breaks[words.start] - breaks[words.offsets[:-1]][row]  # the line's number in its text
        new = np.ones(len(words), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(words))[: len(start)]
        n = end - start
        fixed = np.add.reduceat((~variable).astype(np.int64), start) if len(start) else n
        size = mix(n.astype(np.uint64))
        self.row, self.number = row[start], number[start]
        # a template of too few constants says too little: the line as it is
        self.template = mix(np.where(fixed >= constant, _line_sums(value, start, end) + size, _line_sums(mix(words.hash), start, end) + (size ^ _ANY)))
        # what is merged at the leaves: tokens in 32 bits, 0 for a variable one
        self.tokens = np.where(variable, np.uint32(0), np.maximum(value >> np.uint64(32), np.uint64(1)).astype(np.uint32))
        at = np.flatnonzero((n > lead) & (fixed >= constant) & (100 * fixed >= SIMILAR * n))
        leaf = size[at]
        for i in range(lead):
            leaf = mix(leaf ^ value[start[at] + i])
        self.merging = self.row[at], start[at], end[at], leaf, self.template[at]


def line_templates(texts: DataFrame, *, once: bool) -> DataFrame:
    """(doc_id, txt, line, template) of (doc_id, txt, t); ``once``: only (template), once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 1 << 19):
                found = Lines(part.column("t"))
                if once:
                    order = np.lexsort((found.template, found.row))
                    row, template = found.row[order], found.template[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(template[first].view(np.int64))], ["template"])
                else:
                    take = pa.array(found.row)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("txt").take(take), pa.array(found.number.astype(np.int32)), pa.array(found.template.view(np.int64))], ["doc_id", "txt", "line", "template"])

    if once:
        return texts.select("t").mapInArrow(run, "template long")
    return texts.select("doc_id", "txt", "t").mapInArrow(run, "doc_id long, txt long, line int, template long")


def leaf_lines(texts: DataFrame) -> DataFrame:
    """(leaf, template, n, tokens) of (t): the lines that can be merged, each template once for some texts, ``n`` of which have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "t", 1 << 19):
                found = Lines(part.column("t"))
                row, start, end, leaf, template = found.merging
                order = np.lexsort((row, template))
                row, template = row[order], template[order]
                new = np.ones(len(row), bool)
                new[1:] = template[1:] != template[:-1]
                text = new.copy()
                text[1:] |= row[1:] != row[:-1]
                first = np.flatnonzero(new)
                n = np.add.reduceat(text.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                pick = order[first]
                raw = memoryview(np.ascontiguousarray(found.tokens)).cast("B")
                tokens = [bytes(raw[4 * a : 4 * b]) for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[pick].view(np.int64)), pa.array(template[first].view(np.int64)), pa.array(n), pa.array(tokens, pa.binary())], ["leaf", "template", "n", "tokens"])

    return texts.select("t").mapInArrow(run, "leaf long, template long, n long, tokens binary")


class _Leaf:
    """The lines of a leaf: rows of tokens, with their own template and the number of documents that have it."""

    def __init__(self, width: int):
        self.width = width
        self.constant = max(CONSTANT, -(-SIMILAR * width // 100))
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []  # own templates and documents; the tokens are in the spool
        self.spool = tempfile.SpooledTemporaryFile(max_size=8 * HELD)  # noqa: SIM115

    def _places(self, tokens: np.ndarray) -> np.ndarray:
        return tokens.astype(np.uint64) | np.arange(self.width, dtype=np.uint64) << np.uint64(32)

    def add(self, own: np.ndarray, docs: np.ndarray, tokens: np.ndarray) -> None:
        keys, inverse = np.unique(self._places(tokens), return_inverse=True)
        counts = np.bincount(inverse.reshape(-1), np.repeat(docs, self.width), len(keys)).astype(np.int64)
        if len(self.keys):
            keys, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        self.keys, self.counts = keys, counts
        self.chunks.append((own, docs))
        self.spool.write(tokens.tobytes())

    def generalised(self, min_docs: int, lead: int = LEAD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Own templates, documents, generalised templates and whether enough documents have each of their tokens, chunk by chunk."""
        self.spool.seek(0)
        for own, docs in self.chunks:
            tokens = np.frombuffer(self.spool.read(4 * self.width * len(own)), np.uint32).reshape(len(own), self.width)
            places = self._places(tokens)
            count = self.counts[np.searchsorted(self.keys, places)]
            count[:, :lead] = np.iinfo(np.int64).max
            count[tokens == 0] = -1
            kept = np.argsort(-count, 1, kind="stable")[:, : self.constant]
            value = np.where(tokens == 0, np.uint64(0), mix(mix(places) + _ANY))
            common = ((count >= min_docs) | (tokens == 0))[np.arange(len(own))[:, None], kept].all(1)
            yield own, docs, mix(np.take_along_axis(value, kept, 1).sum(1, dtype=np.uint64) + np.uint64(self.width)), common
        self.spool.close()


def merged_templates(found: DataFrame, *, min_docs: int) -> DataFrame:
    """(template, wide) of ``leaf_lines``: templates of too few documents, with the generalised one if it may recur.

    Lines come by leaf and template.  Of a leaf, at most ``HELD`` tokens are worked on at once; the rest is spooled to the task's
    temporary file, and only the counts of its distinct tokens stay in memory.
    """

    def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Templates, documents and tokens of the lines of one leaf, equal templates joined."""
        table = pa.Table.from_batches(parts)
        template, n = (table[c].to_numpy() for c in ("template", "n"))
        first = np.flatnonzero(np.append(True, template[1:] != template[:-1]))
        raw = table["tokens"].take(pa.array(first)).to_pylist()
        return template[first], np.add.reduceat(n, first), np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), -1)

    def close(leaf: _Leaf, seed: int) -> Iterator[pa.RecordBatch]:
        several = len(leaf.chunks) > 1
        for own, docs, wide, common in leaf.generalised(min_docs):
            open_ = common & (docs < min_docs)  # the others recur by themselves
            if not several:  # all of the leaf is here
                _, inverse = np.unique(wide, return_inverse=True)
                open_ &= (np.bincount(inverse, docs) >= min_docs)[inverse]
            if open_.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[open_]), pa.array(mix(wide[open_] + np.array([seed]).view(np.uint64)).view(np.int64))], ["template", "wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # lines of one leaf
        size, last, large = 0, None, None

        def feed(parts: list[pa.RecordBatch], hold: bool) -> list[pa.RecordBatch]:
            """Adds lines to the large leaf; those of the last template are held back, as more of them may follow."""
            nonlocal large
            own, docs, tokens = joined(parts)
            left = []
            if hold:
                one = parts[-1].slice(parts[-1].num_rows - 1)
                left = [one.set_column(one.schema.get_field_index("n"), "n", pa.array(docs[-1:]))]
                own, docs, tokens = own[:-1], docs[:-1], tokens[:-1]
            if len(own):
                large = large or _Leaf(tokens.shape[1])
                large.add(own, docs, tokens)
            return left

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal large, rest, size
            if rest and (large or (sum(pa.compute.sum(x.column("n")).as_py() or 0 for x in rest) >= min_docs and rest[0].column("template")[0] != rest[-1].column("template")[-1])):
                feed(rest, False)
            if large:
                yield from close(large, last)
            large, rest, size = None, [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, template, n = (batch.column(c).to_numpy() for c in ("leaf", "template", "n"))
            start = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            end = np.append(start[1:], len(leaf))
            # leaves inside the batch that cannot merge anything are passed over
            able = (np.add.reduceat(n, start) >= min_docs) & (template[start] != template[end - 1])
            able[0] = able[-1] = True
            for i in np.flatnonzero(able).tolist():
                a, b = int(start[i]), int(end[i])
                if last is not None and last != leaf[a]:
                    yield from flush()
                last = int(leaf[a])
                part = batch.slice(a, b - a)
                rest.append(part)
                offsets = np.frombuffer(part.column("tokens").buffers()[1], np.int32)[part.column("tokens").offset :]
                size += int(offsets[b - a] - offsets[0]) // 4
                if size > HELD:
                    rest = feed(rest, True)
                    size = 0
        yield from flush()

    return found.repartition("leaf").sortWithinPartitions("leaf", "template").mapInArrow(run, "template long, wide long")


def drop_template_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text), without the lines of recurring templates.

    A template recurs if it occurs in ``min_docs`` rows or more; all its lines go, in every row.  Lines are what newlines separate;
    a null or empty text has none.  A line with fewer than two constant tokens (``Menu``, ``Page 12``, a line in a script without
    spaces) counts as it is, with its variable tokens; blank lines always stay.  Rows with the same
    doc_id are separate texts.  Other columns are ignored, and an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("txt", F.xxhash64("t"))
    recurring = line_templates(texts, once=True).groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    known = recurring.withColumn("wide", F.lit(None).cast("long")).unionByName(merged_templates(leaf_lines(texts), min_docs=min_docs))
    hits = cut(line_templates(texts, once=False).join(known, "template").select("doc_id", "txt", "line", "wide"))
    # the documents of a generalised template, each once; equal rows are separate texts
    unsure = hits.where(F.col("wide").isNotNull())
    copies = unsure.groupBy("wide", "doc_id", "txt", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("wide", "doc_id", "txt").agg(F.max("n").alias("n"))
    wide = copies.groupBy("wide").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("wide")
    gone = hits.where(F.col("wide").isNull()).unionByName(unsure.join(wide, "wide", "left_semi").select(hits.columns))
    dropped = gone.groupBy("doc_id", "txt").agg(F.collect_set("line").alias("gone"))
    right = dropped.select(F.col("doc_id").alias("d"), F.col("txt").alias("x"), "gone")
    joined = texts.join(right, texts["doc_id"].eqNullSafe(right["d"]) & (texts["txt"] == right["x"]), "left").select("doc_id", "t", "gone")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digests, kept = [], [], [], []
            for text, drop in zip(batch.column("t").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                if drop:
                    out = set(drop)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in out)
                n.append(len(lines))
                gone.append(len(drop or ()))
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_text:
                    kept.append(text)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * keep_text, ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * keep_text])

    return joined.mapInArrow(strip, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * keep_text)
