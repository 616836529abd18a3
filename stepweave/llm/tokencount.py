"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A text is cut into leaves of about ``LEAF`` characters, only at places where the tokenizer's splitter always begins a new pre-token: before a single
space between two characters that are not white space.  Leaves are encoded on their own, and inner nodes hold sums.  An edit re-encodes the leaves
that it touches and, where a cut beside them is no longer safe, the neighbours that share it; sums are
updated on the paths to the root.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 400
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
_encodings: dict = {}


def encoding(path: str | None = None):
    """The byte-level BPE of a rank file; by default the public one of 50k tokens."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def safe(text: str, at: int) -> bool:
    """Whether a pre-token always begins at a place, whatever is further away."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """Runs of about ``leaf`` characters, cut at safe places only."""
    out, at = [], 0
    while len(text) - at > leaf:
        m = _CUT.search(text, at + leaf - 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class CountTree:
    """Leaves of a text and the sums of their token counts and lengths, by levels of pairs."""

    def __init__(self, text: str, enc, leaf: int = LEAF):
        self.enc, self.leaf, self.encoded = enc, leaf, 0
        self.leaves = leaves_of(text, leaf)
        self.levels = [[self._pair(x) for x in self.leaves]]
        self._raise(0)

    def _pair(self, text: str) -> tuple[int, int]:
        self.encoded += len(text)
        return len(text), len(self.enc.encode_ordinary(text))

    def _raise(self, low: int, high: int | None = None) -> None:
        """Sums above the leaves from ``low`` on; with ``high``, the number of leaves is as before, and only the paths of low to high change."""
        level = 0
        while len(self.levels[level]) > 1:
            below = self.levels[level]
            low //= 2
            known = level + 1 < len(self.levels)
            if high is not None and known:
                high //= 2
                self.levels[level + 1][low : high + 1] = [self._sum(below, i) for i in range(low, high + 1)]
            else:
                kept = self.levels[level + 1][:low] if known else []
                low = len(kept)
                self.levels[level + 1 : level + 2] = [kept + [self._sum(below, i) for i in range(low, (len(below) + 1) // 2)]]
            level += 1
        del self.levels[level + 1 :]

    @staticmethod
    def _sum(below: list[tuple[int, int]], i: int) -> tuple[int, int]:
        """Node ``i`` above a level: the sum of two neighbours, or the last one alone."""
        a = below[2 * i]
        if 2 * i + 1 == len(below):
            return a
        b = below[2 * i + 1]
        return a[0] + b[0], a[1] + b[1]

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1] if self.leaves else 0

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a place, and the place where it begins: down from the root."""
        if not self.leaves:
            return 0, 0
        i, begin = 0, 0
        for level in range(len(self.levels) - 2, -1, -1):
            i *= 2
            if i + 1 < len(self.levels[level]) and at >= begin + self.levels[level][i][0]:
                begin += self.levels[level][i][0]
                i += 1
        return i, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end (exclusive)."""
        size = sum(x[0] for x in self.levels[-1])
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        if not self.leaves:
            self.leaves = leaves_of(new, self.leaf)
            self.levels = [[self._pair(x) for x in self.leaves]]
            self._raise(0)
            return
        low, begin = self._find(start)
        high, last = self._find(max(start, end - 1))
        body = "".join(self.leaves[low : high + 1])
        body = body[: start - begin] + new + body[end - begin :]
        # a cut beside the region must still lie before a single space between other characters
        while low > 0 and not (len(body) > 1 and safe(self.leaves[low - 1][-1] + body[:2], 1)):
            low -= 1
            body = self.leaves[low] + body
        while high + 1 < len(self.leaves) and not (body and safe(body[-1] + self.leaves[high + 1][:2], 1)):
            high += 1
            body += self.leaves[high]
        fresh = leaves_of(body, self.leaf)
        as_many = len(fresh) == high + 1 - low
        self.leaves[low : high + 1] = fresh
        self.levels[0][low : high + 1] = [self._pair(x) for x in fresh]
        self._raise(low, high if as_many else None)


def count_edits(docs: DataFrame, edits: Column, *, path: str | None = None, leaf: int = LEAF, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_tokens, n_leaves, n_tokens_edited, n_reencoded (and edited_text).

    ``edits`` is an array of (start, end, new), applied in order, each to the text that the one before left; places are clipped
    to it.  n_reencoded has the characters that the edits made the tree encode again.  Null and empty texts have no tokens
    and no leaves; a null array has no edits, and null fields count as 0 or empty.  Rows with the same doc_id are separate texts; other columns are
    ignored, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), edits.cast("array<struct<start:int,end:int,new:string>>").alias("edits"))
    names = ["doc_id", "n_chars", "n_tokens", "n_leaves", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            texts = []
            for doc, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "edits")), strict=True):
                tree = CountTree(text, enc, leaf)
                row = [doc, len(text), tree.tokens, len(tree.leaves)]
                tree.encoded = 0
                for e in own or ():
                    if e:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                for to, x in zip(out, (*row, tree.tokens, tree.encoded), strict=True):
                    to.append(x)
                if keep_text:
                    texts.append(tree.text)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out] + [pa.array(texts, pa.string())] * keep_text, names + ["edited_text"] * keep_text)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", edited_text string" * keep_text)
