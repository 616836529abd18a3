"""Best-fit packing of token sequences with exact complements.

Documents become token ids (each followed by an end id), ids become pieces of at
most ``capacity`` tokens, and pieces become sequences.  Only the histogram of the
pieces' lengths decides which lengths share a sequence: it has at most
``capacity`` entries whatever the corpus, so the plan is made on the driver and
sent to the tasks, while the pieces themselves never leave the executors.

The plan takes the longest open length, looks up in an index of lengths what fills its gap exactly,
by one piece, by two, or by three, and uses each combination as often as its
lengths are available; what is left goes, longest first, into the fullest
sequence that still has room.  Pieces then find their place by their rank among
the pieces of equal length; ranks are counted within salts, as many as the number of pieces of a length
asks for, so that a length that a third of all pieces share is not one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, cut
from .textarrays import Words, portions

CAPACITY = 4096
#: Pieces of one length and salt that a task ranks, about.
RANKED = 1024
#: Borders of words for the tokenizer: 0 white space, 1 ASCII letters, 2 ASCII marks but the apostrophe, 3 all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = 2
#: Lower-case letters of Latin-1: composed, one run of letters, no context.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
_MOST_CACHED = 1_500_000

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and splits at it, word by word.

    Such a tokenizer gives a text the ids of its words, one after the other, and also splits between an ASCII letter and an
    ASCII mark (but for the apostrophe of contractions).  So each distinct word is encoded once
    and later taken from an index by its 64-bit hash; its bytes are compared each time, and a word that only shares another's hash is
    encoded on its own.  Texts with a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: For words that the normaliser and the splitter leave as they are.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.words: list[bytes] = []  # by number

    def _learn(self, words: Words, keys: np.ndarray, where: np.ndarray) -> None:
        if len(self.keys) > _MOST_CACHED:
            self.forget()
        raw = words.raw.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)]
        plain = np.fromiter((_PLAIN.fullmatch(x) is not None for x in texts), bool, len(texts))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids, n = [], []
        for encode, rows in ((self.bare, np.flatnonzero(plain)), (self.tokenizer, np.flatnonzero(~plain))):
            for low in range(0, len(rows), 20_000):
                own = [raw[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in where[rows[low : low + 20_000]]] if encode is self.tokenizer else [texts[i] for i in rows[low : low + 20_000].tolist()]
                for x in encode.encode_batch_fast(own, add_special_tokens=False):
                    one = x.ids
                    n.append(len(one))
                    ids += one
        n = np.asarray(n, np.int32)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, np.asarray(ids, np.int32)])
        sort = np.argsort(keys[order])
        new = keys[order][sort]
        place = np.searchsorted(self.keys, new)
        self.keys, self.at, self.n = np.insert(self.keys, place, new), np.insert(self.at, place, at[sort]), np.insert(self.n, place, n[sort])
        self.number = np.insert(self.number, place, len(self.words) + order[sort])
        self.words += self._bytes(words, where)

    @staticmethod
    def _bytes(words: Words, where: np.ndarray) -> list[bytes]:
        data = words.data.tobytes()
        return [data[s:e] for s, e in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, joined, and their offsets."""
        words = Words(col, lower=True, classes=_CLASS)
        rows = len(words.first) - 1
        uniq, where, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        other = ~words.same(np.arange(len(words)), where[inverse])  # words with another word's hash
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == uniq[inside]
        if not known.all() and len(self.keys) > _MOST_CACHED:
            known[:] = False
        have = np.flatnonzero(known)
        wrong = [i for i, x, k in zip(have.tolist(), self._bytes(words, where[have]), self.number[place[have]].tolist(), strict=True) if self.words[k] != x]
        if wrong:
            other |= np.isin(inverse, wrong)
        if not known.all():
            self._learn(words, uniq[~known], where[~known])
            place = np.searchsorted(self.keys, uniq)
        n, at, flat = self.n[place][inverse].astype(np.int64), self.at[place][inverse], self.flat
        if other.any():
            apart = np.flatnonzero(other)
            raw = words.raw.tobytes()
            own = [self.tokenizer.encode(raw[words.start[i] : words.end[i]].decode("utf-8", "replace"), add_special_tokens=False).ids for i in apart.tolist()]
            n[apart] = [len(x) for x in own]
            at[apart] = len(flat) + np.cumsum(n[apart]) - n[apart]
            flat = np.concatenate([flat, np.asarray([y for x in own for y in x], np.int32)])
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[words.first]
        whole = words.raw.tobytes() if rows else b""
        if any(x in whole for x in _SPECIAL):
            texts = [x or "" for x in col.to_pylist()]
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(rows)]
            for i, text in enumerate(texts):
                if any(x.decode() in text for x in _SPECIAL):
                    parts[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are those of its whole text (null: none) and ``end_id``; only documents of more than
    ``capacity`` ids are cut, into pieces of that many.  ``tokenizer`` is a file's path on every
    machine, by default the public word BPE.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer or default_tokenizer())
        for batch in batches:
            for part in portions(batch, "text"):
                ids, offsets = own.encode(part.column("text"))
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, low, high in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    whole = np.append(ids[low:high], end_id).astype("<u4")
                    for piece, at in enumerate(range(0, len(whole), capacity)):
                        one = whole[at : at + capacity]
                        for to, x in zip(out, (doc, piece, at, len(one), zlib.crc32(one.tobytes())), strict=False):
                            to.append(x)
                        if keep_ids:
                            out[5].append(one.astype(np.int32))
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_up, schema)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; every piece of the histogram is in exactly one.

    ``histogram`` has the number of pieces by length, 1 to ``capacity``.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(have[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                have[x] -= k * times
            plan.append((tuple(lengths), times))
        return bool(times)

    if have[capacity]:
        use(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if have[a] and have[gap]:
            use(a, gap)
        if have[a] and gap > 1:  # pairs (b, gap - b) with b >= gap - b
            b = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in b[(have[b] > 0) & (have[gap - b] > 0)].tolist():
                if not have[a]:
                    break
                use(a, x, gap - x)
        if have[a] and gap > 2:
            for x in (np.flatnonzero(have[1 : gap - 1]) + 1)[::-1].tolist():
                if not have[a]:
                    break
                rest = gap - x
                if not have[x] or rest > 2 * x:
                    continue
                c = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                for y in c[(have[c] > 0) & (have[rest - c] > 0)].tolist():
                    if not have[a] or not have[x]:
                        break
                    use(a, x, y, rest - y)

    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = int(have[length])
        while n:
            gap = min((g for g in room if g >= length), default=0)
            if gap:
                pattern, count = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                fit = min(count, n)
                if count > fit:
                    room.setdefault(gap, []).append((pattern, count - fit))
                room.setdefault(gap - length, []).append(((*pattern, length), fit))
                n -= fit
            else:
                each = capacity // length
                if full := n // each:
                    room.setdefault(capacity - each * length, []).append(((length,) * each, full))
                if n % each:
                    room.setdefault(capacity - n % each * length, []).append(((length,) * (n % each), 1))
                n = 0
    return plan + [x for left in room.values() for x in left]


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ranks of a length: its key (length, first rank), the sequence of its first piece, and the place in the sequence."""
    used = np.zeros(capacity + 1, np.int64)
    keys, sequences, offsets, sequence = [], [], [], 0
    for pattern, times in plan:
        at = 0
        for length in pattern:
            keys.append((length << 48) + int(used[length]))
            sequences.append(sequence)
            offsets.append(at)
            used[length] += times
            at += length
        sequence += times
    order = np.argsort(np.asarray(keys, np.int64), kind="stable")
    return np.asarray(keys, np.int64)[order], np.asarray(sequences, np.int64)[order], np.asarray(offsets, np.int64)[order]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32, ...).

    The pieces should be a cheap, stable table (a checkpoint): they are read twice.  Equal rows are interchangeable.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    salts = F.split(F.lit(",".join(str(-(-histogram.get(x, 0) // RANKED) or 1) for x in range(1, capacity + 1))), ",").cast("array<int>")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int"))))
    groups = cut(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), NARROW)  # at most capacity rows and one for each RANKED pieces
    keys, sequences, offsets = _places(packing_plan(histogram, capacity), capacity)
    before = groups.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = W.partitionBy("length", "_salt").orderBy(F.asc_nulls_first("doc_id"), "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_key", (F.col("length") * F.lit(1 << 48) + F.col("_before") + F.col("_rank")).cast("long"))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, key, "right") - 1
            cols = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_key").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Packs whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are one piece with the end id alone.  Rows with the same doc_id are separate
    documents.  An empty table gives an empty result; other columns are ignored.
    """
    return pack(cut(token_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id), NARROW), capacity)
