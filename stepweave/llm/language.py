"""Language identification with averaged hashed subword embeddings.

A text's subwords are the runs of two to four bytes inside its words, with a mark for
a word's begin and end.  Each is hashed to one of ``BUCKETS`` embeddings; their mean goes
through a linear softmax.  Both are trained by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
Scores are calibrated on labelled rows of their own (temperature), and so is the score below which a
prediction is rejected.

At prediction the linear layer is folded into the embeddings, so a subword costs one
lookup a language and whole texts are read at tens of MB a second.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed
from .textarrays import column_bytes

BITS = 16
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Bound of the sample: about so many labelled texts of each language; of a longer text, a stretch of so many characters is read.
PER_LANGUAGE, STRETCH = 1600, 2000
#: Share of right predictions that the rejection may cost, as measured on the calibration rows.
REJECTED = 0.0005
#: Share of wrong ones among the predictions that are not rejected, as measured on the calibration rows.
WRONG = 0.005
#: No prediction with a score of at least this is rejected.
MOST_REJECTED = 0.5

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size, the buckets at each place (``BUCKETS``: none), and the offsets of the rows."""
    b = np.insert(_FOLD[data], offsets, np.uint8(0x20))  # a mark before each text and at the end
    at = offsets + np.arange(len(offsets))
    capital = np.zeros(len(b), bool)
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F) & (b[1:] != 0x97)
    b[capital] += 0x20
    space = b == 0x20
    out = []
    for n in SIZES:
        code = np.zeros(len(b), np.uint32)
        bad = np.zeros(len(b), bool)
        for j in range(n):
            code[: len(b) - j] |= b[j:].astype(np.uint32) << np.uint32(8 * j)
            if 0 < j < n - 1:
                bad[: len(b) - j] |= space[j:]
        if n == 2:
            bad[:-1] |= space[:-1] & space[1:]
        bad[len(b) - n + 1 :] = True
        hashed = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        hashed[bad] = BUCKETS
        out.append(hashed)
    return out, at


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # languages by BUCKETS + 1: a subword's share of each language's score
    bias: np.ndarray
    temperature: float
    least_score: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, rows by languages."""
        return softmax(self.logits(data, offsets) / self.temperature)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams, at = subwords(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        count = np.zeros(len(offsets) - 1)
        for g in grams:
            count += np.add.reduceat((g != BUCKETS).astype(np.int64), at)[:-1]
            for c in range(len(self.languages)):
                total[:, c] += np.add.reduceat(self.table[c][g], at, dtype=np.float64)[:-1]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """The rows of ``docs`` as a struct ``row``, with ``lang_pred``, ``score`` and ``rejected``.

        Every whole text is read.  Null text, a text without a letter, or a model without languages: ``und``, score 0,
        rejected.  A prediction whose score is below the calibrated threshold keeps its language and is
        marked as rejected.
        """
        model = docs.sparkSession.sparkContext.broadcast(self)
        lettered = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))

        def run(texts: pa.Array) -> pa.Array:
            own = model.value
            names = np.asarray([*own.languages, UNKNOWN], object)
            known = texts.is_valid().to_numpy(zero_copy_only=False) & bool(own.languages)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            data, offsets = column_bytes(texts)
            at = 0
            while at < len(texts) and own.languages:  # about a megabyte of text at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
                p = own.scores(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                best[at:to], score[at:to] = p.argmax(1), p.max(1)
                at = to
            best[~known], score[~known] = len(names) - 1, 0.0
            return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(~known | (score < own.least_score))], ["lang_pred", "score", "rejected"])

        # rows stay in the engine, which only sends the texts
        predicted = F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(F.when(lettered, F.col(text).cast("string")))
        return docs.select(packed(docs).alias("row"), predicted.alias("p")).select("row", "p.*")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, stretch: int = STRETCH, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Trains on rows with a language, a text and a remainder of 0 or 1, and calibrates on those with 3.

    The sample is bounded: about ``per_language`` rows of each language, chosen by a hash of the id; of a text of more than ``stretch``
    characters, so many from a place that the hash chooses.  It alone goes to the driver; other rows only count.  Rows without a letter are no examples.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).withColumn("r", remainder(F.col("d")))
    rows = rows.where("l is not null and r is not null and r <> 2").where(F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0), 1.0, 1.0)
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / counts[l]))])
    unit = F.pmod(F.xxhash64("d", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = (F.pmod(F.xxhash64("d", F.lit("place")), F.greatest(F.length("t") - stretch + 1, F.lit(1))) + 1).cast("int")
    sample = rows.where(unit < F.element_at(share, F.col("l"))).select("l", F.substring("t", begin, F.lit(stretch)).alias("t"), "r", "d").collect()
    sample = sorted((tuple(r) for r in sample), key=lambda r: (r[0], r[3], r[1]))
    encoded = [x.encode() for _, x, _, _ in sample]
    grams = []
    for one in encoded:
        g = np.concatenate(subwords(np.frombuffer(one, np.uint8), np.array([0, len(one)]))[0])
        ids, n = np.unique(g[g != BUCKETS], return_counts=True)
        grams.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    label = np.array([languages.index(r[0]) for r in sample], np.int64)
    part = np.array([r[2] for r in sample], np.int64)
    learn = np.flatnonzero(part != 3)

    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.normal(0, 0.1, (BUCKETS + 1, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids, share_of = grams[i]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share_of @ table[ids]
            z = hidden @ weight + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[label[i]] -= 1
            back = weight @ error
            weight -= step * np.outer(hidden, error)
            bias -= step * error
            table[ids] -= (step * 20) * share_of[:, None] * back
    folded = np.ascontiguousarray((table @ weight).T)
    folded[:, BUCKETS] = 0
    model = LanguageModel(languages, folded, bias.astype(np.float64), 1.0, 0.0)

    held = np.flatnonzero(part == 3)
    if len(held):
        texts = [encoded[i] for i in held]
        z = model.logits(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
        own = label[held]
        heats = np.geomspace(0.25, 20, 120)
        loss = [-np.log(softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean() for t in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        model.least_score = least_score(p.max(1), p.argmax(1) == own)
    return model


def least_score(score: np.ndarray, right: np.ndarray) -> float:
    """The score below which predictions are rejected.

    It costs ``REJECTED`` of the right predictions; more only if otherwise over ``WRONG`` of those that stay were wrong, and never one of
    ``MOST_REJECTED`` or above.
    """
    if not right.any():
        return MOST_REJECTED
    low = np.sort(score[right])[int(REJECTED * right.sum())] * 0.999
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    high = score[order[fine[-1]]] if len(fine) else MOST_REJECTED
    return float(min(max(low, high if fine.size == 0 or fine[-1] + 1 < len(order) else 0.0), MOST_REJECTED))
