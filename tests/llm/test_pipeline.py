"""The pipeline against a plain version of each stage."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from stepweave.llm import language, packing, queries

from .test_operators import WORD, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    parts = {"en": ["the", "and", "tion", "ing", "wh", "er"], "de": ["sch", "ung", "\u00fc", "der", "\u00df", "ein"]}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 90))]
        rows.append([i, " ".join(words), lang, ("a", "b", None)[i * i % 3], 0])
    for i in range(160, 200):  # copies and near copies
        words = rows[i - 160][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), rows[i - 160][2], rng.choice("abc"), 0])
    rows += [[200, None, None, "a", 0], [201, "", "en", "b", 0], [202, "123 456", "en", "c", 0], [203, "word " * 9000, "en", "c", 0], [5, rows[5][1], "de", "a", 0], [None, "the thing and the other one which was there when the rest came in", "en", None, 0]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["source"] or "")


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=key)


def test_stages_equal_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    at = rows_of(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k == 0:
            model = language.fit(docs)
            at = [r for r in at if any(c.isalpha() for c in r["text"] or "") and model.scores(*coded(r["text"])).max() >= model.least_score]
            assert not {200, 201, 202} & {r["doc_id"] for r in at} and len(at) >= 195
        elif k == 1:
            groups = collections.defaultdict(list)
            for r in at:
                groups[r["text"]].append(r)
            best = {t: max(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))["doc_id"] for t, g in groups.items()}
            got = rows_of(out)
            assert sorted((r["text"], r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((t, d) for t, d in best.items() if d is not None) and len(got) == len(best)
            at = got
        elif k == 2:
            sets = [shingles(r["text"], 5) for r in at]
            root = list(range(len(at)))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for i in range(len(at)):  # rows are in the order of ids, null last
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            at = [r for i, r in enumerate(at) if find(i) == i]
        elif k == 3:
            con = duckdb.connect()
            con.sql(f"create view documents as from '{tmp_path}/{k - 1}/*.parquet'")
            con.sql(f"create view labels as from '{folder}/labels.parquet/*.parquet'")
            passes = {}
            for d, size, whole, target, taken in con.sql("select doc_id, size, source_size, target, taken from (" + queries.OP1_SQL + ")").fetchall():
                passes[d] = taken // size if size else int(target // whole) if whole else 0
            at = [r for r in at for _ in range(passes[r["doc_id"]])]
        else:
            tokenizer = packing.encoder(packing.default_tokenizer()).tokenizer
            want = []
            for r in at:
                ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
                want += [(str(r["doc_id"]), i, low, len(ids[low : low + 4096]), zlib.crc32(ids[low : low + 4096].tobytes())) for i, low in enumerate(range(0, len(ids), 4096))]
            pieces = out.collect()
            assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in pieces) == sorted(want)
            held = collections.Counter()
            for r in pieces:
                held[r.sequence_id] += r.length
            assert max(held.values()) <= 4096 and len(held) <= 1.2 * sum(held.values()) / 4096 + 2
            whole = corpus_pipeline.run(spark, folder)
            assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in whole.collect()) == sorted(want)
            break
        assert out.columns == columns, name
        assert rows_of(out) == at, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sum(len(WORD.findall(r["text"] or "")) for r in at) > 0


def coded(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_pipeline_of_no_rows(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("1 = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
