from pyspark.sql import functions as F

from stepweave.llm import exact


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, names string, uid string")


def test_groups_equal_brute_force_with_colliding_hashes(spark):
    long = "".join(chr(97 + i * 7 % 26) for i in range(300))
    texts = ["", None, "", "é" * 9, "é" * 9, long, long, long[:-1] + "!", "!" + long[1:], long + long, long + long, "a\nb", "a\nb"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "é" * 9, "x", "y"), (None, long, "x", "y"), (5, "other", None, None)]
    for bits in (64, 2):
        out = exact.exact_duplicates(frame(spark, rows), block=4, hash_bits=bits).collect()
        assert len(out) == len(rows)
        want = {}
        for d, t, *_ in rows:
            want.setdefault(t or "", []).append(d)
        by_sha = {}
        for r in out:
            by_sha.setdefault(r.text_sha256, []).append(r)
        assert len(by_sha) == len(want)
        for group in want.values():
            best = max((d for d in group if d is not None), default=None)
            own = next(g for g in by_sha.values() if sorted(str(r.doc_id) for r in g) == sorted(map(str, group)) and g[0].group_size == len(group) and g[0].keep_id == best)
            assert sum(r.kept for r in own) == 1
            assert next(r for r in own if r.kept).doc_id == best


def test_kept_rows_and_empty_table(spark):
    rows = [(1, "a", "p", "q"), (2, "a", "r", "s"), (2, "a", "r", "s"), (3, None, None, None), (4, "", "", "")]
    docs = frame(spark, rows)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r)[:2] for r in left.collect()) == [(2, "a"), (4, "")]
    assert exact.exact_duplicates(docs.where(F.lit(False))).count() == 0


def test_names_are_places_in_sorted_order_however_rows_are_dealt(spark):
    docs = frame(spark, [(i, "".join(chr(97 + i * k % 11) for k in range(i % 40)), "", "") for i in range(200)])
    several = [sorted((r.doc_id, r.n_blocks, r.name) for r in exact.text_names(docs.repartition(n), block=4).collect()) for n in (1, 7)]
    assert several[0] == several[1]
    pairs = docs.selectExpr("doc_id % 17 as a", "doc_id % 5 as b").distinct().repartition(5)
    found = exact._named(pairs, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.name)] == sorted((r.a, r.b) for r in found) and sorted(r.name for r in found) == list(range(85))
