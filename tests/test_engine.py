import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepweave.functions import answers, hashing, segments, text
from stepweave.operators import composite, dedup, fitting, greedy, joins, metrics, ordered, policy, resampling, selection, vectors
from stepweave.sources import config, sinks, tables
from stepweave.streaming import events

SF = "/root/testdata/sf0.001"


def col(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


# functions ---------------------------------------------------------------------------------------


def test_hashes_equal_python(spark):
    import hashlib

    rows = [(1, 'é"x'), (2701, "a\\b\n"), (-5, "")]
    df = spark.createDataFrame(rows, "n long, s string")
    got = df.select("n", "s", hashing.stable_hash(F.col("n"), hashing.json_text(F.col("s"))).alias("h"), hashing.stable_seed(F.col("n"), hashing.json_text(F.col("s"))).alias("seed")).collect()
    for r in got:
        h = hashlib.sha256(json.dumps([r.n, r.s], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        assert r.h == h and r.seed == int(h[:16], 16) % 2**31
        d = spark.createDataFrame([(h,)], "h string").select(hashing.unit_interval(F.col("h")).alias("u"), hashing.digest_modulo(F.col("h"), 5).alias("m")).first()
        assert d.u == int(h[:13], 16) / 16**13 and d.m == int(h, 16) % 5


def test_formatting_variants_share_a_key(spark):
    a, b = F.lit("Same  problem  \\left( x \\right)$"), F.lit("same problem (x)")
    assert col(spark, text.latex_hash(F.lit("A \\left B$")) == text.latex_hash(F.lit("aB")))
    assert col(spark, text.normalize_problem_text(a)) == "same problem \\left( x \\right)$"
    assert col(spark, text.normalize_problem_text(b)) == "same problem (x)"


ANSWERS = [
    (r"so \boxed{12} and \boxed {7}", "last_boxed", "7"), (r"x \boxed{\frac{1}{2}} y", "last_boxed", r"\frac{1}{2}"), (r"a \boxed{2}. b \boxed{3}. c \boxed{x", "last_boxed", "3"), ("Work.\n\\boxed{\\frac{1}{2} +\n\\sqrt{3}}", "last_boxed", "\\frac{1}{2} +\n\\sqrt{3}"),
    ("x\n## Final answer: 42 \ny", "final_answer_marker", "42"), ("Work.\nFinal answer:\n$ a = -\\frac{3}{2} $", "final_answer_marker", "-\\frac{3}{2}"), ("Work. \\boxed{open\nanswer: 12", "final_answer_marker", "12"), ("Answer: the sum is yes.", "final_answer_marker", "yes"),
    ("a\n  1,234\nz z", "isolated_answer_line", "1,234"), ("$42$", "isolated_answer_line", "42"), ("so\n$x = 4$", "isolated_answer_line", "x = 4"), ("it is\n(1, 2)", "isolated_answer_line", "(1, 2)"), (r"then" "\n" r"$\frac{1}{2}$.", "isolated_answer_line", r"\frac{1}{2}"),
    ("first\nTherefore it is 3/4 now", "final_assertion", "3/4"), (r"Therefore $x = \sqrt{2}$", "final_assertion", r"\sqrt{2}"), ("Work.\nTherefore, the combined amount is $50,000 per month.", "final_assertion", "$50,000"), ("nothing here", "none", None), ("", "none", None), (None, "none", None),
]


def test_answer_rules_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(ANSWERS)], "i int, t string")
    got = {r.i: r for r in df.select("i", "t", answers.answer_region(F.col("t")).alias("r")).withColumn("cut_off", answers.acceptable(F.col("r"), F.lit("length"))).collect()}
    for i, (t, method, value) in enumerate(ANSWERS):
        r = got[i].r
        assert (r.method, r.parsed_answer) == (method, value), t
        assert r.success == (value is not None) and len(r) == 13
        assert got[i].cut_off == (method in ("last_boxed", "final_answer_marker"))
        if value is not None:
            assert t[r.content_char_start : r.content_char_end] == value and r.char_start <= r.content_char_start < r.content_char_end <= r.char_end
    own = answers.parse("so it is 7", lambda t: ("seven", (9, 10)))
    assert (own["method"], own["parsed_answer"], own["text"]) == ("dataset_specific", "seven", "7")
    assert answers.parse("Answer: 7", lambda t: ("9", (0, 1)))["parsed_answer"] == "7"


def test_answer_steps_and_borders(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    r = row(a=answers.answer_only(F.lit("The final answer is: 7 ."), F.lit("7")), b=answers.answer_only(F.lit("\\boxed{7}"), F.lit("7")), c=answers.answer_only(F.lit("so 7"), F.lit("7")), d=answers.answer_only(F.lit("7"), F.lit(None).cast("string")))
    assert tuple(r) == (True, True, False, False)
    audit = col(spark, answers.step_audit(F.array(F.lit("one two"), F.lit("three "), F.lit("four"))))
    assert [(x.requested, x.token_offset, x.resolved, x.exact, x.sound) for x in audit] == [(8, 2, 8, True, True), (16, 3, 15, False, False), (22, 4, 22, True, True)]
    assert tuple(col(spark, answers.reasoning_split(F.lit("we add them\nFinal answer: 3")))) == (11, 3)
    assert col(spark, answers.prompt(F.lit(" x "), F.lit("P2"))) == answers.PROMPTS["P2"] + "\n\nx"


def test_answers_agree_by_number_or_text(spark):
    for a, b, same in (("$1,234", "1234.0", True), ("50%", "0.5", True), ("x = 1", "X=1", True), ("3", "4", False), ("a", "1", False)):
        assert col(spark, text.answers_agree(F.lit(a), F.lit(b))) is same


def test_balanced_boxes_and_depth():
    assert [r["content"] for r in segments.boxed_regions(r"\boxed{\frac{1}{2}} \boxed{a\}b} \boxed{open")] == [r"\frac{1}{2}", r"a\}b"]
    assert segments.latex_depths("a{b}$c$") == [0, 0, 1, 1, 0, 1, 1]
    assert segments.legacy_list("['a'\n 'it\\'s' \"b\"]") == ["a", "it's", "b"]
    assert segments.legacy_list(None) is None


def test_segments_cover_tokens_in_order():
    rng = random.Random(1)
    for _ in range(50):
        t = " ".join(rng.choice(["word", "end.", "{x", "y}", "line\n\n"]) for _ in range(rng.randint(0, 300)))
        for s in (segments.fixed_segments(t, 64), segments.hybrid_segments(t)):
            assert [x["index"] for x in s] == list(range(len(s)))
            covered = [p for x in s for p in segments.tokens(t[x["start"] : x["end"]])]
            assert len(covered) == len(segments.tokens(t))
        sizes = [len(segments.tokens(t[x["start"] : x["end"]])) for x in segments.hybrid_segments(t)]
        assert all(24 <= n <= 128 for n in sizes[:-1])
    assert [t["start"] for t in segments.paragraphs("a\n\nb\n \nc")] == [0, 3, 7]
    assert segments.snap([(0, 2), (3, 5)], 2) == {"before": 0, "after": 1, "exact": True, "displacement": 0}


def test_step_ranges_point_into_the_completion(spark):
    r = spark.createDataFrame([(["ab", "", "cde"],)], "s array<string>").select(text.completion(F.col("s")).alias("t"), text.step_ranges(F.col("s")).alias("r")).first()
    assert [r.t[x.start : x.end] for x in r.r] == ["ab", "", "cde"]
    assert col(spark, text.safety_labels(F.lit(3), F.lit(1), F.lit(False))) == [True, True, False]
    assert col(spark, text.safety_labels(F.lit(2), F.lit(None).cast("int"), F.lit(False))) is None
    assert col(spark, text.decode_answer(text.encode_answer(F.lit(3)))) == "3"


# joins, duplicates -------------------------------------------------------------------------------


def test_join_checked_rejects_wrong_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string")
    assert joins.join_checked(left, right, ["k"]).count() == 3
    with pytest.raises(joins.CardinalityError):
        joins.join_checked(right, left, ["k"])
    with pytest.raises(joins.CardinalityError):
        joins.join_checked(left, right, ["k"], validate="one_to_one")
    with pytest.raises(joins.CardinalityError):
        joins.join_checked(left, right.where("k = 1"), ["k"], how="left", mandatory=True)


def test_key_differences_and_index(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    o = spark.createDataFrame([(1,), (1,), (4,)], "k int")
    assert sorted(map(tuple, joins.key_differences(e, o, ["k"]).collect())) == [("duplicate", 1), ("missing", 2), ("missing", 3), ("unexpected", 4)]
    i = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in joins.unambiguous_index(i, "k", "v").collect()] == [("a", 1)]
    with pytest.raises(Exception, match="differs"):
        joins.reconcile_alias(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b").collect()


def test_indel_ratio_is_lcs():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert dedup.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
    assert dedup.indel_ratio("private thoughts", "private truth") == pytest.approx(0.7586, abs=1e-4)


# ordered operators and policy --------------------------------------------------------------------


def test_threshold_actions_choose_the_latest(spark):
    rows = [(t, o, p) for t in (1, 2) for o, p in enumerate((0.8, 0.4, 0.7))]
    ck = spark.createDataFrame(rows, "trace_id long, ordinal int, p double")
    got = {(r.trace_id, r.tau): r.chosen for r in policy.select_actions(ck, (0.0, 0.5, 0.75, 1.0)).collect()}
    assert [got[1, t] for t in (0.0, 0.5, 0.75, 1.0)] == [2, 2, 0, None]
    with pytest.raises(ValueError, match="outcomes"):
        policy.blind(ck.withColumn("success_count", F.lit(1)))


def test_one_pass_policy_equals_selection_and_lookup(spark):
    from stepweave.plans.views import checkpoints

    ck, taus = checkpoints(spark, SF), (0.0, 0.5, 1.0)
    two = policy.evaluate(policy.select_actions(ck, taus), ck)
    one = policy.evaluate_thresholds(ck, taus).select(*two.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_projection_is_the_closest_nonincreasing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.normal(size=rng.integers(1, 9))
        f = ordered.project_nonincreasing(x)
        want = [min(max(np.mean(x[j : k + 1]) for k in range(i, len(x))) for j in range(i + 1)) for i in range(len(x))]
        assert np.allclose(f, want) and np.all(np.diff(f) <= 1e-12)


def test_highest_threshold_within_one_per_cent(spark):
    curve = spark.createDataFrame([(0.5, 100.0), (0.75, 100.9), (0.9, 101.1)], "tau double, macro_tokens double")
    assert policy.cheapest_threshold(curve, within=0.01).first()["selected_tau"] == 0.75


def test_pareto_marks_dominated_points(spark):
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate([(1, 1), (2, 1), (2, 2), (3, 5), (3, 5), (0, 0.5)])]
    got = {r.k: r.nondominated for r in policy.pareto(spark.createDataFrame(pts, "k int, gain double, cost double"), "k", "gain", "cost").collect()}
    for i, a, b in pts:
        assert got[i] == (not any(x >= a and y <= b and (x > a or y < b) for _, x, y in pts))


# metrics, selection, resampling ------------------------------------------------------------------


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.1, 0), ("b", 0.3, 1)]
    got = {r.g: r for r in metrics.auc_ap(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    assert got["a"].auc == pytest.approx(0.875) and got["a"].ap == pytest.approx((1 + 2 / 3) / 2, abs=1e-6) and got["b"].auc is None


def test_splits_do_not_leak_and_ignore_order(spark):
    rows = [(i, i % 40) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, grp long")
    split = lambda d: sorted(map(tuple, d.select("grp", selection.hash_split(hashing.unit_interval(hashing.stable_hash(F.col("grp"))), {"a": 0.5, "b": 0.5}).alias("s")).distinct().collect()))
    assert split(df) == split(df.orderBy(F.desc("id")).repartition(7)) and len(split(df)) == 40
    folds = selection.balanced_folds(df.withColumn("dom", F.lit("x")), "grp", "dom", 5, hashing.stable_hash(F.col("grp"))).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [8] * 5


def test_lpt_fills_every_pack_in_balance(spark):
    df = spark.createDataFrame([("m", i, float(i % 9 + 1)) for i in range(40)], "m string, id long, w double")
    out = selection.lpt_packs(df, "m", "id", "w", 10).toPandas()
    assert len(out) == 40 and (out.groupby("pack").size() == 10).all()
    loads = out.groupby("pack")["load"].max()
    assert loads.max() - loads.min() <= 9


def test_bootstrap_law_and_holm(spark):
    u = spark.createDataFrame([("d", i, float(i)) for i in range(50)], "d string, u long, v double")
    reps = resampling.cluster_bootstrap(u, "d", "u", ["v"], 200, "s").toPandas()["v"]
    assert abs(reps.mean() - 24.5) < 1 and abs(reps.std() - 14.43 / 50**0.5) < 0.5
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5), ("d", 1.0)], "n string, p double")
    assert [r.adjusted for r in resampling.holm(p, "n", "p").orderBy("n").collect()] == [0.04, 0.06, 1.0, 1.0]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(x.tolist(), w.tolist())], "x array<double>, w array<double>")
    r = df.select(vectors.layer_norm(F.col("x")).alias("n"), vectors.cosine(F.col("x"), F.col("w")).alias("c"), vectors.decompose(F.col("x"), F.col("w")).alias("d"), vectors.unit(F.col("x")).alias("u")).first()
    assert np.allclose(r.n, (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    assert r.c == pytest.approx(x @ w / np.linalg.norm(x) / np.linalg.norm(w))
    assert r.d.along == pytest.approx(x @ w / np.linalg.norm(w)) and r.d.error < 1e-8 and abs(np.dot(r.d.across, w)) < 1e-9
    assert col(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None


def newton(x, y, w, ridge=0.0):
    """Weighted logistic regression on arrays."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + (ridge + 1e-10) * np.eye(x.shape[1]), x.T @ (w * (p - y)) + ridge * beta)
    return beta


def test_fits_equal_those_on_arrays(spark):
    rng = np.random.default_rng(6)
    z, u = rng.normal(size=2000), rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    m = np.array(["a", "b"])[(np.arange(2000) % 5 == 0).astype(int)]
    frame = pd.DataFrame({"m": m, "z": z, "u": u, "s": np.where(m == "a", y, 1 - y), "c": np.arange(2000) // 7, "fold": np.arange(2000) // 7 % 3})
    df = spark.createDataFrame(frame)

    glm = fitting.binomial_glm(df.unionByName(df.limit(3).withColumn("u", F.lit(None).cast("double"))), by="m", x=["z", "u"], success="s", trials=1, cluster="c").toPandas()
    for g, own in frame.groupby("m"):
        x = np.column_stack([np.ones(len(own)), own["z"], own["u"]])
        beta = newton(x, own["s"].to_numpy(float), np.ones(len(own)))
        p = 1 / (1 + np.exp(-x @ beta))
        bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        scores = pd.DataFrame(x * (own["s"].to_numpy() - p)[:, None]).groupby(own["c"].to_numpy()).sum().to_numpy()
        cov = bread @ (scores.T @ scores) @ bread * len(scores) / (len(scores) - 1) * (len(own) - 1) / (len(own) - 3)
        got = glm[glm["m"] == g].set_index("term").loc[["intercept", "z", "u"]]
        assert np.allclose(got["estimate"], beta, atol=1e-7) and np.allclose(got["se"], np.sqrt(np.diag(cov)), atol=1e-7)

    cal = fitting.crossfit_calibration(df, model="m", fold="fold", trace="c", logit="z", target="s", folds=3).toPandas().set_index(["model", "fold"])
    assert len(cal) == 6
    for fold in range(3):
        own = frame[(frame["m"] == "a") & (frame["fold"] != fold)]
        w = 1 / own.groupby("c")["z"].transform("size").to_numpy()
        assert np.allclose(cal.loc[("a", fold), ["b", "a"]].to_numpy(float), newton(np.column_stack([np.ones(len(own)), own["z"]]), own["s"].to_numpy(float), w), atol=1e-7)
        assert cal.loc[("b", fold), "a"] == 1e-8

    probes = {r.train: r.weights for r in fitting.train_matrix(df, domain="m", x=["z", "u"], target="s").collect()}
    assert sorted(probes) == ["a", "b", "without a", "without b"] and np.allclose(probes["a"], probes["without b"], atol=1e-7)
    own = frame[frame["m"] == "b"]
    assert np.allclose(probes["b"], newton(np.column_stack([np.ones(len(own)), own["z"], own["u"]]), own["s"].to_numpy(float), np.ones(len(own)), 1.0), atol=1e-7)

    ridge = fitting.grouped_ridge(spark.createDataFrame([(i, float(v), 3 * float(v) + 1) for i, v in enumerate(z[:500])], "g int, x double, t double"), x=["x"], target="t", group="g", folds=5).collect()
    assert all(r.rmse < 0.1 for r in ridge)


def test_whitening_of_a_fold_is_fitted_without_it(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 6)) * [5, 3, 2, 1, 0.1, 0.01] + 4
    rows = [(i % 2, i // 2 % 3, i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (7, 0, 90, v[0].tolist())], "g int, fold int, id int, x array<double>").repartition(5)
    fits = fitting.whitenings(df, by="g", fold="fold", column="x", share=0.9)
    got = {(r.g, r.fold, r.id): r.w for r in fitting.whiten(df, fits, by="g", fold="fold", column="x", out="w").collect()}
    assert len(got) == 90  # the group of one row has no other folds
    for g in range(2):
        for fold in range(3):
            fit = np.array([x for a, f, _, x in rows if a == g and f != fold])
            _, s, t = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
            var = s**2 / (len(fit) - 1)
            k = int(np.searchsorted(np.cumsum(var) / var.sum(), 0.9)) + 1
            for a, f, i, x in rows:
                if (a, f) == (g, fold):
                    want = t[:k] @ (np.array(x) - fit.mean(0)) / np.sqrt(var[:k] + 1e-3 * var[:k].mean())
                    assert np.allclose(np.abs(got[a, f, i]), np.abs(want), atol=1e-6)


def test_greedy_selections_meet_quotas(spark):
    rows = [("m", i, "d%d" % (i % 3), (i % 11) / 10, f"{i * 7919 % 1000:04d}") for i in range(200)]
    df = spark.createDataFrame(rows, "model string, trace long, domain string, rate double, tie string")
    got = greedy.balanced_parents(df, model="model", trace="trace", domain="domain", rate="rate", tie="tie", quotas=(("near", 0.35, 0.65, 9), ("low", 0.0, 0.25, 6))).toPandas()
    assert got.groupby("bucket").size().to_dict() == {"near": 9, "low": 6} and got["trace"].is_unique and not got["substitute"].any()
    sample = greedy.margin_sample(df, id_="trace", margins=["domain"], count=30, tie="tie").join(df, F.col("id") == F.col("trace")).groupBy("domain").count().collect()
    assert sorted(r["count"] for r in sample) == [10, 10, 10]


def test_greedy_queries_equal_uncapped_picks_with_a_hot_trace(spark, tmp_path):
    from pyspark.sql import Window as W

    from stepweave.plans import sequential

    rng = random.Random(6)
    line = lambda o, k: (o, k, rng.randint(1, 99), 1, 10.0, float(rng.randint(1, 50)), rng.randint(0, 10) / 100, 0.04, "A")
    lines = [line(1, k) for k in range(1500)] + [line(o, k) for o in range(2, 150) for k in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 4, "ab"[o % 2]) for o in range(1, 150)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rated = sequential._rated(spark, str(tmp_path))
    rows = rated.select("base_model", "trace_id", "domain", "rate", "tie", F.ntile(4).over(W.partitionBy("base_model", "domain").orderBy("p", "tie")).alias("q")).collect()

    quotas = [("near", 0.35, 0.65, 24), ("high", 0.75, 1.0, 8), ("low", 0.0, 0.25, 8)]
    want, taken = [], set()
    for name, lo, hi, quota in sorted(quotas, key=lambda b: (len({r.trace_id for r in rows if b[1] <= r.rate <= b[2]}) / b[3], b[0])):
        count = {"a": 0, "b": 0}
        for _ in range(quota):
            free = [(max(lo - r.rate, r.rate - hi, 0), count[r.domain], r.tie, r) for r in rows if r.trace_id not in taken]
            d, _, _, r = min(free, key=lambda x: x[:3])
            taken.add(r.trace_id)
            count[r.domain] += 1
            want.append((r.base_model, name, r.trace_id, r.rate, d > 0))
    assert [tuple(r) for r in sequential.balanced_parents(spark, str(tmp_path)).collect()] == want

    want = []
    for domain in "ab":
        own = sorted((r for r in rows if r.domain == domain), key=lambda r: r.tie)
        used, chosen, need = set(), [], dict.fromkeys(range(1, 5), 4)
        for fresh in (True, False):
            while True:
                before = len(chosen)
                for q in need:
                    some = [r for r in own if r.q == q and r not in chosen and not (fresh and r.trace_id in used)]
                    if need[q] and some:
                        chosen.append(some[0])
                        used.add(some[0].trace_id)
                        need[q] -= 1
                if len(chosen) == before:
                    break
        want += [(f"m0/{domain}", r.q, r.trace_id, i + 1) for i, r in enumerate(chosen)]
    assert len({t for g, _, t, _ in want if g == "m0/b"}) == 16
    assert sorted(tuple(r) for r in sequential.quartile_quota(spark, str(tmp_path)).collect()) == sorted(want)


# sources, sinks, streams -------------------------------------------------------------------------


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_returnflag = 'A'").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,A)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_jsonl_container_and_selected_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"problem_id": "a", "trace_id": "x"}\n{"problem_id": "b", "trace_id": "y"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "t.jsonl")).count() == 2
    schema = "problem_id string, trace_id string"
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(schema)
    ids = spark.createDataFrame([("y",)], "trace_id string")
    assert [r.problem_id for r in tables.read_selected_lines(spark, str(tmp_path / "t.jsonl"), ids, own).collect()] == ["b"]
    (tmp_path / "c.json").write_text('{"rows": [{"problem_id": "a"}, {"problem_id": "b"}]}')
    assert tables.read_container(spark, str(tmp_path / "c.json"), own).count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(tables.AccessError):
        tables.guard("/x/free_running/y")


def test_write_once_and_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, v double")
    path = str(tmp_path / "out")
    assert sinks.write_once(df, path) == "written" and sinks.write_once(df.orderBy(F.desc("k")), path) == "kept"
    with pytest.raises(FileExistsError):
        sinks.write_once(df.where("k = 1"), path)
    assert sinks.resume(spark, path, ["k"]) and not sinks.resume(spark, path, ["z"]) and not sinks.resume(spark, str(tmp_path / "none"), ["k"])
    assert [json.loads(r.json) for r in sinks.strict_json(df).orderBy("json").collect()] == [{"k": 1, "v": 0.5}, {"k": 2}]
    assert sinks.row_hash(df).select("row_sha256").distinct().count() == 2
    assert sinks.markdown(df.select("k")).startswith("| k |")


def test_packs_need_markers_that_equal_their_bytes(spark, tmp_path):
    import hashlib

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    file = next((tmp_path / "p").glob("part-*"))
    manifest = spark.createDataFrame([("p1", str(file))], "pack_id string, path string")
    ok = spark.createDataFrame([("p1", "complete", hashlib.sha256(file.read_bytes()).hexdigest())], "pack_id string, status string, sha256 string")
    assert tables.read_packs(spark, manifest, ok, str(file)).count() == 5
    with pytest.raises(ValueError, match="p1"):
        tables.read_packs(spark, manifest, ok.withColumn("sha256", F.lit("0")), str(file))


def test_config_and_stage_manifest(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 3}')
    (tmp_path / "own.json").write_text('{"include": "base.json", "a": {"y": 5}}')
    assert config.load(str(tmp_path / "own.json"), ["a.z=7", "c.d=t"]) == {"a": {"x": 1, "y": 5, "z": 7}, "b": 3, "c": {"d": "t"}}
    (tmp_path / "both.json").write_text('{"include": ["own.json", "base.json"]}')
    assert config.load(str(tmp_path / "both.json")) == {"a": {"x": 1, "y": 2}, "b": 3}
    for bad in ("b.x=1", "a", ".x=1"):
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "own.json"), [bad])
    (tmp_path / "loop.json").write_text('{"include": "loop.json"}')
    with pytest.raises(ValueError, match="cycle"):
        config.load(str(tmp_path / "loop.json"))
    with pytest.raises(ZeroDivisionError), config.stage(str(tmp_path), "s", {}):
        raise ZeroDivisionError
    assert json.loads((tmp_path / "s.json").read_text())["status"] == "FAILED"


def test_files_of_the_shared_store(spark, tmp_path):
    root = f"file:{tmp_path}"
    for name, tree in {"a": {"x": 1, "include": "sub/../b.json"}, "b": {"include": ["c.json"], "y": 2}, "c": {"y": 1, "z": "é"}, "loop": {"include": "sub/../loop.json"}}.items():
        sinks.shared_json(spark, f"{root}/{name}.json", {"old": 1})
        sinks.shared_json(spark, f"{root}/{name}.json", tree)
    read = lambda p: sinks.shared_text(spark, p)
    assert config.load(f"{root}/a.json", ["z=3"], read) == {"x": 1, "y": 2, "z": 3}
    with pytest.raises(ValueError, match="cycle"):
        config.load(f"{root}/loop.json", read=read)
    assert sorted(p.name for p in tmp_path.glob("[!.]*.json*")) == ["a.json", "b.json", "c.json", "loop.json"]
    paths = spark.createDataFrame([("x/FREE_running/y",), (None,), ("x",)], "p string")
    assert [r.v for r in paths.select(tables.refused(F.col("p")).alias("v")).collect()] == [["free_running"], [], []]


def test_bundles_without_contrast_or_variance(spark):
    rows = [(t, i, 0.5, z, -z) for t in range(3) for i, z in enumerate((1.0, 2.0, 2.0))]
    df = spark.createDataFrame(rows, "t long, i int, y double, a double, c double")
    got = {r.model: r for r in composite.model_contrasts(df, models={"axis": "a", "control": "c", "other": "c"}, unit="t", order="i", outcome="y", axis="axis", control="control", best=["other"], replicates=5, seed="s").collect()}
    assert got["axis"].eta is None and got["axis"].gap is None and got["axis"].concordance is None and got["axis"].rho is None
    assert got["other"].best and not got["axis"].best and got["other"].gap == got["other"].lo == got["other"].hi == 0
    one = composite.within_unit(df.withColumn("g", F.lit(1)), by=["g"], unit="t", order="i", score="a", outcome="y").first()
    assert (one.units, one.rows, one.pearson, one.rho, one.slope, one.adjacent, one.median_rho) == (3, 9, None, None, 0.0, None, None)
    empty = composite.within_unit(df.where("t < 0").withColumn("g", F.lit(1)), by=["g"], unit="t", order="i", score="a", outcome="y")
    assert empty.count() == 0


def test_streamed_windows_equal_the_batch(spark):
    stream = events.windowed(events.read_events(spark, SF))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed(spark.read.parquet(f"{SF}/events.parquet"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


# every query -------------------------------------------------------------------------------------


def _cell(x):
    """One form for what pandas shows in several ways: nulls, and numbers as int or float."""
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return f"{float(x):.8g}" if isinstance(x, (int, float, np.number)) else str(x)


def test_queries_equal_their_sql(spark):
    from stepweave import catalog

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql, bad = catalog.oracle_sql(), []
    rows = lambda df: sorted(tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    for name, run in catalog.queries().items():
        got = run(spark, SF).toPandas()
        if name in sql and rows(got) != rows(con.sql(sql[name]).df()):
            bad.append(name)
        elif name not in sql and not len(got):
            bad.append(name)
    assert not bad


def test_workers_are_loaded_longest_first(spark):
    from stepweave import catalog

    got = catalog.queries()["worker_loads"](spark, SF).toPandas()
    from stepweave.plans.views import checkpoints

    packs = checkpoints(spark, SF).groupBy("base_model", (F.col("trace_id") % 40).alias("pack")).agg(F.sum("prefix_tokens").alias("work")).toPandas()
    for model, own in packs.groupby("base_model"):
        loads, place = [0.0] * 8, {}
        for _, r in own.assign(p=own["pack"].astype(str)).sort_values(["work", "p"], ascending=[False, True]).iterrows():
            i = min(range(8), key=lambda k: (loads[k], k))
            place[r["pack"]] = i
            loads[i] += float(r["work"])
        rows = got[got["base_model"] == model]
        assert dict(zip(rows["pack"], rows["worker"], strict=True)) == place
        assert np.allclose(rows["load_ratio"], max(loads) / min(loads)) and np.allclose(rows["load"], [loads[i] for i in rows["worker"]])


def test_answer_places_are_slices_of_the_texts(spark):
    from stepweave import catalog
    from stepweave.plans import answers as plans

    texts = {(r.conv_id, r.turn): r.t for r in plans.completions(spark, SF).collect()}
    rows = catalog.queries()["answer_places"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.success:
            t = texts[r.conv_id, r.turn]
            assert t[r.content_char_start : r.content_char_end] == r.parsed_answer == r.text and r.confidence in ("high", "medium")
        else:
            assert r.method == "none" and r.failure_reason and r.char_start is None


def test_a_claim_falls_back_to_the_model_with_most_work(spark):
    from stepweave.operators import integrity

    rows = [(1, 1, "a", "running", "w", 9, 1, 5.0, 1, 1), (2, 1, "a", "pending", None, None, 1, 5.0, 1, 0), (3, 2, "b", "pending", None, None, 1, 2.0, 1, 0), (4, 3, "c", "running", "w", 1, 1, 1.0, 1, 1), (5, 3, "c", "pending", None, None, 1, 4.0, 1, 0)]
    jobs = spark.createDataFrame(rows, "job_id int, checkpoint int, model string, status string, worker string, lease_until int, priority int, work double, prefix int, attempts int")
    claim = lambda m, t: {r.job_id: (r.status, r.worker, r.lease_until, r.attempts) for r in integrity.claim_checkpoint(jobs, worker="x", model=m, now=t, lease=10).where("claimed").collect()}
    assert claim("a", 5) == {4: ("running", "x", 15, 2), 5: ("running", "x", 15, 1)}  # a has a running job on its checkpoint; c's lease ended
    assert claim("b", 5) == {3: ("running", "x", 15, 1)}
    assert claim("a", 10) == {1: ("running", "x", 20, 2), 2: ("running", "x", 20, 1)}
    assert integrity.claim_checkpoint(jobs.where("status = 'running'"), worker="x", model="a", now=0, lease=1).where("claimed").isEmpty()


def test_packs_and_folds_equal_plain_loops(spark):
    from stepweave.plans import selection as plans
    from stepweave.plans.views import traces

    rows = traces(spark, SF).collect()
    want = {}
    for model in {r.base_model for r in rows}:
        own = sorted((r for r in rows if r.base_model == model), key=lambda r: (-r.work, r.trace_id))
        packs = [[0.0, 0] for _ in range(-(-len(own) // 64))]
        for r in own:
            i = min((i for i, p in enumerate(packs) if p[1] < 64), key=lambda i: (packs[i][0], i))
            packs[i] = [packs[i][0] + r.work, packs[i][1] + 1]
            want[r.trace_id] = (i, packs[i][0])
    got = {r.trace_id: (r.pack, r.load) for r in plans.lpt_packs(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_sequential_queries_equal_plain_python(spark):
    from stepweave.plans import sequential

    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    assert {r.n_nationkey: list(r["items"]) for r in sequential.legacy_lists(spark, SF).collect()} == {k: [n, "it's", "two"] for k, n in names.items()}
    turns = sorted((r.conv_id, r.turn, "\\frac{1}{%d}" % r.turn) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    assert sorted(tuple(r) for r in sequential.boxed_regions(spark, SF).collect()) == turns


def test_near_pairs_with_and_without_blocks(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(70, 90))) for _ in range(30)]
    texts += [t[:40] + "x" + t[40:] for t in texts[:10]] + ["x" + t for t in texts[10:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    every = {(i, j) for j in range(len(texts)) for i in range(j) if dedup.indel_ratio(texts[i], texts[j]) >= 0.92}
    pairs = lambda **o: {(r.left, r.right) for r in dedup.near_pairs(df, id_="id", text=F.col("t"), **o).collect()}
    assert pairs(width=0, head=0) == every
    assert pairs() == {(i, j) for i, j in every if len(texts[i]) // 80 == len(texts[j]) // 80 and texts[i][:24] == texts[j][:24]}


def test_lockstep_ratios_are_those_of_pairs():
    from stepweave.operators import lcs

    rng = random.Random(8)
    pairs = [("", ""), ("", "abc"), ("abc", "")]
    for n in (1, 5, 63, 64, 65, 200, 700) * 12:
        letters = rng.choice(["ab", "abcdefgh ", "αβ😀xy"])
        a = [rng.choice(letters) for _ in range(n)]
        b = [rng.choice(letters) if rng.random() < 0.05 else c for c in a if rng.random() > 0.05]
        pairs.append(("".join(a), "".join(b)))
    for share in (0.01, 0.1, 0.2, 0.4):  # some go early, some late
        a = [rng.choice("abcdefgh") for _ in range(1500)]
        pairs.append(("".join(a), "".join(a[: round(1500 - 1500 * share)] + [rng.choice("xyz") for _ in range(round(1500 * share))])))
        pairs.append((pairs[-1][0], "".join(x if rng.random() > share else "x" for x in a)))
    for threshold in (0.6, 0.92):
        for (a, b), got in zip(pairs, lcs.ratios(pairs, threshold), strict=True):
            want = dedup.indel_ratio(a, b)
            assert got == want if want >= threshold else got < threshold
            assert want < threshold or len(lcs.possible(lcs.Profiles([a]), lcs.Profiles([b]), threshold)) == 1


def test_near_dup_pairs_names_copies_once(spark, tmp_path):
    from stepweave.plans import tables

    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(200))
    near = [base[:k] + "zz" + base[k + 2 :] for k in range(30, 190, 4)]
    far = [base[:24] + "".join(rng.choice("abcdefgh") for _ in range(176)) for _ in range(20)]
    rows = [(k, base) for k in range(100, 400)] + list(enumerate(near)) + list(enumerate(far, 1000)) + [(5000, None), (None, base), (399, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.left, r.right, r.ratio) for r in tables.near_dup_pairs(spark, str(tmp_path)).collect()]
    texts = {100: base, **dict(enumerate(near)), **dict(enumerate(far, 1000))}
    want = {(a, b, dedup.indel_ratio(texts[a], texts[b])) for a in texts for b in texts if a < b}
    want = {p for p in want if p[2] >= 0.92}
    assert len(got) == len(set(got))
    assert set(got) == want | {(100, k, 1.0) for k in range(101, 400)}

    def components(pairs):
        root = {}
        find = lambda x: find(root[x]) if x in root else x
        for a, b, *_ in pairs:
            if find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for p in pairs for x in p[:2]}

    t = F.col("text")
    pairs = dedup.near_pairs(df.where("doc_id < 130 or doc_id >= 1000"), id_="doc_id", text=t).collect()
    for tile in (3, 128):
        links = dedup.near_links(df.where("doc_id < 130 or doc_id >= 1000"), id_="doc_id", text=t, tile=tile).collect()
        assert components(links) == components(pairs)
        assert {tuple(r) for r in links} <= {tuple(r) for r in pairs}
        whole = {tuple(r) for r in dedup.near_links(df, id_="doc_id", text=t, tile=tile, width=0, head=0).collect()}
        assert set(got) <= whole


def test_nearest_rows_over_many_tiles_with_ties_and_odd_vectors(spark, monkeypatch):
    import math

    from stepweave.operators import joins

    monkeypatch.setattr(joins, "MEMBERS", (7, 16))
    rng = random.Random(10)
    rows = [(k, k % 2, k % 3, [float(rng.randint(0, 3)) + 1000 for _ in range(4)]) for k in range(120)]
    rows += [(200, 0, 1, None), (201, 0, 1, [1000.0, None, 1000.0, 1001.0]), (202, 0, 2, [1.0]), (203, 5, 1, [0.0] * 4), (204, None, 1, [0.0] * 4), (205, 0, None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, fold int, parent int, x array<double>")
    got = {(r.id, r["rank"]): (r.neighbor, r.dist) for r in joins.nearest_with_control(df, id_="id", block=["fold"], other="parent", vector="x", k=3, tie=F.col("neighbor")).collect()}
    want = {}
    for i, f, p, x in rows:
        near = []
        for j, g, q, y in rows:
            if None not in (f, g, p, q) and f == g and p != q:
                known = x is not None and y is not None and len(x) == len(y) and None not in x + y
                near.append((round(math.dist(x, y), 9) if known else math.inf, j))
        want |= {(i, n + 1): (j, d if d < math.inf else None) for n, (d, j) in enumerate(sorted(near)[:3])}
    assert got == want
