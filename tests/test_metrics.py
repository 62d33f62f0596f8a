"""Metric tables: golden relation, edge cases, invariances."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import compare as J
from tallymark.operators import logs as L
from tallymark.operators import metrics as A
from tallymark.operators import scoring as P
from tallymark.operators import seeds as S
from tallymark.operators import two_stage as Z

# Published accuracies at depth 1 to 8 and the depth ceilings that follow from them.
ACCURACY = {
    ("gemma4_e2b", "cot"): [1.000, 0.960, 0.920, 0.880, 0.895, 0.805, 0.830, 0.835],
    ("gemma4_e2b", "direct"): [0.925, 0.200, 0.050, 0.015, 0.010, 0.015, 0.000, 0.005],
    ("phi4_mini", "cot"): [1.000, 0.955, 0.945, 0.840, 0.730, 0.640, 0.570, 0.615],
    ("phi4_mini", "direct"): [1.000, 0.615, 0.115, 0.015, 0.005, 0.010, 0.015, 0.005],
    ("qwen25_math_1.5b", "cot"): [1.000, 0.915, 0.875, 0.795, 0.770, 0.690, 0.585, 0.510],
    ("qwen25_math_1.5b", "direct"): [1.000, 0.895, 0.730, 0.335, 0.155, 0.135, 0.075, 0.050],
}
CEILING = {
    ("gemma4_e2b", "cot"): (1.0, 0.7, None),
    ("gemma4_e2b", "direct"): (0.925, 0.6475, 2),
    ("phi4_mini", "cot"): (1.0, 0.7, 6),
    ("phi4_mini", "direct"): (1.0, 0.7, 2),
    ("qwen25_math_1.5b", "cot"): (1.0, 0.7, 6),
    ("qwen25_math_1.5b", "direct"): (1.0, 0.7, 4),
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(m, r, k + 1, a) for (m, r), accs in ACCURACY.items() for k, a in enumerate(accs)]
    return spark.createDataFrame(rows, "model STRING, regime STRING, depth INT, acc DOUBLE")


def test_golden_ceiling(golden):
    got = {(r.model, r.regime): (r.baseline_acc, r.threshold, r.k_star) for r in A.depth_ceiling(golden).collect()}
    assert got == CEILING


def test_ceiling_needs_depth_one(golden):
    assert A.depth_ceiling(golden.filter("depth > 1")).count() == 0


def test_gap(golden):
    gap = J.gap_to_reference(golden)
    assert {(r.regime, r.ref_model) for r in gap.select("regime", "ref_model").distinct().collect()} == {
        ("cot", "gemma4_e2b"), ("direct", "qwen25_math_1.5b")}
    assert gap.count() == 32
    named = J.gap_to_reference(golden.filter("not (model = 'phi4_mini' and depth = 3)"), "phi4_mini")
    missing = named.filter("depth = 3").collect()
    assert missing and all(r.gap is None for r in missing)


def test_best_model_tie_goes_to_first_name(spark):
    acc = spark.createDataFrame([("b", "r", 1, 0.5), ("a", "r", 1, 0.5)], "model STRING, regime STRING, depth INT, acc DOUBLE")
    assert A.best_model(acc).first().model == "a"
    assert J.gap_to_reference(acc).first().ref_model == "a"


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "model STRING, regime STRING, depth INT, is_correct BOOLEAN, is_collapse BOOLEAN, first_error_step INT")


def test_depth_accuracy(spark):
    rows = [("m", "cot", 4, True, False, None), ("m", "cot", 4, False, False, 3), ("m", "cot", 4, False, True, 1), (None, "cot", 4, True, False, None)]
    got = A.depth_accuracy(scored(spark, rows)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.n_total, r.n_correct, r.n_collapse) == (3, 1, 1)
    assert (r.acc, r.collapse_rate, r.step_acc) == pytest.approx((1 / 3, 1 / 3, 0.5))
    assert A.depth_accuracy(scored(spark, rows).drop("first_error_step")).first().step_acc == 1.0


def test_variant_accuracy_without_gold(spark):
    df = spark.createDataFrame([("m", False, False)], "model STRING, correct BOOLEAN, evaluated BOOLEAN")
    r = A.variant_accuracy(df).first()
    assert (r.n_evaluated, r.n_skipped_no_gold, r.accuracy) == (0, 1, 0.0)


def test_single_seed_has_zero_std(spark):
    per_seed = spark.createDataFrame([("s1", "m", "cot", 1, 0.5)], "seed STRING, model STRING, method STRING, depth INT, acc DOUBLE")
    r = S.across_seeds(per_seed, ["s1", "s2"], draws=100).first()
    assert (r.n_seeds, r.acc, r.std_acc, r.ci_lo, r.ci_hi, r.acc_s1, r.acc_s2) == (1, 0.5, 0.0, 0.5, 0.5, 0.5, None)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(f"s{i}", "m", "cot", d, (i * d % 7) / 7) for i in range(5) for d in range(1, 5)]
    per_seed = spark.createDataFrame(rows, "seed STRING, model STRING, method STRING, depth INT, acc DOUBLE")
    intervals = lambda n: S.across_seeds(per_seed.repartition(n), draws=200).select("depth", "ci_lo", "ci_hi")
    a, b = (sorted(map(tuple, intervals(n).collect())) for n in (1, 17))
    assert a == b


def test_wilson_contains_share(spark):
    df = spark.range(200).selectExpr("id % 20 AS model", "id % 3 = 0 AS correct")
    rows = A.accuracy(df, ["model"]).collect()
    assert all(r.ci_lo <= r.acc <= r.ci_hi and 0 <= r.ci_lo and r.ci_hi <= 1 for r in rows)


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0, s) for s in (6, 7, 9, 12)] + [(None, 50), (1.0, 2)], "ground_truth DOUBLE, estimated_steps INT")
    r = A.preparation_profile(df).first()
    assert (r.n_total, r.n_no_gold, r.n_few_steps, r.n_kept, r.min_steps, r.max_steps, r.median_steps) == (6, 1, 1, 4, 6, 12, 9)


def test_running_totals_match_one_window_under_skew(spark):
    # one key holds most rows
    log = spark.range(3000).selectExpr("if(id % 10 < 7, 'hot', concat('k', id % 3)) AS key", "id AS seq", "id % 5 AS x")
    got = L.running_totals(log, "key", ["seq"], {"x": F.col("x")}, parts=7)
    log.createOrReplaceTempView("log")
    want = spark.sql("""SELECT key, seq, row_number() OVER w AS row_no, sum(x) OVER w AS running_x FROM log
        WINDOW w AS (PARTITION BY key ORDER BY seq)""")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    every = L.running_totals(log, "key", ["seq"], {"x": F.col("x")}, every=50, parts=7)
    assert every.count() == want.filter("row_no % 50 = 0").count()


def test_latest_and_pending(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id STRING, seq INT, v STRING")
    assert {tuple(r) for r in L.latest(log, ["id"], ["seq"]).collect()} == {("a", 2, "y"), ("b", 1, "z")}
    ids = spark.createDataFrame([("a",), ("c",)], "id STRING")
    cached, todo = L.serve_from_cache(ids, log, ["id"], ["seq"])
    assert [r.v for r in cached.collect()] == ["y"] and [r.id for r in todo.collect()] == ["c"]


def test_names_are_checked(spark):
    known = spark.createDataFrame([("m0",)], "model STRING")
    P.require_known(spark, ["m0"], known)
    with pytest.raises(ValueError, match="zz"):
        P.require_known(spark, ["m0", "zz"], known)
    with pytest.raises(ValueError, match="overlap"):
        J.require_overlap(known.filter("false"))


def test_detection_and_filter_summary(spark):
    rows = [("m", "the sky", "TYPE_A", ["The SKY is blue"], ["a"], True, False), ("m", "q", None, ["zz"], [], False, True)]
    df = spark.createDataFrame(rows, "solver_model STRING, distractor STRING, distractor_type STRING, irrelevant_clauses ARRAY<STRING>, "
                               "relevant_clauses ARRAY<STRING>, is_correct BOOLEAN, filter_failed BOOLEAN")
    got = {r.distractor_type: (r.description, r.n, r.detected) for r in Z.detection_table(df).collect()}
    assert got == {"TYPE_A": ("Scope Confusion", 1, 1), "UNKNOWN": ("UNKNOWN", 1, 0), "OVERALL": ("", 2, 1)}
    s = Z.filter_summary(df).first()
    assert (s.n, s.accuracy, s.acc_filter_ok, s.acc_filter_failed, s.fail_rate) == (2, 0.5, 1.0, 0.0, 0.5)
    assert Z.accuracy_by_type(df).count() == 2
    assert Z.accuracy_by_type(df.filter("distractor_type is not null")).count() == 0


def test_error_rows_are_evaluated(spark):
    df = spark.createDataFrame([("ok 5", None), (None, "status 503")], "response STRING, error STRING")
    assert [r.response for r in P.capture_errors(df).collect()] == ["ok 5", "[ERROR: status 503]"]
    log = spark.createDataFrame([("#### 5", "#### 5", None), ("none", "#### 5", None), ("#### 5", "", "boom")], "answer STRING, response STRING, e STRING")
    got = [(r.correct, r.evaluated, r.error) for r in P.score_variant_log(log, error="e").collect()]
    assert got == [(True, True, None), (False, False, "failed to extract gold answer"), (False, True, "boom")]


def test_corrections_table_and_wide(spark):
    df = spark.createDataFrame([("m0", 1, 2, 0), ("m0", 1, 3, 1), ("m1", 2, 1, 0)],
                               "model STRING, depth INT, corrections_applied INT, unverified_fallbacks INT")
    rows = {r.Depth: r for r in A.corrections_table(df, ["m0", "m1"], {"m0": "Zero"}).collect()}
    assert rows["d1"]["Zero - Corrections"] == "2.500" and rows["d1"]["m1 - Corrections"] is None
    assert rows["d2"]["m1 - Fallbacks"] == "0.000"


def test_optional_fields(spark):
    df = spark.createDataFrame([(None, 3), (2, 5)], "depth INT, estimated_steps INT")
    assert [r.s for r in df.select(P.step_count(df, "depth", "estimated_steps").alias("s")).collect()] == [3, 2]
    assert [tuple(r) for r in P.with_defaults(df, {"depth": 0, "note": "x"}).collect()] == [(0, 3, "x"), (2, 5, "x")]


def test_delta_is_of_means_over_all_seeds(spark):
    rows = [("s1", "m", "cot", 4, 0.5), ("s1", "m", "chunked", 4, 0.6), ("s2", "m", "chunked", 4, 0.9), ("s1", "m", "cot", 5, 0.25), ("s2", "m", "chunked", 5, 0.75)]
    from tallymark.operators import seeds

    df = spark.createDataFrame(rows, "seed string, model string, method string, depth int, acc double")
    got = {r.depth: r for r in seeds.delta_across_seeds(df, draws=20).collect()}
    assert round(got[4].mean_delta, 9) == 0.25 and round(got[4].ci_lo, 9) == round(got[4].ci_hi, 9) == 0.1
    assert (got[5].mean_delta, got[5].ci_lo, got[5].ci_hi) == (0.5, 0.5, 0.5)


def test_running_totals_keep_null_rows(spark):
    from pyspark.sql import functions as F

    from tallymark.operators import logs

    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("a", 3)], "k string, t int")
    got = logs.running_totals(df, "k", ["t"], {"n": F.lit(1)}, parts=3).collect()
    assert sorted(r.row_no for r in got) == [1, 1, 2, 3]


def test_failed_prompts_fail_alone(spark):
    from tallymark.operators.respond import respond

    def fn(prompts, systems, temperature):
        if "bad" in prompts:
            raise RuntimeError("503")
        return prompts[:1] if len(prompts) > 1 and "short" in prompts else list(prompts)

    df = spark.createDataFrame([(p, "") for p in ("a", "bad", "short", "b")], "user_prompt string, system_prompt string").coalesce(1)
    got = {r.user_prompt: r.response for r in respond(df, fn).collect()}
    assert got == {"a": "a", "bad": "[ERROR: 503]", "short": "short", "b": "b"}


def test_running_totals_split_one_key_without_order_values(spark):
    # all rows are equal in key and order: parts share them all the same
    df = spark.range(4000, numPartitions=4).selectExpr("'k' AS k", "CAST(NULL AS TIMESTAMP) AS t", "id % 3 AS x")
    got = L.running_totals(df, "k", ["t"], {"x": F.col("x")}, parts=8)
    assert sorted(r.row_no for r in got.collect()) == list(range(1, 4001))
    assert got.agg(F.max("running_x")).first()[0] == df.agg(F.sum("x")).first()[0]
    from tallymark.operators.logs import _in_ranges

    sizes = [r.n for r in _in_ranges(df, ["k", "t"], 8).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_rows_are_numbered_across_parts(spark):
    df = spark.range(500, numPartitions=5).selectExpr("pmod(hash(id), 97) AS a", "id AS b").unionByName(spark.createDataFrame([(None, 9000)], "a INT, b LONG"))
    got = [tuple(r) for r in L.number_rows(df, ["a", "b"], parts=6).orderBy("position").collect()]
    want = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[:2] for r in got] == want and [r[2] for r in got] == list(range(1, 502))
    assert L.number_rows(df.filter("false"), ["a"]).count() == 0
