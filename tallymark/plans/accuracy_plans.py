"""Metric queries over scored responses: accuracy, intervals, runs, ceilings, gaps, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators import compare as J
from ..operators import metrics as A
from ..operators import scoring as P
from ..operators import seeds as S
from ..operators.logs import number_rows
from .derived import MODELS, PROBLEMS, RESPONSES, SCORED, SEEDS, problems, responses, scored_sql, with_views
from .registry import query, table

DEPTHS = list(range(1, 9))


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def scored(spark, d) -> DataFrame:
    """Responses scored with the depth-log rules."""
    return P.score_depth_log(responses(spark, d), gold="gold", expected="vals")


def methods(spark, d) -> DataFrame:
    """Scored responses on the columns shared by all methods."""
    return scored(spark, d).select(
        "seed", "model", F.col("regime").alias("method"), "depth", F.col("is_correct").alias("correct")
    )


_DEPTH_ACC = """
acc AS (
  SELECT model, regime, depth, count(*) AS n_total, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct,
         CAST(count(*) FILTER (is_collapse) AS BIGINT) AS n_collapse,
         avg(greatest(0, least(depth, coalesce(first_error_step - 1, depth))) / depth) AS step_acc,
         count(*) FILTER (is_correct) / count(*) AS acc, count(*) FILTER (is_collapse) / count(*) AS collapse_rate
  FROM scored GROUP BY model, regime, depth
)"""


def acc_sql(body: str) -> str:
    return with_views(PROBLEMS, RESPONSES, SCORED, _DEPTH_ACC, body)


def wilson_sql(k: str = "k", n: str = "n", digits: int = 6) -> str:
    p, z2 = f"({k} / {n})", "(1.96 * 1.96)"
    centre = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})"
    margin = f"1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / (1 + {z2} / {n})"
    return (
        f"round(greatest(0.0, {centre} - {margin}), {digits}) AS ci_lo, "
        f"round(least(1.0, {centre} + {margin}), {digits}) AS ci_hi"
    )


def interval_sql(keys: str, digits: int = 6) -> str:
    return f"""SELECT *, round(k / n, {digits}) AS acc, {wilson_sql(digits=digits)}
      FROM (SELECT {keys}, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS k
            FROM scored GROUP BY ALL)"""


# --- accuracy at depth ------------------------------------------------------------------------------


@query(
    "a1_accuracy_at_depth",
    acc_sql("SELECT model, regime, depth, n_total, n_correct, n_collapse, acc, collapse_rate FROM acc"),
)
def accuracy_at_depth(spark, d):
    return A.depth_accuracy(scored(spark, d)).drop("step_acc")


@query("a2_step_accuracy", acc_sql("SELECT model, regime, depth, round(step_acc, 6) AS step_acc FROM acc"))
def step_accuracy(spark, d):
    return A.depth_accuracy(scored(spark, d)).select("model", "regime", "depth", r6("step_acc").alias("step_acc"))


@query(
    "flagship_depth_metrics",
    acc_sql(f"""SELECT model, regime, depth, n_total, n_correct, n_collapse, round(acc, 6) AS acc,
        round(collapse_rate, 6) AS collapse_rate, round(step_acc, 6) AS step_acc,
        {wilson_sql("n_correct", "n_total")} FROM acc"""),
)
def flagship(spark, d):
    acc = A.depth_accuracy(scored(spark, d)).withColumns({"k": F.col("n_correct"), "n": F.col("n_total")})
    return rounded(
        A.with_interval(acc).select(
            "model", "regime", "depth", "n_total", "n_correct", "n_collapse", "acc", "collapse_rate", "step_acc",
            "ci_lo", "ci_hi",
        ),
        "acc", "collapse_rate", "step_acc", "ci_lo", "ci_hi",
    )


@query("a3_accuracy_wilson", scored_sql(interval_sql("model, regime AS method, depth")))
def accuracy_wilson(spark, d):
    return rounded(A.accuracy(methods(spark, d)), "acc", "ci_lo", "ci_hi")


@query("a4_overall_accuracy", scored_sql(interval_sql("model, regime AS method")))
def overall_accuracy(spark, d):
    return rounded(A.accuracy(methods(spark, d), A.MODEL_METHOD), "acc", "ci_lo", "ci_hi")


@query(
    "a5_accuracy_by_bin",
    scored_sql(interval_sql("model, regime AS method, CAST(floor((depth - 1) / 3) * 3 + 1 AS INT) AS step_bin")),
)
def accuracy_by_bin(spark, d):
    return rounded(A.accuracy_by_bin(methods(spark, d), "depth", 3), "acc", "ci_lo", "ci_hi")


@query(
    "x30_wilson_interval",
    f"""SELECT *, {wilson_sql()} FROM (
        SELECT lang, source, count(*) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS k
        FROM documents JOIN labels USING (doc_id) GROUP BY lang, source)""",
)
def wilson_of_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    acc = A.accuracy(rows.withColumn("correct", F.col("quality") == 1), ("lang", "source"))
    return rounded(acc.drop("acc"), "ci_lo", "ci_hi")


@query(
    "x31_step_bin",
    """SELECT l_linenumber - 1 AS steps, CAST(floor((l_linenumber - 2) / 2) * 2 + 1 AS INT) AS step_bin,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def step_bins(spark, d):
    steps = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("steps"))
    return steps.groupBy("steps", A.step_bin("steps", 2).alias("step_bin")).agg(F.count(F.lit(1)).alias("n"))


# --- macro means, run summaries, profiles -------------------------------------------------------------


@query(
    "a10_macro_mean",
    acc_sql("SELECT model, regime AS method, round(avg(acc), 6) AS mean_acc FROM acc GROUP BY model, regime"),
)
def macro_mean(spark, d):
    return rounded(A.macro_mean(A.accuracy(methods(spark, d))), "mean_acc")


@query(
    "a24_mean_step_accuracy",
    acc_sql("SELECT model, round(avg(step_acc), 6) AS mean_step_acc FROM acc WHERE regime = 'cot' GROUP BY model"),
)
def mean_step_accuracy(spark, d):
    acc = A.depth_accuracy(scored(spark, d).filter(F.col("regime") == "cot"))
    return rounded(A.macro_mean(acc, ("model",), "step_acc"), "mean_step_acc")


@query(
    "a26_accuracy_by_step_count",
    scored_sql("""SELECT depth, CAST(grouping(depth) AS INT) AS is_total, count(*) AS n,
        CAST(count(*) FILTER (is_correct) AS BIGINT) AS k, count(*) FILTER (is_correct) / count(*) AS acc
        FROM scored GROUP BY ROLLUP (depth)"""),
)
def accuracy_by_steps(spark, d):
    return A.accuracy_rollup(methods(spark, d), "depth")


@query(
    "a28_model_count",
    """SELECT event_type AS method, count(DISTINCT user_id) AS n_models, count(*) AS n_records
       FROM events GROUP BY event_type""",
)
def model_count(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("method"))
    return A.model_count(log, ["method"])


@query(
    "a25_value_profile",
    with_views(PROBLEMS, """SELECT depth, count(*) AS n, min(gold) AS min_value, max(gold) AS max_value
        FROM problems GROUP BY depth"""),
)
def value_profile(spark, d):
    return A.value_profile(problems(spark, d), ["depth"], "gold")


@query(
    "a15_variant_accuracy",
    scored_sql("""SELECT model, regime AS variant, CAST(count(*) FILTER (is_correct AND k % 10 <> 0) AS BIGINT) AS n_correct,
        CAST(count(*) FILTER (k % 10 <> 0) AS BIGINT) AS n_evaluated,
        CAST(count(*) FILTER (k % 10 = 0) AS BIGINT) AS n_skipped_no_gold,
        coalesce(count(*) FILTER (is_correct AND k % 10 <> 0) / nullif(count(*) FILTER (k % 10 <> 0), 0), 0.0) AS accuracy
        FROM scored GROUP BY model, regime"""),
)
def variant_accuracy(spark, d):
    has_gold = F.col("k") % 10 != 0
    rows = scored(spark, d).select(
        "model", F.col("regime").alias("variant"), (F.col("is_correct") & has_gold).alias("correct"),
        has_gold.alias("evaluated"),
    )
    return A.variant_accuracy(rows, ("model", "variant"))


# --- runs (seeds) -------------------------------------------------------------------------------------

_PER_SEED = """
per_seed AS (
  SELECT seed, model, regime AS method, depth, count(*) AS n, count(*) FILTER (is_correct) / count(*) AS acc
  FROM scored GROUP BY ALL
)"""


def bootstrap_sql(values: str, key: str, draws: int) -> str:
    """CTEs boot(key, b, mean) from a table of (key, list of values): an explode and two group-bys."""
    draw = (
        "CAST(('0x' || substr(md5('0|' || key || '|' || b || '|' || (j // 4)), 1 + 8 * (j % 4), 8)) AS BIGINT)"
    )
    return f"""
boot AS (
  SELECT key, b, list_sum(list_transform(range(0, len(vs)), lambda j: vs[{draw} % len(vs) + 1])) / len(vs) AS mean
  FROM (SELECT {key} AS key, {values} AS vs, unnest(range(0, {draws})) AS b FROM cells)
),
bounds AS (
  SELECT key, list_sort(list(mean))[{int(0.025 * draws) + 1}] AS lo, list_sort(list(mean))[{int(0.975 * draws) + 1}] AS hi
  FROM boot GROUP BY key
)"""


def per_seed_sql(*parts: str) -> str:
    return with_views(PROBLEMS, RESPONSES, SCORED, _PER_SEED, *parts)


@query(
    "a8_multi_seed_accuracy",
    per_seed_sql(
        f"""
cells AS (
  SELECT model, method, depth, count(*) AS n_seeds, avg(acc) AS acc, coalesce(stddev_samp(acc), 0.0) AS std_acc,
         list(acc ORDER BY seed) AS vs, {", ".join(f"max(acc) FILTER (seed = '{s}') AS acc_{s}" for s in SEEDS)}
  FROM per_seed GROUP BY model, method, depth
)""",
        bootstrap_sql("vs", "model || '|' || method || '|' || depth", V.BOOTSTRAP_DRAWS),
        f"""SELECT model, method, depth, n_seeds, round(acc, 6) AS acc, round(std_acc, 6) AS std_acc,
            {", ".join(f"round(acc_{s}, 6) AS acc_{s}" for s in SEEDS)}, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi
        FROM cells JOIN bounds ON key = model || '|' || method || '|' || depth""",
    ),
)
def multi_seed_accuracy(spark, d):
    out = S.across_seeds(S.seed_accuracy(methods(spark, d)), SEEDS)
    return rounded(out, "acc", "std_acc", "ci_lo", "ci_hi", *[f"acc_{s}" for s in SEEDS])


@query(
    "a9_bootstrap_interval",
    with_views(
        """cells AS (
  SELECT event_type, list(v ORDER BY day) AS vs FROM (
    SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 2) / count(*) AS v FROM events GROUP BY ALL) GROUP BY 1
)""",
        bootstrap_sql("vs", "event_type", V.BOOTSTRAP_DRAWS),
        "SELECT key AS event_type, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM bounds",
    ),
)
def bootstrap_interval(spark, d):
    daily = (
        table(spark, d, "events")
        .groupBy("event_type", F.date_trunc("day", "ts").alias("seed"))
        .agg((F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("v"))
    )
    cells = daily.groupBy("event_type").agg(S.by_seed("v").alias("vs"))
    return rounded(S.with_bootstrap(cells, "vs", ["event_type"]), "ci_lo", "ci_hi")


@query(
    "a11_macro_multi_seed",
    per_seed_sql("""SELECT model, method, count(*) AS n_seeds, round(avg(a), 6) AS mean_acc,
        round(coalesce(stddev_samp(a), 0.0), 6) AS std_acc
        FROM (SELECT seed, model, method, avg(acc) AS a FROM per_seed GROUP BY ALL) GROUP BY model, method"""),
)
def macro_multi_seed(spark, d):
    return rounded(S.macro_across_seeds(S.seed_accuracy(methods(spark, d))), "mean_acc", "std_acc")


@query(
    "a13_delta_across_seeds",
    per_seed_sql(
        """
cells AS (
  SELECT m.model, m.depth, count(p.delta) AS n_seeds, any_value(m.mean_delta) AS mean_delta,
         list(p.delta ORDER BY p.seed) FILTER (p.delta IS NOT NULL) AS vs
  FROM (SELECT model, depth, avg(acc) FILTER (method = 'cot') - avg(acc) FILTER (method = 'direct') AS mean_delta
        FROM per_seed GROUP BY ALL HAVING mean_delta IS NOT NULL) m
  LEFT JOIN (SELECT c.seed, c.model, c.depth, c.acc - x.acc AS delta FROM per_seed c
        JOIN per_seed x USING (seed, model, depth) WHERE c.method = 'cot' AND x.method = 'direct') p USING (model, depth)
  GROUP BY m.model, m.depth
)""",
        bootstrap_sql("vs", "model || '|' || depth", V.BOOTSTRAP_DRAWS),
        """SELECT model, depth, n_seeds, round(mean_delta, 6) AS mean_delta, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi
        FROM cells JOIN bounds ON key = model || '|' || depth""",
    ),
)
def delta_across_seeds(spark, d):
    out = S.delta_across_seeds(S.seed_accuracy(methods(spark, d)), "direct", "cot")
    return rounded(out, "mean_delta", "ci_lo", "ci_hi")


@query(
    "a13_delta_across_depths",
    per_seed_sql("""SELECT model, count(*) AS n_depths, round(avg(delta), 6) AS mean_delta,
        round(stddev_samp(delta), 6) AS std_delta FROM (
          SELECT c.model, c.depth, c.acc - x.acc AS delta
          FROM (SELECT model, method, depth, avg(acc) AS acc FROM per_seed GROUP BY ALL) c
          JOIN (SELECT model, method, depth, avg(acc) AS acc FROM per_seed GROUP BY ALL) x USING (model, depth)
          WHERE c.method = 'cot' AND x.method = 'direct') GROUP BY model"""),
)
def delta_across_depths(spark, d):
    means = S.seed_accuracy(methods(spark, d)).groupBy(*A.MODEL_METHOD_DEPTH).agg(F.avg("acc").alias("acc"))
    return rounded(S.delta_across_depths(means, "direct", "cot"), "mean_delta", "std_delta")


@query(
    "a14_mean_interval",
    scored_sql(f"""SELECT model, round(avg(acc), 6) AS mean_acc, round(avg(ci_lo), 6) AS mean_ci_lo,
        round(avg(ci_hi), 6) AS mean_ci_hi
        FROM ({interval_sql("model, regime AS method, depth", 15)}) WHERE method = 'cot' GROUP BY model"""),
)
def mean_interval(spark, d):
    cot = A.accuracy(methods(spark, d).filter(F.col("method") == "cot"))
    return rounded(
        A.macro_mean(cot, ("model",), "acc", "ci_lo", "ci_hi"), "mean_acc", "mean_ci_lo", "mean_ci_hi"
    )


@query(
    "j9_key_union_over_seeds",
    per_seed_sql("""SELECT model, method, depth, count(*) AS n_seeds, round(avg(acc), 6) AS acc FROM per_seed
        WHERE NOT (seed = 'seed_42' AND depth > 4) AND NOT (seed = 'seed_123' AND method = 'cot')
        GROUP BY model, method, depth"""),
)
def key_union(spark, d):
    runs = S.seed_accuracy(methods(spark, d)).filter(
        ~((F.col("seed") == "seed_42") & (F.col("depth") > 4))
        & ~((F.col("seed") == "seed_123") & (F.col("method") == "cot"))
    )
    cells = runs.groupBy(*A.MODEL_METHOD_DEPTH).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("acc").alias("acc"))
    return rounded(cells, "acc")


@query("t5_first_seed", with_views(PROBLEMS, "SELECT min(seed) AS seed FROM problems"))
def first_seed(spark, d):
    return S.first_seed(problems(spark, d))


# --- ceilings, gaps, deltas ---------------------------------------------------------------------------


@query(
    "a19_depth_ceiling",
    acc_sql("""SELECT model, regime, round(any_value(b), 4) AS baseline_acc, round(any_value(b) * 0.7, 4) AS threshold,
        min(depth) FILTER (depth > 1 AND acc < b * 0.7) AS k_star
        FROM (SELECT a.*, one.acc AS b FROM acc a JOIN (SELECT model, regime, acc FROM acc WHERE depth = 1) one
              USING (model, regime)) GROUP BY model, regime"""),
)
def depth_ceiling(spark, d):
    return A.depth_ceiling(A.depth_accuracy(scored(spark, d)))


_BEST = """
best AS (
  SELECT regime, model AS ref_model, mean_acc FROM (
    SELECT *, row_number() OVER (PARTITION BY regime ORDER BY mean_acc DESC, model) AS r
    FROM (SELECT regime, model, avg(acc) AS mean_acc FROM acc GROUP BY regime, model)) WHERE r = 1
)"""


@query(
    "a20_best_model",
    with_views(
        PROBLEMS, RESPONSES, SCORED, _DEPTH_ACC, _BEST,
        "SELECT regime, ref_model AS model, round(mean_acc, 6) AS mean_acc FROM best",
    ),
)
def best_model(spark, d):
    return rounded(A.best_model(A.depth_accuracy(scored(spark, d))), "mean_acc")


@query(
    "j7_gap_to_best",
    with_views(
        PROBLEMS, RESPONSES, SCORED, _DEPTH_ACC, _BEST,
        """SELECT a.model, a.regime, a.depth, round(a.acc, 6) AS acc, ref_model, round(r.acc, 6) AS ref_acc,
            round(r.acc - a.acc, 6) AS gap
        FROM acc a JOIN best USING (regime)
        LEFT JOIN acc r ON r.regime = a.regime AND r.depth = a.depth AND r.model = ref_model
        WHERE a.model <> ref_model""",
    ),
)
def gap_to_best(spark, d):
    return rounded(J.gap_to_reference(A.depth_accuracy(scored(spark, d))), "acc", "ref_acc", "gap")


@query(
    "f3_gap_to_named_model",
    acc_sql("""SELECT a.model, a.regime, a.depth, round(a.acc, 6) AS acc, 'm2' AS ref_model,
        round(r.acc, 6) AS ref_acc, round(r.acc - a.acc, 6) AS gap
        FROM acc a LEFT JOIN acc r ON r.regime = a.regime AND r.depth = a.depth AND r.model = 'm2'
        WHERE a.model <> 'm2'"""),
)
def gap_to_named(spark, d):
    return rounded(J.gap_to_reference(A.depth_accuracy(scored(spark, d)), "m2"), "acc", "ref_acc", "gap")


_VARIANTS = """
variants AS (
  SELECT model, regime AS variant, count(*) FILTER (is_correct) / count(*) AS accuracy
  FROM scored WHERE NOT (model = 'm2' AND regime = 'direct') GROUP BY ALL
)"""


def _variants(spark, d) -> DataFrame:
    rows = scored(spark, d).filter(~((F.col("model") == "m2") & (F.col("regime") == "direct")))
    return A.variant_accuracy(
        rows.select("model", F.col("regime").alias("variant"), F.col("is_correct").alias("correct"),
                    F.lit(True).alias("evaluated")),
        ("model", "variant"),
    )


@query(
    "j5_variant_drop",
    with_views(
        PROBLEMS, RESPONSES, SCORED, _VARIANTS,
        """SELECT model, round(o.accuracy, 6) AS acc_original, round(e.accuracy, 6) AS acc_enhanced,
            round(o.accuracy - e.accuracy, 6) AS "drop"
        FROM variants o JOIN variants e USING (model) WHERE o.variant = 'cot' AND e.variant = 'direct'""",
    ),
)
def variant_drop(spark, d):
    return rounded(J.variant_drop(_variants(spark, d), "cot", "direct"), "acc_original", "acc_enhanced", "drop")


@query(
    "j6_two_runs",
    with_views(
        PROBLEMS, RESPONSES, SCORED, _VARIANTS,
        """SELECT model, round(o.accuracy, 6) AS acc_first, round(e.accuracy, 6) AS acc_second,
            round(e.accuracy - o.accuracy, 6) AS difference
        FROM variants o JOIN variants e USING (model) WHERE o.variant = 'cot' AND e.variant = 'direct'""",
    ),
)
def two_runs(spark, d):
    metric = _variants(spark, d)
    out = J.two_runs(metric.filter(F.col("variant") == "cot"), metric.filter(F.col("variant") == "direct"))
    return rounded(out, "acc_first", "acc_second", "difference")


@query(
    "j8_method_delta",
    acc_sql("""SELECT model, depth, round(b.acc, 6) AS acc_base, round(m.acc, 6) AS acc_method,
        round(m.acc - b.acc, 6) AS delta FROM acc b JOIN acc m USING (model, depth)
        WHERE b.regime = 'direct' AND m.regime = 'cot'"""),
)
def method_delta(spark, d):
    return rounded(
        J.method_delta(A.accuracy(methods(spark, d)), base="direct", method="cot"), "acc_base", "acc_method", "delta"
    )


@query(
    "j10_dense_grid",
    scored_sql("""SELECT model, depth, coalesce(round(acc, 6), 0.0) AS acc
        FROM (SELECT * FROM (SELECT DISTINCT model FROM scored), (SELECT CAST(unnest(range(1, 11)) AS INT) AS depth))
        LEFT JOIN (SELECT model, depth, count(*) FILTER (is_correct) / count(*) AS acc FROM scored
                   WHERE regime = 'cot' GROUP BY ALL) USING (model, depth)"""),
)
def dense_grid(spark, d):
    cot = methods(spark, d).filter(F.col("method") == "cot")
    return rounded(A.dense_grid(A.accuracy(cot, ("model", "depth")), list(range(1, 11))), "acc")


# --- pivots, labels, formats --------------------------------------------------------------------------


@query(
    "a21_pivot_depth",
    acc_sql("SELECT model, " + ", ".join(
        f"round(max(acc) FILTER (depth = {k}), 3) AS d{k}" for k in DEPTHS
    ) + " FROM acc WHERE regime = 'cot' GROUP BY model"),
)
def pivot_depth(spark, d):
    acc = A.depth_accuracy(scored(spark, d).filter(F.col("regime") == "cot"))
    return A.wide(acc.withColumn("acc", F.round("acc", 3)), "model", "depth", DEPTHS, prefix="d")


@query(
    "a21_pivot_method",
    scored_sql("""SELECT model, round(max(acc) FILTER (m = 'direct'), 4) AS direct, round(max(acc) FILTER (m = 'cot'), 4) AS cot,
        round(max(acc) FILTER (m = 'chunked'), 4) AS chunked
        FROM (SELECT model, regime AS m, count(*) FILTER (is_correct) / count(*) AS acc FROM scored GROUP BY ALL)
        GROUP BY model"""),
)
def pivot_method(spark, d):
    acc = A.accuracy(methods(spark, d), A.MODEL_METHOD).withColumn("acc", F.round("acc", 4))
    return A.wide(acc, "model", "method", ["direct", "cot", "chunked"])


@query(
    "a22_pivot_mean_std",
    per_seed_sql("SELECT model, " + ", ".join(
        f"max(t) FILTER (depth = {k}) AS d{k}" for k in DEPTHS
    ) + """ FROM (SELECT model, depth,
            printf('%.3f', round(avg(acc), 5)) || ' ± ' || printf('%.3f', round(coalesce(stddev_samp(acc), 0.0), 5)) AS t
        FROM per_seed WHERE method = 'cot' GROUP BY model, depth) GROUP BY model"""),
)
def pivot_mean_std(spark, d):
    runs = S.seed_accuracy(methods(spark, d).filter(F.col("method") == "cot"))
    cells = runs.groupBy("model", "depth").agg(
        F.round(F.avg("acc"), 5).alias("acc"), F.round(S.sample_std("acc"), 5).alias("std_acc")
    )
    return A.wide_mean_std(cells, DEPTHS)


@query(
    "p8_label_recode",
    scored_sql("""SELECT CASE model WHEN 'm0' THEN 'Model Zero' WHEN 'm1' THEN 'Model One' ELSE model END AS model,
        count(*) AS n FROM scored GROUP BY 1"""),
)
def label_recode(spark, d):
    named = A.labelled(responses(spark, d), "model", {"m0": "Model Zero", "m1": "Model One"})
    return named.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t1_sorted_metrics",
    acc_sql("SELECT model, regime, depth, n_correct, row_number() OVER (ORDER BY model, regime, depth) AS position FROM acc"),
)
def sorted_metrics(spark, d):
    acc = A.depth_accuracy(scored(spark, d)).select("model", "regime", "depth", "n_correct")
    return number_rows(acc, ["model", "regime", "depth"])


@query(
    "t4_sorted_by_label",
    scored_sql("""SELECT label, n, row_number() OVER (ORDER BY label) AS position FROM (
        SELECT CASE model WHEN 'm2' THEN 'Alpha' ELSE model END AS label, count(*) AS n FROM scored GROUP BY 1)"""),
)
def sorted_by_label(spark, d):
    counts = responses(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    labelled = A.labelled(counts, "model", {"m2": "Alpha"}).withColumnRenamed("model", "label")
    return number_rows(labelled.select("label", "n"), ["label"])


@query(
    "x38_formats",
    with_views(PROBLEMS, """SELECT printf('depth%02d_prob%04d', depth, k) AS problem_id, 'd' || depth AS depth_label,
        printf('%.1f%%', depth * 12.5) AS share, printf('%.3f ± %.3f', round(depth / 8, 3), round(depth / 16, 3)) AS mean_std FROM problems"""),
)
def formats(spark, d):
    from ..functions.stats import mean_std_label, percent_label

    return problems(spark, d).select(
        F.format_string("depth%02d_prob%04d", "depth", "k").alias("problem_id"),
        A.depth_label("depth").alias("depth_label"),
        percent_label(F.col("depth") * 0.125).alias("share"),
        mean_std_label(F.col("depth") / 8, F.col("depth") / 16).alias("mean_std"),
    )


# --- set operations on metric keys --------------------------------------------------------------------


def _cells(spark, d, regime: str) -> DataFrame:
    """Cells of the metric table in which at least six of ten answers are correct."""
    acc = A.depth_accuracy(scored(spark, d).filter(F.col("regime") == regime))
    return acc.filter(F.col("n_correct") * 10 >= F.col("n_total") * 6)


_CELLS = "".join(
    f"""{", " if regime == "direct" else ""}
{regime} AS (SELECT model, depth FROM scored WHERE regime = '{regime}' GROUP BY ALL HAVING count(*) FILTER (is_correct) * 10 >= count(*) * 6)"""
    for regime in ("cot", "direct")
)


@query(
    "u2_key_intersection",
    with_views(PROBLEMS, RESPONSES, SCORED, _CELLS, "SELECT * FROM cot INTERSECT SELECT * FROM direct"),
)
def key_intersection(spark, d):
    return J.shared_keys(_cells(spark, d, "cot"), _cells(spark, d, "direct"), "model", "depth")


@query(
    "u4_key_union",
    with_views(PROBLEMS, RESPONSES, SCORED, _CELLS, "SELECT * FROM cot UNION SELECT * FROM direct"),
)
def key_union_distinct(spark, d):
    return J.all_keys(_cells(spark, d, "cot"), _cells(spark, d, "direct"), "model", "depth")


@query(
    "u3_unknown_names",
    """SELECT name FROM (VALUES ('click'), ('nothing'), ('view'), ('other')) v(name)
       WHERE name NOT IN (SELECT event_type FROM events)""",
)
def unknown(spark, d):
    return P.unknown_names(spark, ["click", "nothing", "view", "other"], table(spark, d, "events").select("event_type"))


@query("u5_distinct_values", "SELECT DISTINCT source, lang FROM documents")
def distinct_values(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query(
    "u1_stack_methods",
    with_views(PROBLEMS, """SELECT method, count(*) AS n, count(DISTINCT problem_id) AS n_ids FROM (
        SELECT problem_id, 'cot' AS method FROM problems UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'chunked' FROM lineitem)
        GROUP BY method"""),
)
def stack_methods(spark, d):
    cot = problems(spark, d).select("problem_id", F.lit("cot").alias("method"))
    chunked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.lit("chunked").alias("method"))
    both = J.stack_methods(cot, chunked, columns=("problem_id", "method"))
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("problem_id").alias("n_ids"))


@query(
    "p5_member_filter",
    scored_sql("""SELECT model, regime, count(*) AS n FROM scored WHERE model IN ('m0', 'm2') AND regime IN ('cot')
        AND depth IN (1, 3, 5) GROUP BY ALL"""),
)
def member_filter(spark, d):
    rows = P.select_members(P.select_members(responses(spark, d), "model", ["m0", MODELS[2]]), "regime", ["cot"])
    rows = P.select_members(rows, "depth", [1, 3, 5])
    return rows.groupBy("model", "regime").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w5_first_violation",
    """WITH daily AS (SELECT event_type AS model, 'all' AS regime, CAST(date_part('day', ts) AS INT) AS depth,
                     count(*) FILTER (value >= 60) / count(*) AS acc FROM events GROUP BY ALL)
       SELECT model, round(any_value(b), 4) AS baseline_acc, min(depth) FILTER (depth > 1 AND acc < b * 0.7) AS k_star
       FROM (SELECT d.*, one.acc AS b FROM daily d JOIN (SELECT model, acc FROM daily WHERE depth = 1) one USING (model))
       GROUP BY model""",
)
def first_violation(spark, d):
    daily = (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("model"), F.lit("all").alias("regime"), F.dayofmonth("ts").alias("depth"))
        .agg(F.avg((F.col("value") >= 60).cast("int")).alias("acc"))
    )
    return A.depth_ceiling(daily).select("model", "baseline_acc", "k_star")


@query(
    "f4_method_labels",
    """WITH daily AS (SELECT event_type, CAST(date_part('day', ts) AS INT) AS day, count(*) FILTER (value >= 60) / count(*) AS acc
                      FROM events GROUP BY ALL)
       SELECT day, round(c.acc, 6) AS acc_base, round(v.acc, 6) AS acc_method, round(v.acc - c.acc, 6) AS delta
       FROM daily c JOIN daily v USING (day) WHERE c.event_type = 'click' AND v.event_type = 'view'""",
)
def method_labels(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_type").alias("method"), F.dayofmonth("ts").alias("day"), (F.col("value") >= 60).alias("correct")
    )
    out = J.method_delta(A.accuracy(log, ("method", "day")), ("day",), "click", "view")
    return rounded(out, "acc_base", "acc_method", "delta")


@query(
    "p7_default_fill",
    """SELECT depth, corrections_applied, count(*) AS n FROM (
        SELECT CASE WHEN l_partkey % 3 = 0 THEN l_linenumber WHEN l_partkey % 3 = 1 THEN CAST(l_quantity AS INT) ELSE 0 END AS depth,
               CASE WHEN l_partkey % 2 = 0 THEN l_linenumber ELSE 0 END AS corrections_applied FROM lineitem) GROUP BY ALL""",
)
def default_fill(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 3 = 0 THEN l_linenumber END AS depth",
        "CASE WHEN l_partkey % 3 < 2 THEN cast(l_quantity AS int) END AS estimated_steps",
        "CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS corrections_applied",
    )
    filled = P.with_defaults(rows, {"corrections_applied": 0, "unverified_fallbacks": 0})
    return filled.groupBy(P.step_count(filled, "depth", "estimated_steps").alias("depth"), "corrections_applied").agg(
        F.count(F.lit(1)).alias("n")
    )
