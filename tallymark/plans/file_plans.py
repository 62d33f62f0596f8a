"""Source and sink queries: derived tables are written in the documented layouts and read back.

Files go below the shared folder of the session; every run uses a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.clauses import inject_distractor
from ..operators import metrics as A
from ..operators import scoring as P
from ..session import shared_dir
from ..sources import json_tables as I
from ..sources import sinks as O
from ..sources.rejects import Rejects
from .accuracy_plans import r6, scored
from .derived import PROBLEMS, problems, scored_sql, with_views
from .registry import query, table
from .text_plans import DISTRACTED, POOLS, draw_sql, pools

# --- template documents: one record per file ----------------------------------------------------------------

_QUESTION = "CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'Supplier ' || s_suppkey || ' sells. How many?' END"
_ANSWER = "CASE WHEN s_suppkey % 11 <> 0 THEN 'so' || chr(10) || '#### ' || s_nationkey END"


def _templates(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr(
        f"{_QUESTION} AS question", f"{_ANSWER} AS answer", "cast(s_suppkey AS int) AS id_orig",
        "cast(s_nationkey AS int) AS id_shuffled", "s_name AS question_annotated", "s_name AS answer_annotated",
        "CASE WHEN s_suppkey % 4 > 0 THEN transform(sequence(1, cast(s_suppkey % 4 as int)), j -> named_struct("
        "'type', 'TYPE_' || substr('ABCD', j, 1), 'text', 'Fact ' || j || ' of ' || s_suppkey)) END AS dynamic_distractor_pool",
    )
    return rows


_VALID = "s_suppkey % 9 <> 0 AND s_suppkey % 11 <> 0"


@query(
    "s1_template_scan",
    f"""SELECT CAST(s_suppkey AS INT) AS id_orig, {_QUESTION} AS question, {_ANSWER} AS answer, TRUE AS is_file
        FROM supplier WHERE {_VALID}""",
)
def template_scan(spark, d):
    path = O.write_documents(_templates(spark, d).drop("dynamic_distractor_pool"), shared_dir(spark, "s1"))
    return I.read_templates(spark, path, "*.txt").select(
        "id_orig", "question", "answer", F.endswith("source_file", F.lit(".txt")).alias("is_file")
    )


@query(
    "s2_pool_scan",
    f"""SELECT CAST(s_suppkey AS INT) AS id_orig, j AS picked, 'Fact ' || j || ' of ' || s_suppkey AS distractor,
        'TYPE_' || substr('ABCD', j, 1) AS distractor_type,
        'Supplier ' || s_suppkey || ' sells. Fact ' || j || ' of ' || s_suppkey || '. How many?' AS question
        FROM (SELECT *, CAST({draw_sql("(s_suppkey % 4)", "'42'", "s_suppkey")} AS INT) + 1 AS j
              FROM supplier WHERE {_VALID} AND s_suppkey % 4 > 0)""",
)
def pool_scan(spark, d):
    path = O.write_documents(_templates(spark, d), shared_dir(spark, "s2"))
    rows = P.keep_complete(I.read_templates_with_pool(spark, path, "*.txt"), "question", "answer")
    picked = I.pick_distractor(rows, key="id_orig")
    return picked.select(
        "id_orig", F.regexp_extract("distractor", r"Fact (\d+)", 1).cast("int").alias("picked"), "distractor", "distractor_type",
        inject_distractor("question", "distractor").alias("question"),
    )


# --- data sets ------------------------------------------------------------------------------------------------


def _math_problems(spark, d) -> DataFrame:
    return problems(spark, d).select(
        "problem_id", "depth", "question", F.col("gold").cast("double").alias("ground_truth"),
        F.col("vals").cast("array<double>").alias("intermediate_values"),
        F.transform("vals", lambda _: F.lit("add")).alias("operations"), F.lit("items").alias("answer_unit"),
    )


@query(
    "s3_dataset_by_suffix",
    with_views(PROBLEMS, """SELECT layout, count(*) AS n, CAST(sum(gold) AS BIGINT) AS total, CAST(sum(depth) AS BIGINT) AS n_steps
        FROM problems, (VALUES ('lines', 0), ('arrays', 1)) l(layout, i) GROUP BY layout"""),
)
def dataset_by_suffix(spark, d):
    path = shared_dir(spark, "s3")
    lines, arrays = f"{path}/set.jsonl", f"{path}/set.json"
    O.write_json(_math_problems(spark, d), lines)
    O.write_documents(I.read_dataset(spark, lines, S.MATH_PROBLEM), arrays)
    both = [
        I.read_dataset(spark, p, S.MATH_PROBLEM).withColumn("layout", F.lit(n)) for p, n in ((lines, "lines"), (arrays, "arrays"))
    ]
    return both[0].unionByName(both[1]).groupBy("layout").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ground_truth").cast("bigint").alias("total"),
        F.sum(F.size("intermediate_values")).alias("n_steps"),
    )


@query(
    "s4_depth_partitions",
    with_views(PROBLEMS, """SELECT depth, problem_id, CAST(gold AS DOUBLE) AS ground_truth FROM (
        SELECT *, row_number() OVER (PARTITION BY depth ORDER BY problem_id) AS r FROM problems WHERE depth IN (2, 5, 8))
        WHERE r <= 10"""),
)
def depth_partitions(spark, d):
    path = O.write_by_depth(_math_problems(spark, d), shared_dir(spark, "s4"))
    return I.read_depths(spark, path, [2, 5, 8], 10).select("depth", "problem_id", "ground_truth")


@query(
    "k4_by_depth",
    with_views(PROBLEMS, "SELECT depth, count(*) AS n, min(gold) AS min_value, max(gold) AS max_value FROM problems GROUP BY depth"),
)
def by_depth(spark, d):
    path = O.write_by_depth(_math_problems(spark, d), shared_dir(spark, "k4"))
    out = A.value_profile(spark.read.schema(S.MATH_PROBLEM).json(path), ["depth"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("min_value", "max_value")})


@query("k1_json_round_trip", with_views(PROBLEMS, "SELECT problem_id, depth, question, CAST(gold AS DOUBLE) AS ground_truth FROM problems"))
def json_round_trip(spark, d):
    path = O.write_json(_math_problems(spark, d), shared_dir(spark, "k1"))
    return spark.read.schema(S.MATH_PROBLEM).json(path).select("problem_id", "depth", "question", "ground_truth")


# --- result logs ----------------------------------------------------------------------------------------------


def _results(spark, d) -> DataFrame:
    """Scored responses in the layout of a depth log."""
    return scored(spark, d).select(
        "seed", "k", "model", "regime", "problem_id", "depth", "question", F.col("gold").cast("double").alias("ground_truth"),
        "response", "predicted", "is_correct", "is_collapse", "first_error_step", F.lit(0.5).alias("elapsed_s"),
    )


_LOG_COUNTS = "model, regime, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct"


def _log_counts(df: DataFrame, regime: str = "regime") -> DataFrame:
    return df.groupBy("model", regime).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"))


@query("s5_lenient_log", scored_sql(f"SELECT {_LOG_COUNTS} FROM scored WHERE k % 10 > 1 GROUP BY model, regime"))
def lenient_log(spark, d):
    line = F.when(F.col("k") % 10 == 0, "").when(F.col("k") % 10 == 1, '{"model": "m0", ').otherwise(
        F.to_json(F.struct("*"))
    )
    path = O.write_lines(_results(spark, d).select(line.alias("value")), shared_dir(spark, "s5"))
    return _log_counts(I.read_log(spark, path))


@query(
    "s5_reject_counts",
    scored_sql("""SELECT reason, CAST(n AS BIGINT) AS n FROM (
        SELECT unnest(['lines', 'blank', 'not_json', 'lacking_key']) AS reason, unnest([count(*), count(*) FILTER (k % 10 = 0),
               count(*) FILTER (k % 10 = 1), count(*) FILTER (k % 10 > 1 AND (k % 6 = 0 OR k % 7 = 0))]) AS n FROM scored)"""),
)
def log_reject_counts(spark, d):
    """Lines a lenient reader skips, and records that lack a key, counted by the job that writes the rest."""
    rows = _results(spark, d).withColumn("regime", F.when(F.col("k") % 6 != 0, F.col("regime"))).withColumn(
        "is_correct", F.when(F.col("k") % 7 != 0, F.col("is_correct"))
    )
    line = F.when(F.col("k") % 10 == 0, "").when(F.col("k") % 10 == 1, '{"model": "m0", ').otherwise(F.to_json(F.struct("*")))
    path, rejects = shared_dir(spark, "s5-rejects"), Rejects()
    O.write_lines(rows.select(line.alias("value")), f"{path}/log")
    O.write_table(I.read_method_log(spark, f"{path}/log", rejects=rejects), f"{path}/kept")
    return rejects.table(spark)


@query(
    "p3_reject_counts",
    """SELECT reason, CAST(n AS BIGINT) AS n FROM (
        SELECT unnest(['templates', 'empty_pool']) AS reason, unnest([count(*), count(*) FILTER (s_suppkey % 4 = 0)]) AS n FROM supplier)""",
)
def pool_reject_counts(spark, d):
    path, rejects = shared_dir(spark, "p3-rejects"), Rejects()
    O.write_documents(_templates(spark, d), f"{path}/in")
    O.write_json(I.distract(I.read_templates_with_pool(spark, f"{path}/in", "*.txt", rejects)), f"{path}/out")
    return rejects.table(spark)


@query(
    "s6_required_fields",
    scored_sql("""SELECT model, regime AS method, depth, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS k
        FROM scored WHERE k % 6 <> 0 AND k % 7 <> 0 GROUP BY ALL"""),
)
def required_fields(spark, d):
    rows = _results(spark, d).withColumn("regime", F.when(F.col("k") % 6 != 0, F.col("regime"))).withColumn(
        "is_correct", F.when(F.col("k") % 7 != 0, F.col("is_correct"))
    )
    path = O.write_json(rows, shared_dir(spark, "s6"))
    return A.accuracy(I.read_method_log(spark, path)).select("model", "method", "depth", "n", "k")


@query(
    "s6_model_of_log_name",
    scored_sql("""SELECT model, 'cot' AS method, depth AS estimated_steps, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS k
        FROM scored WHERE regime = 'cot' GROUP BY ALL"""),
)
def model_of_log_name(spark, d):
    path = shared_dir(spark, "s6b")
    rows = _results(spark, d).filter(F.col("regime") == "cot").withColumn("estimated_steps", F.col("depth"))
    O.write_json(rows.withColumn("log", F.concat("model", F.lit("_cot.jsonl"))).drop("model"), path, ["log"])
    log = I.read_qa_log(spark, path)
    return A.accuracy(log, ("model", "method", "estimated_steps")).select("model", "method", "estimated_steps", "n", "k")


@query("s7_strict_log", scored_sql(f"SELECT {_LOG_COUNTS} FROM scored GROUP BY model, regime"))
def strict_log(spark, d):
    path = O.write_json(_results(spark, d), shared_dir(spark, "s7"))
    return _log_counts(I.read_log_strict(spark, path, S.DEPTH_RESULT))


def _chunk_rows(spark, d) -> DataFrame:
    """Chunk results as in a result file; some rows lack counters or use the other step field."""
    return _results(spark, d).filter(F.col("regime") == "cot").select(
        "seed", "model", F.col("k").cast("int").alias("id"), F.when(F.col("k") % 3 > 0, F.col("depth")).alias("depth"),
        F.col("depth").alias("estimated_steps"), F.col("is_correct").alias("correct"),
        F.when(F.col("k") % 4 > 0, (F.col("k") % 5).cast("int")).alias("corrections_applied"),
        F.lit(1).alias("unverified_fallbacks"), ((F.col("depth") + 1) / 2).cast("int").alias("num_chunks"),
    )


@query(
    "s8_model_from_path",
    scored_sql("""SELECT model, depth, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS k,
        CAST(sum(CASE WHEN k % 4 > 0 THEN k % 5 ELSE 0 END) AS BIGINT) AS corrections, CAST(0 AS BIGINT) AS failures
        FROM scored WHERE regime = 'cot' GROUP BY ALL"""),
)
def model_from_path(spark, d):
    path = shared_dir(spark, "s8")
    # half of the rows stand in a snapshot as well
    suffixes = F.when(F.col("id") % 2 == 0, F.array(F.lit(""), F.lit("_ckpt_50"))).otherwise(F.array(F.lit("")))
    rows = _chunk_rows(spark, d).drop("seed").withColumn("suffix", F.explode(suffixes))
    O.write_json(rows.withColumn("file", F.concat(F.lit("exp4_chunked_"), "model", "suffix", F.lit(".json"))).drop("model", "suffix"), path, ["file"])
    out = I.read_chunk_results(spark, path, multi_line=False)
    return out.groupBy("model", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.sum("corrections_applied").alias("corrections"),
        F.sum("extraction_failures").alias("failures"),
    )


@query(
    "s9_seed_directories",
    scored_sql("SELECT seed, model, regime, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct FROM scored GROUP BY ALL"),
)
def seed_directories(spark, d):
    base = shared_dir(spark, "s9")
    O.write_json(_results(spark, d).withColumnRenamed("seed", "seed_run"), base, ["seed_run"])
    return I.read_seed_logs(spark, base).groupBy("seed", "model", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct")
    )


@query("k2_append_log", scored_sql(f"SELECT {_LOG_COUNTS} FROM scored GROUP BY model, regime"))
def append_log(spark, d):
    path = shared_dir(spark, "k2")
    # scored once, without a shuffle; both appends read the scored rows, and the first is tried again, which adds nothing
    rows = spark.read.parquet(O.write_table(_results(spark, d), f"{path}/scored"))
    for half in (0, 1, 0):
        O.append_log(rows.filter(F.col("k") % 2 == half), f"{path}/log", f"run/{half}")
    return _log_counts(I.read_log(spark, f"{path}/log"))


@query(
    "u6_all_models",
    scored_sql("""SELECT count(*) AS n, count(DISTINCT model) AS n_models, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct,
        round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy FROM scored"""),
)
def all_models(spark, d):
    path = O.append_log(_results(spark, d), shared_dir(spark, "u6"), "all", ("model",))
    log = I.read_log(spark, path)
    return log.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("n_models"), F.count_if("is_correct").alias("n_correct"),
        F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"),
    )


@query(
    "k3_metrics_csv",
    scored_sql("""SELECT model, regime, depth, count(*) AS n_total, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct,
        round(count(*) FILTER (is_correct) / count(*), 6) AS acc FROM scored GROUP BY ALL"""),
)
def metrics_csv(spark, d):
    acc = A.depth_accuracy(scored(spark, d)).select(
        "model", "regime", "depth", "n_total", "n_correct", "n_collapse", r6("acc").alias("acc"), "collapse_rate", "step_acc"
    )
    path = O.write_csv(acc, shared_dir(spark, "k3"), ["model", "regime", "depth"])
    back = spark.read.schema(S.ACCURACY_METRIC).option("header", True).csv(path)
    return back.select("model", "regime", "depth", "n_total", "n_correct", "acc")


# --- reports and exports --------------------------------------------------------------------------------------


def _variants(spark, d) -> DataFrame:
    rows = scored(spark, d).select(
        "model", F.when(F.col("regime") == "cot", "original").otherwise("enhanced").alias("variant"),
        F.col("is_correct").alias("correct"), F.lit(True).alias("evaluated"),
    )
    return A.variant_accuracy(rows, ("model", "variant"))


_VARIANT_SQL = """SELECT model, CASE regime WHEN 'cot' THEN 'original' ELSE 'enhanced' END AS variant,
        CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct, count(*) AS n_evaluated,
        round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy FROM scored GROUP BY ALL"""


@query("s10_payload_explode", scored_sql(_VARIANT_SQL))
def payload_explode(spark, d):
    path = O.write_report(_variants(spark, d), shared_dir(spark, "s10"))
    rows = I.read_payload(spark, path)
    return rows.select("model", "variant", "n_correct", "n_evaluated", r6("accuracy").alias("accuracy"))


_REPORT_SCHEMA = "original map<string, struct<accuracy: double, n_correct: long, n_evaluated: long>>"
_REPORT_SCHEMA += ", " + _REPORT_SCHEMA.replace("original", "enhanced")


@query("k6_report", scored_sql(_VARIANT_SQL))
def report(spark, d):
    """Every model's figures, read back from the one document of the report."""
    back = O.report(_variants(spark, d)).select(F.from_json("value", _REPORT_SCHEMA).alias("r"))
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"r.{v}").alias("models")) for v in ("original", "enhanced")])
    models = back.select(F.explode(variants).alias("v")).select("v.variant", F.explode("v.models").alias("model", "m"))
    return models.select("model", "variant", "m.n_correct", "m.n_evaluated", r6("m.accuracy").alias("accuracy"))


@query(
    "k7_distracted_export",
    with_views(PROBLEMS, POOLS, DISTRACTED, """SELECT source_file, question, answer, question_original, distractor, distractor_type
        FROM distracted"""),
)
def distracted_export(spark, d):
    rows = pools(spark, d).filter(F.size("dynamic_distractor_pool") > 0)
    path = O.write_json(I.distract(rows), shared_dir(spark, "k7"))
    back = spark.read.schema(S.DISTRACTED).json(path)
    return back.select("source_file", "question", "answer", "question_original", "distractor", "distractor_type")
