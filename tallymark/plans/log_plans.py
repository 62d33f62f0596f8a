"""Queries over result logs: resume, caches, running figures, first rows, streaming jobs, response hook."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as T
from ..operators import logs as J
from ..operators import scoring as P
from ..operators.respond import respond
from ..session import shared_dir
from ..sources.sinks import append_bucketed
from ..streaming import incremental as R
from .derived import ORDERS, PER_SPLIT, PROBLEMS, RESPONSES, problems, problems_of, responses, responses_of, scored_sql, with_views
from .registry import query, table

KEYS = ["model", "regime", "problem_id"]


# --- resume and caches ------------------------------------------------------------------------------------


_RESUME = """SELECT model, regime, count(*) AS n_pending, min(problem_id) AS first_id
        FROM responses r WHERE NOT EXISTS (SELECT 1 FROM responses d WHERE d.h IN (1, 4, 8)
          AND d.model = r.model AND d.regime = r.regime AND d.problem_id = r.problem_id) GROUP BY ALL"""


def _pending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("model", "regime").agg(F.count(F.lit(1)).alias("n_pending"), F.min("problem_id").alias("first_id"))


@query("j1_resume", with_views(PROBLEMS, RESPONSES, _RESUME))
def resume(spark, d):
    planned = responses(spark, d).select(*KEYS, "h")
    done = planned.filter(F.col("h").isin(1, 4, 8))
    return _pending_summary(J.pending(planned, done, KEYS))


BUCKETS = 16


@query("j1_resume_bucketed", with_views(PROBLEMS, RESPONSES, _RESUME))
def resume_bucketed(spark, d):
    """The log in buckets, written by two runs; the resumed run reads it in place."""
    planned = responses(spark, d).select(*KEYS, "h")
    name, path = f"result_log_{uuid.uuid4().hex}", shared_dir(spark, "result_log")
    for run in ([1, 4], [8]):
        append_bucketed(planned.filter(F.col("h").isin(run)).select(*KEYS), name, KEYS, BUCKETS, path)
    return _pending_summary(J.pending(planned, spark.table(name), KEYS))


@query(
    "j2_skip_processed",
    with_views(PROBLEMS, """SELECT problem_id || '.json' AS source_file, depth FROM problems
        WHERE problem_id NOT IN (SELECT 'p' || l_orderkey FROM lineitem)"""),
)
def skip_processed(spark, d):
    inputs = problems(spark, d).select(F.expr("problem_id || '.json'").alias("source_file"), "depth")
    outputs = table(spark, d, "lineitem").select(F.expr("'p' || l_orderkey || '.json'").alias("source_file"))
    return J.pending(inputs, outputs, ["source_file"])


ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def write_log(spark, d) -> DataFrame:
    """Line items as a log of cache writes: the same id is written several times."""
    return table(spark, d, "lineitem").select("l_orderkey", *ORDER)


_LATEST = f"""
latest AS (
  SELECT l_orderkey, l_partkey, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(f"{c} DESC" for c in ORDER)}) AS r FROM lineitem)
  WHERE r = 1
)"""


@query("w7_latest_per_id", with_views(_LATEST, "SELECT * FROM latest"))
def latest_per_id(spark, d):
    return J.latest(write_log(spark, d), ["l_orderkey"], ORDER).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "j3_filter_cache",
    with_views(PROBLEMS, _LATEST, """SELECT depth, CAST(count(l_orderkey) AS BIGINT) AS n_cached,
        CAST(count(*) FILTER (l_orderkey IS NULL) AS BIGINT) AS n_pending, CAST(sum(l_partkey) AS BIGINT) AS part_sum
        FROM problems LEFT JOIN latest ON l_orderkey = k GROUP BY depth"""),
)
def filter_cache(spark, d):
    examples = problems(spark, d).select(F.col("k").alias("l_orderkey"), "depth")
    cached, todo = J.serve_from_cache(examples, write_log(spark, d), ["l_orderkey"], ORDER)
    both = cached.select("depth", "l_partkey", F.lit(True).alias("hit")).unionByName(
        todo.select("depth", F.lit(None).cast("bigint").alias("l_partkey"), F.lit(False).alias("hit"))
    )
    return both.groupBy("depth").agg(
        F.count_if("hit").alias("n_cached"), F.count_if(~F.col("hit")).alias("n_pending"), F.sum("l_partkey").alias("part_sum")
    )


@query(
    "w1_running_accuracy",
    """SELECT event_type, event_id, row_no, running_correct, running_corrections, round(running_correct / row_no, 6) AS acc
       FROM (SELECT event_type, event_id, count(*) OVER w AS row_no, CAST(sum((value >= 50)::INT) OVER w AS BIGINT) AS running_correct,
                    CAST(sum(event_id % 3) OVER w AS BIGINT) AS running_corrections FROM events
             WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE row_no % 50 = 0""",
)
def running_accuracy(spark, d):
    log = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    totals = {"correct": (F.col("value") >= 50).cast("bigint"), "corrections": F.col("event_id") % 3}
    out = J.running_totals(log, "event_type", ["ts", "event_id"], totals, every=50)
    return out.drop("ts").withColumn("acc", F.round(F.col("running_correct") / F.col("row_no"), 6))


# --- first rows -------------------------------------------------------------------------------------------


@query(
    "t2_first_per_depth",
    with_views(PROBLEMS, """SELECT depth, problem_id FROM (
        SELECT *, row_number() OVER (PARTITION BY depth ORDER BY problem_id) AS r FROM problems) WHERE r <= 20"""),
)
def first_per_depth(spark, d):
    return J.first_per_group(problems(spark, d).select("depth", "problem_id"), "depth", ["problem_id"], 20)


@query("t3_first_rows", with_views(PROBLEMS, "SELECT problem_id, depth FROM problems ORDER BY problem_id LIMIT 25"))
def first_rows(spark, d):
    return J.first_rows(problems(spark, d).select("problem_id", "depth"), ["problem_id"], 25)


@query(
    "t6_deepest_sample",
    with_views(PROBLEMS, "SELECT problem_id, gold FROM problems WHERE depth = 8 ORDER BY problem_id LIMIT 3"),
)
def deepest_sample(spark, d):
    deep = problems(spark, d).filter(F.col("depth") == 8).select("problem_id", "gold")
    return J.first_rows(deep, ["problem_id"], 3)


# --- streaming --------------------------------------------------------------------------------------------


def _stream(spark, d, name: str, *columns: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return R.stream_files(spark, d, schema, "parquet", glob=f"{name}.parquet").select(*columns)


def _recorded(spark, orders: DataFrame) -> DataFrame:
    """Log records as the scorer reads them: keys, depth, gold values and the response, not the text of the problem."""
    # a thin stream whose rows are costly to process: use all cores, in small tasks
    tasks = PER_SPLIT * spark.sparkContext.defaultParallelism // 2
    return responses_of(problems_of(orders.repartition(tasks, *ORDERS))).select(*KEYS, "k", "depth", "gold", "vals", "response")


def _score(df: DataFrame) -> DataFrame:
    return P.score_depth_log(df, gold="gold", expected="vals")


PARTS = 3


def _log_part(spark, d, part: int) -> DataFrame:
    """Orders of one part of the log: every third key, and again every fifth key of the part before."""
    key = F.col("o_orderkey")
    again = (key % PARTS == part - 1) & (key % 5 == 0)
    return table(spark, d, "orders").select(*ORDERS).filter((key % PARTS == part) | again)


def _append_part(spark, d, part: int, path: str) -> None:
    _log_part(spark, d, part).coalesce(1).write.mode("append").parquet(path)


def _score_log(spark, d, path: str, files_per_trigger: int | None = None) -> str:
    schema = table(spark, d, "orders").select(*ORDERS).schema
    log = R.stream_files(spark, f"{path}/log", schema, "parquet", files_per_trigger=files_per_trigger)
    R.score_incrementally(_recorded(spark, log), _score, KEYS, f"{path}/scored", f"{path}/checkpoint").awaitTermination()
    return f"{path}/scored"


@query(
    "r1_incremental_scoring",
    scored_sql("""SELECT model, regime, depth, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct,
        CAST(sum(first_error_step) AS BIGINT) AS error_steps FROM scored GROUP BY ALL"""),
)
def incremental_scoring(spark, d):
    # a file is a batch; some keys come again in a later one and must be scored once
    path = shared_dir(spark, "r1")
    for part in range(PARTS):
        _append_part(spark, d, part, f"{path}/log")
    return spark.read.parquet(_score_log(spark, d, path, files_per_trigger=1)).groupBy("model", "regime", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"), F.sum("first_error_step").alias("error_steps")
    )


@query(
    "k5_numbered_snapshots",
    scored_sql("""SELECT *, CAST(sum(n) OVER (PARTITION BY snapshot) AS BIGINT) AS n_rows FROM (
        SELECT CAST(part AS BIGINT) AS snapshot, model, regime, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS n_correct
        FROM scored, (VALUES (0), (1), (2)) v(part) WHERE k % 3 <= part GROUP BY part, model, regime)"""),
)
def numbered_snapshots(spark, d):
    """The scored table as of each snapshot: a run of the job for every part of the log, each going on from the checkpoint."""
    path = shared_dir(spark, "k5")
    for part in range(PARTS):
        _append_part(spark, d, part, f"{path}/log")
        scored = _score_log(spark, d, path)
    taken = R.snapshots(spark, scored).select("snapshot", "n_rows")
    cells = [
        R.read_snapshot(spark, scored, n)
        .groupBy("model", "regime")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"))
        .withColumn("snapshot", F.lit(n).cast("bigint"))
        for n in range(PARTS)
    ]
    return reduce(DataFrame.unionByName, cells).join(taken, "snapshot")


@query(
    "r2_maintained_accuracy",
    scored_sql("SELECT model, regime, depth, count(*) AS n, CAST(count(*) FILTER (is_correct) AS BIGINT) AS k FROM scored GROUP BY ALL"),
)
def maintained_accuracy(spark, d):
    path, by = shared_dir(spark, "r2"), ["model", "regime", "depth"]
    R.maintain_counts(_score(_recorded(spark, _stream(spark, d, "orders", *ORDERS))), by, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return R.read_counts(spark, f"{path}/counts", by)


@query("r3_cache_upsert", with_views(_LATEST, "SELECT * FROM latest"))
def cache_upsert(spark, d):
    path = shared_dir(spark, "r3")
    updates = _stream(spark, d, "lineitem", "l_orderkey", *ORDER)
    R.upsert_cache(updates, ["l_orderkey"], ORDER, f"{path}/cache", f"{path}/checkpoint").awaitTermination()
    return R.read_cache(spark, f"{path}/cache", ["l_orderkey"], ORDER).select("l_orderkey", "l_partkey", "l_quantity")


# --- response hook ----------------------------------------------------------------------------------------


def last_number_responder(prompts, systems, temperature):
    """Rule-based stand-in for a model: answers with the last number of the prompt."""
    return ["Answer: " + re.findall(r"\d+", p)[-1] for p in prompts]


@query(
    "f1_response_hook",
    with_views(PROBLEMS, r"""SELECT problem_id, 'Answer: ' || regexp_extract_all(question, '\d+')[-1] AS response,
        CAST(regexp_extract_all(question, '\d+')[-1] AS DOUBLE) AS predicted FROM problems"""),
)
def response_hook(spark, d):
    from ..functions.answers import reported_answer

    prompts = problems(spark, d).select(
        "problem_id", T.cot_prompt("question").alias("user_prompt"), T.system_prompt(F.lit("cot")).alias("system_prompt")
    )
    answered = respond(prompts, last_number_responder)
    return answered.select("problem_id", "response", reported_answer("response").alias("predicted"))
