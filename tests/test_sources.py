"""Readers, writers and streaming jobs on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallymark import schemas as S
from tallymark.operators import metrics as A
from tallymark.operators.logs import latest, pending
from tallymark.operators.respond import respond
from tallymark.session import shared_dir, spread
from tallymark.sources import json_tables as I
from tallymark.sources import sinks as O
from tallymark.streaming import incremental as R
from tallymark.streaming.runs import FAN, Runs


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=2), encoding="utf-8")


def test_templates(spark, tmp_path):
    base = {"id_orig": 1, "id_shuffled": 2, "question_annotated": "q", "answer_annotated": "a"}
    put(tmp_path, "0000.json", {"question": "A. B?", "answer": "#### 1", **base})
    put(tmp_path, "0001.json", {"question": "", "answer": "#### 1", **base})
    put(tmp_path, "0002.json", {"question": "x", **base})
    rows = I.read_templates(spark, str(tmp_path)).collect()
    assert [(r.source_file, r.id_orig, r.question) for r in rows] == [("0000.json", 1, "A. B?")]


def test_pools_of_objects_and_texts(spark, tmp_path):
    put(tmp_path, "a.json", {"question": "One. Two?", "answer": "#### 1", "dynamic_distractor_pool": [{"type": "TYPE_A", "text": "Sky is blue."}]})
    put(tmp_path, "b.json", {"question": "One. Two?", "answer": "#### 1", "dynamic_distractor_pool": ["bare text"]})
    put(tmp_path, "c.json", {"question": "One. Two?", "answer": "#### 1", "dynamic_distractor_pool": []})
    put(tmp_path, "d.json", {"question": "One. Two?", "answer": "#### 1"})
    rows = {r.source_file: r for r in I.read_distracted(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.json", "b.json"}
    assert (rows["a.json"].distractor_type, rows["a.json"].question) == ("TYPE_A", "One. Sky is blue. Two?")
    assert (rows["b.json"].distractor_type, rows["b.json"].question) == ("UNKNOWN", "One. bare text. Two?")


def test_dataset_formats(spark, tmp_path):
    rows = [{"problem_id": "p1", "depth": 1, "ground_truth": 2}, {"problem_id": "p2", "depth": 2, "ground_truth": 3.5}]
    put(tmp_path, "x.json", rows)
    put(tmp_path, "x.jsonl", "\n".join(json.dumps(r) for r in rows) + "\n\n")
    a, b = (I.read_dataset(spark, str(tmp_path / n), S.MATH_PROBLEM).orderBy("problem_id").collect() for n in ("x.json", "x.jsonl"))
    assert a == b and [r.ground_truth for r in a] == [2.0, 3.5]


LINE = {"model": "m", "regime": "cot", "problem_id": "p", "depth": 2, "is_correct": True}


def test_logs(spark, tmp_path):
    put(tmp_path, "m_cot.jsonl", json.dumps(LINE) + "\n\n{bad\n" + json.dumps({**LINE, "regime": None}) + "\n")
    assert I.read_log(spark, str(tmp_path)).count() == 2
    assert [tuple(r) for r in I.read_method_log(spark, str(tmp_path)).collect()] == [("m", "cot", 2, True)]
    with pytest.raises(Exception, match="(?i)malformed"):
        I.read_log_strict(spark, str(tmp_path), S.DEPTH_RESULT).collect()
    put(tmp_path / "none", "m_cot.jsonl", "\n")
    with pytest.raises(FileNotFoundError):
        I.read_log(spark, str(tmp_path / "none"))


def test_qa_log_takes_model_from_name(spark, tmp_path):
    put(tmp_path, "some_model_cot.jsonl", json.dumps({"problem_id": "p", "is_correct": True}) + "\n" + json.dumps({"problem_id": "q"}))
    put(tmp_path, "other.jsonl", json.dumps({"problem_id": "z", "is_correct": True}))
    assert [tuple(r) for r in I.read_qa_log(spark, str(tmp_path)).collect()] == [("some_model", "cot", "p", 0, True)]


def test_chunk_results_ignore_snapshots(spark, tmp_path):
    rows = [{"id": 0, "correct": True, "depth": 3, "corrections_applied": 1}, {"id": 1, "correct": False, "estimated_steps": 4}]
    put(tmp_path / "seed_7", "exp4_chunked_my_model.json", rows)
    put(tmp_path / "seed_7", "exp4_chunked_my_model_ckpt_50.json", rows)
    got = I.read_chunk_results(spark, str(tmp_path / "seed_*")).orderBy("problem_id").collect()
    assert [(r.seed, r.model, r.problem_id, r.depth, r.corrections_applied, r.num_chunks) for r in got] == [
        ("seed_7", "my_model", "0", 3, 1, 0), ("seed_7", "my_model", "1", 4, 0, 0)]


def test_seed_directories(spark, tmp_path):
    for seed in ("seed_1", "seed_2"):
        put(tmp_path / seed, "m_cot.jsonl", json.dumps(LINE))
    put(tmp_path / "other", "m_cot.jsonl", json.dumps(LINE))
    assert sorted(r.seed for r in I.read_seed_logs(spark, str(tmp_path)).collect()) == ["seed_1", "seed_2"]


def test_report_round_trip(spark, tmp_path):
    metric = spark.createDataFrame([("m", v, 1, 2, 0, 0.5) for v in ("original", "enhanced")],
                                   "model STRING, variant STRING, n_correct LONG, n_evaluated LONG, n_skipped_no_gold LONG, accuracy DOUBLE")
    path = O.write_report(metric, str(tmp_path / "r"), {"seed": F.lit(42)})
    assert {(r.variant, r.model, r.accuracy) for r in I.read_payload(spark, path).collect()} == {("original", "m", 0.5), ("enhanced", "m", 0.5)}
    put(tmp_path, "half.json", {"original": {"m": {"accuracy": 1.0}}})
    with pytest.raises(Exception, match="lacks the block"):
        I.read_payload(spark, str(tmp_path / "half.json")).collect()


def test_depth_partitions_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", i % 4 + 1) for i in range(40)], "problem_id STRING, depth INT")
    path = O.write_by_depth(df, str(tmp_path / "d"))
    out = I.read_depths(spark, path, [2, 3], 4)
    assert [(r.depth, r.n) for r in out.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()] == [(2, 4), (3, 4)]
    assert "PartitionFilters: [isnotnull(depth" in out._jdf.queryExecution().toString() or "depth#" in str(out._jdf.queryExecution())


def test_prepared_problems(spark):
    df = spark.createDataFrame([(0, "q", "<<1+1=2>>2 <<2+1=3>>\n#### 3"), (1, "q", "none"), (2, "q", "#### 4")], "idx INT, question STRING, answer STRING")
    assert [(r.problem_id, r.estimated_steps) for r in I.prepare_qa(df, min_steps=2).collect()] == [("gsm8k_0000", 2)]
    assert I.prepare_qa(df, min_steps=None).count() == 2


LOG_SCHEMA = "problem_id STRING, response STRING, ts TIMESTAMP"


def add_batch(folder, name, rows):
    put(folder, name, "\n".join(json.dumps({"problem_id": p, "response": r, "ts": t}) for p, r, t in rows))


def as_answer(df):
    from tallymark.functions.answers import reported_answer

    return df.withColumn("predicted", reported_answer("response"))


def test_each_key_is_scored_once_across_restarts(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name, rows in (("1.json", [("a", "Answer: 1", "2024-01-01"), ("a", "Answer: 1", "2024-01-01")]),
                       ("2.json", [("a", "Answer: 1", "2024-01-01"), ("b", "Answer: 2", "2024-01-02")])):
        add_batch(log, name, rows)
        stream = R.stream_files(spark, str(log), LOG_SCHEMA)
        R.score_incrementally(stream, as_answer, ["problem_id"], out, ckpt).awaitTermination()
    assert sorted((r.problem_id, r.predicted) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 2.0)]


def test_event_time_bounds_the_memory(spark, tmp_path):
    add_batch(tmp_path / "log", "1.json", [("a", "5", "2024-01-01"), ("a", "5", "2024-01-01"), ("b", "6", "2024-01-01")])
    stream = R.stream_files(spark, str(tmp_path / "log"), LOG_SCHEMA)
    out = str(tmp_path / "out")
    R.score_incrementally(stream, as_answer, ["problem_id"], out, str(tmp_path / "ckpt"), "ts").awaitTermination()
    assert sorted(r.predicted for r in spark.read.parquet(out).collect()) == [5.0, 6.0]


def test_maintained_counts(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name, rows in (("1.json", [("a", "1", "2024-01-01"), ("b", "1", "2024-01-01")]), ("2.json", [("a", "2", "2024-01-01")])):
        add_batch(log, name, rows)
        stream = as_answer(R.stream_files(spark, str(log), LOG_SCHEMA)).withColumn("is_correct", F.col("predicted") == 1)
        R.maintain_counts(stream, ["problem_id"], out, ckpt).awaitTermination()
    assert sorted(tuple(r) for r in R.read_counts(spark, out, ["problem_id"]).collect()) == [("a", 2, 1), ("b", 1, 1)]


def test_cache_upsert(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name, rows in (("1.json", [("a", "old", "2024-01-01"), ("b", "x", "2024-01-01")]), ("2.json", [("a", "new", "2024-01-03")])):
        add_batch(log, name, rows)
        R.upsert_cache(R.stream_files(spark, str(log), LOG_SCHEMA), ["problem_id"], ["ts"], out, ckpt).awaitTermination()
    cache = R.read_cache(spark, out, ["problem_id"], ["ts"])
    assert sorted((r.problem_id, r.response) for r in cache.collect()) == [("a", "new"), ("b", "x")]


def test_response_hook_records_failures(spark):
    df = spark.createDataFrame([("q1", "s"), ("q2", "s")], "user_prompt STRING, system_prompt STRING")
    assert sorted(r.response for r in respond(df, lambda p, s, t: [x.upper() for x in p]).collect()) == ["Q1", "Q2"]

    def broken(prompts, systems, temperature):
        raise RuntimeError("503")

    assert {r.response for r in respond(df, broken).collect()} == {"[ERROR: 503]"}


def test_shared_dir_and_spread(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path.startswith(root or "/tmp/run-")
    assert path != shared_dir(spark, "x")
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3


def test_spread_deals_a_split_to_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spread(spark.range(1000, numPartitions=cores + 3), "id", per_split=4)
    assert wide.rdd.getNumPartitions() == 4 * (cores + 3)
    assert wide.count() == 1000 and wide.distinct().count() == 1000


def test_problems_run_in_small_tasks(spark, sf_dir):
    from tallymark.plans.derived import PER_SPLIT, problems

    assert problems(spark, sf_dir).rdd.getNumPartitions() >= PER_SPLIT


def test_json_logs_are_small_gzip_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_FILE", 100)
    rows = spark.range(1000, numPartitions=2).selectExpr("concat('p', id) AS problem_id", "'m' AS model", "'cot' AS regime", "repeat('Answer: 1 ', 20) AS response")
    path, log = O.write_json(rows, str(tmp_path / "set")), O.append_log(rows, str(tmp_path / "log"), "b")
    files = [f for f in (tmp_path / "set").rglob("part-*")]
    assert len(files) == 10 and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 50_000  # 250 kB as plain lines
    want = {f"p{i}" for i in range(1000)}
    for back in (I.read_log(spark, path), I.read_log_strict(spark, path, S.DEPTH_RESULT), I.read_log(spark, log)):
        assert back.count() == 1000 and {r.problem_id for r in back.collect()} == want


@pytest.mark.parametrize("name", ["s5_lenient_log", "s5_reject_counts"])
def test_lenient_logs_are_small_gzip_files(spark, tmp_path, monkeypatch, name):
    from tallymark.plans import QUERIES, file_plans

    monkeypatch.setattr(file_plans, "shared_dir", lambda _, folder: str(tmp_path / folder))
    monkeypatch.setattr(O, "ROWS_PER_FILE", 1000)
    orders = spark.range(2000, numPartitions=1).selectExpr("id AS o_orderkey", "id % 97 AS o_custkey", "cast(id * 3 AS double) AS o_totalprice")
    orders.write.parquet(str(tmp_path / "in" / "orders.parquet"))
    counts = QUERIES[name](spark, str(tmp_path / "in")).collect()
    # a tenth of the lines is blank, a tenth is cut off
    n = {r.reason: r.n for r in counts} if name == "s5_reject_counts" else {"lines": sum(r.n for r in counts) * 10 // 8}
    assert n["lines"] == 12_000 and n.get("blank", 1200) == n.get("not_json", 1200) == 1200
    files = [*tmp_path.rglob("part-*.txt*")]
    lines = [len(gzip.open(f).read().split(b"\n")) - 1 for f in files if f.suffix == ".gz"]
    assert len(lines) == len(files) and max(lines) <= 1000
    assert sum(lines) == 12_000


def test_log_of_the_stream_is_narrow(spark, sf_dir):
    from tallymark.plans.log_plans import _recorded, table

    log = _recorded(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    assert "question" not in log.columns and {"model", "regime", "problem_id", "response", "gold", "vals"} <= set(log.columns)


def test_metric_csv(spark, tmp_path):
    acc = A.dense_grid(spark.createDataFrame([("m", 1, 0.5)], "model STRING, depth INT, acc DOUBLE"), [1, 2])
    path = O.write_csv(acc, str(tmp_path / "csv"), ["depth"])
    back = spark.read.option("header", True).schema("model STRING, depth INT, acc DOUBLE").csv(path)
    assert [tuple(r) for r in back.collect()] == [("m", 1, 0.5), ("m", 2, 0.0)]


def test_late_keys_are_scored(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name, rows in (("1.json", [("a", "1", "2024-01-09")]), ("2.json", [("c", "3", "2024-02-01"), ("a", "1", "2024-01-09")]), ("3.json", [("b", "2", "2024-01-01")])):
        add_batch(log, name, rows)
        R.score_incrementally(R.stream_files(spark, str(log), LOG_SCHEMA), as_answer, ["problem_id"], out, ckpt, "ts").awaitTermination()
    assert sorted(r.problem_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_log_values_are_cast_and_rows_do_not_depend_on_columns(spark, tmp_path):
    lines = [
        '{"model": "m", "regime": "cot", "depth": 3, "is_correct": true}',
        '{"model": "m", "regime": "cot", "depth": 3.0, "is_correct": 1}',
        '{"model": "m", "regime": "cot", "depth": "3", "is_correct": 0}',
        '{"model": "m", "regime": "cot", "depth": "x", "is_correct": false}',
        '{"model": "m", "regime": "co',
        "",
        "[]",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = I.read_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == len(log.collect()) == log.select("model").count() == 4
    got = I.read_method_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r.depth, r.correct) for r in got.collect()) == [(3, False), (3, True), (3, True)]


def test_log_laid_out_by_columns_keeps_them(spark, tmp_path):
    rows = [("7", "cot", "p1", 2, True), ("a b/c%+é", "direct", "p2", 3, False), (None, "cot", "p3", 1, True)]
    df = spark.createDataFrame(rows, "model STRING, regime STRING, problem_id STRING, depth INT, is_correct BOOLEAN")
    path = str(tmp_path / "log")
    for _ in range(2):  # the same append twice adds nothing
        O.append_log(df, path, "first/1")
    got = I.read_log(spark, path).select("model", "regime", "problem_id", "depth", "is_correct").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert sorted(tuple(r) for r in I.read_method_log(spark, path).collect()) == [("7", "cot", 2, True), ("a b/c%+é", "direct", 3, False)]
    O.append_log(df.limit(1), path, "second")
    assert I.read_log(spark, path).count() == 4


def test_append_that_failed_halfway_is_not_read_and_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([("m", "cot", "p1"), ("m", "cot", "p2")], "model STRING, regime STRING, problem_id STRING")
    path = str(tmp_path / "log")
    O.append_log(df.limit(1), path, "a")
    # rows of a batch that never came to its commit
    df.write.partitionBy("model", "regime").json(f"{path}/batch=b")
    assert I.read_log(spark, path).count() == 1
    O.append_log(df, path, "b")
    assert I.read_log(spark, path).count() == 3


def test_partitioned_runs_keep_model_and_seed(spark, tmp_path):
    df = spark.createDataFrame([("m_1", "seed_4", "p1", True), ("x", "seed_5", "p2", False)], "model STRING, seed STRING, problem_id STRING, is_correct BOOLEAN")
    O.write_json(df.withColumn("log", F.concat("model", F.lit("_cot.jsonl"))).drop("model", "seed"), str(tmp_path / "q"), ["log"])
    assert sorted(r.model for r in I.read_qa_log(spark, str(tmp_path / "q")).collect()) == ["m_1", "x"]
    O.write_json(df.withColumnRenamed("seed", "seed_run"), str(tmp_path / "s"), ["seed_run", "model"])
    assert sorted((r.seed, r.model) for r in I.read_seed_logs(spark, str(tmp_path / "s")).collect()) == [("seed_4", "m_1"), ("seed_5", "x")]


def test_documents_hold_bounded_arrays(spark, tmp_path):
    df = spark.range(25, numPartitions=2).selectExpr("concat('q', id) AS question", "concat('#### ', id) AS answer")
    path = O.write_documents(df, str(tmp_path / "docs"), per_file=5)
    files = list((tmp_path / "docs").glob("*.txt"))
    assert len(files) == 6 and all(len(json.loads(f.read_text())) <= 5 for f in files)
    assert sorted(r.answer for r in I.read_templates(spark, path, "*.txt").collect()) == sorted(f"#### {k}" for k in range(25))


def test_runs_stay_few_and_hold_the_latest(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), ("k",), lambda rows: latest(rows, ["k"], ["t"]), buckets=2)
    assert runs.read() is None
    n = FAN * FAN + 2
    for batch in range(n):
        runs.add(spark.createDataFrame([(k, batch, f"v{batch}") for k in (None, 1, 2)], "k INT, t INT, v STRING"), batch)
    live = runs.newest().runs
    # sixteen batches are one run of the second level by now, the last two are their own
    assert sorted(live) == [f"L0-{n - 2}", f"L0-{n - 1}", f"L2-{FAN * FAN - 1}"]
    assert runs.read().count() == 3 * len(live)
    assert sorted((str(r.k), r.t, r.v) for r in latest(runs.read(), ["k"], ["t"]).collect()) == [(k, n - 1, f"v{n - 1}") for k in ("1", "2", "None")]
    # a batch that runs again gives the same version; a reader may ask for the state before it
    runs.add(spark.createDataFrame([(k, n - 1, "again") for k in (1,)], "k INT, t INT, v STRING"), n - 1)
    assert sorted(runs.newest().runs) == sorted(live)
    assert {r.t for r in latest(runs.read(runs.newest(before=n - 1)), ["k"], ["t"]).collect()} == {n - 2}
    mine = runs.read(buckets=[0])
    assert "PartitionFilters: [isnotnull(_bucket" in mine._jdf.queryExecution().executedPlan().toString()
    assert mine.count() + runs.read(buckets=[1]).count() == runs.read().count()


def test_batches_replay_and_snapshots_are_numbered(spark, tmp_path):
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), tmp_path / "ckpt"
    parts = ([("a", "Answer: 1", "2024-01-01"), (None, "4", "2024-01-01")], [("a", "Answer: 9", "2024-01-01"), ("b", "Answer: 2", "2024-01-02"), (None, "5", "2024-01-03")],
             [("c", "3", "2024-01-01"), ("b", "Answer: 7", "2024-01-01")])
    for k, rows in enumerate(parts):
        add_batch(log, f"{k}.json", rows)

        def go():
            stream = R.stream_files(spark, str(log), LOG_SCHEMA)
            R.score_incrementally(stream, as_answer, ["problem_id"], out, str(ckpt), "ts").awaitTermination()

        go()
    want = [("None", 4.0), ("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert sorted((str(r.problem_id), r.predicted) for r in R.read_snapshot(spark, out).collect()) == want
    # the last batch fails before its commit and runs again
    (ckpt / "commits" / "2").unlink()
    (ckpt / "commits" / ".2.crc").unlink(missing_ok=True)
    go()
    assert sorted((str(r.problem_id), r.predicted) for r in R.read_snapshot(spark, out).collect()) == want
    assert sorted(map(tuple, R.snapshots(spark, out).select("snapshot", "n_new", "n_rows").collect())) == [(0, 2, 2), (1, 1, 3), (2, 1, 4)]
    assert R.read_snapshot(spark, out, 1).count() == 3 and R.read_snapshot(spark, out, 0).count() == 2


def test_streamed_log_has_the_casts_of_the_reader(spark, tmp_path):
    (tmp_path / "log" / "model=7").mkdir(parents=True)
    lines = ['{"problem_id": "a", "depth": 3.0, "is_correct": 1}', '{"problem_id": "b", "depth": "3", "is_correct": true}', "{bad", ""]
    (tmp_path / "log" / "model=7" / "x.json").write_text("\n".join(lines))
    stream = R.stream_log(spark, str(tmp_path / "log")).select("model", "problem_id", "depth", "is_correct")
    R.score_incrementally(stream, lambda df: df, ["problem_id"], str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(tuple(r) for r in R.read_snapshot(spark, str(tmp_path / "out")).collect()) == [("7", "a", 3, True), ("7", "b", 3, True)]


def test_bucketed_log_grows_and_pending_rows_are_whole(spark, tmp_path):
    name, keys = "test_result_log", ["model", "problem_id"]
    planned = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('m', id % 7)) AS model", "concat('p', id) AS problem_id", "id")
    runs = [planned.filter("id % 4 = 0"), planned.filter("id % 4 = 1"), planned.filter("id % 100 = 0"), planned.limit(0)]
    try:
        for run in runs:  # the third repeats keys of the first, the last is empty
            O.append_bucketed(run.select(*keys), name, keys, 4, str(tmp_path / "log"))
        assert spark.table(name).count() == sum(r.count() for r in runs)
        strange = spark.createDataFrame([(None, "p0", -1), ("hot", None, -2)], "model STRING, problem_id STRING, id LONG")
        got = pending(planned.unionByName(strange), spark.table(name), keys)
        assert sorted(r.id for r in got.collect()) == [-2, -1, *(i for i in range(3000) if i % 4 > 1)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
