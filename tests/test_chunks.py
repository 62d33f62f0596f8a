"""Recorded chunk solutions: literal stories through the fold."""

import pytest

from tallymark.operators import chunks as K
from tallymark.operators import generate as G

SCHEMA = "problem_id STRING, gold DOUBLE, chunk_idx INT, attempt INT, clause_text STRING, response STRING"


def story(spark, *rows, gold=10.0, partitions=3):
    data = [("p", gold, c, a, clause, text) for c, a, clause, text in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return K.verify_solutions(K.nest_attempts(df, ["problem_id"], ["gold"])).first()


def test_names_carry_over(spark):
    r = story(
        spark,
        (0, 0, "Diana works 6 hours", "6 * 5 = 30"),
        (1, 0, "nothing named", "current_total - 4 = 26, diana_hours + 1 = 31"),
        (2, 0, "x", "current_total / 0 = 1"),
        gold=31.0,
    )
    logs = r.chunk_logs
    assert [g.chunk_value for g in logs[:2]] == [30.0, 31.0]
    assert logs[0].context_before == {} and logs[0].context_after == {"diana_hours": 30.0, "current_total": 30.0}
    assert logs[1].expressions_found == ["30.0 - 4 = 26", "30.0 + 1 = 31"]
    assert set(logs[1].context_after) == {"diana_hours", "step_2_result", "current_total"}
    # division by zero leaves no value: the last number of the raw response steps in
    assert logs[2].extraction_method == "emergency_fallback" and logs[2].chunk_value == 1.0
    assert r.unverified_fallbacks == 0


def test_double_count_beats_tag(spark):
    r = story(spark, (0, 0, "t", "6 * 5 = 30\n30 * 5 = 150\nANSWER: 150"), gold=30.0)
    assert (r.predicted, r.correct, r.total_expressions_checked) == ("30.0", True, 2)


def test_tag_beats_expressions(spark):
    r = story(spark, (0, 0, "t", "2 + 2 = 5\nANSWER: 7"), gold=7.0)
    assert (r.predicted, r.correct, r.corrections_applied) == ("7.0", True, 1)


def test_without_tag_the_chain_end_counts(spark):
    r = story(spark, (0, 0, "t", "2 + 3 = 5, 5 * 2 = 11, 100 + 1 = 101"))
    assert (r.predicted, r.correct) == ("10.0", True)


def test_retries(spark):
    r = story(spark, (0, 0, "t", "hm 4"), (0, 1, "t", "ANSWER: 10"), (0, 2, "t", "ANSWER: 99"))
    assert (r.predicted, r.chunk_logs[0].num_retries, r.chunk_logs[0].extraction_method) == ("10.0", 1, "arithmetic")
    r = story(spark, (0, 0, "t", "hm 4"), (0, 1, "t", "hm 5"), (0, 2, "t", "about 10"))
    assert (r.predicted, r.chunk_logs[0].num_retries, r.unverified_fallbacks) == ("10.0", 3, 1)
    r = story(spark, (0, 0, "t", "no"), (0, 1, "t", "idea"))
    assert (r.predicted, r.correct, r.extraction_failures) == (None, False, 1)


def test_failed_chunk_keeps_total(spark):
    r = story(spark, (0, 0, "t", "ANSWER: 10"), (1, 0, "t", "no idea"))
    assert (r.predicted, r.num_chunks, r.extraction_failures) == ("10.0", 2, 1)


def test_fold_does_not_depend_on_partitions(spark):
    rows = [(c, 0, "t", f"{c + 1} + {c} = {2 * c + 1}") for c in range(11)]
    a, b = (story(spark, *rows, partitions=n).asDict(recursive=True) for n in (1, 17))
    assert a == b
    assert [g["chunk_idx"] for g in a["chunk_logs"]] == list(range(11))


def test_planned_chunks(spark):
    df = spark.createDataFrame([("A has 1. B has 2. C has 3. How many?",)], "question STRING")
    planned = K.plan_chunks(df, size=2)
    assert (planned.first().num_clauses, len(planned.first().chunks)) == (4, 2)
    texts = [r.chunk_text for r in K.explode_chunks(planned).orderBy("chunk_idx").collect()]
    assert texts[0].startswith("1. A has 1.\n2. B has 2.\n3. Compute") and texts[1] == "1. C has 3.\n2. How many?"


def test_generated_problems(spark):
    grid = G.problem_grid(spark, list(range(1, 13)), 30)
    rows = G.generate_problems(grid, seed=42).collect()
    assert len(rows) == 360 and len({r.problem_id for r in rows}) == 360
    for r in rows:
        assert r.ground_truth > 0 and r.ground_truth == r.intermediate_values[-1]
        assert len(r.intermediate_values) == r.depth == len(r.operations)
        assert r.operations[0] == "multiply" and r.question.endswith("have in the end?")
    again = G.generate_problems(grid.repartition(17), seed=42).collect()
    assert {tuple(map(str, r)) for r in rows} == {tuple(map(str, r)) for r in again}
    assert {r.question for r in G.generate_problems(grid, seed=1).collect()} != {r.question for r in rows}


def test_generated_steps_follow_their_sentences(spark):
    grid = G.problem_grid(spark, [2], 120)
    changes = {"spends half": lambda v: v / 2, "spends a third": lambda v: v * 2 / 3, "spends a quarter": lambda v: v * 3 / 4,
               "doubles": lambda v: v * 2}
    seen = set()
    for r in G.generate_problems(grid).collect():
        for text, change in changes.items():
            if text in r.question:
                seen.add(text)
                assert r.ground_truth == pytest.approx(change(r.intermediate_values[0]))
    assert seen == set(changes)


def test_unread_logs_are_not_built(spark):
    row = [("p", 10.0, 0, 0, "t", "current_total + 1 = 2\nANSWER: 10")]
    nested = K.nest_attempts(spark.createDataFrame(row, SCHEMA), ["problem_id"], ["gold"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    results = K.verify_solutions(nested)
    assert "map_from_entries" in plan(results)
    assert "map_from_entries" not in plan(results.select("predicted", "correct", "corrections_applied", "unverified_fallbacks"))
    # a bound value is no transform of a one-element array, which copies and types its body again for each row
    assert "transform(array(" not in plan(results)


def test_guarded_patterns_find_what_they_found(spark):
    from pyspark.sql import functions as F

    from tallymark.functions import arithmetic as M
    from tallymark.functions import clauses as C
    from tallymark.functions import fixed as V

    units = ["hours", "minute", "Seconds", "days", "weeks", "months", "YEARS", "dollars", "cents", "euros", "rupees", "apples", "books", "miles",
             "cookies", "items", "pieces", "balls", "flowers", "coins", "marbles", "pencils", "stars", "tickets", "gallons", "points", "pounds"]
    texts = [(f"Ann: 3 \n{u} + 4 {u} = $7, ⟦x 8 {u}s ANSWER: 7",) for u in [*units, "answers", "oranges"]]
    df = spark.createDataFrame([*texts, (None,), ("",)], "t STRING")
    plain = F.regexp_replace(F.regexp_replace(F.translate("t", "$", ""), V.THOUSANDS, "$1$2"), V.UNIT_AFTER_DIGIT, "")
    noun = F.lower(F.regexp_extract("t", V.UNIT_NOUN, 1))
    rows = df.select(
        M.plain_arithmetic("t").eqNullSafe(plain).alias("plain"),
        F.when(noun != "", C.variable_name("t", F.lit(0)) == F.concat(F.lit("ann_"), noun)).alias("noun"),
    ).collect()
    assert all(r.plain and r.noun is not False for r in rows)
    assert sum(r.noun is True for r in rows) == 20


def test_written_out_verification_agrees_with_the_fold(spark):
    from pyspark.sql import functions as F

    from tallymark.functions import arithmetic as M

    texts = [
        "", "no numbers", "2 + 3 = 5", "6 * 5 = 30\n30 * 5 = 150", "6 * 5 = 31, 31 * 5 = 155, 155 * 5 = 775, 775 / 5 = 155",
        "2 * 2 = 4, 4 * 2 = 8, 8 * 2 = 16, 16 * 2 = 32", "1 / 0 = 4, 4 / 0 = 1", "3 ÷ 2 = 1.5; 1.5 × 2 = 3.0001", "1 + 1 = 2, 9 - 2 = 7, 2 + 5 = 7",
        "100 + 1 = 101, 2 + 3 = 5, 7 + 1 = 8", "1 + 2 * 3 = 9", "1 + 2 = 3 + 4 * 5 = 35, 35 - 1 = 34", "12.5.3 + 1 = 6.3", "1/2 + 3 = 4",
        ", ".join(f"{i} + 1 = {i + 1}" for i in range(M.FEW)), ", ".join(f"{i} * 2 = {i * 2}" for i in range(M.FEW + 3)),
        "0 * 5 = 0, 0 * 5 = 0, 0 * 5 = 1, 1 * 5 = 5", f"{'9' * 400} + 1 = 2",
    ]
    df = spark.createDataFrame([*[(t,) for t in texts], (None,)], "t STRING").select("*", M.readable("t").alias("plain"))
    nothing = F.array().cast(M.EXPRESSIONS)
    expected = M.verify(F.coalesce(M.expressions_of_plain(F.col("plain")), nothing))
    rows = M.with_verified(df, "plain").select("*", expected.alias("want"), M.chain_terminal(expected, F.lit(None).cast("double")).alias("end"))
    for total in (None, 2.0, 4.0, 7.0, 31.0, 100.0):
        t = F.lit(total).cast("double")
        found = rows.select("t", "log", "want", "terminal", "end", M.terminal_with_total(F.col("log"), F.col("terminal"), t).alias("a"), M.chain_terminal("log", t).alias("b")).collect()
        for r in found:
            assert str(r.log) == str(r.want), r.t
            assert r.terminal is None or (r.terminal, r.a) == (r.end, r.b), (r.t, total)
    assert {r.t for r in found if r.terminal is None} == {t for t in texts if t.startswith(("1 + 2 ", "1/2")) or len(t) > 60 and "0 * 2" in t}


def test_names_are_read_in_long_and_late_attempts(spark):
    sums = ", ".join(f"current_total + {i} = {10 + i}" for i in range(6))
    r = story(spark, (0, 0, "t", "ANSWER: 10"), (1, 0, "t", "no idea"), (1, 1, "t", sums), (2, 0, "t", "step_2_result - 15 = 0"), gold=0.0)
    assert [g.chunk_value for g in r.chunk_logs] == [10.0, 15.0, 0.0]
    assert r.chunk_logs[1].num_retries == 1 and r.chunk_logs[1].expressions_found[5] == "10.0 + 5 = 15"
    assert (r.correct, r.total_expressions_checked, r.corrections_applied) == (True, 7, 0)
    assert set(r.chunk_logs[2].context_before) == {"step_1_result", "step_2_result", "current_total"}


def test_queries_build_contexts_only_where_they_read_them(spark, sf_dir):
    from tallymark.plans import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan("x37_context_update")
    for name in ("w3_double_count_lookback", "a27_log_rollup", "a23_corrections_table"):
        assert "map_from_entries" not in plan(name) and "names_before" not in plan(name)
