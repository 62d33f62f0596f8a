"""Problem and response tables derived from the given tables, for Spark and as SQL.

The given tables hold no arithmetic texts. Problems are derived row by row from `orders` (no shuffle, one
problem per order, unique id), responses from problems by exploding a fixed list of models and regimes.
Everything is written with integers, so both engines produce the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .registry import table

ORDERS = ("o_orderkey", "o_custkey", "o_totalprice")
#: A row of orders becomes up to six texts, so a split of them is dealt to so many tasks.
PER_SPLIT = 16

NL = "chr(10)"
BS = "chr(92)"

MODELS = ["m0", "m1", "m2"]
REGIMES = ["direct", "cot"]
SEEDS = ["seed_42", "seed_123", "seed_456"]

# Integer arithmetic and text shared by both dialects.
_QUANTITY = "1 + ({price} {div} i + o_custkey * i) % 50"
_HASH = "(k * 13 + model_idx * 7 + regime_idx * 5) % 20"
_SEED = "'seed_' || CASE k % 3 WHEN 0 THEN '42' WHEN 1 THEN '123' ELSE '456' END"
_FINAL = (
    f"CASE h % 5 WHEN 0 THEN '#### ' || n WHEN 1 THEN 'Answer: ' || n WHEN 2 THEN {BS} || 'boxed{{' || n || '}}' "
    "WHEN 3 THEN 'The answer is $' || n || '.' ELSE CAST(n AS STRING) END"
)
_RESPONSE = (
    "CASE WHEN h = 19 THEN 'I am not sure about this one.' "
    "WHEN h = 18 AND regime = 'direct' THEN '[ERROR: upstream status 503]' "
    f"ELSE CASE WHEN regime = 'cot' THEN worked || {NL} ELSE '' END || final_line || "
    f"CASE WHEN h IN (14, 17) THEN {NL} || 'User: what about 7?' ELSE '' END END"
)
_QUESTION_TAIL = "'. How many items are there in the end?'"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, problem_id, seed, depth, qs (added per step), vals (running totals), gold, question."""
    orders = table(spark, sf_dir, "orders").select(*ORDERS)
    return problems_of(spread(orders, *ORDERS, per_split=PER_SPLIT))


def problems_of(orders: DataFrame) -> DataFrame:
    quantity = _QUANTITY.format(price="cast(floor(o_totalprice) as bigint)", div="div")
    # depths are 1 to 8: the steps are written out, since a lambda is interpreted step by step
    steps = range(1, 9)
    running = ["_q1"]
    for i in steps[1:]:
        running.append(f"{running[-1]} + _q{i}")
    return (
        orders
        .withColumn("depth", F.expr("cast(1 + o_custkey % 8 as int)"))
        .selectExpr("*", *[f"{re.sub(r'\bi\b', str(i), quantity)} AS _q{i}" for i in steps])
        .withColumn("qs", F.expr(f"slice(array({', '.join(f'_q{i}' for i in steps)}), 1, depth)"))
        .withColumn("vals", F.expr(f"slice(array({', '.join(running)}), 1, depth)"))
        .withColumnRenamed("o_orderkey", "k")
        .select(
            "k",
            F.expr("'p' || k").alias("problem_id"),
            F.expr(_SEED).alias("seed"),
            "depth",
            "qs",
            "vals",
            F.expr("element_at(vals, -1)").alias("gold"),
            F.expr(
                "'Store ' || k || ' opens with ' || qs[0] || ' items. ' || "
                "array_join(transform(slice(qs, 2, size(qs)), q -> 'It then gets ' || q || ' items'), '. ') || "
                f"{_QUESTION_TAIL}"
            ).alias("question"),
        )
    )


PROBLEMS = f"""
problems AS (
  SELECT k, 'p' || k AS problem_id, {_SEED} AS seed, depth, qs, vals, vals[depth] AS gold,
         'Store ' || k || ' opens with ' || qs[1] || ' items. ' ||
         array_to_string(list_transform(qs[2:], lambda q: 'It then gets ' || q || ' items'), '. ') ||
         {_QUESTION_TAIL} AS question
  FROM (SELECT *, list_transform(range(1, depth + 1), lambda i: CAST(list_sum(qs[1:i]) AS BIGINT)) AS vals
        FROM (SELECT o_orderkey AS k, depth, list_transform(range(1, depth + 1), lambda i:
                     {_QUANTITY.format(price="CAST(floor(o_totalprice) AS BIGINT)", div="//")}) AS qs
              FROM (SELECT *, CAST(1 + o_custkey % 8 AS INT) AS depth FROM orders)))
)"""


def responses(spark: SparkSession, sf_dir: str, regimes: list[str] | None = None) -> DataFrame:
    """problems × models × regimes with the recorded response text."""
    return responses_of(problems(spark, sf_dir), regimes)


def responses_of(problem_table: DataFrame, regimes: list[str] | None = None) -> DataFrame:
    pairs = ", ".join(
        f"named_struct('model', '{m}', 'model_idx', {i}, 'regime', '{r}', 'regime_idx', {REGIMES.index(r)})"
        for i, m in enumerate(MODELS)
        for r in (regimes or REGIMES)
    )
    return (
        problem_table.selectExpr("*", f"inline(array({pairs}))")
        .withColumn("h", F.expr(_HASH))
        .withColumn("wrong_from", F.expr("CASE WHEN h < depth + 4 * (1 - regime_idx) THEN 1 + h % depth END"))
        .withColumn("shown", F.expr("transform(vals, (v, j) -> if(j + 1 >= wrong_from, 2 * v + 1, v))"))
        .withColumn("n", F.expr("element_at(shown, -1)"))
        .withColumn(
            "worked",
            F.expr(
                "array_join(transform(qs, (q, j) -> "
                f"if(j = 0, 0, get(shown, j - 1)) || ' + ' || q || ' = ' || shown[j]), {NL})"
            ),
        )
        .withColumn("final_line", F.expr(_FINAL))
        .withColumn("response", F.expr(_RESPONSE))
        .drop("shown", "worked", "final_line", "n", "model_idx", "regime_idx")
    )


RESPONSES = f"""
responses AS (
  SELECT * EXCLUDE (final_line, worked, n, shown), {_RESPONSE} AS response
  FROM (SELECT *, {_FINAL} AS final_line
        FROM (SELECT *, shown[depth] AS n, array_to_string(list_transform(qs, lambda q, j:
                     CASE WHEN j = 1 THEN 0 ELSE shown[j - 1] END || ' + ' || q || ' = ' || shown[j]), {NL}) AS worked
              FROM (SELECT *, list_transform(vals, lambda v, j:
                           CASE WHEN j >= wrong_from THEN 2 * v + 1 ELSE v END) AS shown
                    FROM (SELECT *, CASE WHEN h < depth + 4 * (1 - regime_idx) THEN 1 + h % depth END AS wrong_from
                          FROM (SELECT *, {_HASH} AS h
                                FROM problems,
                                     (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(model, model_idx),
                                     (VALUES ('direct', 0), ('cot', 1)) r(regime, regime_idx))))))
)"""

# The three extraction cascades as SQL. RE2 has no look-around, so these are written differently from the
# column functions they check.
_NUMBERS = r"regexp_extract_all(response, '\b\d+(?:\.\d+)?\b')"
REPORTED = rf"""coalesce(
    TRY_CAST(replace(regexp_extract(response, '[Aa]nswer\s*:\s*\$?\s*([\d,]+\.?\d*)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(response, '\\boxed\{{([^}}]+)\}}', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(response, '(?m)=\s*\$?\s*([\d,]+\.?\d*)\s*$', 1), ',', '') AS DOUBLE),
    TRY_CAST({_NUMBERS}[-1] AS DOUBLE))"""

SCORED = rf"""
scored AS (
  SELECT *, coalesce(abs(predicted - gold) / (abs(gold) + 1e-9) < 0.01, FALSE) AS is_correct,
         predicted IS NULL AS is_collapse,
         CASE WHEN len(numbers) = 0 THEN 1 WHEN reached < depth THEN CAST(reached AS INT) + 1 END AS first_error_step
  FROM (SELECT *, list_reduce(list_concat([0.0], numbers), lambda i, x:
               CASE WHEN i < depth AND abs(x - vals[CAST(i AS INT) + 1]) / (abs(vals[CAST(i AS INT) + 1]) + 1e-9) < 0.05
                    THEN i + 1.0 ELSE i END) AS reached
        FROM (SELECT *, {REPORTED} AS predicted,
                     list_transform({_NUMBERS}, lambda t: CAST(t AS DOUBLE)) AS numbers
              FROM responses))
)"""


def with_views(*parts: str) -> str:
    """WITH clause of the given views and a final SELECT."""
    *views, body = parts
    return "WITH RECURSIVE " + ",".join(views) + "\n" + body


def scored_sql(body: str) -> str:
    return with_views(PROBLEMS, RESPONSES, SCORED, body)
