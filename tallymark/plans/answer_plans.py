"""Queries over answer extraction, gold parsing, matching and scored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as X
from ..operators import metrics as A
from ..operators import scoring as P
from ..session import shared_dir, spread
from ..sources.json_tables import prepare_qa
from ..sources.rejects import Rejects
from ..sources.sinks import write_table
from .derived import BS, NL, PROBLEMS, REPORTED, RESPONSES, problems, responses, scored_sql, with_views
from .registry import query, table

# --- SQL spelling of the extraction rules (no look-around in RE2) ---------------------------------------

_TOKEN = r"(?:^|[^\w.])(-?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def candidate_sql(x: str) -> str:
    return rf"regexp_extract_all(translate(regexp_replace({strip_sql(x)}, '(?i)^(?:is|=)\s*', ''), '$%,\', ''), '{_TOKEN}', 1)[-1]"


def hash_sql(x: str) -> str:
    payload = strip_sql(rf"regexp_extract_all({x}, '####\s*([^\n]+)', 1)[-1]")
    return f"coalesce({candidate_sql(payload)}, {payload})"


def phrase_sql(x: str) -> str:
    phrase = r"(?im)(?:(?:\*\*\s*)?final answer\s*:|the\s+(?:final\s+)?answer\s+is\s*:?|^\s*answer:)\s*([^\n]+)"
    return strip_sql(f"regexp_extract_all({x}, '{phrase}', 1)[-1]")


def boxed_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)[-1]"


def tail_sql(x: str) -> str:
    return f"right(array_to_string(string_split({x}, {NL})[-25:], {NL}), 2000)"


def unleaked_sql(x: str) -> str:
    return rf"regexp_replace({x}, '(?is)\n(?:user|assistant|system):.*$', '')"


def final_sql(x: str) -> str:
    """Cascade over an already unleaked text."""
    phrase, boxed = phrase_sql(x), boxed_sql(x)
    return f"""coalesce({hash_sql(x)}, {candidate_sql(phrase)}, nullif({phrase}, ''), {candidate_sql(boxed)},
        nullif({strip_sql(boxed)}, ''), replace(regexp_extract_all({tail_sql(x)}, '{_TOKEN}', 1)[-1], ',', ''))"""


def numeric_sql(x: str) -> str:
    phrase = r"(?im)(?:(?:\*\*\s*)?final\s+answer\s*:|the\s+(?:final\s+)?answer\s+is\s*:?|^\s*answer\s*:)\s*\$?\s*([\-\d,\.]+)"
    return rf"""coalesce(
        TRY_CAST(replace(regexp_extract({x}, '\\boxed\{{([^}}]+)\}}', 1), ',', '') AS DOUBLE),
        TRY_CAST(replace(regexp_extract_all({x}, '####\s*([\-\d,\.]+)', 1)[-1], ',', '') AS DOUBLE),
        TRY_CAST(replace(regexp_extract_all({x}, '{phrase}', 1)[-1], ',', '') AS DOUBLE),
        TRY_CAST(replace(regexp_extract_all({tail_sql(x)}, '(?:^|[^\w])(-?\d[\d,]*(?:\.\d+)?)', 1)[-1], ',', '') AS DOUBLE))"""


# --- derived question/answer table with calculation markers ---------------------------------------------

_GOLD_N = "gold * 37"
_GROUPED = (
    "CASE WHEN {n} >= 1000 THEN ({n} {div} 1000) || ',' || lpad(CAST({n} % 1000 AS STRING), 3, '0') "
    "ELSE CAST({n} AS STRING) END"
)
_ANSWER = (
    "marked || CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN " + NL + " || '#### none' "
    "ELSE " + NL + " || '#### ' || {grouped} END"
)


def qa_rows(spark, d) -> DataFrame:
    """idx, question, answer: one marked calculation per step and a gold line; some rows lack it."""
    marked = f"array_join(transform(qs, (q, j) -> 'so <<' || q || '+' || j || '=' || (q + j) || '>>' || (q + j)), {NL})"
    grouped = _GROUPED.format(n=f"({_GOLD_N})", div="div")
    return (
        problems(spark, d)
        .withColumn("marked", F.expr(marked))
        .select(F.col("k").alias("idx"), "question", F.expr(_ANSWER.format(grouped=grouped)).alias("answer"))
    )


QA = f"""
qa AS (
  SELECT k AS idx, question, {_ANSWER.format(grouped=_GROUPED.format(n=f"({_GOLD_N})", div="//"))} AS answer
  FROM (SELECT *, array_to_string(list_transform(qs, lambda q, j:
               'so <<' || q || '+' || (j - 1) || '=' || (q + j - 1) || '>>' || (q + j - 1)), {NL}) AS marked FROM problems)
)"""
_GOLD_SQL = r"TRY_CAST(replace(regexp_extract_all(answer, '####\s*([\-\d,\.]+)', 1)[-1], ',', '') AS DOUBLE)"
_STEPS_SQL = "CAST(len(regexp_extract_all(answer, '<<[^>]+>>')) AS INT)"


def answers_sql(body: str) -> str:
    return with_views(PROBLEMS, QA, body)


# --- record scoring -------------------------------------------------------------------------------------


@query(
    "p1_scored_records",
    scored_sql("""SELECT model, regime, problem_id, depth, CAST(gold AS DOUBLE) AS ground_truth, predicted, is_correct,
        is_collapse, first_error_step FROM scored"""),
)
def scored_records(spark, d):
    return P.score_depth_log(responses(spark, d), gold="gold", expected="vals").select(
        "model", "regime", "problem_id", "depth", F.col("gold").cast("double").alias("ground_truth"), "predicted",
        "is_correct", "is_collapse", "first_error_step",
    )


@query(
    "x32_first_error_step",
    scored_sql("""SELECT depth, first_error_step, count(*) AS n FROM scored GROUP BY ALL"""),
)
def first_error(spark, d):
    step = X.first_error_step("response", "vals").alias("first_error_step")
    return responses(spark, d).select("depth", step).groupBy("depth", "first_error_step").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "x10_reported_answer",
    with_views(PROBLEMS, RESPONSES, f"SELECT model, regime, problem_id, {REPORTED} AS predicted FROM responses"),
)
def reported(spark, d):
    return responses(spark, d).select("model", "regime", "problem_id", X.reported_answer("response").alias("predicted"))


@query(
    "x9_final_answer",
    with_views(PROBLEMS, RESPONSES, f"""SELECT model, regime, problem_id, {final_sql("t")} AS predicted
        FROM (SELECT *, {unleaked_sql("response")} AS t FROM responses)"""),
)
def final(spark, d):
    return responses(spark, d).select("model", "regime", "problem_id", X.final_answer("response").alias("predicted"))


@query(
    "x9_final_answer_documents",
    f"""SELECT doc_id, {final_sql("t")} AS predicted FROM (SELECT doc_id, {unleaked_sql("text")} AS t FROM documents)""",
)
def final_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.final_answer("text").alias("predicted"))


@query(
    "x11_numeric_answer",
    with_views(PROBLEMS, RESPONSES, f"SELECT model, regime, problem_id, {numeric_sql('response')} AS predicted FROM responses"),
)
def numeric(spark, d):
    return responses(spark, d).select("model", "regime", "problem_id", X.numeric_answer("response").alias("predicted"))


@query(
    "p4_gold_with_fallback",
    with_views(PROBLEMS, QA, f"""
parsed AS (SELECT idx, coalesce({hash_sql("answer")}, {final_sql("answer")}) AS gold FROM (
    SELECT idx, CASE WHEN idx % 17 = 0 THEN 'no number here' ELSE answer END AS answer FROM qa))""",
        """SELECT gold IS NOT NULL AS evaluated, gold = 'none' AS raw_text, count(*) AS n, count(DISTINCT gold) AS n_golds
        FROM parsed GROUP BY ALL"""),
)
def gold_with_fallback(spark, d):
    rows = qa_rows(spark, d).withColumn(
        "answer", F.when(F.col("idx") % 17 == 0, "no number here").otherwise(F.col("answer"))
    )
    gold = rows.select(P.gold_text("answer").alias("gold"))
    return gold.groupBy(F.col("gold").isNotNull().alias("evaluated"), (F.col("gold") == "none").alias("raw_text")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("gold").alias("n_golds")
    )


@query(
    "p11_error_capture",
    with_views(PROBLEMS, RESPONSES, f"""
failed AS (SELECT model, regime, k, CASE WHEN k % 9 = 0 THEN '[ERROR: ' || ('code ' || k) || ']' ELSE response END AS response
           FROM responses)""",
        f"""SELECT model, regime, starts_with(response, '[ERROR:') AS failed, count(*) AS n,
        CAST(count(predicted) AS BIGINT) AS n_predicted, CAST(count(*) FILTER (predicted = k) AS BIGINT) AS n_from_error
        FROM (SELECT *, {REPORTED} AS predicted FROM failed) GROUP BY ALL"""),
)
def error_capture(spark, d):
    log = responses(spark, d).withColumn(
        "error", F.when(F.col("k") % 9 == 0, F.concat(F.lit("code "), F.col("k").cast("string")))
    )
    rows = P.capture_errors(log).select(
        "model", "regime", "k", X.is_error_text("response").alias("failed"), X.reported_answer("response").alias("predicted")
    )
    return rows.groupBy("model", "regime", "failed").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("predicted").alias("n_predicted"),
        F.count_if(F.col("predicted") == F.col("k")).alias("n_from_error"),
    )


@query(
    "a15_variant_scoring",
    with_views(PROBLEMS, QA, RESPONSES, f"""
pairs AS (
  SELECT r.model, r.regime AS variant, {final_sql("t")} AS predicted, r.k,
         CASE WHEN r.k % 10 = 0 THEN NULL ELSE CAST(r.gold AS VARCHAR) END AS g
  FROM (SELECT *, {unleaked_sql("response")} AS t FROM responses) r
)""", """SELECT model, variant, CAST(count(*) FILTER (ok) AS BIGINT) AS n_correct, CAST(count(g) AS BIGINT) AS n_evaluated,
        CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS n_skipped_no_gold, round(count(*) FILTER (ok) / count(g), 6) AS accuracy
        FROM (SELECT *, coalesce(k % 9 <> 0 AND TRY_CAST(predicted AS DOUBLE) = CAST(g AS DOUBLE), FALSE) AS ok FROM pairs)
        GROUP BY ALL"""),
)
def variant_scoring(spark, d):
    log = responses(spark, d).select(
        "model",
        F.col("regime").alias("variant"),
        "response",
        F.when(F.col("k") % 10 == 0, "nothing").otherwise(F.concat(F.lit("#### "), F.col("gold").cast("string"))).alias(
            "answer"
        ),
        F.when(F.col("k") % 9 == 0, "timeout").alias("failure"),
    )
    scored = P.score_variant_log(log, error="failure")
    return A.variant_accuracy(scored, ("model", "variant")).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "x16_qa_log_accuracy",
    with_views(PROBLEMS, RESPONSES, f"""SELECT model, depth, count(*) AS n, CAST(count(predicted) AS BIGINT) AS n_answered,
        CAST(count(*) FILTER (abs(gold - predicted) <= greatest(1e-5, abs(gold) * 1e-5)) AS BIGINT) AS k
        FROM (SELECT *, {numeric_sql("response")} AS predicted FROM responses) GROUP BY ALL"""),
)
def qa_log(spark, d):
    return P.score_qa_log(responses(spark, d), gold="gold").groupBy("model", "depth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_collapse")).alias("n_answered"),
        F.count_if("is_correct").alias("k"),
    )


# --- prepared question/answer problems --------------------------------------------------------------------


@query("x13_gold_number", answers_sql(f"SELECT idx, {_GOLD_SQL} AS gold FROM qa"))
def gold_number(spark, d):
    return qa_rows(spark, d).select("idx", X.gold_number("answer").alias("gold"))


@query("x14_step_markers", answers_sql(f"SELECT idx, {_STEPS_SQL} AS steps FROM qa"))
def step_markers(spark, d):
    return qa_rows(spark, d).select("idx", X.count_steps("answer").alias("steps"))


@query(
    "s11_prepare_problems",
    answers_sql(f"""SELECT printf('gsm8k_%04d', idx) AS problem_id, {_GOLD_SQL} AS ground_truth, {_STEPS_SQL} AS estimated_steps,
        md5(question) AS question, md5(answer) AS answer FROM qa
        WHERE {_GOLD_SQL} IS NOT NULL AND {_STEPS_SQL} >= 6"""),
)
def prepare(spark, d):
    out = prepare_qa(qa_rows(spark, d))
    return out.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("question", "answer")})


@query(
    "s11_reject_counts",
    answers_sql(f"""SELECT reason, CAST(n AS BIGINT) AS n FROM (
        SELECT unnest(['rows', 'no_gold', 'few_steps']) AS reason,
               unnest([count(*), count(*) FILTER (g IS NULL), count(*) FILTER (g IS NOT NULL AND s < 6)]) AS n
        FROM (SELECT {_GOLD_SQL} AS g, {_STEPS_SQL} AS s FROM qa))"""),
)
def preparation_reject_counts(spark, d):
    rejects = Rejects()
    write_table(prepare_qa(qa_rows(spark, d), rejects=rejects), shared_dir(spark, "s11-rejects"))
    return rejects.table(spark)


@query(
    "p6_minimum_steps",
    answers_sql(f"""SELECT {_STEPS_SQL} AS estimated_steps, count(*) AS n FROM qa
        WHERE {_GOLD_SQL} IS NOT NULL AND {_STEPS_SQL} >= 3 GROUP BY 1"""),
)
def minimum_steps(spark, d):
    return prepare_qa(qa_rows(spark, d), min_steps=3).groupBy("estimated_steps").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a25_preparation_profile",
    answers_sql(f"""SELECT count(*) AS n_total, CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS n_no_gold,
        CAST(count(*) FILTER (g IS NOT NULL AND s < 4) AS BIGINT) AS n_few_steps,
        CAST(count(*) FILTER (g IS NOT NULL AND s >= 4) AS BIGINT) AS n_kept,
        min(s) FILTER (g IS NOT NULL AND s >= 4) AS min_steps, max(s) FILTER (g IS NOT NULL AND s >= 4) AS max_steps,
        list_sort(list(s) FILTER (g IS NOT NULL AND s >= 4))[count(*) FILTER (g IS NOT NULL AND s >= 4) // 2 + 1] AS median_steps
        FROM (SELECT {_GOLD_SQL} AS g, {_STEPS_SQL} AS s FROM qa)"""),
)
def preparation_profile(spark, d):
    return A.preparation_profile(prepare_qa_all(spark, d), min_steps=4)


def prepare_qa_all(spark, d) -> DataFrame:
    return qa_rows(spark, d).select(
        X.gold_number("answer").alias("ground_truth"), X.count_steps("answer").alias("estimated_steps")
    )


@query(
    "p2_required_fields",
    answers_sql("""SELECT count(*) AS n, min(idx) AS first_idx FROM (
        SELECT idx, CASE WHEN idx % 5 = 0 THEN '' WHEN idx % 7 = 0 THEN NULL ELSE question END AS question FROM qa)
        WHERE question <> ''"""),
)
def required_fields(spark, d):
    question = F.when(F.col("idx") % 5 == 0, "").when(F.col("idx") % 7 == 0, None).otherwise(F.col("question"))
    rows = qa_rows(spark, d).withColumn("question", question)
    return P.keep_complete(rows, "question").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))


# --- single rules over texts built from line items and conversations ----------------------------------------


def lines(spark, d) -> DataFrame:
    """p, q, v: two numbers and a variant per line item."""
    items = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    return spread(items).selectExpr("l_partkey AS p", "cast(l_quantity AS bigint) AS q", "l_linenumber % 6 AS v")


LINES = "lines AS (SELECT l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 6 AS v FROM lineitem)"


def _over_lines(spark, d, text: str, rule, name: str) -> DataFrame:
    """Result of a text rule per distinct line, with counts."""
    rows = lines(spark, d).select("v", F.expr(text).alias("t")).select("v", rule("t").alias(name))
    return rows.groupBy("v", name).agg(F.count(F.lit(1)).alias("n"))


def _over_lines_sql(text: str, rule: str, name: str) -> str:
    return with_views(LINES, f"SELECT v, {rule} AS {name}, count(*) AS n FROM (SELECT v, {text} AS t FROM lines) GROUP BY ALL")


_CANDIDATES = f"""CASE v WHEN 0 THEN 'is $' || p || ',250%' WHEN 1 THEN '= ' || q || '.5 kg' WHEN 2 THEN q || 'e3'
    WHEN 3 THEN 'about ' || q || ' or -' || p || '.25' WHEN 4 THEN 'no. ' || {BS} || '$' || q || {BS} || ' ' ELSE 'none' END"""


@query("x5_numeric_candidate", _over_lines_sql(_CANDIDATES, candidate_sql("t"), "candidate"))
def numeric_candidate(spark, d):
    return _over_lines(spark, d, _CANDIDATES, X.numeric_candidate, "candidate")


_HASHES = f"""CASE v WHEN 0 THEN '#### ' || q || {NL} || '####  ' || p || ' items' WHEN 1 THEN 'x ####' || {NL} || q
    WHEN 2 THEN '#### many' WHEN 3 THEN '### ' || q WHEN 4 THEN '#### $' || p || ',000.50' ELSE 'none' END"""


@query("x6_hash_answer", _over_lines_sql(_HASHES, hash_sql("t"), "answer"))
def hash_answer(spark, d):
    return _over_lines(spark, d, _HASHES, X.hash_answer, "answer")


_PHRASES = f"""CASE v WHEN 0 THEN 'The answer is ' || q || '.' || {NL} || 'Answer: ' || p WHEN 1 THEN '**Final answer: ' || q || '**'
    WHEN 2 THEN 'Answer: ' || q || {NL} || 'the final answer is: ' || p WHEN 3 THEN 'My Answer: ' || q
    WHEN 4 THEN 'THE ANSWER IS none' ELSE 'no' END"""


@query("x7_answer_phrase", _over_lines_sql(_PHRASES, phrase_sql("t"), "phrase"))
def answer_phrase(spark, d):
    return _over_lines(spark, d, _PHRASES, X.answer_phrase, "phrase")


_BOXES = f"""CASE v WHEN 0 THEN {BS} || 'boxed{{' || {BS} || 'frac{{' || q || '}}{{' || p || '}}}} end'
    WHEN 1 THEN {BS} || 'boxed{{' || q || '}} then ' || {BS} || 'boxed{{' || p || '}}' WHEN 2 THEN {BS} || 'boxed{{' || q || '}} and ' || {BS} || 'boxed{{' || p
    WHEN 3 THEN '{{' || q || '}}' WHEN 4 THEN {BS} || 'boxed{{}}' ELSE 'none' END"""


@query("x8_last_boxed", _over_lines_sql(_BOXES, boxed_sql("t"), "boxed"))
def last_boxed(spark, d):
    return _over_lines(spark, d, _BOXES, X.last_boxed, "boxed")


_TAGS = """CASE v WHEN 0 THEN 'ANSWER: $' || q || '.375' WHEN 1 THEN 'final answer : ' || q || '/8' WHEN 2 THEN 'answer: ' || p || ',000 or answer: 2'
    WHEN 3 THEN 'ANSWER: ' || q || ' / 0' WHEN 4 THEN 'ANSWER: -' || q ELSE 'none ' || q END"""
_TAG_SQL = r"regexp_replace(regexp_extract(t, '(?i)(?:final\s+)?answer\s*:\s*\$?\s*([-\d,]+(?:\.\d+)?(?:\s*/\s*[-\d,]+(?:\.\d+)?)?)', 1), '[,\s]', '', 'g')"


@query(
    "x12_answer_tag",
    _over_lines_sql(
        _TAGS,
        f"""CASE WHEN contains({_TAG_SQL}, '/')
            THEN TRY_CAST(split_part({_TAG_SQL}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({_TAG_SQL}, '/', 2) AS DOUBLE), 0)
            ELSE TRY_CAST({_TAG_SQL} AS DOUBLE) END""",
        "tag",
    ),
)
def answer_tag(spark, d):
    return _over_lines(spark, d, _TAGS, X.answer_tag, "tag")


_NUMBERS = f"""CASE v WHEN 0 THEN q || '/4 then ' || p WHEN 1 THEN 'about -' || q || '.5 left' WHEN 2 THEN {BS} || 'boxed{{' || q || '}} 7'
    WHEN 3 THEN {BS} || 'frac{{1}}{{' || p || '}} and ' || q WHEN 4 THEN q || '/0 or ' || p ELSE 'none' END"""


@query(
    "x23_last_number",
    _over_lines_sql(
        _NUMBERS,
        r"""coalesce(TRY_CAST(regexp_extract(t, '\\boxed\{([-\d.]+)\}', 1) AS DOUBLE),
            TRY_CAST(regexp_extract_all(c, '(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)', 1)[-1] AS DOUBLE)
              / nullif(TRY_CAST(regexp_extract_all(c, '(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)', 2)[-1] AS DOUBLE), 0),
            TRY_CAST(regexp_extract_all(c, '-?\d+(?:\.\d+)?')[-1] AS DOUBLE))""".replace(
            "(c,", r"(regexp_replace(t, '\\frac\{[^}]*\}\{[^}]*\}', '', 'g'),"
        ),
        "number",
    ),
)
def last_number(spark, d):
    return _over_lines(spark, d, _NUMBERS, X.last_number, "number")


@query(
    "x15_normalized_answer",
    _over_lines_sql(
        _CANDIDATES,
        rf"""coalesce(nullif(regexp_extract({strip_sql("translate(" + strip_sql("t") + r", ',$%\', '')")}, '-?\d+(?:\.\d+)?'), ''),
            {strip_sql("translate(" + strip_sql("t") + r", ',$%\', '')")})""",
        "answer",
    ),
)
def normalized_answer(spark, d):
    return _over_lines(spark, d, _CANDIDATES, X.normalized_answer, "answer")


_PREDICTED = "q + CASE v WHEN 0 THEN 0.0 WHEN 1 THEN 0.00001 WHEN 2 THEN 0.005 WHEN 3 THEN 0.25 WHEN 4 THEN 0.1 END"


@query(
    "x16_answer_match",
    with_views(
        LINES,
        f"""SELECT v, count(*) AS n,
            CAST(count(*) FILTER (abs(q - x) <= 1e-5 * greatest(1.0, abs(q), abs(x))) AS BIGINT) AS n_relative,
            CAST(count(*) FILTER (abs(x - q) <= 0.01) AS BIGINT) AS n_absolute,
            CAST(count(*) FILTER (abs(q - x) <= greatest(1e-5, abs(q) * 1e-5)) AS BIGINT) AS n_scaled,
            CAST(count(*) FILTER (abs(x - q) / (abs(q) + 1e-9) < 0.01) AS BIGINT) AS n_percent
            FROM (SELECT v, CAST(q AS DOUBLE) AS q, CAST({_PREDICTED} AS DOUBLE) AS x FROM lines) GROUP BY v""",
    ),
)
def answer_match(spark, d):
    predicted = F.expr(f"cast({_PREDICTED} as double)")
    rows = lines(spark, d).select("v", F.col("q").cast("double").alias("g"), predicted.alias("x"))
    rows = rows.withColumns({"gs": F.col("g").cast("string"), "xs": F.format_string("$%.5f", "x")})
    rows = rows.withColumn("xs", F.when(F.col("x").isNotNull(), F.col("xs")))
    bare = F.regexp_replace("xs", r"^\$", "")
    return rows.groupBy("v").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(X.match_relative("gs", "xs")).alias("n_relative"),
        F.count_if(X.match_absolute(F.col("gs"), bare)).alias("n_absolute"),
        F.count_if(X.match_scaled("g", "x")).alias("n_scaled"),
        F.count_if(X.match_percent("g", "x")).alias("n_percent"),
    )


@query(
    "x4_chat_turn_cut",
    f"""SELECT conv_id, turn, md5({unleaked_sql("t")}) AS kept, length({unleaked_sql("t")}) AS n_chars
        FROM (SELECT conv_id, turn, text || {NL} || upper(role) || ': turn ' || turn || {NL} || 'User: next' AS t FROM conversations)""",
)
def chat_turn_cut(spark, d):
    leaked = F.expr(f"text || {NL} || upper(role) || ': turn ' || turn || {NL} || 'User: next'")
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.before_chat_turn(leaked).alias("t"))
    return rows.select(
        "conv_id", "turn", F.md5(F.col("t").cast("binary")).alias("kept"), F.length("t").cast("bigint").alias("n_chars")
    )


@query(
    "x3_base_text",
    with_views(PROBLEMS, "SELECT problem_id, question AS base_text FROM problems"),
)
def base_text(spark, d):
    annotated = F.concat(
        F.col("question"), F.lit(" \n\n#init:\n- $n = "), F.col("gold").cast("string"), F.lit("\n\n#answer: n")
    )
    return problems(spark, d).select("problem_id", X.base_text(annotated).alias("base_text"))
