"""Queries over arithmetic in responses: normalisation, expressions, verification, chunked solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic as M
from ..operators import chunks as K
from ..operators import compare as J
from ..operators import metrics as A
from ..operators import seeds as S
from .answer_plans import LINES, lines
from .derived import BS, MODELS, NL, PROBLEMS, problems, with_views
from .registry import query

# --- normalisation of single lines --------------------------------------------------------------------------

_LATEX = f"""CASE v WHEN 0 THEN {BS} || 'frac{{' || q || '}}{{8}} ' || {BS} || 'times ' || {BS} || '$' || p || ' = 5'
    WHEN 1 THEN q || ' hours × ' || p || ' Dollars = ' || (q * p)
    WHEN 2 THEN {BS} || 'text{{ ' || q || ' }} ' || {BS} || 'mathrm{{kg}} ' || {BS} || 'div 2'
    WHEN 3 THEN 'costs $' || p || ',250,000 ' || {BS} || 'cdot 3'
    WHEN 4 THEN {BS} || 'frac{{' || q || '}}{{0}} left' ELSE 'plain ' || q || ' itemset' END"""
_FRAC = r"'\\frac\{([\d.]+)\}\{([\d.]+)\}'"
_FRAC_VALUE = f"""CASE WHEN TRY_CAST(regexp_extract(t, {_FRAC}, 2) AS DOUBLE) = 0 THEN '0'
    ELSE CAST(TRY_CAST(regexp_extract(t, {_FRAC}, 1) AS DOUBLE) / TRY_CAST(regexp_extract(t, {_FRAC}, 2) AS DOUBLE) AS VARCHAR) END"""
_UNITS = r"'([0-9])\s+(?:hours?|dollars?|items?)\b'"
_NORMAL_SQL = rf"""regexp_replace(regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(w, '\$', ''), '$', ''), '\times', '×'), '\cdot', '×'), '\div', '÷'),
      '(\d),(\d{{3}})', '\1\2', 'g'), '(\d),(\d{{3}})', '\1\2', 'g'), {_UNITS}, '\1', 'gi')"""
_UNWRAP_SQL = r"""regexp_replace(regexp_replace(f, '\\(?:text|mathrm|mathbf)\{\s*([\d.]+)\s*\}', '\1', 'g'),
      '\\(?:text|mathrm|mathbf)\{[^}]*\}', ' ', 'g')"""


@query(
    "x17_plain_arithmetic",
    with_views(LINES, f"""SELECT v, {_NORMAL_SQL} AS plain, count(*) AS n FROM (SELECT v, {_UNWRAP_SQL} AS w FROM (
        SELECT v, CASE WHEN regexp_matches(t, {_FRAC}) THEN replace(t, regexp_extract(t, {_FRAC}), {_FRAC_VALUE}) ELSE t END AS f
        FROM (SELECT v, {_LATEX} AS t FROM lines))) GROUP BY ALL"""),
)
def plain_arithmetic(spark, d):
    rows = lines(spark, d).select("v", F.expr(_LATEX).alias("t")).select("v", M.plain_arithmetic("t").alias("plain"))
    return rows.groupBy("v", "plain").agg(F.count(F.lit(1)).alias("n"))


_PARENS = """CASE v WHEN 0 THEN q || ' * (1/4) = ' || p WHEN 1 THEN '(' || q || '/0) and ( ' || q || ' / 8 )'
    WHEN 2 THEN '(' || q || ')' ELSE q || '/2' END"""


@query(
    "x18_expand_fractions",
    with_views(LINES, """SELECT v, CASE v WHEN 0 THEN q || ' * 0.25 = ' || p
        WHEN 1 THEN '(' || q || '/0) and ' || CAST(q / 8 AS VARCHAR) WHEN 2 THEN '(' || q || ')' ELSE q || '/2' END AS expanded,
        count(*) AS n FROM lines GROUP BY ALL"""),
)
def expand_fractions(spark, d):
    rows = lines(spark, d).select("v", M.expand_fractions(F.expr(_PARENS)).alias("expanded"))
    return rows.groupBy("v", "expanded").agg(F.count(F.lit(1)).alias("n"))


_SYMBOLS = """CASE v WHEN 0 THEN 'current_total - 4 = 1' WHEN 1 THEN 'total + bob_items = 9' WHEN 2 THEN 'subtotal' ELSE 'no names' END"""


@query(
    "x19_symbolic_operands",
    with_views(LINES, """SELECT v, CASE v WHEN 0 THEN q || '.0 - 4 = 1' WHEN 1 THEN p || '.5 + 7.0 = 9' WHEN 2 THEN 'subtotal'
        ELSE 'no names' END AS text, count(*) AS n FROM lines GROUP BY ALL"""),
)
def symbolic_operands(spark, d):
    def known(name: str, value) -> F.struct:
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))

    names = F.array(known("total", F.col("p") + 0.5), known("current_total", F.col("q")), known("bob_items", F.lit(7)))
    rows = lines(spark, d).select("v", M.substitute_names(F.expr(_SYMBOLS), names).alias("text"))
    return rows.groupBy("v", "text").agg(F.count(F.lit(1)).alias("n"))


# --- expressions --------------------------------------------------------------------------------------------

_NUM = r"\d+(?:\.\d+)?"
_OP = r"[+\-*/×÷]"
_CHAIN = rf"(^|[^\d/])({_NUM})\s*({_OP})\s*({_NUM})\s*({_OP})\s*({_NUM})\s*=\s*({_NUM})"
_BINARY = rf"({_NUM})\s*({_OP})\s*({_NUM})\s*=\s*({_NUM})"


def eval_sql(left: str, op: str, right: str) -> str:
    return f"CASE {op} WHEN '+' THEN {left} + {right} WHEN '-' THEN {left} - {right} WHEN '*' THEN {left} * {right} ELSE {left} / nullif({right}, 0) END"


def _number(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _part(i: int) -> str:
    return f"regexp_extract(k, '{_BINARY}', {i})"


_EXPRESSIONS = rf"""
marked AS (SELECT *, regexp_replace(t, '{_CHAIN}', '\1⟦\2|\3|\4|\5|\6|\7⟧', 'g') AS m FROM texts),
tokens AS (SELECT *, regexp_extract_all(m, '⟦[^⟧]*⟧|{_BINARY}') AS toks FROM marked),
parsed AS (
  SELECT *, flatten(list_transform(toks, lambda k: CASE WHEN starts_with(k, '⟦') THEN list_transform([string_split(translate(k, '⟦⟧', ''), '|')],
      lambda s: {{'l': {_number("s[1]")}, 'op': translate(s[2], '×÷', '*/'), 'r': {_number("s[3]")}, 'c': round({eval_sql(_number("s[1]"), "translate(s[2], '×÷', '*/')", _number("s[3]"))}, 10)}})
      || list_transform([string_split(translate(k, '⟦⟧', ''), '|')],
      lambda s: {{'l': round({eval_sql(_number("s[1]"), "translate(s[2], '×÷', '*/')", _number("s[3]"))}, 10), 'op': translate(s[4], '×÷', '*/'), 'r': {_number("s[5]")}, 'c': {_number("s[6]")}}})
    ELSE [{{'l': {_number(_part(1))}, 'op': translate({_part(2)}, '×÷', '*/'), 'r': {_number(_part(3))}, 'c': {_number(_part(4))}}}] END)) AS es
  FROM tokens
)"""


def verify_sql(source: str, target: str) -> str:
    """CTEs that add status and carried lists to a table with es (list of l, op, r, c)."""
    value = eval_sql("e.l", "e.op", "e.r")
    return f"""
{target}_1 AS (
  SELECT *, list_transform(es, lambda e: {value}) AS computed,
         list_transform(es, lambda e: coalesce(abs(({value}) - e.c) > 1e-4, FALSE)) AS wrong,
         list_transform(es, lambda e, i: i > 1 AND e.op IN ('*', '/') AND e.op = es[i - 1].op AND ({value}) IS NOT NULL
           AND abs(e.l - es[i - 1].c) <= 1e-4 AND (abs(e.r - es[i - 1].r) <= 1e-4 OR abs(e.r - es[i - 1].l) <= 1e-4)) AS suspect
  FROM {source}
),
{target}_2 AS (
  SELECT *, CASE WHEN len(es) = 0 THEN [] ELSE list_reduce(list_transform(suspect, lambda s: [s]), lambda acc, x:
         list_concat(acc, [x[1] AND NOT (wrong[len(acc)] AND NOT acc[len(acc)])])) END AS flags FROM {target}_1
),
{target} AS (
  SELECT *, list_transform(es, lambda e, i: CASE WHEN computed[i] IS NULL THEN 'error' WHEN flags[i] THEN 'double_count'
           WHEN wrong[i] THEN 'corrected' ELSE 'correct' END) AS status,
         list_transform(es, lambda e, i: CASE WHEN computed[i] IS NULL THEN NULL WHEN flags[i] THEN es[i - 1].c
           WHEN wrong[i] THEN round(computed[i], 10) ELSE e.c END) AS carried FROM {target}_2
)"""


_EXPRESSION_TEXT = f"""CASE v WHEN 0 THEN q || ' * 5 = ' || (q * 5) || {NL} || (q * 5) || ' * 5 = ' || (q * 25)
    WHEN 1 THEN q || ' + ' || p || ' * 2 = ' || (q + p * 2) WHEN 2 THEN q || ' - 60 = ' || (q - 60)
    WHEN 3 THEN q || ' × 3 = ' || (q * 3 + 1) || ', ' || (q * 3 + 1) || ' × 3 = ' || (q * 9) || ' and ' || (q * 9) || ' * 3 = ' || (q * 27)
    WHEN 4 THEN q || ' / 0 = 1. ' || p || ' ÷ 4 = ' || p || '.25' ELSE q || ' + 1 = ' || (q + 1) || ' + 4 * 5 = ' || (q * 5 + 25) END"""
_TEXTS = f"texts AS (SELECT p, q, v, {_EXPRESSION_TEXT} AS t FROM lines)"
_LISTED = "array_to_string(list_transform(es, lambda e: CAST(e.l AS VARCHAR) || e.op || CAST(e.r AS VARCHAR) || '=' || CAST(e.c AS VARCHAR)), ';')"


def _texts(spark, d) -> DataFrame:
    return lines(spark, d).select("v", "p", "q", M.expressions_in(F.expr(_EXPRESSION_TEXT)).alias("es"))


@query(
    "x20_expressions",
    with_views(LINES, _TEXTS, _EXPRESSIONS, f"""SELECT v, len(es) AS n_expressions, {_LISTED} AS expressions, count(*) AS n
        FROM parsed GROUP BY ALL"""),
)
def expressions(spark, d):
    listed = F.array_join(
        F.transform(
            "es",
            lambda e: F.concat(
                e["left"].cast("string"), e["op"], e["right"].cast("string"), F.lit("="), e["claimed"].cast("string")
            ),
        ),
        ";",
    )
    rows = _texts(spark, d).select("v", F.size("es").cast("bigint").alias("n_expressions"), listed.alias("expressions"))
    return rows.groupBy("v", "n_expressions", "expressions").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x21_evaluate",
    with_views(LINES, f"""SELECT op, count(*) AS n, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS n_undefined, round(sum(x), 4) AS total
        FROM (SELECT op, {eval_sql("l", "op", "r")} AS x FROM (
          SELECT ['+', '-', '*', '/'][CAST(p % 4 AS INT) + 1] AS op, CAST(q AS DOUBLE) AS l, CAST(v AS DOUBLE) AS r FROM lines))
        GROUP BY op"""),
)
def evaluate(spark, d):
    op = F.expr("array('+', '-', '*', '/')[cast(p % 4 as int)]")
    rows = lines(spark, d).select(op.alias("op"), F.col("q").cast("double").alias("l"), F.col("v").cast("double").alias("r"))
    value = rows.select("op", M.evaluate(F.col("l"), F.col("op"), F.col("r")).alias("x"))
    return value.groupBy("op").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_undefined"), F.round(F.sum("x"), 4).alias("total")
    )


@query(
    "x22_verify_expressions",
    with_views(LINES, _TEXTS, _EXPRESSIONS, verify_sql("parsed", "verified"),
        """SELECT v, array_to_string(status, ',') AS statuses, count(*) AS n,
        round(sum(coalesce(list_sum(carried), 0)), 4) AS carried FROM verified GROUP BY ALL"""),
)
def verify_expressions(spark, d):
    rows = _texts(spark, d).select("v", M.verify("es").alias("log"))
    carried = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.coalesce(x["corrected_value"], F.lit(0.0)))
    return rows.groupBy("v", F.array_join(F.transform("log", lambda x: x["status"]), ",").alias("statuses")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(carried), 4).alias("carried")
    )


_TERMINAL = """CASE WHEN len(es) <= 1 THEN len(es) - 1 ELSE coalesce(list_max(list_filter(list_transform(es, lambda e, i:
    CASE WHEN status[i] <> 'double_count' AND (i = 1 OR abs(e.l - {total}) <= 1e-4 OR len(list_filter(range(1, i), lambda j:
      status[j] <> 'double_count' AND abs(e.l - es[j].c) <= 1e-4)) > 0) THEN i - 1 END), lambda x: x IS NOT NULL)), 0) END"""


@query(
    "x28_chain_terminal",
    with_views(LINES, _TEXTS, _EXPRESSIONS, verify_sql("parsed", "verified"),
        f"""SELECT v, terminal, count(*) AS n FROM (SELECT v, {_TERMINAL.format(total="CASE WHEN q % 2 = 0 THEN CAST(p AS DOUBLE) END")} AS terminal
        FROM verified) GROUP BY ALL"""),
)
def chain_terminal(spark, d):
    total = F.when(F.col("q") % 2 == 0, F.col("p").cast("double"))
    rows = _texts(spark, d).withColumn("total", total).withColumn("log", M.verify("es"))
    return rows.groupBy("v", M.chain_terminal("log", "total").cast("bigint").alias("terminal")).agg(F.count(F.lit(1)).alias("n"))


# --- recorded chunk solutions ---------------------------------------------------------------------------------

_CHUNK_HASH = "(k * 13 + model_idx * 7 + 5) % 20"
_WRONG = "CASE WHEN h < depth THEN 1 + h % depth END"
# w: worked lines of the chunk, n: value shown last, q1: first added quantity, a: attempt
_CHUNK_TEXT = f"""CASE WHEN h = 11 THEN 'cannot tell' WHEN h = 13 THEN 'maybe about ' || n WHEN h % 6 = 0 AND a = 0 THEN 'thinking'
    WHEN h = 7 THEN n || ' / 0 = ' || n
    WHEN h IN (5, 16) THEN q1 || ' * 2 = ' || (q1 * 2) || {NL} || (q1 * 2) || ' * 2 = ' || (q1 * 4) || CASE WHEN h = 5 THEN {NL} || 'ANSWER: ' || n ELSE '' END
    WHEN h = 9 AND c > 0 THEN 'current_total + ' || q1 || ' = ' || n
    WHEN h = 17 THEN 'ANSWER: $' || n
    ELSE w || CASE WHEN h % 7 = 0 THEN '' ELSE {NL} || 'ANSWER: ' || n END END"""
_ATTEMPTS = "CASE WHEN h IN (11, 13) THEN 3 WHEN h % 6 = 0 THEN 2 ELSE 1 END"
_CLAUSE = "'Store ' || k || ' gets ' || q1 || ' items.'"


def _shown(j: str) -> str:
    """The running total shown after step j, from 0."""
    return f"if({j} + 1 >= wrong_from, 2 * vals[{j}] + 1, vals[{j}])"


def _step(j: str) -> str:
    return f"if({j} = 0, 0, {_shown(f'{j} - 1')}) || ' + ' || qs[{j}] || ' = ' || {_shown(j)}"


def attempts(spark, d) -> DataFrame:
    """One row per recorded attempt: model, problem_id, seed, depth, gold, chunk_idx, clause_text, attempt, response."""
    models = ", ".join(f"named_struct('model', '{m}', 'model_idx', {i})" for i, m in enumerate(MODELS))
    return (
        problems(spark, d)
        .selectExpr("k", "problem_id", "seed", "depth", "gold", "qs", "vals", f"inline(array({models}))")
        .withColumn("h", F.expr(_CHUNK_HASH))
        .withColumn("wrong_from", F.expr(_WRONG))
        .withColumn("c", F.expr("explode(sequence(0, cast((depth - 1) div 2 as int)))"))
        .withColumn("last", F.expr("least(2 * c + 2, depth)"))
        .withColumn("n", F.expr(_shown("last - 1")))
        .withColumn("q1", F.expr("qs[2 * c]"))
        # a chunk has one or two steps
        .withColumn("w", F.expr(f"array_join(array({_step('2 * c')}, CASE WHEN 2 * c + 1 < last THEN {_step('2 * c + 1')} END), {NL})"))
        .withColumn("a", F.expr(f"explode(sequence(0, {_ATTEMPTS} - 1))"))
        .select(
            "model", "problem_id", "seed", "depth", "gold", F.col("c").alias("chunk_idx"), F.expr(_CLAUSE).alias("clause_text"),
            F.col("a").alias("attempt"), F.expr(_CHUNK_TEXT).alias("response"),
        )
    )


ATTEMPTS = f"""
attempts AS (
  SELECT model, problem_id, seed, depth, gold, CAST(c AS INT) AS chunk_idx, CAST(a AS INT) AS attempt, {_CHUNK_TEXT} AS response
  FROM (SELECT *, unnest(range(0, {_ATTEMPTS})) AS a
        FROM (SELECT *, shown[last] AS n, qs[2 * c + 1] AS q1, array_to_string(list_transform(range(2 * c + 1, last + 1), lambda j:
                     CASE WHEN j = 1 THEN 0 ELSE shown[j - 1] END || ' + ' || qs[j] || ' = ' || shown[j]), {NL}) AS w
              FROM (SELECT *, least(2 * c + 2, depth) AS last
                    FROM (SELECT *, unnest(range(0, (depth - 1) // 2 + 1)) AS c,
                                 list_transform(vals, lambda x, j: CASE WHEN j >= wrong_from THEN 2 * x + 1 ELSE x END) AS shown
                          FROM (SELECT *, {_WRONG} AS wrong_from
                                FROM (SELECT *, {_CHUNK_HASH} AS h FROM problems,
                                           (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(model, model_idx)))))))
)"""


def _chunk_expressions_sql(x: str) -> str:
    parts = [f"regexp_extract_all({x}, '{_BINARY}', {i})" for i in (1, 2, 3, 4)]
    return (
        f"list_transform(list_zip({', '.join(parts)}), lambda z: "
        "{'l': CAST(z[1] AS DOUBLE), 'op': z[2], 'r': CAST(z[3] AS DOUBLE), 'c': CAST(z[4] AS DOUBLE)})"
    )


_READ = "replace(tx, 'current_total', coalesce(CAST(total AS VARCHAR), 'current_total'))"
_TAG = r"TRY_CAST(regexp_extract(tx, '(?i)answer\s*:\s*\$?\s*(\d+)', 1) AS DOUBLE)"
_LAST = r"TRY_CAST(regexp_extract_all({}, '-?\d+(?:\.\d+)?')[-1] AS DOUBLE)"
_LAST_OR_RATIO = rf"""coalesce(TRY_CAST(regexp_extract_all(tx, '(-?\d+)\s*/\s*(-?\d+)', 1)[-1] AS DOUBLE)
    / nullif(TRY_CAST(regexp_extract_all(tx, '(-?\d+)\s*/\s*(-?\d+)', 2)[-1] AS DOUBLE), 0), {_LAST.format("tx")})"""
_STAGE_VALUE = f"""CASE WHEN len(es) > 0 THEN CASE WHEN status[len(es)] = 'double_count' THEN carried[len(es)]
    WHEN tag IS NOT NULL THEN tag ELSE carried[({_TERMINAL.format(total="total")}) + 1] END ELSE tag END"""


def _verify_inline(source: str) -> str:
    """The verification CTEs as nested subqueries (for use inside a recursive member)."""
    import re as _re

    text = verify_sql(source, "stage")
    bodies = _re.findall(r"stage(?:_\d)? AS \(\n(.*?)\n\)", text, _re.S)
    first = bodies[0]
    second = bodies[1].replace("FROM stage_1", f"FROM ({first})")
    return bodies[2].replace("FROM stage_2", f"FROM ({second})")


# One recursion step per chunk position: all problems at once, carrying the running total.
FOLD = f"""
recorded AS (
  SELECT model, problem_id, any_value(seed) AS seed, any_value(depth) AS depth, any_value(gold) AS gold, chunk_idx,
         list(response ORDER BY attempt) AS texts FROM attempts GROUP BY model, problem_id, chunk_idx
),
fold AS (
  SELECT model, problem_id, seed, depth, gold, -1 AS chunk_idx, CAST(NULL AS DOUBLE) AS total, '' AS method, 0 AS retries,
         CAST([] AS VARCHAR[]) AS status FROM recorded WHERE chunk_idx = 0
  UNION ALL
  SELECT model, problem_id, seed, depth, gold, chunk_idx, coalesce(value, number, total),
         CASE WHEN usable AND value IS NULL AND number IS NOT NULL THEN 'emergency_fallback' WHEN usable THEN 'arithmetic'
              WHEN number IS NOT NULL THEN 'last_number' ELSE 'failed' END,
         retries, status
  FROM (SELECT *, {_STAGE_VALUE} AS value, {_LAST_OR_RATIO} AS number FROM ({_verify_inline(f'''(
    SELECT *, {_TAG} AS tag, {_chunk_expressions_sql(_READ)} AS es FROM (
      SELECT *, texts[coalesce(found, len(texts))] AS tx, found IS NOT NULL AS usable, CAST(coalesce(found - 1, len(texts)) AS INT) AS retries
      FROM (SELECT r.*, f.total, list_filter(list_transform(r.texts, lambda tx, i: CASE WHEN {_TAG} IS NOT NULL
                   OR regexp_matches(replace(tx, 'current_total', coalesce(CAST(f.total AS VARCHAR), 'current_total')), '{_BINARY}') THEN i END),
                   lambda x: x IS NOT NULL)[1] AS found
            FROM fold f JOIN recorded r ON r.model = f.model AND r.problem_id = f.problem_id AND r.chunk_idx = f.chunk_idx + 1)))''')}))
),
chunk_rows AS (SELECT * FROM fold WHERE chunk_idx >= 0),
chunk_results AS (
  SELECT model, problem_id, any_value(seed) AS seed, any_value(depth) AS depth, any_value(gold) AS gold,
         count(*) AS num_chunks, max_by(total, chunk_idx) AS predicted,
         sum(len(status)) AS total_expressions_checked, sum(len(list_filter(status, lambda s: s = 'corrected'))) AS corrections_applied,
         count(*) FILTER (method = 'failed') AS extraction_failures, count(*) FILTER (method = 'last_number') AS unverified_fallbacks,
         coalesce(abs(max_by(total, chunk_idx) - any_value(gold)) <= 0.01, FALSE) AS correct
  FROM chunk_rows GROUP BY model, problem_id
)"""


def fold_sql(*parts: str) -> str:
    return with_views(PROBLEMS, ATTEMPTS, FOLD, *parts)


def results(spark, d, contexts: bool = True) -> DataFrame:
    """Verified chunk results of the recorded attempts."""
    nested = K.nest_attempts(attempts(spark, d), ["model", "problem_id"], ["seed", "depth", "gold"])
    return K.verify_solutions(nested, contexts=contexts)


def chunk_rows(spark, d, contexts: bool = False) -> DataFrame:
    """One row per chunk; what was known before and after it only where it is asked for."""
    return K.explode_logs(results(spark, d, contexts).select("model", "problem_id", "seed", "depth", "chunk_logs"))


@query(
    "w6_chunk_fold",
    fold_sql("""SELECT model, problem_id, CAST(num_chunks AS INT) AS num_chunks, round(predicted, 6) AS predicted, correct
        FROM chunk_results"""),
)
def chunk_fold(spark, d):
    return results(spark, d).select(
        "model", "problem_id", "num_chunks", F.round(F.col("predicted").cast("double"), 6).alias("predicted"), "correct"
    )


@query(
    "a27_log_rollup",
    fold_sql("""SELECT model, problem_id, CAST(total_expressions_checked AS INT) AS total_expressions_checked,
        CAST(corrections_applied AS INT) AS corrections_applied, CAST(extraction_failures AS INT) AS extraction_failures,
        CAST(unverified_fallbacks AS INT) AS unverified_fallbacks FROM chunk_results"""),
)
def log_rollup(spark, d):
    return results(spark, d).select(
        "model", "problem_id", "total_expressions_checked", "corrections_applied", "extraction_failures", "unverified_fallbacks"
    )


@query(
    "x29_chunk_value",
    fold_sql("""SELECT model, chunk_idx, method AS extraction_method, count(*) AS n, round(sum(total), 2) AS total FROM chunk_rows
        WHERE method <> 'failed' GROUP BY ALL"""),
)
def chunk_value(spark, d):
    rows = chunk_rows(spark, d).filter(F.col("extraction_method") != "failed")
    return rows.groupBy("model", "chunk_idx", "extraction_method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("chunk_value"), 2).alias("total")
    )


@query(
    "w4_retry_selection",
    fold_sql("SELECT model, retries AS num_retries, method AS extraction_method, count(*) AS n FROM chunk_rows GROUP BY ALL"),
)
def retry_selection(spark, d):
    return chunk_rows(spark, d).groupBy("model", "num_retries", "extraction_method").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w3_double_count_lookback",
    fold_sql("""SELECT model, s AS status, count(*) AS n FROM (SELECT model, unnest(status) AS s FROM chunk_rows) GROUP BY ALL"""),
)
def double_count(spark, d):
    statuses = chunk_rows(spark, d).select("model", F.explode_outer("verification_log.status").alias("status"))
    return statuses.filter(F.col("status").isNotNull()).groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x37_context_update",
    fold_sql("""SELECT model, chunk_idx, count(*) AS n, CAST(count(total) AS BIGINT) AS n_known, round(sum(total), 2) AS total
        FROM chunk_rows GROUP BY ALL"""),
)
def context_update(spark, d):
    total = F.try_element_at("context_after", F.lit("current_total"))
    return chunk_rows(spark, d, contexts=True).groupBy("model", "chunk_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count(total).alias("n_known"), F.round(F.sum(total), 2).alias("total")
    )


# --- diagnostics of chunk results -----------------------------------------------------------------------------

_MEANS = """round(avg(corrections_applied), 6) AS corrections_per_prob, round(avg(unverified_fallbacks), 6) AS {fallbacks},
    round(avg(extraction_failures), 6) AS ext_fail_per_prob"""


@query(
    "a6_chunk_diagnostics",
    fold_sql(f"""SELECT model, depth, {_MEANS.format(fallbacks="fallbacks_per_prob")}, round(avg(num_chunks), 6) AS chunks_per_prob
        FROM chunk_results GROUP BY model, depth"""),
)
def chunk_diagnostics(spark, d):
    out = A.chunk_diagnostics(results(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_per_prob")})


@query(
    "a7_run_summary",
    fold_sql(f"""SELECT depth, CAST(grouping(depth) AS INT) AS is_total, count(*) AS n, CAST(count(*) FILTER (correct) AS BIGINT) AS k,
        CAST(sum(corrections_applied) AS BIGINT) AS corrections, {_MEANS.format(fallbacks="unverified_per_prob")},
        round(count(*) FILTER (correct) / count(*), 6) AS acc FROM chunk_results GROUP BY ROLLUP (depth)"""),
)
def run_summary(spark, d):
    out = A.run_summary(results(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in [*[c for c in out.columns if c.endswith("_per_prob")], "acc"]})


_NAMES = ("corrections_per_prob", "fallbacks_per_prob", "ext_fail_per_prob", "chunks_per_prob")


@query(
    "a12_diagnostics_across_seeds",
    fold_sql("""
runs AS (SELECT seed, model, depth, avg(corrections_applied) AS corrections_per_prob, avg(unverified_fallbacks) AS fallbacks_per_prob,
                avg(extraction_failures) AS ext_fail_per_prob, avg(num_chunks) AS chunks_per_prob FROM chunk_results GROUP BY ALL)""",
        "SELECT model, depth, " + ", ".join(
            f"round(avg({n}), 6) AS mean_{n}, round(coalesce(stddev_samp({n}), 0.0), 6) AS std_{n}" for n in _NAMES
        ) + " FROM runs GROUP BY model, depth"),
)
def diagnostics_across_seeds(spark, d):
    out = S.diagnostics_across_seeds(results(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_per_prob")})


@query(
    "a23_corrections_table",
    fold_sql("SELECT 'd' || depth AS Depth, " + ", ".join(
        f"printf('%.3f', round(avg({c}) FILTER (model = '{m}'), 3)) AS \"{label} - {t}\""
        for m, label in (("m0", "Model Zero"), ("m1", "m1"), ("m2", "m2"))
        for c, t in (("corrections_applied", "Corrections"), ("unverified_fallbacks", "Fallbacks"))
    ) + " FROM chunk_results GROUP BY depth"),
)
def corrections_table(spark, d):
    return A.corrections_table(results(spark, d), MODELS, {"m0": "Model Zero"})


@query(
    "j8_chunked_delta",
    fold_sql("""SELECT model, depth, round(b, 6) AS acc_base, round(m, 6) AS acc_method, round(m - b, 6) AS delta FROM (
        SELECT model, depth, avg((right(CAST(gold AS VARCHAR), 1) <> '7')::INT) AS b, avg(correct::INT) AS m FROM chunk_results GROUP BY ALL)"""),
)
def chunked_delta(spark, d):
    chunked = results(spark, d).select("model", F.lit("chunked").alias("method"), "depth", "correct", "gold")
    base = chunked.withColumns({"method": F.lit("cot"), "correct": F.right(F.col("gold").cast("string"), F.lit(1)) != "7"})
    both = J.stack_methods(base, chunked)
    out = J.method_delta(A.accuracy(both))
    return out.withColumns({c: F.round(c, 6) for c in ("acc_base", "acc_method", "delta")})
