"""Queries over problem text: clauses, chunk routing, distractors, filter responses, prompts, generated problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as X
from ..functions import fixed as V
from ..functions import prompts as T
from ..operators import chunks as K
from ..operators import generate as G
from ..operators import scoring as P
from ..operators import two_stage as Z
from ..session import spread
from ..sources.json_tables import distract, pick_distractor
from .answer_plans import LINES, lines, strip_sql
from .derived import MODELS, NL, PROBLEMS, problems, with_views
from .registry import query, table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clauses_sql(x: str) -> str:
    marked = rf"regexp_replace(replace({x}, {NL}, '. '), '([.?!])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda c: {strip_sql('c')}), lambda c: length(c) > 2)"


def draw_sql(size: str, *parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {size})"


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# --- clauses and chunks -----------------------------------------------------------------------------------


@query(
    "x24_split_clauses",
    f"""SELECT doc_id, len(cs) AS n_clauses, md5(array_to_string(cs, '|')) AS clauses
        FROM (SELECT doc_id, {clauses_sql("text")} AS cs FROM documents)""",
)
def split_clauses(spark, d):
    cs = documents(spark, d).select("doc_id", X.split_clauses("text").alias("cs"))
    return cs.select(
        "doc_id", F.size("cs").cast("bigint").alias("n_clauses"), digest(F.array_join("cs", "|")).alias("clauses")
    )


@query(
    "x25_group_clauses",
    f"""SELECT doc_id, len(gs) AS n_groups, len(gs[-1]) AS last_size,
        md5(array_to_string(list_transform(gs, lambda g: array_to_string(g, '|')), '##')) AS groups
        FROM (SELECT doc_id, list_transform(range(1, len(cs) + 1, 3), lambda i: cs[i:i + 2]) AS gs
              FROM (SELECT doc_id, {clauses_sql("text")} AS cs FROM documents))""",
)
def group_clauses(spark, d):
    gs = documents(spark, d).select("doc_id", X.group_clauses(X.split_clauses("text"), 3).alias("gs"))
    joined = F.array_join(F.transform("gs", lambda g: F.array_join(g, "|")), "##")
    return gs.select(
        "doc_id",
        F.size("gs").cast("bigint").alias("n_groups"),
        F.nullif(F.size(F.try_element_at("gs", F.lit(-1))), F.lit(-1)).cast("bigint").alias("last_size"),
        digest(joined).alias("groups"),
    )


_GOALS = """CASE k % 6 WHEN 0 THEN 'How much' WHEN 1 THEN 'What  is' WHEN 2 THEN 'Find the' WHEN 3 THEN 'So how many'
    WHEN 4 THEN 'how many = ' ELSE 'How many' END"""
_ASKED = f"replace(question, 'How many', {_GOALS})"
_GOAL_SQL = r"(regexp_matches(c, '(?i)^\s*(?:how\s+(?:much|many)|what\s+is|find\s+(?:the|how))') AND NOT contains(c, '='))"


def asked(spark, d) -> DataFrame:
    return problems(spark, d).withColumn("question", F.expr(_ASKED))


ASKED = f"asked AS (SELECT * REPLACE ({_ASKED} AS question) FROM problems)"


@query(
    "p12_goal_clauses",
    with_views(PROBLEMS, ASKED, f"""SELECT depth, k % 6 AS kind, count(*) AS n_clauses,
        CAST(count(*) FILTER ({_GOAL_SQL}) AS BIGINT) AS n_goals
        FROM (SELECT k, depth, unnest({clauses_sql("question")}) AS c FROM asked) GROUP BY ALL"""),
)
def goal_clauses(spark, d):
    rows = asked(spark, d).select("k", "depth", F.explode_outer(X.split_clauses("question")).alias("c"))
    return rows.groupBy("depth", (F.col("k") % 6).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_clauses"), F.count_if(X.is_goal_clause("c")).alias("n_goals")
    )


def _chunked(size: str) -> str:
    return f"""
parts AS (SELECT problem_id, {size} AS size, cs, list_filter(cs, lambda c: NOT {_GOAL_SQL}) AS facts,
                 list_filter(cs, lambda c: {_GOAL_SQL}) AS goals
          FROM (SELECT *, {clauses_sql("question")} AS cs FROM asked)),
asks AS (SELECT *, CASE WHEN len(goals) > 0 THEN goals ELSE [{quoted(V.GOAL_FALLBACK)}] END AS gs FROM parts),
routed AS (
  SELECT problem_id, CAST(len(cs) AS INT) AS num_clauses, CASE WHEN len(facts) <= size THEN [list_concat(facts, gs)]
    ELSE list_transform(range(1, len(facts) + 1, size), lambda i: list_append(facts[i:i + size - 1],
         CASE WHEN i + size > len(facts) THEN gs[1] ELSE {quoted(V.RUNNING_TOTAL_CLAUSE)} END)) END AS chunks
  FROM asks
)"""


_CHUNKED = _chunked("2 + k % 3")
#: Two models with a chunk size of their own and one without, dealt to the problems by their key.
_SIZED_MODELS = ["qwen25_math_1.5b", "gemma4_e2b", "another_model"]


def routed(spark, d) -> DataFrame:
    rows = asked(spark, d).withColumn("size", F.expr("cast(2 + k % 3 as int)"))
    return K.plan_chunks(rows, "question", F.col("size")).select("problem_id", "num_clauses", "chunks")


@query(
    "x26_route_chunks",
    with_views(PROBLEMS, ASKED, _CHUNKED, """SELECT problem_id, num_clauses, CAST(len(chunks) AS INT) AS num_chunks,
        array_to_string(list_transform(chunks, lambda g: array_to_string(g, '|')), '##') AS chunks FROM routed"""),
)
def route_chunks(spark, d):
    return routed(spark, d).select(
        "problem_id", "num_clauses", F.size("chunks").alias("num_chunks"),
        F.array_join(F.transform("chunks", lambda g: F.array_join(g, "|")), "##").alias("chunks"),
    )


@query(
    "x26_chunk_size_by_model",
    with_views(PROBLEMS, ASKED, _chunked("CASE WHEN k % 3 = 1 THEN 4 ELSE 2 END"),
               "SELECT problem_id, num_clauses, CAST(len(chunks) AS INT) AS num_chunks FROM routed"),
)
def chunk_size_by_model(spark, d):
    names = F.array(*[F.lit(m) for m in _SIZED_MODELS])
    rows = asked(spark, d).withColumn("model", F.get(names, (F.col("k") % 3).cast("int")))
    planned = K.plan_chunks(rows, "question", K.chunk_size("model"))
    return planned.select("problem_id", "num_clauses", F.size("chunks").alias("num_chunks"))


@query(
    "w2_numbered_clauses",
    with_views(PROBLEMS, ASKED, _CHUNKED, f"""SELECT problem_id, CAST(i - 1 AS INT) AS chunk_idx,
        array_to_string(list_transform(chunks[i], lambda c, j: j || '. ' || c), {NL}) AS chunk_text
        FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM routed)"""),
)
def numbered_clauses(spark, d):
    return K.explode_chunks(routed(spark, d)).select("problem_id", "chunk_idx", "chunk_text")


_NAMED = """CASE v WHEN 0 THEN 'then Bob has ' || q || ' Apples' WHEN 1 THEN 'Eve pays ' || p WHEN 2 THEN 'no name ' || q || ' dollars'
    WHEN 3 THEN 'the A1 and Tom take 3 MILES' WHEN 4 THEN 'nothing' ELSE 'Ann Lee sold hourly items' END"""


@query(
    "x27_variable_name",
    with_views(LINES, rf"""SELECT name, count(*) AS n FROM (SELECT CASE
          WHEN a <> '' AND u <> '' THEN a || '_' || u WHEN a <> '' THEN a || '_value' ELSE 'step_' || (q + 1) || '_result' END AS name
        FROM (SELECT q, lower(regexp_extract(t, '\b([A-Z][a-z]+)\b', 1)) AS a,
                     lower(regexp_extract(t, '(?i)(dollar|apple|book|hour|mile|cookie|point|item)s?')) AS u
              FROM (SELECT q, {_NAMED} AS t FROM lines))) GROUP BY name"""),
)
def variable_name(spark, d):
    named = lines(spark, d).select(X.variable_name(F.expr(_NAMED), "q").alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x36_context_snapshot",
    with_views(LINES, """SELECT n_keys, keys, round(sum(total), 2) AS total, count(*) AS n FROM (
        SELECT len(ks) AS n_keys, array_to_string(list_sort(ks), ',') AS keys, CAST(q AS DOUBLE) * 1.5 AS total FROM (
          SELECT q, list_filter(['__last__', q || '.5', 'current_total', 'bob_' || v], lambda x:
                 NOT starts_with(x, '__') AND TRY_CAST(x AS DOUBLE) IS NULL) AS ks FROM lines)) GROUP BY ALL"""),
)
def context_snapshot(spark, d):
    total = F.col("q") * F.lit(1.5)
    context = F.create_map(
        F.lit("__last__"), total, F.expr("q || '.5'"), total, F.lit("current_total"), total, F.expr("'bob_' || v"), total
    )
    snap = lines(spark, d).select(X.context_snapshot(context).alias("m"))
    keys = F.array_join(F.array_sort(F.map_keys("m")), ",")
    return snap.groupBy(F.size("m").cast("bigint").alias("n_keys"), keys.alias("keys")).agg(
        F.round(F.sum(F.element_at("m", "current_total")), 2).alias("total"), F.count(F.lit(1)).alias("n")
    )


_DOCUMENT_PARTS = f"""
parts AS (SELECT doc_id, cs, len(list_filter(cs, lambda c: NOT {_GOAL_SQL})) AS n_facts
          FROM (SELECT doc_id, {clauses_sql("text")} AS cs FROM documents))"""


@query(
    "f2_field_names",
    with_views(_DOCUMENT_PARTS, """SELECT doc_id, CAST(len(cs) AS INT) AS num_clauses,
        CAST(greatest(1, ceil(n_facts / 3)) AS INT) AS num_chunks FROM parts"""),
)
def field_names(spark, d):
    planned = K.plan_chunks(documents(spark, d), problem="text", size=3)
    return planned.select("doc_id", "num_clauses", F.size("chunks").alias("num_chunks"))


# --- distractors ------------------------------------------------------------------------------------------

_POOL_ITEM = (
    "CASE WHEN (k + j) % 3 = 0 THEN 'Bare fact ' || j || '...' ELSE '{\"type\":\"TYPE_' || "
    "substr('ABCD', CAST(1 + (k + j) % 4 AS INT), 1) || '\",\"text\":\"The clerk took ' || (k % 90 + j) || ' minutes.\"}' END"
)


def pools(spark, d) -> DataFrame:
    """Templates with pools of zero to three elements."""
    return (
        problems(spark, d)
        .withColumn("size", F.expr("cast(k % 4 as int)"))
        .withColumn(
            "dynamic_distractor_pool",
            F.expr(f"CASE WHEN size > 0 THEN transform(sequence(1, size), j -> {_POOL_ITEM}) ELSE cast(array() as array<string>) END"),
        )
        .select(
            "k", "problem_id", "question", F.expr("'#### ' || gold").alias("answer"),
            F.col("k").cast("int").alias("id_orig"), F.col("depth").alias("id_shuffled"), "dynamic_distractor_pool",
            F.expr("problem_id || '.json'").alias("source_file"),
        )
    )


POOLS = f"""
pools AS (
  SELECT k, problem_id, question, '#### ' || gold AS answer, problem_id || '.json' AS source_file,
         list_transform(range(1, k % 4 + 1), lambda j: {_POOL_ITEM}) AS pool FROM problems
),
picked AS (
  SELECT *, CASE WHEN el[1] = '{{' THEN json_extract_string(el, '$.text') ELSE el END AS distractor,
         CASE WHEN el[1] = '{{' THEN json_extract_string(el, '$.type') ELSE 'UNKNOWN' END AS distractor_type
  FROM (SELECT *, pool[{draw_sql("len(pool)", "'42'", "source_file")} + 1] AS el FROM pools WHERE len(pool) > 0)
)"""
_LAST_START = r"regexp_extract(question, '^(.*[.!])\s+([^.!]*)$', {})"
DISTRACTED = rf"""
distracted AS (
  SELECT source_file, question AS question_original, distractor, distractor_type, answer,
         {_LAST_START.format(1)} || ' ' || regexp_replace(distractor, '\.+$', '') || '. ' || {_LAST_START.format(2)} AS question
  FROM picked
)"""


@query(
    "x2_seeded_pick",
    with_views(PROBLEMS, POOLS, "SELECT source_file, distractor, distractor_type FROM picked"),
)
def seeded_pick(spark, d):
    rows = pools(spark, d).filter(F.size("dynamic_distractor_pool") > 0)
    return pick_distractor(rows).select("source_file", "distractor", "distractor_type")


@query(
    "x1_inject_distractor",
    with_views(PROBLEMS, POOLS, DISTRACTED, "SELECT source_file, question, distractor, question_original FROM distracted"),
)
def inject_distractor(spark, d):
    rows = pools(spark, d).filter(F.size("dynamic_distractor_pool") > 0)
    return distract(rows).select("source_file", "question", "distractor", "question_original")


@query(
    "x1_inject_at_end",
    with_views(PROBLEMS, POOLS, r"""SELECT source_file,
        left(question, length(question) - 1) || ', ' || regexp_replace(distractor, '\.+$', '') || '?' AS question FROM picked"""),
)
def inject_at_end(spark, d):
    rows = pools(spark, d).filter(F.size("dynamic_distractor_pool") > 0)
    return distract(rows, position="end").select("source_file", "question")


@query(
    "p3_nonempty_pool",
    with_views(PROBLEMS, POOLS, """SELECT len(pool) > 0 AS kept, count(*) AS n FROM pools GROUP BY 1"""),
)
def nonempty_pool(spark, d):
    return pools(spark, d).groupBy((F.size("dynamic_distractor_pool") > 0).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


_POOL_TEXT = """CASE k % 5 WHEN 0 THEN '[' || array_join(dynamic_distractor_pool_json, ',') || ']' WHEN 1 THEN '{"text":"x"}'
    WHEN 2 THEN 'oops [' WHEN 3 THEN '[{"type":"TYPE_A","text":"t' || k || '"},{"text":"u"}]' ELSE NULL END"""


@query(
    "x35_parse_pool",
    with_views(PROBLEMS, """SELECT problem_id, CASE k % 5 WHEN 0 THEN depth WHEN 3 THEN 2 ELSE 0 END AS n_elements,
        CASE k % 5 WHEN 0 THEN 'w' || (k + 1) WHEN 3 THEN 't' || k END AS first_text,
        CASE k % 5 WHEN 0 THEN 'UNKNOWN' WHEN 3 THEN 'TYPE_A' END AS first_type FROM problems"""),
)
def parse_pool(spark, d):
    words = F.expr("""transform(sequence(1, depth), j -> '"w' || (k + j) || '"')""")
    rows = problems(spark, d).withColumn("dynamic_distractor_pool_json", words)
    parsed = rows.select("problem_id", X.parse_pool(F.expr(_POOL_TEXT)).alias("pool"))
    return parsed.select(
        "problem_id", F.size("pool").alias("n_elements"), F.get("pool", F.lit(0))["text"].alias("first_text"),
        F.get("pool", F.lit(0))["type"].alias("first_type"),
    )


@query(
    "p9_stable_id",
    with_views(PROBLEMS, """SELECT k, CASE WHEN k % 3 <> 0 THEN problem_id WHEN k % 4 <> 0 THEN problem_id || '.json'
        ELSE printf('prob_%04d', k) END AS stable_id FROM problems"""),
)
def stable_id(spark, d):
    rows = problems(spark, d).select(
        "k", F.expr("CASE WHEN k % 3 <> 0 THEN problem_id END").alias("problem_id"),
        F.expr("CASE WHEN k % 4 <> 0 THEN 'p' || k || '.json' END").alias("source_file"),
    )
    return rows.select("k", P.stable_id(rows, "k", "problem_id", "source_file").alias("stable_id"))


# --- two-stage filter -------------------------------------------------------------------------------------

_TYPE = "CASE doc_id % 5 WHEN 4 THEN NULL ELSE 'TYPE_' || substr('ABCD', CAST(1 + doc_id % 5 AS INT), 1) END"
_LABEL = "CASE WHEN (i + doc_id) % 3 = 0 THEN ' | IRRELEVANT' ELSE ' | relevant' END"


def labelled_documents(spark, d) -> DataFrame:
    """Documents as distracted questions with a labelling response; the distractor is one of the clauses."""
    return (
        documents(spark, d)
        .withColumn("cs", X.split_clauses("text"))
        .withColumn(
            "filter_response",
            F.expr(
                "CASE WHEN doc_id % 7 = 0 THEN 'no labels' ELSE array_join(transform(cs, (c, i) -> "
                f"'Clause ' || (i + 1) || ': ' || c || {_LABEL.replace('(i ', '(i + 1 ')}), {NL}) END"
            ),
        )
        .withColumn("distractor", F.get("cs", G.draw(F.size("cs"), F.lit("7"), F.col("doc_id"))))
        .select(
            F.expr("'d' || doc_id").alias("problem_id"), "doc_id", F.col("text").alias("question"), "filter_response",
            "distractor", F.expr(_TYPE).alias("distractor_type"), F.expr("'#### ' || doc_id").alias("answer"),
        )
    )


LABELLED = rf"""
labelled AS (
  SELECT doc_id, text AS question, cs, CASE WHEN doc_id % 7 = 0 THEN 'no labels' ELSE array_to_string(
           list_transform(cs, lambda c, i: 'Clause ' || i || ': ' || c || {_LABEL}), {NL}) END AS filter_response,
         CASE WHEN len(cs) > 0 THEN cs[{draw_sql("len(cs)", "'7'", "doc_id")} + 1] END AS distractor, {_TYPE} AS distractor_type
  FROM (SELECT doc_id, text, {clauses_sql("text")} AS cs FROM documents)
),
parsed AS (
  SELECT *, list_filter(ls, lambda x: x[3] <> '') AS found FROM (
    SELECT *, list_transform(list_transform(string_split(filter_response, {NL}), lambda s: {strip_sql("s")}), lambda s:
      [s, {strip_sql(r"regexp_extract(s, '(?i)^clause\s*\d+\s*:\s*([^\n]+?)\s*\|\s*(RELEVANT|IRRELEVANT)', 1)")},
       upper(regexp_extract(s, '(?i)^clause\s*\d+\s*:\s*([^\n]+?)\s*\|\s*(RELEVANT|IRRELEVANT)', 2))]) AS ls FROM labelled)
),
filtered AS (
  SELECT *, list_transform(list_filter(found, lambda x: x[3] = 'RELEVANT'), lambda x: x[2]) AS relevant,
         list_transform(list_filter(found, lambda x: x[3] = 'IRRELEVANT'), lambda x: x[2]) AS irrelevant FROM parsed
)"""
_DETECTED = f"""(coalesce(distractor, '') <> '' AND len(list_filter(irrelevant, lambda c:
    contains(lower(c), lower({strip_sql("distractor")})) OR contains(lower({strip_sql("distractor")}), lower(c)))) > 0)"""


@query(
    "x33_filter_lines",
    with_views(LABELLED, """SELECT doc_id, len(relevant) AS n_relevant, len(irrelevant) AS n_irrelevant,
        md5(array_to_string(relevant, '|')) AS relevant, md5(array_to_string(irrelevant, '|')) AS irrelevant FROM filtered"""),
)
def filter_lines(spark, d):
    rows = Z.filter_records(labelled_documents(spark, d))
    return rows.select(
        "doc_id",
        F.size("relevant_clauses").cast("bigint").alias("n_relevant"),
        F.size("irrelevant_clauses").cast("bigint").alias("n_irrelevant"),
        digest(F.array_join("relevant_clauses", "|")).alias("relevant"),
        digest(F.array_join("irrelevant_clauses", "|")).alias("irrelevant"),
    )


@query(
    "x34_clean_problem",
    with_views(LABELLED, """SELECT doc_id, len(relevant) = 0 AS filter_failed,
        md5(CASE WHEN len(relevant) = 0 THEN question ELSE array_to_string(relevant, ' ') END) AS clean_problem FROM filtered"""),
)
def clean_problem(spark, d):
    rows = Z.filter_records(labelled_documents(spark, d))
    return rows.select("doc_id", "filter_failed", digest(F.col("clean_problem")).alias("clean_problem"))


@query("j11_distractor_contained", with_views(LABELLED, f"SELECT doc_id, {_DETECTED} AS detected FROM filtered"))
def distractor_contained(spark, d):
    rows = Z.filter_records(labelled_documents(spark, d))
    return rows.select("doc_id", X.distractor_detected("distractor", "irrelevant_clauses").alias("detected"))


@query(
    "a18_detection_table",
    with_views(LABELLED, f"""
hits AS (SELECT coalesce(distractor_type, 'UNKNOWN') AS t, {_DETECTED} AS hit FROM filtered)""",
        """SELECT CASE WHEN grouping(t) = 1 THEN 'OVERALL' ELSE t END AS distractor_type,
        CASE WHEN grouping(t) = 1 THEN '' ELSE CASE t WHEN 'TYPE_A' THEN 'Scope Confusion' WHEN 'TYPE_B' THEN 'Wrong Formula'
             WHEN 'TYPE_C' THEN 'Unit Trap' WHEN 'TYPE_D' THEN 'Temporal Misdirection' ELSE t END END AS description,
        count(*) AS n, CAST(count(*) FILTER (hit) AS BIGINT) AS detected, round(count(*) FILTER (hit) / count(*), 6) AS rate
        FROM hits GROUP BY ROLLUP (t)"""),
)
def detection_table(spark, d):
    table_ = Z.detection_table(Z.filter_records(labelled_documents(spark, d)))
    return table_.withColumn("rate", F.round("rate", 6))


def solved(spark, d) -> DataFrame:
    """Filter records joined to their examples and three recorded solver answers each."""
    examples = labelled_documents(spark, d)
    records = Z.filter_records(examples.select("problem_id", "question", "filter_response")).select(
        "problem_id", "filter_failed", "clean_problem", "n_relevant", "n_irrelevant"
    )
    joined = Z.attach_filter(examples.select("problem_id", "doc_id", "answer", "distractor", "distractor_type"), records)
    solvers = ", ".join(f"named_struct('solver_model', '{m}', 'model_idx', {i})" for i, m in enumerate(MODELS))
    answers = joined.selectExpr("*", f"inline(array({solvers}))").withColumn(
        "solve_response",
        F.expr("CASE WHEN (doc_id + model_idx) % 4 = 0 THEN 'The answer is ' || (doc_id + 1) ELSE 'so #### ' || doc_id END"),
    )
    return Z.score_solutions(answers)


SOLVED = """
solved AS (
  SELECT *, (doc_id + model_idx) % 4 <> 0 AS ok, len(relevant) = 0 AS failed
  FROM filtered, (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(solver_model, model_idx)
)"""


@query(
    "a16_filter_summary",
    with_views(LABELLED, SOLVED, """SELECT solver_model, count(*) AS n, round(avg(ok::INT), 6) AS accuracy,
        CAST(count(*) FILTER (NOT failed) AS BIGINT) AS n_filter_ok, round(avg(ok::INT) FILTER (NOT failed), 6) AS acc_filter_ok,
        CAST(count(*) FILTER (failed) AS BIGINT) AS n_filter_failed, round(avg(ok::INT) FILTER (failed), 6) AS acc_filter_failed,
        round(avg(failed::INT), 6) AS fail_rate, round(avg(len(relevant)), 6) AS avg_relevant,
        round(avg(len(irrelevant)), 6) AS avg_irrelevant FROM solved GROUP BY solver_model"""),
)
def filter_summary(spark, d):
    out = Z.filter_summary(solved(spark, d))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles})


@query(
    "a17_accuracy_by_type",
    with_views(LABELLED, SOLVED, """SELECT solver_model, coalesce(distractor_type, 'UNKNOWN') AS distractor_type, count(*) AS n,
        CAST(count(*) FILTER (ok) AS BIGINT) AS k, round(count(*) FILTER (ok) / count(*), 6) AS acc FROM solved GROUP BY ALL"""),
)
def accuracy_by_type(spark, d):
    return Z.accuracy_by_type(solved(spark, d)).withColumn("acc", F.round("acc", 6))


@query(
    "j4_example_filter_join",
    with_views(LABELLED, """SELECT 'd' || doc_id AS problem_id, distractor_type, len(relevant) = 0 AS filter_failed FROM filtered"""),
)
def example_filter_join(spark, d):
    examples = labelled_documents(spark, d)
    records = Z.filter_records(examples).select("problem_id", "filter_failed")
    return Z.attach_filter(examples.select("problem_id", "distractor_type"), records)


# --- prompts ----------------------------------------------------------------------------------------------

_CHUNK_PARTS = V.CHUNK_PROMPT.split("%s")
_FILTER_TEMPLATE = "Label every clause RELEVANT or IRRELEVANT.\nProblem:\n{problem}\n"
_SQL_PROMPTS = {
    "direct": (quoted(V.SYSTEM_DIRECT), "question"),
    "cot": (quoted(V.SYSTEM_COT), f"question || {quoted(V.COT_SUFFIX)}"),
    "filter": (quoted(V.SYSTEM_FILTER), f"'Label every clause RELEVANT or IRRELEVANT.' || {NL} || 'Problem:' || {NL} || question || {NL}"),
    "solve": (quoted(V.SYSTEM_SOLVE), f"question || {quoted(V.SOLVE_SUFFIX)}"),
    "chunk": (
        quoted(V.SYSTEM_CHUNK),
        f"""'Known values:' || {NL} || CASE WHEN k % 2 = 0 THEN 'current_total = ' || gold || '.5' || {quoted(V.CONTEXT_NOTE)}
        ELSE {quoted(V.NO_CONTEXT)} END || {quoted(_CHUNK_PARTS[1])} || '1. ' || question || {quoted(_CHUNK_PARTS[2])} ||
        CASE WHEN k % 2 = 0 THEN {quoted(V.CHUNK_REMINDER)} ELSE '' END || {quoted(_CHUNK_PARTS[3])}""",
    ),
}


@query(
    "p10_prompt_table",
    with_views(PROBLEMS, " UNION ALL ".join(
        f"SELECT problem_id, '{kind}' AS kind, md5({system}) AS system_prompt, md5({user}) AS user_prompt FROM problems"
        for kind, (system, user) in _SQL_PROMPTS.items()
    )),
)
def prompt_table(spark, d):
    total = F.when(F.col("k") % 2 == 0, F.col("gold") + F.lit(0.5))
    prompts = {
        "direct": (T.system_prompt(F.lit("direct")), T.direct_prompt("question")),
        "cot": (T.system_prompt(F.lit("cot")), T.cot_prompt("question")),
        "filter": (F.lit(V.SYSTEM_FILTER), T.filter_prompt("question", _FILTER_TEMPLATE)),
        "solve": (F.lit(V.SYSTEM_SOLVE), T.solve_prompt("question")),
        "chunk": (F.lit(V.SYSTEM_CHUNK), T.chunk_prompt(F.array("question"), total)),
    }
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("kind"), digest(s).alias("system_prompt"), digest(u).alias("user_prompt"))
                for k, (s, u) in prompts.items()
            ]
        )
    )
    return problems(spark, d).select("problem_id", rows)


# --- generated problems -----------------------------------------------------------------------------------

_KEY = "CAST(depth * 10000 + idx AS VARCHAR)"


def _shuffle_sql(tag: str, count: str) -> str:
    pairs = f"list_transform(range(1, {count} + 1), lambda j: {{'h': md5(key || '|{tag}|' || j), 'j': j}})"
    return f"list_transform(list_sort({pairs}), lambda s: s.j)"


def _pick_sql(words: list, tag: str, step: str) -> str:
    listed = ", ".join(quoted(w) if isinstance(w, str) else str(w) for w in words)
    return f"[{listed}][{draw_sql(str(len(words)), 'key', quoted(tag), step)} + 1]"


def _between_sql(low: int, high: int, tag: str, step: str = "i") -> str:
    return f"({draw_sql(str(high - low + 1), 'key', quoted(tag), step)} + {low})"


GENERATED = f"""
seeds AS (
  SELECT *, {_pick_sql(V.ACTORS, "actor", "0")} AS actor, {_shuffle_sql("op", "8")} AS ops,
         list_transform({_shuffle_sql("item", "greatest(depth, 2)")}, lambda j: [{", ".join(quoted(w) for w in V.ITEMS)}][(j - 1) % 8 + 1]) AS items
  FROM (SELECT *, {_KEY} AS key FROM (SELECT CAST(1 + o_custkey % 8 AS INT) AS depth, o_orderkey AS idx FROM orders))
),
walk AS (
  SELECT key, depth, idx, actor, ops, items, 0 AS i, CAST({_between_sql(10, 30, "rate", "0")} * {_between_sql(5, 15, "hours", "0")} AS BIGINT) AS num,
         CAST(1 AS BIGINT) AS den, 0 AS used,
         actor || ' ' || {_pick_sql(V.JOBS, "job", "0")} || ' $' || {_between_sql(10, 30, "rate", "0")} || ' per hour and works ' ||
         {_between_sql(5, 15, "hours", "0")} || ' hours.' AS body, '' AS steps
  FROM seeds
  UNION ALL
  SELECT key, depth, idx, actor, ops, items, i,
         CAST(CASE op WHEN 2 THEN num * 2 WHEN 3 THEN num * 3 WHEN 4 THEN num - n * afford * den WHEN 5 THEN num + bonus * den
              WHEN 6 THEN num * (100 - fee) WHEN 7 THEN num * 2 WHEN 8 THEN num - amount * den ELSE num END AS BIGINT),
         CAST(CASE op WHEN 1 THEN den * 2 WHEN 2 THEN den * 3 WHEN 3 THEN den * 4 WHEN 6 THEN den * 100 ELSE den END AS BIGINT),
         used + CASE WHEN op IN (1, 2, 3, 4, 8) THEN 1 ELSE 0 END,
         body || ' ' || CASE op
           WHEN 1 THEN actor || ' spends half of ' || actor || '''s remaining $ on ' || item || '.'
           WHEN 2 THEN actor || ' spends a third of ' || actor || '''s remaining $ on ' || item || '.'
           WHEN 3 THEN actor || ' spends a quarter of ' || actor || '''s remaining $ on ' || item || '.'
           WHEN 4 THEN actor || ' then ' || {_pick_sql(V.BUY_VERBS, "buy", "i")} || ' ' || n || ' ' || item || ' at $' || afford || ' each.'
           WHEN 5 THEN actor || ' also receives a $' || bonus || ' bonus.'
           WHEN 6 THEN 'A ' || fee || '% fee is deducted from ' || actor || '''s total.'
           WHEN 7 THEN actor || ' doubles ' || actor || '''s current $ total.'
           ELSE actor || ' ' || {_pick_sql(V.USE_VERBS, "use", "i")} || ' $' || amount || ' on ' || item || '.' END,
         steps || round(num / den, 4) || ';'
  FROM (SELECT *, CASE WHEN n * price > whole THEN greatest(1, whole // n) ELSE price END AS afford,
               least({_between_sql(2, 10, "amount")}, whole) AS amount
        FROM (SELECT * REPLACE (i + 1 AS i), ops[i % 8 + 1] AS op, items[used + 1] AS item, {_between_sql(2, 5, "count", "(i + 1)")} AS n,
                     {_between_sql(2, 8, "price", "(i + 1)")} AS price, greatest(1, CAST(floor(num / den) AS BIGINT) - 1) AS whole,
                     {_between_sql(5, 15, "bonus", "(i + 1)")} AS bonus, {_pick_sql(V.FEES, "fee", "(i + 1)")} AS fee
              FROM walk WHERE i < depth - 1))
)"""


@query(
    "s12_generate_problems",
    with_views(GENERATED, """SELECT printf('depth%02d_prob%04d', depth, idx) AS problem_id, depth,
        body || ' How much $ does ' || actor || ' have in the end?' AS question, round(num / den, 6) AS ground_truth,
        depth AS n_steps, num > 0 AS is_positive FROM walk WHERE i = depth - 1"""),
)
def generated(spark, d):
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = orders.selectExpr("cast(1 + o_custkey % 8 as int) AS depth", "o_orderkey AS idx")
    return G.generate_problems(rows).select(
        "problem_id", "depth", "question", F.round("ground_truth", 6).alias("ground_truth"),
        F.size("intermediate_values").alias("n_steps"), (F.col("ground_truth") > 0).alias("is_positive"),
    )
