"""Verification of recorded chunk-by-chunk solutions.

A problem is solved in chunks; each chunk has one or more recorded attempts. What an attempt says can depend on
the value carried over from the chunk before (it may write `current_total - 4 = 28`), so the chunks of one
problem are folded in order. The fold is a native `aggregate` over the problem's own chunks and runs row by
row: distribution, shuffle and spill stay with Spark. The grouping key holds the problem id, so a group is
never larger than one problem's attempts, however large a model's or a seed's share of the rows is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import arithmetic as M
from ..functions import clauses as C
from ..functions import fixed as V
from ..functions.base import col, last, let, plain_text
from ..schemas import VERIFICATION

NAMES = "ARRAY<STRUCT<name: STRING, value: DOUBLE>>"
RECORD = (
    "STRUCT<chunk_idx: INT, chunk_text: STRING, slm_response: STRING, "
    f"verification_log: ARRAY<{VERIFICATION}>, answer_tag: DOUBLE, extraction_method: STRING, "
    "num_retries: INT, chunk_value: DOUBLE>"
)


def chunk_size(model: str | Column, sizes: dict[str, int] | None = None, default: int = 2) -> Column:
    """Facts per chunk for a model; unknown and NULL models get the default."""
    found = [F.when(col(model) == m, n) for m, n in (V.CHUNK_SIZES if sizes is None else sizes).items()]
    return F.coalesce(*found, F.lit(default))


def plan_chunks(df: DataFrame, problem: str = "question", size: int | Column = 2) -> DataFrame:
    """Adds num_clauses and chunks (list of clause lists) to a problem table."""
    return df.withColumn("_clauses", C.split_clauses(problem)).select(
        *df.columns,
        F.size("_clauses").alias("num_clauses"),
        C.route_chunks(problem, "_clauses", size).alias("chunks"),
    )


def explode_chunks(planned: DataFrame) -> DataFrame:
    """One row per chunk with its numbered text."""
    rest = [c for c in planned.columns if c != "chunks"]
    # every problem has a chunk; a plain explode would add a filter that evaluates the routing a second time
    return planned.select(*rest, F.posexplode_outer("chunks").alias("chunk_idx", "clauses")).withColumn(
        "chunk_text", C.numbered_lines("clauses")
    )


def parse_attempts(df: DataFrame) -> DataFrame:
    """Adds to recorded attempts all that a response says by itself, found row by row: plain (the readable text, NULL where the
    response is it already or has no equals sign), log (its expressions, verified), terminal (where their chain ends, if
    known), tag, and named (a name may stand in it: every name has an underscore)."""
    parsed = df.select("*", F.when(F.col("response").contains("="), M.readable("response")).alias("_plain"))
    verified = M.with_verified(parsed, "_plain")
    text = F.coalesce("_plain", "response")
    return verified.select(
        *df.columns,
        F.when(F.col("_plain") != F.col("response"), F.col("_plain")).alias("plain"),
        "log",
        "terminal",
        A.answer_tag("response").alias("tag"),
        F.coalesce(text.contains("=") & text.contains("_"), F.lit(False)).alias("named"),
    )


def nest_attempts(df: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Recorded attempts (one row each) to one row per problem with a list of chunks; one shuffle.

    Expects chunk_idx, attempt, clause_text and response; `carry` columns are constant per problem. A chunk is what has
    one chunk_idx; its text is that of its first attempt. Attempts are parsed before the shuffle (`parse_attempts`).
    """
    fields = ("chunk_idx", "attempt", "clause_text", "response", "plain", "log", "terminal", "tag", "named")
    rows = parse_attempts(df).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"),
    )

    def nested(head: Column) -> Column:
        return let(F.filter("_rows", lambda r: r["chunk_idx"].eqNullSafe(head)), lambda mine: of_chunk(head, mine))

    def of_chunk(head: Column, mine: Column) -> Column:
        return F.struct(head.alias("chunk_idx"), F.get(mine, F.lit(0))["clause_text"].alias("clause_text"), mine.alias("attempts"))

    heads = F.array_distinct(F.col("_rows.chunk_idx"))
    return rows.select(*keys, *carry, F.transform(heads, nested).alias("chunks"))


CHOSEN = f"STRUCT<response: STRING, log: ARRAY<{VERIFICATION}>, terminal: INT, tag: DOUBLE, usable: BOOLEAN, retries: INT>"


def choose_attempt(attempts: str | Column, names: Column) -> Column:
    """First attempt with an expression or an answer tag, else the last one; attempts after the first usable one are not
    looked at. STRUCT<response, log, terminal, tag, usable, retries>.

    Attempts are parsed (`parse_attempts`); one is read again only where a known name occurs in it.
    """
    nothing = F.lit(None)
    start = F.struct(
        nothing.alias("response"), nothing.alias("log"), nothing.alias("terminal"), nothing.alias("tag"),
        F.lit(False).alias("usable"), F.lit(0).alias("retries"),
    )

    def read(tried: Column, a: Column) -> Column:
        text = F.coalesce(a["plain"], a["response"])
        known = text.contains("=") & F.exists(names, lambda n: text.contains(n["name"]))
        again = lambda: let(M.verify(M.expressions_of_plain(M.substitute_names(text, names))), lambda log: judged(log, F.lit(None)))

        def judged(log: Column, terminal: Column) -> Column:
            usable = (F.size(log) > 0) | a["tag"].isNotNull()
            return F.struct(
                a["response"].alias("response"), log.alias("log"), terminal.cast("int").alias("terminal"), a["tag"].alias("tag"),
                usable.alias("usable"), (tried["retries"] + F.when(usable, 0).otherwise(1)).alias("retries"),
            )

        return F.when((F.size(names) > 0) & known, again()).otherwise(judged(a["log"], a["terminal"]))

    return F.aggregate(col(attempts), start.cast(CHOSEN), lambda tried, a: F.when(tried["usable"], tried).otherwise(read(tried, a)))


def chunk_value(chosen: Column, total: Column) -> Column:
    """What a chunk hands on. STRUCT<value, method>.

    An answer tag counts unless the last expression repeats an operand; then the verified expressions, then a
    lone tag, then the last number of the response.
    """
    verified, tag, known = chosen["log"], chosen["tag"], chosen["terminal"]
    final = last(verified)
    repeated = F.coalesce(final["status"] == "double_count", F.lit(False))
    terminal = F.when(known.isNull(), M.chain_terminal(verified, total)).otherwise(M.terminal_with_total(verified, known, total))
    from_log = (
        F.when(repeated, final["corrected_value"])
        .when(tag.isNotNull(), tag)
        .otherwise(F.get(verified, terminal)["corrected_value"])
    )

    def with_fallback(value: Column) -> Column:
        number = F.when(value.isNull(), A.last_number(chosen["response"]))
        return let(number, lambda n: settle(value, n))

    def settle(value: Column, number: Column) -> Column:
        method = (
            F.when(chosen["usable"] & number.isNotNull(), "emergency_fallback")
            .when(chosen["usable"], "arithmetic")
            .when(number.isNotNull(), "last_number")
            .otherwise("failed")
        )
        return F.struct(F.coalesce(value, number).alias("value"), method.alias("method"))

    value = F.when(F.size(verified) > 0, from_log).otherwise(tag)
    return let(value, with_fallback)


def _remember(names: Column, text: Column, chunk_idx: Column, value: Column) -> Column:
    """Set the name of a chunk and the running total to the chunk's value, if it has one."""
    pair = lambda n: F.struct(n.alias("name"), value.alias("value"))

    def named(name: Column) -> Column:
        others = F.filter(names, lambda n: (n["name"] != name) & (n["name"] != "current_total"))
        return F.concat(others, F.array(pair(name), pair(F.lit("current_total"))))

    return F.when(value.isNull(), names).otherwise(let(C.variable_name(text, chunk_idx), named))


def _no_names() -> Column:
    return F.array().cast(NAMES)


def _names_of(records: Column) -> Column:
    """The names known after a fold's records."""
    step = lambda names, r: _remember(names, r["chunk_text"], r["chunk_idx"], r["chunk_value"])
    return F.aggregate(records, _no_names(), step)


def fold_chunks(chunks: str | Column) -> Column:
    """Ordered fold over a problem's chunks. STRUCT<total: DOUBLE, names, logs: ARRAY<log>>."""
    return let(
        fold_records(chunks),
        lambda f: F.struct(f["total"], _names_of(f["logs"]).alias("names"), chunk_logs(f["logs"]).alias("logs")),
    )


def chunk_logs(records: Column, contexts: bool = True) -> Column:
    """The logs of a fold's records: the expressions found, and with `contexts` the names before and after as maps."""

    def log(r: Column, *context: Column) -> Column:
        return F.struct(
            *[r[c].alias(c) for c in ("chunk_idx", "chunk_text", "slm_response")],
            r["verification_log"]["full_match"].alias("expressions_found"),
            *[r[c].alias(c) for c in ("verification_log", "answer_tag", "extraction_method", "num_retries", "chunk_value")],
            *context,
        )

    if not contexts:
        return F.transform(records, lambda r: log(r))

    # names before the first record and after each one
    def grown(all_names: Column, r: Column) -> Column:
        return let(last(all_names), lambda names: F.concat(all_names, F.array(_remember(names, r["chunk_text"], r["chunk_idx"], r["chunk_value"]))))

    def with_maps(all_names: Column) -> Column:
        known = lambda i, name: F.map_from_entries(F.get(all_names, i)).alias(name)
        return F.transform(records, lambda r, i: log(r, known(i, "context_before"), known(i + 1, "context_after")))

    return let(F.aggregate(records, F.array(_no_names()), grown), with_maps)


def fold_records(chunks: str | Column) -> Column:
    """The fold itself. STRUCT<total: DOUBLE, logs: ARRAY<record>>; a record is a log without its names."""
    start = F.struct(
        F.lit(None).cast("double").alias("total"),
        _no_names().alias("names"),
        F.array().cast(f"ARRAY<{RECORD}>").alias("logs"),
    )

    def step(by_name: Column, acc: Column, chunk: Column) -> Column:
        def valued(chosen: Column) -> Column:
            return let(chunk_value(chosen, acc["total"]), lambda v: recorded(chosen, v))

        def recorded(chosen: Column, v: Column) -> Column:
            entry = F.struct(
                chunk["chunk_idx"].cast("int").alias("chunk_idx"),
                chunk["clause_text"].alias("chunk_text"),
                chosen["response"].alias("slm_response"),
                chosen["log"].alias("verification_log"),
                F.when(chosen["usable"], chosen["tag"]).alias("answer_tag"),
                v["method"].alias("extraction_method"),
                chosen["retries"].cast("int").alias("num_retries"),
                v["value"].alias("chunk_value"),
            )
            names = _remember(acc["names"], chunk["clause_text"], chunk["chunk_idx"], v["value"])
            return F.struct(
                F.coalesce(v["value"], acc["total"]).alias("total"),
                F.when(by_name, names).otherwise(acc["names"]).alias("names"),
                F.concat(acc["logs"], F.array(entry)).alias("logs"),
            )

        return let(choose_attempt(chunk["attempts"], acc["names"]), valued)

    def folded(ordered: Column) -> Column:
        # names are kept only where some attempt may use one; a clause that is NULL has a name without an underscore
        by_name = F.exists(ordered, lambda c: c["clause_text"].isNull() | F.exists(c["attempts"], lambda a: a["named"]))
        found = lambda acc: F.struct(acc["total"].alias("total"), acc["logs"].alias("logs"))
        return let(by_name, lambda b: F.aggregate(ordered, start, lambda acc, chunk: step(b, acc, chunk), found))

    return let(F.sort_array(col(chunks)), folded)


def explode_logs(results: DataFrame) -> DataFrame:
    """One row per chunk log."""
    rest = [c for c in results.columns if c != "chunk_logs"]
    # as above: a plain inline would add a filter that evaluates the fold a second time
    return results.select(*rest, F.inline_outer("chunk_logs"))


def count_logs(logs: Column) -> dict[str, Column]:
    """Counters of a problem's nested logs, without exploding them."""
    statuses = F.flatten(logs["verification_log"])["status"]
    among = lambda values, x: F.size(values) - F.size(F.array_remove(values, x))
    return {
        "total_expressions_checked": F.size(statuses),
        "corrections_applied": among(statuses, "corrected"),
        "extraction_failures": among(logs["extraction_method"], "failed"),
        "unverified_fallbacks": among(logs["extraction_method"], "last_number"),
    }


def verify_solutions(nested: DataFrame, gold: str = "gold", contexts: bool = True) -> DataFrame:
    """One result per problem: predicted, correct, counters and chunk_logs (without their contexts if those are not wanted)."""
    rest = [c for c in nested.columns if c != "chunks"]
    folded = nested.select(*rest, F.size("chunks").alias("num_chunks"), fold_records("chunks").alias("_fold"))
    # counted on the records: a query without the logs does not build them
    counted = folded.select(
        *rest,
        "num_chunks",
        plain_text(F.round("_fold.total", 10)).alias("predicted"),
        chunk_logs(F.col("_fold.logs"), contexts).alias("chunk_logs"),
        *[c.alias(n) for n, c in count_logs(F.col("_fold.logs")).items()],
    )
    return counted.withColumn("correct", A.match_absolute(F.col(gold).cast("string"), "predicted"))
