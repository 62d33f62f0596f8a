"""Problem text: sentences, distractors, chunk routing, filter responses, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import POOL
from . import fixed as V
from .base import col, let, strip, to_double


def split_clauses(text: str | Column) -> Column:
    """Sentences longer than two characters."""
    parts = F.split(F.replace(col(text), F.lit("\n"), F.lit(". ")), r"(?<=[.?!])\s+", -1)
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 2)


def group_clauses(clauses: str | Column, size: int | Column) -> Column:
    """Consecutive groups of at most `size` clauses."""
    width = size if isinstance(size, Column) else F.lit(size)

    def groups(cs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(cs), F.lit(1)), width)
        return F.when(F.size(cs) > 0, F.transform(starts, lambda i: F.slice(cs, i, width))).otherwise(
            F.array().cast("array<array<string>>")
        )

    return let(col(clauses), groups)


def is_goal_clause(clause: str | Column) -> Column:
    """A pure question without a computation."""
    clause = col(clause)
    return clause.rlike(V.GOAL_CLAUSE) & ~clause.contains("=")


def numbered_lines(clauses: str | Column) -> Column:
    """`1. …` per clause, one per line."""
    return F.array_join(
        F.transform(col(clauses), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n"
    )


def route_chunks(problem: str | Column, clauses: str | Column, size: int | Column) -> Column:
    """Chunks of a problem, each a list of clauses.

    Few facts: one chunk with all questions. Otherwise groups of `size` facts: every group but the last asks
    for the running total, the last one asks the first question.
    """
    width = size if isinstance(size, Column) else F.lit(size)

    def route(parts: Column) -> Column:
        facts, goals = parts["facts"], parts["goals"]
        goals_or_default = F.when(F.size(goals) > 0, goals).otherwise(F.array(F.lit(V.GOAL_FALLBACK)))
        several = let(
            group_clauses(facts, width),
            lambda gs: F.transform(
                gs,
                lambda g, i: F.concat(
                    g,
                    F.array(
                        F.when(i < F.size(gs) - 1, F.lit(V.RUNNING_TOTAL_CLAUSE)).otherwise(
                            F.get(goals_or_default, F.lit(0))
                        )
                    ),
                ),
            ),
        )
        return F.when(F.size(facts) <= width, F.array(F.concat(facts, goals_or_default))).otherwise(several)

    def parts(cs: Column) -> Column:
        facts = F.filter(cs, lambda c: ~is_goal_clause(c))
        return F.struct(
            let(facts, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(col(problem)))).alias("facts"),
            F.filter(cs, is_goal_clause).alias("goals"),
        )

    return let(let(col(clauses), parts), route)


def inject_distractor(question: str | Column, distractor: str | Column, position: str = "mid") -> Column:
    """Put a distractor sentence before the last sentence, or at the end if there is only one."""
    q = strip(col(question))
    d = F.regexp_replace(strip(col(distractor)), r"\.+$", "")

    def place(p: Column) -> Column:
        q, d = p["q"], p["d"]
        at_end = F.when(
            F.endswith(q, F.lit("?")), F.concat(F.substring(q, F.lit(1), F.length(q) - 1), F.lit(", "), d, F.lit("?"))
        ).otherwise(F.concat(q, F.lit(" "), d, F.lit(".")))
        if position == "end":
            placed = at_end
        else:
            placed = let(
                F.split(q, r"(?<=[.!])\s+", -1),
                lambda s: F.when(F.size(s) <= 1, at_end).otherwise(
                    F.array_join(
                        F.concat(
                            F.slice(s, F.lit(1), F.size(s) - 1),
                            F.array(F.concat(d, F.lit("."))),
                            F.slice(s, F.size(s), F.lit(1)),
                        ),
                        " ",
                    )
                ),
            )
        return F.when(d == "", q).otherwise(placed)

    return let(F.struct(q.alias("q"), F.coalesce(d, F.lit("")).alias("d")), place)


def parse_filter_lines(response: str | Column) -> Column:
    """STRUCT<relevant, irrelevant> of a clause-labelling response."""

    def labelled(lines: Column) -> Column:
        def pick(label: str) -> Column:
            wanted = F.filter(lines, lambda ln: F.upper(F.regexp_extract(ln, V.FILTER_LINE, 2)) == label)
            return F.transform(wanted, lambda ln: strip(F.regexp_extract(ln, V.FILTER_LINE, 1)))

        return F.struct(pick("RELEVANT").alias("relevant"), pick("IRRELEVANT").alias("irrelevant"))

    return let(F.transform(F.split(col(response), V.LINE_BREAK, -1), strip), labelled)


def distractor_detected(distractor: str | Column, irrelevant: str | Column) -> Column:
    """The distractor lies in a clause labelled irrelevant or such a clause lies in it, ignoring case."""

    def found(d: Column) -> Column:
        inside = F.exists(
            F.transform(col(irrelevant), lambda c: F.lower(strip(c))), lambda c: c.contains(d) | d.contains(c)
        )
        return F.when(d == "", F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))

    return let(F.lower(strip(F.coalesce(col(distractor), F.lit("")))), found)


def pool_element(raw: Column) -> Column:
    """STRUCT<type, text> of a pool element: an object, or a bare text of unknown type."""
    parsed = F.from_json(raw, "STRUCT<type: STRING, text: STRING>")
    bare = F.struct(F.lit("UNKNOWN").alias("type"), raw.alias("text"))
    fields = let(
        parsed,
        lambda p: F.struct(
            F.coalesce(p["type"], F.lit("UNKNOWN")).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text")
        ),
    )
    return F.when(F.startswith(raw, F.lit("{")), fields).otherwise(bare)


def parse_pool(response: str | Column) -> Column:
    """Distractor pool from a JSON list; anything else gives an empty pool."""
    text = strip(col(response))
    elements = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "ARRAY<STRING>"))
    return F.coalesce(F.transform(elements, pool_element), F.array().cast(POOL))


# a look at two letters before the 20 words are tried
_UNIT_NOUN = "(?i)(?=[abcdfghimpst][aeilopt])" + V.UNIT_NOUN


def variable_name(text: str | Column, chunk_index: str | Column) -> Column:
    """First capitalised word and first unit noun, else `step_N_result`."""
    text = col(text)
    parts = F.struct(
        F.lower(F.regexp_extract(text, V.PROPER_NAME, 1)).alias("name"),
        F.lower(F.regexp_extract(text, _UNIT_NOUN, 1)).alias("unit"),
    )
    fallback = F.concat(F.lit("step_"), (col(chunk_index) + 1).cast("string"), F.lit("_result"))
    return let(
        parts,
        lambda p: F.when(p["name"] == "", fallback)
        .when(p["unit"] == "", F.concat(p["name"], F.lit("_value")))
        .otherwise(F.concat_ws("_", p["name"], p["unit"])),
    )


def context_snapshot(context: str | Column) -> Column:
    """Context without internal (`__…`) and numeric keys."""
    return F.map_filter(col(context), lambda k, _: ~F.startswith(k, F.lit("__")) & to_double(k).isNull())
