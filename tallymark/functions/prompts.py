"""Prompt columns; one row per planned model call is built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .base import col, let, plain_text
from .clauses import numbered_lines


def direct_prompt(question: str | Column) -> Column:
    return col(question)


def cot_prompt(question: str | Column) -> Column:
    return F.concat(col(question), F.lit(V.COT_SUFFIX))


def filter_prompt(question: str | Column, template: str) -> Column:
    """Fill `{problem}` of a labelling template."""
    return F.replace(F.lit(template), F.lit("{problem}"), col(question))


def solve_prompt(clean_problem: str | Column) -> Column:
    return F.concat(col(clean_problem), F.lit(V.SOLVE_SUFFIX))


def context_text(current_total: str | Column) -> Column:
    total = col(current_total)
    return F.coalesce(
        F.concat(F.lit("current_total = "), plain_text(total), F.lit(V.CONTEXT_NOTE)), F.lit(V.NO_CONTEXT)
    )


def chunk_prompt(clauses: str | Column, current_total: str | Column) -> Column:
    """The prompt of one chunk; NULL for NULL clauses."""
    reminder = F.when(col(current_total).isNotNull(), V.CHUNK_REMINDER).otherwise("")
    return let(
        numbered_lines(clauses),
        lambda steps: F.when(steps.isNotNull(), F.format_string(V.CHUNK_PROMPT, context_text(current_total), steps, reminder)),
    )


def system_prompt(regime: str | Column) -> Column:
    return F.when(col(regime) == "cot", V.SYSTEM_COT).otherwise(V.SYSTEM_DIRECT)
