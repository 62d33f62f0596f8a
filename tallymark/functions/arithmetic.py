"""Arithmetic found in free text: normalisation, expression extraction and step-by-step verification."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as V
from .base import col, find_all, let, plain_text, rewrite_matches, strip

# A match is rewritten to a token of its parts between these brackets; a chain keeps its text with the equals sign
# replaced, so that the second pass finds nothing inside it.
_OPEN, _CLOSE, _EQUALS = "⟦", "⟧", "⟨"
EXPRESSIONS = "ARRAY<STRUCT<left: DOUBLE, op: STRING, right: DOUBLE, claimed: DOUBLE, full_match: STRING>>"
# The looks ahead at the start of the patterns take nothing away: they only end most tries at their first character.
# `V.OPERAND` that gives nothing back: a shorter number would be followed by a digit or a point, which no pattern wants.
_OPERAND = r"(\d++(?:\.\d++)?+)"
_BINARY = rf"(?=\d)(?<![\d/]){_OPERAND}\s*+{V.OPERATOR}\s*+{_OPERAND}\s*+=\s*+{_OPERAND}"
_BINARY_TOKEN = f"{_OPEN}$1|$2|$3|$4|$0{_CLOSE}"
_NONZERO_DIVISION = r"(?!\d+(?:\.\d+)?\s*[/÷]\s*0+(?:\.0+)?\s*[+\-*/×÷])"
_CHAIN = (
    rf"(?=\d)(?<![\d/]){_NONZERO_DIVISION}"
    rf"({_OPERAND}\s*+{V.OPERATOR}\s*+{_OPERAND}\s*+{V.OPERATOR}\s*+{_OPERAND}\s*+)=(\s*+{_OPERAND})"
)
_UNIT_AFTER_DIGIT = r"(?i)(?=\s+[a-z][aeiloptu])" + V.UNIT_AFTER_DIGIT
_CHAIN_TOKEN = f"{_OPEN}$2|$3|$4|$5|$6|$8|$1{_EQUALS}$7{_CLOSE}"


def without(text: Column, characters: str) -> Column:
    """The text without these characters; a plain search first, since few texts hold any."""

    def cleared(t: Column) -> Column:
        held = functools.reduce(Column.__or__, [t.contains(c) for c in characters])
        return F.when(held, F.translate(t, characters, "")).otherwise(t)

    return let(text, cleared)


def plain_arithmetic(text: str | Column) -> Column:
    """LaTeX maths to plain text: fractions to decimals, units, currency and thousands commas dropped."""

    def fraction(m: Column) -> Column:
        num = F.regexp_extract(m, V.LATEX_FRACTION, 1).try_cast("double")
        den = F.regexp_extract(m, V.LATEX_FRACTION, 2).try_cast("double")
        value = F.when(den == 0, F.lit("0")).otherwise(plain_text(F.try_divide(num, den)))
        return F.coalesce(value, m)

    def unwrapped(m: Column) -> Column:
        inner = strip(F.regexp_extract(m, V.LATEX_TEXT, 1))
        return F.when(inner.rlike(r"^[\d.]+$"), inner).otherwise(" ")

    def latex(t: Column) -> Column:
        t = rewrite_matches(t, V.LATEX_FRACTION, fraction)
        t = rewrite_matches(t, V.LATEX_TEXT, unwrapped)
        t = F.regexp_replace(t, r"\\?\$", "")
        t = F.regexp_replace(t, r"\\times|\\cdot", "×")
        return F.regexp_replace(t, r"\\div", "÷")

    # a text without a backslash has no LaTeX, one without a comma no thousands
    t = let(col(text), lambda x: F.when(x.contains("\\"), latex(x)).otherwise(x))
    t = without(t, "$")
    t = let(
        t,
        lambda x: F.when(
            x.contains(","), F.regexp_replace(F.regexp_replace(x, V.THOUSANDS, "$1$2"), V.THOUSANDS, "$1$2")
        ).otherwise(x),
    )
    return F.regexp_replace(t, _UNIT_AFTER_DIGIT, "")


def expand_fractions(text: str | Column) -> Column:
    """`(a/b)` to its decimal value; left alone when `b` is zero or a part is not a number."""

    def value(m: Column) -> Column:
        num = F.regexp_extract(m, V.PAREN_FRACTION, 1).try_cast("double")
        den = F.regexp_extract(m, V.PAREN_FRACTION, 2).try_cast("double")
        return F.coalesce(plain_text(F.try_divide(num, den)), m)

    return let(
        col(text), lambda t: F.when(t.contains("("), rewrite_matches(t, V.PAREN_FRACTION, value)).otherwise(t)
    )


def substitute_names(text: str | Column, names: str | Column) -> Column:
    """Replace known names by their values, longest name first. `names`: ARRAY<STRUCT<name, value>>.

    A text without any of the names is left as it is after a plain search. Else names with a word bound inside them (few)
    are replaced one after another; all others are words: the text is split once at its word bounds and each word looked up.
    """
    longest_first = F.transform(
        F.sort_array(F.transform(col(names), lambda n: F.struct(-F.length(n["name"]), n["name"], n["value"]))),
        lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")),
    )

    def shown(n: Column) -> Column:
        return plain_text(F.round(n["value"], 10))

    def looked_up(word: Column, words: Column) -> Column:
        return let(F.get(F.filter(words, lambda n: n["name"] == word), F.lit(0)), lambda n: F.when(n.isNull(), word).otherwise(shown(n)))

    def replaced(t: Column, found: Column) -> Column:
        phrases = F.filter(found, lambda n: n["name"].rlike(r"\B\W|\W\B|.\b."))
        words = F.filter(found, lambda n: ~n["name"].rlike(r"\B\W|\W\B|.\b."))
        pattern = lambda n: F.concat(F.lit(r"\b\Q"), n["name"], F.lit(r"\E\b"))
        done = F.aggregate(phrases, t, lambda x, n: F.regexp_replace(x, pattern(n), shown(n)))
        by_word = lambda ws: F.array_join(F.transform(F.split(done, r"\b"), lambda w: looked_up(w, ws)), "")
        return F.when(F.size(words) > 0, let(words, by_word)).otherwise(done)

    def in_text(t: Column) -> Column:
        # names that occur nowhere cost one search each
        found = F.filter(col(names), lambda n: t.contains(n["name"]))
        return F.when(F.size(found) > 0, let(F.filter(longest_first, lambda n: t.contains(n["name"])), lambda f: replaced(t, f))).otherwise(t)

    return let(col(text), in_text)


def evaluate(left: Column, op: Column, right: Column) -> Column:
    """One binary operation; NULL on division by zero."""
    return (
        F.when(op == "+", left + right)
        .when(op == "-", left - right)
        .when(op == "*", left * right)
        .when(op == "/", F.try_divide(left, right))
    )


def _operator(c: Column) -> Column:
    return F.translate(c, "×÷", "*/")


def _expression(left: Column, op: Column, right: Column, claimed: Column, full: Column) -> Column:
    return F.struct(
        left.alias("left"), op.alias("op"), right.alias("right"), claimed.alias("claimed"), full.alias("full_match")
    )


def _expressions_of(parts: Column) -> Column:
    """Expressions of a token; a chain `a op b op c = d` is `a op b = x` and `x op c = d`, from left to right."""
    part = lambda i: F.get(parts, F.lit(i))
    number = lambda i: part(i).cast("double")
    binary = F.array(_expression(number(0), _operator(part(1)), number(2), number(3), part(4)))
    chain = let(
        F.round(evaluate(number(0), _operator(part(1)), number(2)), 10),
        lambda x: F.array(
            _expression(number(0), _operator(part(1)), number(2), x, F.concat_ws(" ", part(0), part(1), part(2))),
            _expression(x, _operator(part(3)), number(4), number(5), F.translate(part(6), _EQUALS, "=")),
        ),
    )
    return F.when(F.size(parts) == 7, chain).otherwise(binary)


def readable(text: str | Column) -> Column:
    """The text as the expression patterns want it: plain arithmetic without fractions, names still in it."""
    return expand_fractions(plain_arithmetic(without(col(text), _OPEN + _CLOSE + _EQUALS)))


def tokens_of_plain(plain: Column) -> Column:
    """The expressions of a readable text, each as its parts joined by bars."""
    marked = F.regexp_replace(F.regexp_replace(plain, _CHAIN, _CHAIN_TOKEN), _BINARY, _BINARY_TOKEN)
    return find_all(marked, f"{_OPEN}([^{_CLOSE}]*){_CLOSE}", 1)


def _expressions_of_tokens(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda k: let(F.split(k, r"\|"), _expressions_of)))


def expressions_of_plain(plain: Column) -> Column:
    """Expressions of a readable text."""
    return _expressions_of_tokens(tokens_of_plain(plain))


def expressions_in(text: str | Column, names: str | Column | None = None) -> Column:
    """All `a op b = c` and `a op b op c = d` of a text, in order. ARRAY<STRUCT<left,op,right,claimed,full_match>>."""

    def found(t: Column) -> Column:
        plain = readable(t)
        return expressions_of_plain(plain if names is None else substitute_names(plain, names))

    nothing = F.array().cast(EXPRESSIONS)
    return let(col(text), lambda t: F.when(t.contains("="), found(t)).otherwise(nothing))


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def _wrong(e, value: Column, tolerance: float) -> Column:
    return F.coalesce(~_near(value, e["claimed"], tolerance), F.lit(False))


def _repeats(e, before, tolerance: float) -> Column:
    """An expression uses an operand of the one before it once more."""
    reused = _near(e["right"], before["right"], tolerance) | _near(e["right"], before["left"], tolerance)
    return (e["op"] == before["op"]) & _near(e["left"], before["claimed"], tolerance) & reused


def _may_repeat(e, value: Column) -> Column:
    return e["op"].isin("*", "/") & value.isNotNull()


def _verdict(e, claimed_before: Column, value: Column, wrong: Column, twice: Column) -> Column:
    status = F.when(value.isNull(), "error").when(twice, "double_count").when(wrong, "corrected").otherwise("correct")
    carried = (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(twice, claimed_before)
        .when(wrong, value)
        .otherwise(e["claimed"])
    )
    return F.struct(
        e["left"].alias("left"),
        e["op"].alias("op"),
        e["right"].alias("right"),
        e["claimed"].alias("claimed"),
        e["full_match"].alias("full_match"),
        e["left"].alias("resolved_left"),
        e["right"].alias("resolved_right"),
        F.round(value, 10).alias("computed"),
        status.alias("status"),
        F.round(carried, 10).alias("corrected_value"),
    )


def verify(expressions: str | Column, tolerance: float = V.VERIFY_TOLERANCE) -> Column:
    """Check each expression and say what to carry on.

    Whether an expression counts the same operand twice depends on the verdict of the one before it, so the
    flags come from an ordered fold; everything else is element-wise.
    """

    def checked(es: Column, e: Column, i: Column) -> Column:
        """An expression's value, whether it is wrong and whether it repeats an operand of the one before."""

        def facts(value: Column) -> Column:
            suspect = F.when((i > 0) & _may_repeat(e, value), let(F.get(es, i - 1), lambda before: _repeats(e, before, tolerance)))
            return F.struct(
                value.alias("value"), _wrong(e, value, tolerance).alias("wrong"), F.coalesce(suspect, F.lit(False)).alias("suspect")
            )

        return let(evaluate(e["left"], e["op"], e["right"]), facts)

    def flags(facts: Column) -> Column:
        # suspects[i]: i repeats an operand of i-1; a corrected predecessor clears it.
        def step(acc: Column, s: Column) -> Column:
            def grown(flag: Column) -> Column:
                return F.struct(
                    F.concat(acc["all"], F.array(flag)).alias("all"), flag.alias("flag"), s["wrong"].alias("wrong")
                )

            return let(s["suspect"] & ~(acc["wrong"] & ~acc["flag"]), grown)

        start = F.struct(
            F.array().cast("array<boolean>").alias("all"), F.lit(False).alias("flag"), F.lit(False).alias("wrong")
        )
        # without a suspect there is no flag
        return F.when(F.exists(facts, lambda s: s["suspect"]), F.aggregate(facts, start, step, lambda acc: acc["all"]))

    def entry(es: Column, twice: Column, e: Column, i: Column, fact: Column) -> Column:
        return _verdict(e, F.get(es, i - 1)["claimed"], fact["value"], fact["wrong"], twice)

    def entries(es: Column, facts: Column, fs: Column) -> Column:
        return F.transform(es, lambda e, i: let(F.get(facts, i), lambda fact: entry(es, F.get(fs, i), e, i, fact)))

    def verified(es: Column) -> Column:
        facts = F.transform(es, lambda e, i: checked(es, e, i))
        return let(facts, lambda known: let(flags(known), lambda fs: entries(es, known, fs)))

    return let(col(expressions), verified)


#: Texts with at most so many expressions are verified by compiled columns.
FEW = 4


def with_verified(df: DataFrame, plain: str, tolerance: float = V.VERIFY_TOLERANCE) -> DataFrame:
    """Adds `log`, the verified expressions of a readable text (none for NULL), and `terminal`, their `chain_terminal` without
    a total where it is known already.

    `log` is what `verify` gives. Lambdas are interpreted row by row; texts of at most `FEW` expressions without a chain
    have the same rules written out, which is compiled, and what they share is computed once: none of it may stand in a
    branch. A place beyond the last expression is NULL throughout. The others go through `verify`.
    """
    tokens = df.select("*", tokens_of_plain(F.col(plain)).alias("_tokens"))
    short = (F.size("_tokens") <= FEW) & ~F.array_join("_tokens", "").contains(_EQUALS)
    tokens = tokens.select("*", F.coalesce(F.when(short, F.col("_tokens")), F.when(F.col("_tokens").isNull(), F.array().cast("array<string>"))).alias("_short"))
    parts = [F.split(F.get("_short", F.lit(i)), r"\|") for i in range(FEW)]
    es = [
        {"left": F.get(p, F.lit(0)).cast("double"), "op": _operator(F.get(p, F.lit(1))), "right": F.get(p, F.lit(2)).cast("double"),
         "claimed": F.get(p, F.lit(3)).cast("double"), "full_match": F.get(p, F.lit(4))}
        for p in parts
    ]
    values = [evaluate(e["left"], e["op"], e["right"]) for e in es]
    wrong = [_wrong(e, v, tolerance) for e, v in zip(es, values, strict=True)]
    twice, verdicts, goes_on = [F.lit(False)], [], []
    for i, e in enumerate(es):
        if i:  # a corrected predecessor clears the suspicion
            suspect = F.coalesce(_may_repeat(e, values[i]) & _repeats(e, es[i - 1], tolerance), F.lit(False))
            twice.append(suspect & ~(wrong[i - 1] & ~twice[i - 1]))
        earlier = [~twice[j] & _near(e["left"], es[j]["claimed"], tolerance) for j in range(i)]
        goes_on.append(~twice[i] & functools.reduce(Column.__or__, earlier, F.lit(False)))
        verdicts.append(_verdict(e, es[i - 1]["claimed"] if i else F.lit(None).cast("double"), values[i], wrong[i], twice[i]))
    n = F.size("_short")
    latest = functools.reduce(lambda found, i: found.when(goes_on[i], i), range(FEW - 2, 0, -1), F.when(goes_on[-1], FEW - 1)).otherwise(0)
    longer = verify(_expressions_of_tokens(F.col("_tokens")), tolerance)
    return tokens.select(
        *df.columns,
        F.coalesce(F.slice(F.array(*verdicts), F.lit(1), n), longer).alias("log"),
        F.when(n <= 1, n - 1).when(n > 1, latest).alias("terminal"),
    )


def chain_terminal(
    verified: str | Column, current_total: str | Column, tolerance: float = V.VERIFY_TOLERANCE
) -> Column:
    """0-based index of the last expression that goes on from an earlier result or from the running total."""

    def bucket(x: Column) -> Column:
        # values within the tolerance lie in one bucket or in two that are neighbours
        return F.floor(x / (2 * tolerance))

    def index(log: Column) -> Column:
        total = col(current_total)
        usable = F.filter(log, lambda e: e["status"] != "double_count")
        carried = F.flatten(F.transform(usable, lambda e: let(bucket(e["claimed"]), lambda b: F.array(b - 1, b, b + 1))))
        lefts = F.transform(usable, lambda e: bucket(e["left"]))

        def continues(e: Column, i: Column, near: Column) -> Column:
            # an earlier result is searched for only where some result is near at all
            on_earlier = F.array_contains(near, bucket(e["left"])) & F.exists(
                F.slice(log, F.lit(1), i),
                lambda x: (x["status"] != "double_count") & (F.abs(e["left"] - x["claimed"]) <= tolerance),
            )
            on_total = F.abs(e["left"] - total) <= tolerance
            return (e["status"] != "double_count") & ((i == 0) | F.coalesce(on_total, F.lit(False)) | F.coalesce(on_earlier, F.lit(False)))

        def latest(near: Column) -> Column:
            # from the last expression back to the first that continues; nothing is looked at beyond it
            back = F.sequence(F.size(log) - 1, F.lit(0), F.lit(-1))
            step = lambda hit, i: F.when(hit >= 0, hit).when(continues(F.get(log, i), i, near), i).otherwise(hit)
            return F.greatest(F.aggregate(back, F.lit(-1), step), F.lit(0))

        return F.when(F.size(log) <= 1, F.size(log) - 1).otherwise(let(F.array_intersect(lefts, carried), latest))

    return let(col(verified), index)


def terminal_with_total(
    verified: Column, terminal: Column, current_total: Column, tolerance: float = V.VERIFY_TOLERANCE
) -> Column:
    """`chain_terminal` with a total, from the one without it: only expressions behind that one are looked at."""
    back = F.sequence(F.size(verified) - 1, terminal + 1, F.lit(-1))
    on_total = lambda e: (e["status"] != "double_count") & F.coalesce(_near(e["left"], current_total, tolerance), F.lit(False))
    step = lambda hit, i: F.when(hit >= 0, hit).when(on_total(F.get(verified, i)), i).otherwise(hit)
    later = (terminal < F.size(verified) - 1) & current_total.isNotNull()
    return F.when(later, F.greatest(F.aggregate(back, F.lit(-1), step), terminal)).otherwise(terminal)
