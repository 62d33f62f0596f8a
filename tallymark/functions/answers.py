"""Final-answer extraction, gold parsing and answer matching over free text."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .base import col, digits_to_double, find_all, first_match, last, let, none_if_empty, strip, to_double


def base_text(annotated: str | Column) -> Column:
    """Text before the first annotation section."""
    return strip(F.get(F.split(col(annotated), V.ANNOTATION_START, 2), F.lit(0)))


def before_chat_turn(text: str | Column) -> Column:
    """Text before the first leaked chat turn."""
    return F.get(F.split(col(text), V.CHAT_TURN, 2), F.lit(0))


def numeric_candidate(text: str | Column) -> Column:
    """Last numeric token once a leading `is`/`=` and the characters `$ % , \\` are gone; else NULL."""
    bare = F.translate(F.regexp_replace(strip(col(text)), V.LEADING_IS, ""), "$%,\\", "")
    return last(find_all(bare, V.NUMERIC_TOKEN))


def hash_answer(text: str | Column) -> Column:
    """Answer on the last `####` line: its number if it has one, else the text itself."""
    text = col(text)
    payload = strip(last(find_all(text, V.HASH_LINE, 1)))
    return F.when(text.contains("####"), let(payload, lambda p: F.coalesce(numeric_candidate(p), p)))


def _latest_phrase(text: Column, patterns: tuple[str, ...]) -> Column:
    """First group of the match that starts last among all patterns; on a tie the earlier pattern wins."""

    def hit(order: int, pattern: str) -> Column:
        def found(matched: Column) -> Column:
            start = F.length(text) - F.length(last(F.split(text, pattern, -1))) - F.length(matched)
            return F.when(
                matched.isNotNull(),
                F.struct(
                    start.alias("start"),
                    F.lit(-order).alias("preference"),
                    F.regexp_extract(matched, pattern, 1).alias("payload"),
                ),
            )

        return let(last(find_all(text, pattern)), found)

    hits = F.array(*[hit(i, p) for i, p in enumerate(patterns)])
    latest = F.array_max(F.filter(hits, lambda h: h.isNotNull()))
    return F.when(text.rlike("(?i)answer"), latest["payload"])


def answer_phrase(text: str | Column) -> Column:
    """What follows the last phrase that introduces an answer."""
    return none_if_empty(strip(_latest_phrase(col(text), V.PHRASES)))


def _balanced_prefix(text: Column) -> Column:
    """Text up to the brace that closes an already opened one; NULL if it is never closed."""
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["open"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        return F.when(acc["open"] == 0, acc).otherwise(
            F.struct(depth.alias("open"), (acc["end"] + F.length(piece)).alias("end"))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == 0, F.substring(text, F.lit(1), acc["end"] - 1))

    return F.aggregate(find_all(text, r"[^{}]*[{}]"), start, step, finish)


def last_boxed(text: str | Column) -> Column:
    """Content of the last `\\boxed{…}` whose braces balance; tried from the last one backwards."""
    text = col(text)

    def search(parts: Column) -> Column:
        def attempt(found: Column, k: Column) -> Column:
            suffix = F.array_join(F.slice(parts, k, F.size(parts)), "\\boxed{")
            return F.when(found.isNotNull(), found).otherwise(let(suffix, _balanced_prefix))

        backwards = F.sequence(F.size(parts), F.lit(2), F.lit(-1))
        return F.aggregate(backwards, F.lit(None).cast("string"), attempt)

    return F.when(text.contains("\\boxed{"), let(F.split(text, V.BOXED_OPEN, -1), search))


def text_tail(text: str | Column) -> Column:
    """Bounded tail in which a bare last number still counts as the answer."""
    text = col(text)

    def lines_of(t: Column) -> Column:
        return F.split(F.regexp_replace(t, f"(?:{V.LINE_BREAK})\\z", ""), V.LINE_BREAK, -1)

    tail = let(
        lines_of(text),
        lambda ls: F.when(
            F.size(ls) > V.TAIL_LINES, F.array_join(F.slice(ls, -V.TAIL_LINES, V.TAIL_LINES), "\n")
        ).otherwise(text),
    )
    return F.right(tail, F.lit(V.TAIL_CHARS))


def final_answer(text: str | Column) -> Column:
    """`####` line, answer phrase, boxed value, last number in the tail, after cutting leaked turns."""

    def cascade(t: Column) -> Column:
        phrase = answer_phrase(t)
        boxed = last_boxed(t)
        return F.when(
            strip(t) != "",
            F.coalesce(
                hash_answer(t),
                let(phrase, lambda p: F.coalesce(numeric_candidate(p), p)),
                let(boxed, lambda b: F.coalesce(numeric_candidate(b), none_if_empty(strip(b)))),
                F.replace(last(find_all(text_tail(t), V.NUMERIC_TOKEN)), F.lit(","), F.lit("")),
            ),
        )

    return let(before_chat_turn(text), cascade)


def _flat_boxed(text: Column) -> Column:
    inner = F.translate(F.regexp_extract(text, V.BOXED_FLAT, 1), ",", "")
    number = to_double(strip(F.regexp_replace(inner, r"^\$+|\$+$", "")))
    return F.when(text.contains("\\boxed{"), number)


def reported_answer(text: str | Column) -> Column:
    """First `Answer: N`, first boxed number, first `= N` at a line end, last plain number."""
    text = col(text)
    return F.coalesce(
        F.when(text.contains("nswer"), digits_to_double(F.regexp_extract(text, V.REPORTED_ANSWER, 1))),
        _flat_boxed(text),
        F.when(text.contains("="), digits_to_double(F.regexp_extract(text, V.EQUALS_AT_EOL, 1))),
        digits_to_double(last(find_all(text, V.PLAIN_NUMBER))),
    )


def number_phrase(text: str | Column) -> Column:
    """Number behind the last numeric answer phrase."""
    return digits_to_double(_latest_phrase(col(text), V.NUMBER_PHRASES))


def numeric_answer(text: str | Column) -> Column:
    """First boxed number, last `####` number, last answer phrase, last number in the tail."""
    text = col(text)
    return F.coalesce(
        _flat_boxed(text),
        F.when(text.contains("####"), digits_to_double(last(find_all(text, V.HASH_NUMBER, 1)))),
        number_phrase(text),
        digits_to_double(last(find_all(text_tail(text), V.WORD_FREE_NUMBER))),
    )


def answer_tag(text: str | Column) -> Column:
    """Number in the first `ANSWER:` tag; `a/b` is evaluated, division by zero gives NULL."""
    # a look at one letter before the words are tried
    value = F.regexp_replace(first_match(col(text), "(?i)(?=[af])" + V.ANSWER_TAG), r"[,\s]", "")

    def parse(v: Column) -> Column:
        part = lambda i: F.get(F.split(v, "/", 2), F.lit(i)).try_cast("double")
        return F.when(v.contains("/"), F.try_divide(part(0), part(1))).otherwise(v.try_cast("double"))

    return F.when(col(text).rlike("(?i)answer"), let(value, parse))


def gold_number(answer: str | Column) -> Column:
    """Number after the last `####`."""
    return digits_to_double(last(find_all(col(answer), V.HASH_NUMBER, 1)))


def count_steps(answer: str | Column) -> Column:
    """Number of `<<…>>` calculation markers."""
    return F.regexp_count(col(answer), F.lit(V.STEP_MARKER))


def last_number(text: str | Column) -> Column:
    """First boxed number, else the last `a/b` evaluated, else the last number; LaTeX fractions ignored."""
    text = col(text)
    bare = F.regexp_replace(text, V.LATEX_FRACTION_ANY, "")
    ratio = let(
        last(find_all(bare, V.TEXT_FRACTION)),
        lambda m: F.try_divide(
            F.regexp_extract(m, V.TEXT_FRACTION, 1).try_cast("double"),
            F.regexp_extract(m, V.TEXT_FRACTION, 2).try_cast("double"),
        ),
    )
    return F.coalesce(
        F.when(text.contains("\\boxed{"), digits_to_double(F.regexp_extract(text, V.BOXED_NUMBER, 1))),
        F.when(text.contains("/"), ratio),
        digits_to_double(last(find_all(bare, V.SIGNED_NUMBER))),
    )


def normalized_answer(answer: str | Column) -> Column:
    """Answer text without `, $ % \\`; its first number if it has one."""
    bare = strip(F.translate(strip(col(answer)), ",$%\\", ""))
    return let(bare, lambda t: F.coalesce(first_match(t, V.SIGNED_NUMBER, 0), t))


# Four ways to compare an answer with the gold value. All are FALSE for a missing prediction.


def match_relative(gold: str | Column, predicted: str | Column, eps: float = 1e-5) -> Column:
    """Texts: numbers within `eps * max(1, |gold|, |pred|)`; otherwise equal ignoring case."""

    def compare(pair: Column) -> Column:
        g, p = pair["g"], pair["p"]
        gn, pn = to_double(g), to_double(p)
        close = F.abs(gn - pn) <= eps * F.greatest(F.lit(1.0), F.abs(gn), F.abs(pn))
        blank = (g == "") | (p == "")
        return F.when(blank, g == p).otherwise(F.coalesce(close, F.lower(g) == F.lower(p)))

    pair = F.struct(normalized_answer(gold).alias("g"), normalized_answer(predicted).alias("p"))
    return F.when(col(predicted).isNull(), F.lit(False)).otherwise(F.coalesce(let(pair, compare), F.lit(False)))


def match_absolute(gold: str | Column, predicted: str | Column, eps: float = 0.01) -> Column:
    """Texts: numbers at most `eps` apart; otherwise equal once trimmed."""
    g, p = strip(col(gold)), strip(col(predicted))
    return F.coalesce(F.abs(to_double(p) - to_double(g)) <= eps, p == g, F.lit(False))


def match_scaled(gold: str | Column, predicted: str | Column, eps: float = 1e-5) -> Column:
    """Numbers within `max(eps, |gold| * eps)`."""
    g, p = col(gold), col(predicted)
    return F.coalesce(F.abs(g - p) <= F.greatest(F.lit(eps), F.abs(g) * eps), F.lit(False))


def match_percent(gold: str | Column, predicted: str | Column, tolerance: float = V.DEPTH_TOLERANCE) -> Column:
    """Numbers whose relative error is strictly below `tolerance`."""
    g, p = col(gold), col(predicted)
    return F.coalesce(F.abs(p - g) / (F.abs(g) + 1e-9) < tolerance, F.lit(False))


MATCHERS = {
    "relative": match_relative,
    "absolute": match_absolute,
    "scaled": match_scaled,
    "percent": match_percent,
}


def numbers_in(text: str | Column) -> Column:
    """All plain numbers of a text, in order."""
    return F.transform(find_all(col(text), V.PLAIN_NUMBER), lambda n: n.cast("double"))


def first_error_step(
    response: str | Column, expected: str | Column, tolerance: float = V.STEP_TOLERANCE
) -> Column:
    """1-based index of the first expected value that the response does not reach in order; NULL if none."""
    expected = col(expected)

    def advance(reached: Column, n: Column) -> Column:
        target = F.get(expected, reached)
        near = F.abs(n - target) / (F.abs(target) + 1e-9) < tolerance
        return F.when(near, reached + 1).otherwise(reached)

    def finish(reached: Column) -> Column:
        return F.when(reached < F.size(expected), reached + 1)

    return let(
        numbers_in(response),
        lambda ns: F.when(F.size(ns) == 0, F.lit(1)).otherwise(F.aggregate(ns, F.lit(0), advance, finish)),
    )


def is_error_text(response: str | Column) -> Column:
    """A captured failure of the model call."""
    return F.startswith(col(response), F.lit("[ERROR:"))


