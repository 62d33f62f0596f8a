"""Random texts: native rules against Python's `re` with the same fixed pattern."""

import random
import re

from pyspark.sql import functions as F

from tallymark.functions import answers as A
from tallymark.functions import arithmetic as M
from tallymark.functions import clauses as C
from tallymark.functions import fixed as V
from tallymark.functions.base import find_all


def texts(n=400, seed=7):
    rng = random.Random(seed)
    words = ["1", "23", "4.5", "6,000", "-7", "= ", "+ ", "* ", "/ ", "answer", "Answer: ", "\n", " ", ". ", "? ", "$", "x", "####", "\\boxed{", "}", "{",
             "The answer is ", "Final answer: ", "hours ", "current_total", "(", ")", "User: "]
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_patterns_mean_the_same_in_python(values):
    sample = texts()
    for pattern in (V.NUMERIC_TOKEN, V.WORD_FREE_NUMBER, V.PLAIN_NUMBER, V.SIGNED_NUMBER, V.TEXT_FRACTION):
        got = values(lambda p=pattern: find_all(F.col("x"), p), sample)
        assert got == [[m.group(0) for m in re.finditer(pattern, t, re.ASCII)] for t in sample]


def test_first_matches_mean_the_same_in_python(values):
    sample = texts(seed=8)
    for pattern in (V.REPORTED_ANSWER, V.ANSWER_TAG, V.BOXED_FLAT, V.BOXED_NUMBER):
        got = values(lambda p=pattern: F.regexp_extract("x", p, 1), sample)
        assert got == [(m.group(1) if (m := re.search(pattern, t, re.ASCII)) else "") for t in sample]


def test_clauses_keep_all_words(values):
    sample = texts(seed=9)
    for text, clauses in zip(sample, values(lambda: C.split_clauses("x"), sample)):
        assert all(len(c) > 2 and c == c.strip() for c in clauses)
        kept = re.sub(r"\s", "", "".join(clauses))
        whole = re.sub(r"\s", "", text.replace("\n", ". "))
        assert len(kept) <= len(whole) and all(re.sub(r"\s", "", c) in whole for c in clauses)


def test_groups_partition_the_clauses(values):
    rows = [(list(map(str, range(n))), s) for n in range(0, 9) for s in range(1, 5)]
    for (clauses, size), groups in zip(rows, values(lambda: C.group_clauses("c", F.col("s")), rows, "c ARRAY<STRING>, s INT")):
        assert [c for g in groups for c in g] == clauses
        assert all(len(g) == size for g in groups[:-1]) and all(len(g) <= size for g in groups)


def test_expressions_come_from_the_text(values):
    sample = texts(seed=10)
    plain = values(lambda: M.expand_fractions(M.plain_arithmetic("x")), sample)
    for text, found in zip(plain, values(lambda: M.expressions_in("x"), sample)):
        assert all(e.full_match in text or re.fullmatch(r"\S+ . \S+", e.full_match) for e in found)
        assert all(e.op in "+-*/" for e in found)


def test_verdicts_are_consistent(values):
    sample = [t.replace("x", " 2 * 3 = 6 6 * 3 = 18 ") for t in texts(seed=11)]
    for log in values(lambda: M.verify(M.expressions_in("x")), sample):
        for i, v in enumerate(log):
            if v.status == "correct":
                assert abs(v.computed - v.claimed) <= 1e-4 and v.corrected_value == v.claimed
            elif v.status == "corrected":
                assert abs(v.computed - v.claimed) > 1e-4 and v.corrected_value == v.computed
            elif v.status == "double_count":
                assert v.op in "*/" and v.corrected_value == log[i - 1].claimed and log[i - 1].status != "corrected"
            else:
                assert v.op == "/" and v.right == 0


def test_cascades_never_fail(values):
    sample = texts(800, seed=12) + ["", "\n", "####", "\\boxed{", "Answer:", "Answer: ,", "####  \n", "{" * 50]
    for rule in (A.final_answer, A.reported_answer, A.numeric_answer, A.answer_tag, A.last_number, A.text_tail, A.last_boxed):
        assert len(values(lambda r=rule: r("x"), sample)) == len(sample)
