"""Literal cases for every text branch."""

import math

import pytest
from pyspark.sql import functions as F

from tallymark.functions import answers as A
from tallymark.functions import arithmetic as M
from tallymark.functions import clauses as C
from tallymark.functions import prompts as P
from tallymark.functions import stats as S


def test_step_markers_and_gold(values):
    text = "They pack <<6*2=12>>12 boxes, then <<1=1>>1 foot\n#### 10"
    assert values(lambda: A.count_steps("x"), [text, "none", "<<>>"]) == [2, 0, 0]
    assert values(lambda: A.gold_number("x"), [text, "#### 1,234\n#### -5.5", "no gold", "#### ."]) == [
        10.0, -5.5, None, None]


def test_chat_turn_and_base_text(values):
    assert values(lambda: A.before_chat_turn("x"), ["a\nuser: b\nSystem: c", "a", "User: a"]) == ["a", "a", "User: a"]
    assert values(lambda: A.base_text("x"), ["q text \n\n#init: a\n\n#answer: b", "plain"]) == ["q text", "plain"]


def test_numeric_candidate(values):
    got = values(lambda: A.numeric_candidate("x"), ["is $1,234.50", "= 7%", r"\$5\ ", "-3e4", "a1 b2 9", "none", "", "v1.5"])
    assert got == ["1234.50", "7", "5", "-3e4", "9", None, None, None]


def test_hash_answer(values):
    got = values(lambda: A.hash_answer("x"), ["#### 5\nx\n####  10\r", "####\n7", "#### seven", "none", None])
    assert got == ["10", "7", "seven", None, None]


def test_answer_phrase(values):
    got = values(
        lambda: A.answer_phrase("x"),
        ["Final answer: The answer is 5", "The answer is 3.\nAnswer: 4", "Answer: 4\nThe final answer is: 8",
         "the answer is the answer is 5", "not Answer: 4", "**Final answer: 6**", "Final answer:   \n 12", "no"],
    )
    assert got == ["5", "4", "8", "the answer is 5", None, "6**", "12", None]


def test_last_boxed(values):
    got = values(
        lambda: A.last_boxed("x"),
        [r"\boxed{\frac{1}{2}}", r"\boxed{1} and \boxed{2", r"\boxed{a\boxed{b}c}", "none", r"\boxed{{{{5}}}}", r"\boxed{}"],
    )
    assert got == [r"\frac{1}{2}", "1", "b", None, "{{{5}}}", ""]


def test_final_answer(values):
    long_tail = "\n".join(["7"] + ["x"] * 30)
    got = values(
        lambda: A.final_answer("x"),
        ["#### 12 apples", "The answer is $1,000.", r"so \boxed{3.5}", "it is 4 or 5", "x\nUser: 5", "Final answer: none",
         long_tail, "", None, "[ERROR: status 503]", "#### ten"],
    )
    assert got == ["12", "1000", "3.5", "5", None, "none", None, None, None, "503", "ten"]


def test_text_tail_is_bounded(values):
    text = "9 " + "x" * 2000
    assert values(lambda: A.final_answer("x"), [text, "9" + "x" * 1998]) == [None, "9"]


def test_reported_answer(values):
    got = values(
        lambda: A.reported_answer("x"),
        ["Answer: $1,234.5 and Answer: 2", "Answer: ,", r"\boxed{$42$}", r"\boxed{x} a = 5", "a = 3\nb = 4 kg", "7 then 8",
         "none", "Answer: -5", "v = 12 \nend 99", r"\boxed{5d} 6"],
    )
    assert got == [1234.5, None, 42.0, 5.0, 3.0, 8.0, None, 5.0, 12.0, 6.0]


def test_numeric_answer(values):
    got = values(
        lambda: A.numeric_answer("x"),
        [r"\boxed{7} \boxed{8} #### 9", "#### 1\n#### 2,000", "The answer is $5", "a\nanswer: 3\nThe final answer is 4",
         "x 1 y -2", "none", "#### -", "Final Answer: ."],
    )
    assert got == [7.0, 2000.0, 5.0, 4.0, -2.0, None, None, None]


def test_answer_tag(values):
    got = values(
        lambda: A.answer_tag("x"),
        ["ANSWER: $30.375", "ANSWER: 200/3", "final answer : 1,000", "ANSWER: 5/0", "ANSWER: -", "none", "answer: 4 then answer: 5"],
    )
    assert got == [30.375, pytest.approx(200 / 3), 1000.0, None, None, None, 4.0]


def test_last_number(values):
    got = values(
        lambda: A.last_number("x"),
        [r"\boxed{5} 7", "1/2 then 9", "3/0 then 8", r"\frac{1}{7} and 6", "none", "-4", r"\boxed{1.2.3} 9"],
    )
    assert got == [5.0, 0.5, 8.0, 6.0, None, -4.0, 9.0]


def test_normalized_answer(values):
    got = values(lambda: A.normalized_answer("x"), [" $1,200% ", r"\$5 apples", "Five", "  ", "-2.50"])
    assert got == ["1200", "5", "Five", "", "-2.50"]


def test_matchers(values):
    pairs = [("10", "10.00001"), ("10", "10.1"), ("Ten", "tEN"), ("", "5"), ("10", None), ("1,000", "$1000")]
    assert values(lambda: A.match_relative("g", "p"), pairs, "g STRING, p STRING") == [True, False, True, False, False, True]
    assert values(lambda: A.match_absolute("g", "p"), [("10", "10.01"), ("10", "10.02"), ("a", " a"), (None, "1")],
                  "g STRING, p STRING") == [True, False, True, False]
    assert values(lambda: A.match_scaled("g", "p"), [(1e6, 1e6 + 9), (1.0, 1.1), (1.0, None)],
                  "g DOUBLE, p DOUBLE") == [True, False, False]
    assert values(lambda: A.match_percent("g", "p"), [(100.0, 101.0), (100.0, 101.1), (0.0, 0.0), (5.0, None)],
                  "g DOUBLE, p DOUBLE") == [True, False, True, False]


def test_first_error_step(values):
    cases = [("1 3 6", [1.0, 3.0, 6.0]), ("1 6", [1.0, 3.0, 6.0]), ("none", [1.0]), ("0 1 2 3 9 6", [1.0, 3.0, 6.0]),
             ("6 3 1", [1.0, 3.0, 6.0])]
    assert values(lambda: A.first_error_step("r", "e"), cases, "r STRING, e ARRAY<DOUBLE>") == [None, 2, 1, None, 2]


def test_plain_arithmetic(values):
    got = values(
        lambda: M.plain_arithmetic("x"),
        ["9 hours × 15 dollars = 135", r"\frac{1}{5} \times \$1,234,567", r"\text{ 12 } \mathrm{kg}", r"\frac{3}{0}\div 2\cdot3",
         r"\frac{1.2.3}{4}", "5 itemset"],
    )
    assert got == ["9 × 15 = 135", "0.2 × 1234567", "12  ", "0÷ 2×3", r"\frac{1.2.3}{4}", "5 itemset"]


def test_expand_fractions(values):
    got = values(lambda: M.expand_fractions("x"), ["5 * (1/5) = 1", "(1/0) (1 / 4)", "(1.2.3/4)"])
    assert got == ["5 * 0.2 = 1", "(1/0) 0.25", "(1.2.3/4)"]


def expressions(rows):
    return [(e.left, e.op, e.right, e.claimed) for e in rows]


def test_expressions_in(values):
    texts = ["5 - 7 = -2", "1 + 2 = 3 + 4 * 5 = 23", "2 + 3 * 4 = 14", "1 + 2 + 3 + 4 = 10", "6 × 5 = 30 so 30 ÷ 5 = 6",
             "4 / 0 + 3 = 3", "1 + 1 + 1 = 3 then 2 * 2 = 4", "a 1/2 + 3 = 4"]
    got = [expressions(r) for r in values(lambda: M.expressions_in("x"), texts)]
    assert got == [
        [],
        [(3.0, "+", 4.0, 7.0), (7.0, "*", 5.0, 23.0)],
        [(2.0, "+", 3.0, 5.0), (5.0, "*", 4.0, 14.0)],
        [(2.0, "+", 3.0, 5.0), (5.0, "+", 4.0, 10.0)],
        [(6.0, "*", 5.0, 30.0), (30.0, "/", 5.0, 6.0)],
        [(0.0, "+", 3.0, 3.0)],
        [(1.0, "+", 1.0, 2.0), (2.0, "+", 1.0, 3.0), (2.0, "*", 2.0, 4.0)],
        [(1.0, "/", 2.0, 0.5), (0.5, "+", 3.0, 4.0)],
    ]
    full = values(lambda: F.transform(M.expressions_in("x"), lambda e: e["full_match"]), ["2 + 3*4 = 14"])
    assert full == [["2 + 3", "2 + 3*4 = 14"]]


def test_symbolic_operands(values):
    names = F.array(
        F.struct(F.lit("total").alias("name"), F.lit(1.0).alias("value")),
        F.struct(F.lit("current_total").alias("name"), F.lit(32.0).alias("value")),
    )
    got = values(lambda: M.expressions_in("x", names), ["current_total - 4 = 28", "subtotal - 4 = 28"])
    assert [expressions(r) for r in got] == [[(32.0, "-", 4.0, 28.0)], []]


def verdicts(rows):
    return [(v.status, v.corrected_value) for v in rows]


def test_verify(values):
    texts = ["6 * 5 = 30 and 30 * 5 = 150", "2 + 3 * 4 = 14", "7 / 0 = 1 then 1 * 0 = 0", "2 * 3 = 7, 7 * 3 = 21, 21 * 3 = 63",
             "2 + 3 = 5, 5 + 3 = 8", "2 * 3 = 6, 6 * 3 = 99, 99 * 3 = 1"]
    got = [verdicts(r) for r in values(lambda: M.verify(M.expressions_in("x")), texts)]
    assert got == [
        [("correct", 30.0), ("double_count", 30.0)],
        [("correct", 5.0), ("corrected", 20.0)],
        [("error", None), ("correct", 0.0)],
        # the first row is corrected, so the second is no double count; the third then is one
        [("corrected", 6.0), ("correct", 21.0), ("double_count", 21.0)],
        [("correct", 5.0), ("correct", 8.0)],
        # a double count that is also wrong does not shield its successor
        [("correct", 6.0), ("double_count", 6.0), ("double_count", 99.0)],
    ]


def test_chain_terminal(values):
    texts = [("2 + 3 = 5, 5 + 1 = 6, 9 + 9 = 18", None), ("2 + 3 = 5, 9 + 9 = 18", 9.0), ("2 + 3 = 5", None), ("none", None),
             ("6 * 5 = 30, 30 * 5 = 150", None)]
    got = values(lambda: M.chain_terminal(M.verify(M.expressions_in("x")), "t"), texts, "x STRING, t DOUBLE")
    assert got == [1, 1, 0, -1, 0]


def test_clauses(values):
    assert values(lambda: C.split_clauses("x"), ["One two. Three! Is it?  no\nnew line", "a. bcd"]) == [
        ["One two.", "Three!", "Is it?", "no.", "new line"], ["bcd"]]
    assert values(lambda: C.group_clauses(F.split("x", ","), 2), ["a,b,c", "a"]) == [[["a", "b"], ["c"]], [["a"]]]
    assert values(lambda: C.is_goal_clause("x"), ["How many?", "how much = 2?", " What is it", "Find the sum", "So how many"]) == [
        True, False, True, True, False]
    assert values(lambda: C.numbered_lines(F.split("x", ",")), ["a,b"]) == ["1. a\n2. b"]


def test_route_chunks(values):
    route = lambda: C.route_chunks("x", C.split_clauses("x"), 2)
    total, goal = "Compute the running total after applying all operations above.", "What is the final total after all operations above?"
    got = values(route, ["Fact one. Fact two. How many?", "Fact one. Fact two. Fact three.", "How many? What is it?",
                         "F one. F two. F three. How many? How much?"])
    assert got == [
        [["Fact one.", "Fact two.", "How many?"]],
        [["Fact one.", "Fact two.", total], ["Fact three.", goal]],
        [["How many? What is it?", "How many?", "What is it?"]],
        [["F one.", "F two.", total], ["F three.", "How many?"]],
    ]


def test_inject_distractor(values):
    cases = [("A is 1. B is 2. How many?", "The sky is blue.."), ("How many?", "d one."), ("Just this.", "d"), ("A. B?", "  "), ("A. B?", None)]
    schema = "q STRING, d STRING"
    assert values(lambda: C.inject_distractor("q", "d"), cases, schema) == [
        "A is 1. B is 2. The sky is blue. How many?", "How many, d one?", "Just this. d.", "A. B?", "A. B?"]
    assert values(lambda: C.inject_distractor("q", "d", "end"), cases[:1], schema) == [
        "A is 1. B is 2. How many, The sky is blue?"]


def test_filter_lines_and_detection(values):
    text = "Clause 1: a | RELEVANT\nclause 2: b b | irrelevant\nnoise\n xClause 3: c | RELEVANT"
    got = values(lambda: C.parse_filter_lines("x"), [text])[0]
    assert (got.relevant, got.irrelevant) == (["a"], ["b b"])
    cases = [("Blue Sky", ["the blue sky is", "x"]), ("the blue sky", ["BLUE"]), ("", [""]), (None, ["a"]), ("q", [])]
    assert values(lambda: C.distractor_detected("d", "c"), cases, "d STRING, c ARRAY<STRING>") == [True, True, False, False, False]


def test_pool_names_context(values):
    got = values(lambda: C.parse_pool("x"), ['[{"type":"TYPE_A","text":"t"},"bare",{"text":"u"}]', '{"a":1}', "oops", None, "[1"])
    assert [(e.type, e.text) for e in got[0]] == [("TYPE_A", "t"), ("UNKNOWN", "bare"), ("UNKNOWN", "u")]
    assert got[1:] == [[], [], [], []]
    assert values(lambda: C.variable_name("x", F.lit(1)), ["Bob has 3 apples", "Eve pays", "no name", "ten DOLLARS"]) == [
        "bob_apples", "eve_value", "step_2_result", "step_2_result"]
    ctx = F.create_map(F.lit("__last__"), F.lit(1.0), F.lit("12.0"), F.lit(2.0), F.lit("current_total"), F.lit(3.0))
    assert values(lambda: C.context_snapshot(ctx), ["x"]) == [{"current_total": 3.0}]


def test_wilson_and_bins(values):
    got = values(lambda: S.wilson("k", "n"), [(0, 0), (5, 10), (10, 10)], "k INT, n INT")
    assert (got[0].lo, got[0].hi) == (0.0, 1.0)
    assert got[1].lo < 0.5 < got[1].hi and math.isclose(got[1].lo + got[1].hi, 1.0)
    assert got[2].hi == 1.0 and 0.69 < got[2].lo < 0.73
    assert values(lambda: S.step_bin("s", 2), [(0,), (1,), (2,), (3,)], "s INT") == [-1, 1, 1, 3]


def test_bootstrap(values):
    cases = [("a", [0.5]), ("b", []), ("c", [0.1, 0.5, 0.9]), ("d", [float(i) for i in range(9)])]
    got = values(lambda: S.bootstrap_ci("v", "k", 200), cases, "k STRING, v ARRAY<DOUBLE>")
    assert (got[0].lo, got[0].hi) == (0.5, 0.5)
    assert (got[1].lo, got[1].hi) == (None, None)
    assert 0.1 <= got[2].lo < 0.5 < got[2].hi <= 0.9
    assert 1.0 < got[3].lo < 4.0 < got[3].hi < 7.0
    assert got == values(lambda: S.bootstrap_ci("v", "k", 200), cases, "k STRING, v ARRAY<DOUBLE>")


def test_labels_and_prompts(values):
    assert values(lambda: S.label_of("x", {"m": "Model"}), ["m", "z"]) == ["Model", "z"]
    assert values(lambda: S.mean_std_label(F.lit(0.5), F.lit(0.01)), ["x"]) == ["0.500 ± 0.010"]
    got = values(lambda: P.chunk_prompt(F.split("x", ","), "t"), [("a,b", None), ("a", 12.5)], "x STRING, t DOUBLE")
    assert "(none yet" in got[0] and "1. a\n2. b" in got[0] and "IMPORTANT" not in got[0]
    assert "current_total = 12.5  ←" in got[1] and "IMPORTANT" in got[1]
    assert values(lambda: P.filter_prompt("x", "P:\n{problem}\n"), ["q"]) == ["P:\nq\n"]
