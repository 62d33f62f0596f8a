"""Fixed values.

Patterns, word lists, constants and prompt texts that have to keep exactly these values for results to
agree with previously published evaluation runs. Nothing here is logic. Patterns are ASCII-class regular
expressions; `[^\\n]` and the `d` flag keep "end of line" meaning a newline only.
"""

# --- fixed values: answer patterns -----------------------------------------------------------------
CHAT_TURN = r"(?i)\n(?:User|Assistant|System):\s*"
HASH_LINE = r"####\s*([^\n]+)"
HASH_NUMBER = r"####\s*([\-\d,\.]+)"
STEP_MARKER = r"<<[^>]+>>"
PHRASES = (
    r"(?i)(?:\*\*\s*)?Final answer\s*:\s*([^\n]+)",
    r"(?i)The\s+final\s+answer\s+is\s*:?\s*([^\n]+)",
    r"(?i)The\s+answer\s+is\s*:?\s*([^\n]+)",
    r"(?imd)^\s*Answer:\s*([^\n]+)",
)
NUMBER_PHRASES = (
    r"(?i)(?:\*\*\s*)?final\s+answer\s*:\s*\$?\s*([\-\d,\.]+)",
    r"(?i)the\s+(?:final\s+)?answer\s+is\s*:?\s*\$?\s*([\-\d,\.]+)",
    r"(?imd)^\s*answer\s*:\s*\$?\s*([\-\d,\.]+)",
)
NUMERIC_TOKEN = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?"
WORD_FREE_NUMBER = r"(?<!\w)-?\d[\d,]*(?:\.\d+)?"
PLAIN_NUMBER = r"\b\d+(?:\.\d+)?\b"
SIGNED_NUMBER = r"-?\d+(?:\.\d+)?"
LEADING_IS = r"(?i)^(?:is|=)\s*"
BOXED_OPEN = r"\\boxed\{"
BOXED_FLAT = r"\\boxed\{([^}]+)\}"
BOXED_NUMBER = r"\\boxed\{([-\d.]+)\}"
REPORTED_ANSWER = r"[Aa]nswer\s*:\s*\$?\s*([\d,]+\.?\d*)"
EQUALS_AT_EOL = r"(?md)=\s*\$?\s*([\d,]+\.?\d*)\s*$"
ANSWER_TAG = (
    r"(?i)(?:final\s+)?answer\s*:\s*\$?\s*"
    r"([-\d,]+(?:\.\d+)?(?:\s*/\s*[-\d,]+(?:\.\d+)?)?)"
)
TAIL_LINES = 25
TAIL_CHARS = 2000
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# --- fixed values: arithmetic patterns ---------------------------------------------------------------
LATEX_FRACTION = r"\\frac\{([\d.]+)\}\{([\d.]+)\}"
LATEX_FRACTION_ANY = r"\\frac\{[^}]*\}\{[^}]*\}"
LATEX_TEXT = r"\\(?:text|mathrm|mathbf)\{([^}]*)\}"
PAREN_FRACTION = r"\(\s*([\d.]+)\s*/\s*([\d.]+)\s*\)"
THOUSANDS = r"(\d),(\d{3})"
UNIT_AFTER_DIGIT = (
    r"(?i)(?<=[0-9])\s+(?:hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
    r"dollars?|cents?|euros?|rupees?|"
    r"apples?|books?|miles?|cookies?|items?|pieces?|balls?|flowers?|coins?|"
    r"marbles?|pencils?|stars?|tickets?|gallons?|points?|pounds?)\b"
)
OPERAND = r"(\d+(?:\.\d+)?)"
OPERATOR = r"([+\-*/×÷])"
TEXT_FRACTION = r"(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)"
VERIFY_TOLERANCE = 1e-4

# --- fixed values: clauses, names, filter lines ------------------------------------------------------
GOAL_CLAUSE = r"(?i)^\s*(?:how\s+(?:much|many)|what\s+is|find\s+(?:the|how))"
PROPER_NAME = r"\b([A-Z][a-z]+)\b"
UNIT_NOUN = (
    r"(?i)(dollars?|apples?|books?|hours?|miles?|cookies?|points?|"
    r"items?|pounds?|gallons?|minutes?|pieces?|cents?|tickets?|"
    r"balls?|flowers?|pencils?|stars?|coins?|marbles?)"
)
FILTER_LINE = r"(?i)^clause\s*\d+\s*:\s*([^\n]+?)\s*\|\s*(RELEVANT|IRRELEVANT)"
ANNOTATION_START = r"\n\n#(init|conditions|answer):"
GOAL_FALLBACK = "What is the final total after all operations above?"
RUNNING_TOTAL_CLAUSE = "Compute the running total after applying all operations above."

# --- fixed values: statistics ------------------------------------------------------------------------
WILSON_Z = 1.96
BOOTSTRAP_DRAWS = 10_000
CEILING_DROP = 0.30
DEPTH_TOLERANCE = 0.01
STEP_TOLERANCE = 0.05
MIN_STEPS = 6

# --- fixed values: prompts ---------------------------------------------------------------------------
SYSTEM_DIRECT = (
    "You are a precise math assistant. Read the problem carefully and output only the final numeric answer. "
    "Do not show any working. Format: Answer: <number>"
)
SYSTEM_COT = (
    "You are a precise math assistant. Solve the problem step by step. Show each calculation clearly. "
    "At the end, write your final answer as: Answer: <number>"
)
COT_SUFFIX = "\n\nPlease reason step by step, then give your final answer as: Answer: <number>"
SYSTEM_FILTER = (
    "You are a math problem analyzer. Your job is to identify which parts of a problem are needed to answer "
    "the question and which are irrelevant distractors."
)
SYSTEM_SOLVE = (
    "You are a careful math assistant. Reason step by step. Your final line MUST be exactly: "
    "#### <numeric_answer>. Use only a number in <numeric_answer> (no words, currency symbols, units, or "
    "extra text). If the answer is an integer, write an integer; otherwise write a decimal."
)
SOLVE_SUFFIX = "\n\nSolve step by step."
SYSTEM_CHUNK = (
    "You are a math solver. Solve the given problem using only the known values provided. "
    "Show your work step by step."
)
# known values, numbered steps, reminder
CHUNK_PROMPT = (
    "Known values:\n%s\n\nNew information (follow these steps IN ORDER):\n%s"
    "\n\nUsing ONLY the known values and the new information above, work through each numbered step IN THE "
    "ORDER GIVEN. Show each calculation as: number operation number = result.\n%s"
    "\nAfter all steps, write your final answer as:\nANSWER: <number>\n"
)
CHUNK_REMINDER = (
    "IMPORTANT: current_total is your starting amount. Your ANSWER must be the result of applying the new "
    "steps TO current_total, not just the result of the new steps alone. For example, if current_total=135 "
    "and a cost is 33.75, write 135 - 33.75 = 101.25, then ANSWER: 101.25."
)
NO_CONTEXT = "(none yet — this is the start of the problem)"
CONTEXT_NOTE = "  ← use ONLY this as your starting amount"

# --- fixed values: generated problems ----------------------------------------------------------------
ACTORS = ["Alice", "Bob", "Carlos", "Diana", "Eve", "Frank", "Grace", "Henry"]
ITEMS = ["apples", "books", "boxes", "tickets", "pens", "bags", "coins", "cards"]
JOBS = ["earns", "collects", "receives", "gathers"]
BUY_VERBS = ["buys", "purchases"]
USE_VERBS = ["uses", "spends", "donates", "gives away"]
FEES = [10, 20, 25]
MONEY = "$"
EARN_SENTENCE = "%s %s $%d per hour and works %d hours."
HALF_SENTENCE = "%s spends half of %s's remaining $ on %s."
THIRD_SENTENCE = "%s spends a third of %s's remaining $ on %s."
QUARTER_SENTENCE = "%s spends a quarter of %s's remaining $ on %s."
BUY_SENTENCE = "%s then %s %d %s at $%d each."
BONUS_SENTENCE = "%s also receives a $%d bonus."
FEE_SENTENCE = "A %d%% fee is deducted from %s's total."
DOUBLE_SENTENCE = "%s doubles %s's current $ total."
USE_SENTENCE = "%s %s $%d on %s."
GOAL_SENTENCE = " How much $ does %s have in the end?"

# --- fixed values: ids and file names ----------------------------------------------------------------
GENERATED_ID = "depth%02d_prob%04d"
PREPARED_ID = "gsm8k_%04d"
SEQUENCE_ID = "prob_%04d"
CHUNK_FILES = "*exp4_chunked_*.json"
CHUNK_FILE_MODEL = r"exp4_chunked_([^/]+?)(?:_ckpt_\d+)?\.json"
SNAPSHOT_MARK = "_ckpt_"
QA_FILES = "*_cot.jsonl"
# folders that a partitioned write names (`column=value`) count like plain ones
QA_FILE_MODEL = r"/(?:[^/=]+=)?([^/=]+?)_cot\.jsonl"
SEED_DIR = r"/(?:[^/=]+=)?(seed_[^/=]+)/"

# --- fixed values: labels ----------------------------------------------------------------------------
MODEL_LABELS = {
    "qwen25_math_1.5b": "Qwen2.5-Math-1.5B",
    "gemma4_e2b": "Gemma 4 E2B",
    "phi4_mini": "Phi-4-mini",
}
CHUNK_SIZES = {"qwen25_math_1.5b": 2, "gemma4_e2b": 4, "phi4_mini": 4}
DISTRACTOR_LABELS = {
    "TYPE_A": "Scope Confusion",
    "TYPE_B": "Wrong Formula",
    "TYPE_C": "Unit Trap",
    "TYPE_D": "Temporal Misdirection",
}
