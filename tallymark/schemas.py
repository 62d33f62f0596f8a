"""Explicit schemas of every table the library reads or writes; nothing is inferred. Written as DDL."""

from __future__ import annotations

TEMPLATE = (
    "question STRING, answer STRING, id_orig INT, id_shuffled INT, "
    "question_annotated STRING, answer_annotated STRING"
)
POOL = "ARRAY<STRUCT<type: STRING, text: STRING>>"
TEMPLATE_WITH_POOL = f"{TEMPLATE}, dynamic_distractor_pool {POOL}"
# Some pools hold bare strings; read as text they can be told apart from objects row by row.
TEMPLATE_WITH_RAW_POOL = f"{TEMPLATE}, dynamic_distractor_pool ARRAY<STRING>"
DISTRACTED = (
    "question STRING, answer STRING, question_original STRING, distractor STRING, "
    "distractor_type STRING, id_orig INT, id_shuffled INT, source_file STRING"
)
MATH_PROBLEM = (
    "problem_id STRING, depth INT, question STRING, ground_truth DOUBLE, "
    "intermediate_values ARRAY<DOUBLE>, operations ARRAY<STRING>, answer_unit STRING"
)
QA_PROBLEM = "problem_id STRING, question STRING, answer STRING, ground_truth DOUBLE, estimated_steps INT"
DEPTH_RESULT = (
    "model STRING, regime STRING, problem_id STRING, depth INT, question STRING, ground_truth DOUBLE, "
    "response STRING, predicted DOUBLE, is_correct BOOLEAN, is_collapse BOOLEAN, "
    "first_error_step INT, elapsed_s DOUBLE"
)
QA_RESULT = (
    "model STRING, problem_id STRING, estimated_steps INT, question STRING, ground_truth DOUBLE, "
    "response STRING, predicted DOUBLE, is_correct BOOLEAN, is_collapse BOOLEAN, elapsed_s DOUBLE"
)
VARIANT_RESULT = (
    "source_file STRING, id_orig INT, id_shuffled INT, question STRING, question_original STRING, "
    "distractor STRING, ground_truth_extracted STRING, predicted_extracted STRING, correct BOOLEAN, "
    "full_model_output STRING, error STRING"
)
MODEL_BLOCK = (
    "MAP<STRING, STRUCT<model_id: STRING, family: STRING, accuracy: DOUBLE, n_correct: BIGINT, "
    "n_evaluated: BIGINT, n_skipped_no_gold: BIGINT>>"
)
PAYLOAD = f"original {MODEL_BLOCK}, enhanced {MODEL_BLOCK}"
FILTER_RECORD = (
    "problem_id STRING, filter_model STRING, filter_response STRING, relevant_clauses ARRAY<STRING>, "
    "irrelevant_clauses ARRAY<STRING>, filter_failed BOOLEAN, clean_problem STRING"
)
FILTERED_RESULT = (
    "solver_model STRING, filter_model STRING, problem_id STRING, distracted_question STRING, "
    "question_original STRING, distractor STRING, distractor_type STRING, ground_truth STRING, "
    "filter_response STRING, relevant_clauses ARRAY<STRING>, irrelevant_clauses ARRAY<STRING>, "
    "filter_failed BOOLEAN, clean_problem STRING, solve_response STRING, predicted STRING, "
    "is_correct BOOLEAN, elapsed_s DOUBLE"
)
VERIFICATION = (
    "STRUCT<left: DOUBLE, op: STRING, right: DOUBLE, claimed: DOUBLE, full_match: STRING, "
    "resolved_left: DOUBLE, resolved_right: DOUBLE, computed: DOUBLE, status: STRING, "
    "corrected_value: DOUBLE>"
)
CHUNK_LOG = (
    "STRUCT<chunk_text: STRING, context_before: MAP<STRING, DOUBLE>, slm_response: STRING, "
    f"expressions_found: ARRAY<STRING>, verification_log: ARRAY<{VERIFICATION}>, answer_tag: DOUBLE, "
    "context_after: MAP<STRING, DOUBLE>, extraction_method: STRING, num_retries: INT>"
)
CHUNK_RESULT = (
    "id INT, problem STRING, gold STRING, depth INT, estimated_steps INT, num_clauses INT, num_chunks INT, "
    "chunk_size INT, predicted STRING, correct BOOLEAN, total_expressions_checked INT, "
    "corrections_applied INT, extraction_failures INT, unverified_fallbacks INT, "
    f"chunk_logs ARRAY<{CHUNK_LOG}>"
)
ACCURACY_METRIC = (
    "model STRING, regime STRING, depth INT, n_total BIGINT, n_correct BIGINT, n_collapse BIGINT, "
    "acc DOUBLE, collapse_rate DOUBLE, step_acc DOUBLE"
)
CEILING_METRIC = "model STRING, regime STRING, baseline_acc DOUBLE, threshold DOUBLE, k_star INT"
