"""Declared schemas, as DDL that readers take; nothing is inferred."""

from __future__ import annotations

DIMENSIONS = ("faithfulness", "single_focus", "informativeness", "cleanliness")
LEVELS = (1, 2, 3, 4, 5)
#: The source-filter labels.
SOURCE_LABELS = (
    "usable",
    "unusable_multiple_independent_items",
    "unusable_substantive_content_not_in_text",
    "unusable_damaged_or_fragmentary_text",
    "unusable_insufficient_substantive_content",
    "unusable_other",
)
EDIT_TYPES = ("pipes_removed", "boilerplate_stripped", "truncation_repaired", "light_edit", "full_rewrite")
WINNERS = ("a", "b", "tie")


RAW_RECORD = ("id STRING, text STRING, headline STRING")
TRIMMED_RECORD = ("id STRING, text STRING, headline STRING, tail_boilerplate_removed BOOLEAN")
TAIL_CANDIDATE = ("tail STRING, count BIGINT, length INT, ids ARRAY<STRING>")
SOURCE_FILTER_RESULT = ("id STRING, filter_label STRING")
HEADLINE_RESULT = ("id STRING, replacement_headline STRING")
FAILED_LINE = ("id STRING, batch_id STRING, custom_id STRING, error STRUCT<code: STRING, message: STRING>")
FINAL_RECORD = ("hesum_id STRING, text STRING, headline STRING")
LEDGER = (
    "hesum_id STRING, article_tokens INT, headline_tokens INT, n_pipes INT, over_token_budget BOOLEAN, multi_pipe BOOLEAN, "
    "tail_boilerplate_removed BOOLEAN, source_label STRING, reached_model_curation BOOLEAN, headline_action STRING, "
    "headline_edit_type STRING, headline_lead_overlap DOUBLE"
)
JUDGE_SCORES = ("hesum_id STRING, scores MAP<STRING, STRUCT<score: INT, justification: STRING>>")
JUDGE_OUTCOME = ("hesum_id STRING, outcome STRING")
ANNOTATION = (
    "annotator_id STRING, hesum_id STRING, task STRING, submitted_at STRING, "
    "scores STRUCT<faithfulness: INT, single_focus: INT, informativeness: INT, cleanliness: INT>, winner STRING, slot_map MAP<STRING, STRING>"
)
WORKLIST = ("split_mode STRING, annotators ARRAY<STRING>, rows ARRAY<STRUCT<hesum_id: STRING, assigned_annotator: STRING, tasks: ARRAY<STRING>>>")
TRAINING_RECORD = ("text STRING, summary STRING, source STRING, hesum_id STRING")
PREDICTION = ("text STRING, reference STRING, prediction STRING, model STRING, variant STRING")
RUBRIC_PAIR = (
    "text_prefix STRING, raw_scores STRUCT<faithfulness: INT, single_focus: INT, informativeness: INT, cleanliness: INT>, "
    "curated_scores STRUCT<faithfulness: INT, single_focus: INT, informativeness: INT, cleanliness: INT>"
)
PAIRWISE_ROW = ("curated_is_a BOOLEAN, winner STRING, outcome STRING, justification STRING, text_prefix STRING")
