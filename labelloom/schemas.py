"""Explicit schemas of the sources; nothing is inferred at read time."""

from __future__ import annotations

ABSTRACTS = "ID string, ABSTRACT string, SDG int"
COMMUNITY = "text string, sdg int, agreement double"
NULL_CLASS = (
    "id string, title string, abstract string, field string,"
    " sdg_relation int, sdg_label int"
)
NULL_CLASS_TOPIC = (
    "_c0 int, id string, title string, abstract string, field string, sdg_relation int"
)
SEARCH_HITS = (
    "topic string, rank int, paperId string, title string, year int,"
    " abstract string, fieldsOfStudy array<string>"
)
SYNTHETIC = (
    "text string, sdg_id int, main_topic string, sub_topic string,"
    " style string, length int"
)
GOALS = "goal int, description string"
SUBTOPICS = "map<string, map<string, struct<Subtopics: array<string>>>>"
METADATA = "id string, meta map<string, string>"
TARGET_ROWS = "goal int, row_no int, cells array<string>"
RESPONSES = "prompt_id string, message string"
PREPARED = "text string, label int, is_abstract int"
CLEANED = "text_clean string, label int, is_abstract int"
PREDICTIONS = "row_id bigint, logits array<double>, label int"
