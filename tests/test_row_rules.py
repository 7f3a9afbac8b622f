"""Row rules of single records: one valid record of some kinds, then one change and the code that it breaks."""

import json

import pytest
from pyspark.sql import functions as F

from veritrail import schemas

SPAN = {"text_id": "t", "start": 2, "end": 5, "exact_text": "abc"}
HAVE = {"availability": "available", "data": ["x"]}
VALID = {
    "alternative_inspection": {"state": "inspected", "excerpt_text_id": "t", "decision_id": "d", "correspondence": "match", "coverage": "assessable"},
    "step_attempt": {"status": "succeeded", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:00:01Z", "outcome_uncertain": False},
    "observation": {"status": "succeeded", "raw_artifact_id": "a", "answer_text_id": "t", "source_reference_ids": HAVE, "citation_reference_ids": HAVE},
    "review": {"decision": "corrected", "correction": {"status": "categorized", "category": 2}},
    "passage": {"span": SPAN, "heading_spans": [SPAN, {**SPAN, "start": 0, "end": 3}]},
    "source_reference": {"reference_kind": "citation", "excerpt": {"availability": "available", "data": SPAN}},
    "text_unit": {"unit_kind": "heading", "span": SPAN},
}
ERROR = {"code": "x", "message": "y", "retryable": False}
CASES = [
    ("alternative_inspection", {"decision_id": None}, "inspection_requires_excerpt_and_decision"), ("alternative_inspection", {"correspondence": "not_assessed"}, "inspected_cannot_be_not_assessed"),
    ("alternative_inspection", {"state": "unavailable"}, "unassessed_cannot_have_correspondence_decision"), ("alternative_inspection", {"state": "unassessed", "correspondence": "not_assessed", "decision_id": None}, "unassessed_coverage_is_insufficient"),
    ("step_attempt", {"finished_at": "2023-01-01T00:00:00Z"}, "attempt_timing_reversed"), ("step_attempt", {"error": ERROR}, "attempt_failure_requires_error_only_on_failure"), ("step_attempt", {"finished_at": None}, "terminal_attempt_requires_finish_time"),
    ("step_attempt", {"status": "running"}, "terminal_attempt_requires_finish_time"), ("step_attempt", {"outcome_uncertain": True}, "uncertain_attempt_cannot_be_successful"),
    ("observation", {"citation_reference_ids": {"availability": "unavailable", "data": ["x"], "reason": "r"}}, "unavailable_requires_null_data_and_reason"), ("observation", {"citation_reference_ids": {"availability": "unavailable"}}, "unavailable_requires_null_data_and_reason"),
    ("observation", {"source_reference_ids": {"availability": "available"}}, "available_or_incomplete_requires_data"), ("observation", {"source_reference_ids": {**HAVE, "availability": "incomplete"}}, "incomplete_requires_reason"),
    ("observation", {"fanout_queries": {**HAVE, "availability": "perhaps"}}, "value_not_allowed"), ("observation", {"answer_text_id": None}, "successful_capture_requires_raw_and_answer"), ("observation", {"error": ERROR}, "capture_failure_requires_error_only_on_failure"),
    ("review", {"correction": None}, "corrected_review_requires_correction_only"), ("review", {"correction": {"status": "categorized"}}, "correction_category_status_mismatch"), ("review", {"decision": "maybe"}, "value_not_allowed"), ("review", {"supersedes_review_id": "r"}, "review_cannot_supersede_itself"),
    ("passage", {"span": {**SPAN, "end": 2}}, "span_end_must_exceed_start"), ("passage", {"heading_spans": [SPAN, {**SPAN, "end": 9}]}, "span_length_mismatch"), ("passage", {"span": {**SPAN, "start": -1}}, "span_end_must_exceed_start"),
    ("source_reference", {"excerpt": {"availability": "available", "data": {**SPAN, "exact_text": "ab"}}}, "span_length_mismatch"), ("source_reference", {"reference_kind": "x"}, "value_not_allowed"), ("text_unit", {"unit_kind": "x"}, "value_not_allowed"), ("text_unit", {"id": "no id"}, "invalid_id"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = {kind: [{"id": "r", **record}] for kind, record in VALID.items()}
    for n, (kind, change, _) in enumerate(CASES):
        same = kind == "review" and "supersedes_review_id" in change
        rows[kind].append({**VALID[kind], "id": f"c{n}", **change, **({"supersedes_review_id": f"c{n}"} if same else {}), **({"id": f"no c{n}"} if "id" in change else {})})
    tables = {}
    for kind, some in rows.items():
        said = [(json.dumps({"kind": kind, "schema_version": "1", **r}),) for r in some]
        tables[kind] = spark.createDataFrame(said, "j string").select(F.from_json("j", schemas.schema(kind)).alias("r")).select("r.*")
    return {(r.id.removeprefix("no "), r.kind, r.code) for r in schemas.all_violations(tables).collect()}


def test_valid_records_break_nothing(found):
    assert not [x for x in found if x[0] == "r"]


def test_one_change_one_code(found):
    assert {(f"c{n}", kind, code) for n, (kind, _, code) in enumerate(CASES)} <= found  # some changes break a second rule as well
