"""Table schemas of the twenty record kinds, and the row rules that hold within one record."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = "id string, kind string, schema_version string"
_UTC = _BASE + ", created_at timestamp"
_DERIVED = _UTC + ", analysis_run_id string, input_ids array<string>"
_SPAN = "struct<text_id:string,start:bigint,end:bigint,exact_text:string,source_unit_id:string>"
_VREF = "struct<name:string,version:string,sha256:string>"
_ERROR = "struct<code:string,message:string,retryable:boolean,provider_request_id:string>"
_SETTINGS = f"struct<version:{_VREF},values:variant>"


def _available(data: str) -> str:
    return f"struct<availability:string,data:{data},reason:string>"


_DDL = {
    "artifact": f"{_BASE}, storage_key string, sha256 string, media_type string, access string, redacted_transport_fields array<string>",
    "text": f"{_BASE}, text string, artifact_id string, source_text_id string, transformation {_VREF}",
    "capture_request": f"{_UTC}, query_id string, query string, product string, provider string, requested_settings {_SETTINGS}",
    "observation": f"{_UTC}, request_id string, query_id string, product string, provider string, requested_settings {_SETTINGS}, reported_settings {_SETTINGS}, status string, raw_artifact_id string, answer_text_id string, source_reference_ids {_available('array<string>')}, citation_reference_ids {_available('array<string>')}, fanout_queries {_available('array<string>')}, normalization_version string, provider_request_id string, error {_ERROR}",
    "source_reference": f"{_UTC}, observation_id string, url string, metadata_artifact_id string, metadata_location string, reference_kind string, excerpt {_available(_SPAN)}, citation_span {_SPAN}, duplicate_group string",
    "text_unit": f"{_DERIVED}, observation_id string, unit_kind string, ord bigint, parent_unit_id string, heading_unit_id string, span {_SPAN}",
    "claim": f"{_DERIVED}, observation_id string, normalized_claim string, language string, original_span {_SPAN}, context_unit_ids array<string>, decision_ids array<string>, claim_group_id string",
    "extraction_issue": f"{_DERIVED}, observation_id string, issue string, reason string, proposed_claim string, original_span {_SPAN}, context_unit_ids array<string>, decision_ids array<string>",
    "citation_association": f"{_DERIVED}, observation_id string, claim_id string, reference_ids array<string>, status string, scope_assessable boolean, rule_version string, evidence_spans array<{_SPAN}>, reason string",
    "article_version": f"{_UTC}, url string, raw_artifact_id string, raw_text_id string, cleaned_text_id string, title string, heading_spans array<{_SPAN}>, fetched_at timestamp, content_sha256 string, parser_version string, status string, reason string, previous_version_id string",
    "passage": f"{_UTC}, article_version_id string, ord bigint, span {_SPAN}, heading_spans array<{_SPAN}>, parent_passage_id string, construction_version string",
    "corpus_manifest": f"{_UTC}, article_version_ids array<string>, passage_ids array<string>, construction_version string, status string, reason string",
    "retrieval_batch": f"{_DERIVED}, claim_id string, corpus_manifest_id string, index_id string, index_corpus_manifest_id string, candidate_pair_ids array<string>, completion string, truncation_reason string, settings {_SETTINGS}",
    "candidate_pair": f"{_DERIVED}, claim_id string, retrieval_batch_id string, corpus_manifest_id string, index_id string, passage_id string, path_ranks array<struct<path:string,rank:bigint,score:double>>, fused_rank bigint, context_passage_ids array<string>, verification_decision_id string, correspondence_decision_id string",
    "decision_record": f"{_DERIVED}, task_type string, input_artifact_ids array<string>, requested_model string, returned_model string, prompt {_VREF}, rubric {_VREF}, configuration {_VREF}, status string, decision struct<label:string,allowed:array<string>,probabilities:map<string,double>>, generation struct<output_artifact_id:string,structured_output:variant>, usage {_available('struct<input_tokens:bigint,cached_tokens:bigint,output_tokens:bigint,cost:double,currency:string>')}, started_at timestamp, finished_at timestamp, error {_ERROR}, provider_request_id string",
    "alternative_inspection": f"{_DERIVED}, observation_id string, claim_id string, source_reference_id string, excerpt_text_id string, state string, correspondence string, decision_id string, coverage string, coverage_reason string, duplicate_group string",
    "finding": f"{_DERIVED}, observation_id string, claim_id string, citation_association_id string, status string, category int, candidate_pair_ids array<string>, decision_ids array<string>, alternative_inspection_ids {_available('array<string>')}, provisional_scores {_available('map<string,double>')}, reason_codes array<string>, supersedes_finding_id string",
    "run_manifest": f"{_UTC}, input_ids array<string>, observation_ids array<string>, corpus_manifest_id string, purpose string, mode string, capture_settings {_SETTINGS}, configuration {_VREF}, model_ids array<string>, prompt_versions array<{_VREF}>, rubric_versions array<{_VREF}>, budget struct<max_requests:bigint,max_cost:double,currency:string>, status string",
    "step_attempt": f"{_DERIVED}, step string, work_key string, attempt_number bigint, status string, output_ids array<string>, started_at timestamp, finished_at timestamp, provider_request_id string, usage {_available('map<string,double>')}, error {_ERROR}, outcome_uncertain boolean",
    "review": f"{_DERIVED}, finding_id string, reviewer_id string, decision string, note string, correction struct<status:string,category:int>, supersedes_review_id string",
}
KINDS = tuple(_DDL)


@cache
def schema(kind: str) -> T.StructType:
    """The schema of a record kind; parsing it needs a running session."""
    return T.StructType.fromDDL(_DDL[kind])


def _given(name: str) -> Column:
    return F.col(name).isNotNull()


def _implies(a: Column, b: Column) -> Column:
    return ~a | b


def rules(kind: str) -> dict[str, Column]:
    """Row rules by violation code, each a condition that must hold."""
    status = F.col("status")
    found = {
        "text": {"transformation_requires_source_and_version": _given("source_text_id") == _given("transformation"), "text_cannot_transform_itself": ~F.col("source_text_id").eqNullSafe(F.col("id"))},
        "observation": {"successful_capture_requires_raw_and_answer": _implies(status == "succeeded", _given("raw_artifact_id") & _given("answer_text_id")), "capture_failure_requires_error_only_on_failure": (status == "failed") == _given("error")},
        "citation_association": {"citation_yes_requires_references": _implies(status == "yes", F.size("reference_ids") > 0), "definite_citation_status_requires_assessable_scope": _implies(status.isin("yes", "no"), F.col("scope_assessable"))},
        "article_version": {"usable_article_requires_content_and_provenance": _implies(status == "usable", _given("raw_artifact_id") & _given("cleaned_text_id") & _given("content_sha256")), "unusable_article_requires_reason": _implies(status != "usable", _given("reason"))},
        "corpus_manifest": {"ready_corpus_requires_articles_and_passages": _implies(status == "ready", (F.size("article_version_ids") > 0) & (F.size("passage_ids") > 0)), "incomplete_corpus_requires_reason": _implies(status != "ready", _given("reason"))},
        "retrieval_batch": {"index_corpus_mismatch": F.col("index_corpus_manifest_id") == F.col("corpus_manifest_id"), "retrieval_completion_reason_mismatch": (F.col("completion") == "truncated") == _given("truncation_reason")},
        "candidate_pair": {"duplicate_retrieval_path": F.size(F.array_distinct(F.transform("path_ranks", lambda p: p["path"]))) == F.size("path_ranks")},
        "decision_record": {"model_timing_reversed": F.col("finished_at") >= F.col("started_at"), "model_success_requires_result_without_error": _implies(status == "succeeded", (_given("decision") | _given("generation")) & ~_given("error")), "model_failure_requires_error_without_result": _implies(status == "failed", _given("error") & ~_given("decision") & ~_given("generation"))},
        "finding": {"category_requires_categorized_status_and_vice_versa": (status == "categorized") == _given("category"), "finding_cannot_supersede_itself": ~F.col("supersedes_finding_id").eqNullSafe(F.col("id"))},
        "review": {"corrected_review_requires_correction_only": (F.col("decision") == "corrected") == _given("correction"), "review_cannot_supersede_itself": ~F.col("supersedes_review_id").eqNullSafe(F.col("id"))},
    }
    more = {
        "alternative_inspection": {
            "inspection_requires_excerpt_and_decision": _implies(F.col("state") == "inspected", _given("excerpt_text_id") & _given("decision_id")),
            "inspected_cannot_be_not_assessed": _implies(F.col("state") == "inspected", F.col("correspondence") != "not_assessed"),
            "unassessed_cannot_have_correspondence_decision": _implies(F.col("state") != "inspected", (F.col("correspondence") == "not_assessed") & ~_given("decision_id")),
            "unassessed_coverage_is_insufficient": _implies(F.col("state") == "unassessed", F.col("coverage") != "assessable"),
        },
        "step_attempt": {
            "attempt_timing_reversed": ~_given("finished_at") | (F.col("finished_at") >= F.col("started_at")),
            "attempt_failure_requires_error_only_on_failure": (status == "failed") == _given("error"),
            "terminal_attempt_requires_finish_time": status.isin("succeeded", "failed", "skipped") == _given("finished_at"),
            "uncertain_attempt_cannot_be_successful": _implies(F.col("outcome_uncertain"), status == "failed"),
        },
        "review": {"correction_category_status_mismatch": ~_given("correction") | ((F.col("correction.status") == "categorized") == F.col("correction.category").isNotNull())},
    }
    common = {"invalid_id": F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"), "wrong_kind": F.col("kind") == kind, "unknown_schema_version": F.col("schema_version") == "1"}
    return common | found.get(kind, {}) | more.get(kind, {}) | _by_schema(kind)


#: What fields of each kind may hold.
ALLOWED = {
    "artifact": {"access": ("shareable_fixture", "restricted")},
    "source_reference": {"reference_kind": ("citation", "reference", "search_result")},
    "text_unit": {"unit_kind": ("heading", "paragraph", "bullet", "sentence")},
    "extraction_issue": {"issue": ("invalid", "unlocatable", "ambiguous", "unresolved", "excluded", "failed")},
    "citation_association": {"status": ("yes", "no", "unclear")},
    "article_version": {"status": ("usable", "failed", "unusable")},
    "corpus_manifest": {"status": ("ready", "incomplete", "failed")},
    "run_manifest": {"purpose": ("diagnostic", "monitoring"), "mode": ("capture", "reanalysis")},
    "review": {"decision": ("confirmed", "rejected", "corrected")},
}


def _by_schema(kind: str) -> dict[str, Column]:
    """Rules that follow from a kind's fields: of each ``available`` value, of each span at any depth, and of fields with fixed values."""
    from .operators.links import spans_in

    fields = schema(kind).fields
    out: dict[str, Column] = {}

    def both(code: str, rule: Column) -> None:
        out[code] = out[code] & rule if code in out else rule

    for field in fields:
        if isinstance(field.dataType, T.StructType) and field.dataType.names == ["availability", "data", "reason"]:
            what, data, reason = (F.col(f"{field.name}.{x}") for x in ("availability", "data", "reason"))
            none = F.col(field.name).isNull()
            both("value_not_allowed", none | what.isin("available", "incomplete", "unavailable"))
            both("unavailable_requires_null_data_and_reason", none | _implies(what == "unavailable", data.isNull() & reason.isNotNull()))
            both("available_or_incomplete_requires_data", none | _implies(what.isin("available", "incomplete"), data.isNotNull()))
            both("incomplete_requires_reason", none | _implies(what == "incomplete", reason.isNotNull()))
    spans = [x for x in (spans_in(f.dataType, F.col(f.name)) for f in fields) if x is not None]
    if spans:
        every = F.concat(*spans)
        out["span_end_must_exceed_start"] = F.forall(every, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))
        out["span_length_mismatch"] = F.forall(every, lambda s: F.length(s["exact_text"]) == s["end"] - s["start"])
    for name, values in ALLOWED.get(kind, {}).items():
        both("value_not_allowed", F.col(name).isNull() | F.col(name).isin(*values))
    return out


def violations(records: DataFrame, kind: str) -> DataFrame:
    """(id, code) of the row rules that records of one kind break: one pass that makes each record's codes as an array."""
    from .operators.guards import record_violations

    return record_violations(records, "id", rules(kind))


def all_violations(records: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, code) of the row rules that records of any kind break."""
    return reduce(DataFrame.unionByName, [violations(table, kind).select("id", F.lit(kind).alias("kind"), "code") for kind, table in records.items()])
