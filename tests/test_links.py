"""Checks of whole record graphs: one valid bundle, and for each code a copy with one field changed; all copies are checked at once."""

import copy
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.operators import links
from veritrail.schemas import KINDS, schema

ANSWER = "Kühe 🐄 fressen Gras. Schafe auch."
PAGE = "Kühe\nKühe 🐄 fressen Gras."


def span(text, quote, unit=None, source=ANSWER):
    start = source.index(quote)
    return {"text_id": text, "start": start, "end": start + len(quote), "exact_text": quote, "source_unit_id": unit}


def bundle():
    settings = {"version": {"name": "s", "version": "1"}, "values": {"language": "de"}}
    run = {"analysis_run_id": "run", "input_ids": ["obs"]}
    have = lambda data: {"availability": "available", "data": data}
    at = lambda minute: f"2024-03-01T10:{minute:02d}:00Z"
    rows = [
        ("artifact", "raw"), ("artifact", "page"), ("artifact", "made"),
        ("text", "answer", {"text": ANSWER, "artifact_id": "raw"}), ("text", "pagetext", {"text": PAGE, "artifact_id": "page"}),
        ("text", "cleaned", {"text": PAGE, "artifact_id": "page", "source_text_id": "pagetext"}), ("text", "extract", {"text": "Kühe", "artifact_id": "raw"}),
        ("text", "blank", {"text": " \n ", "artifact_id": "raw"}),
        ("capture_request", "req", {"query_id": "q", "product": "p", "provider": "v", "requested_settings": settings}),
        ("observation", "obs", {"request_id": "req", "query_id": "q", "product": "p", "provider": "v", "requested_settings": settings, "status": "succeeded", "raw_artifact_id": "raw", "answer_text_id": "answer",
                                "source_reference_ids": have(["ref1", "ref2"]), "citation_reference_ids": have(["ref1"])}),
        ("observation", "obs2", {"request_id": "req", "query_id": "q", "product": "p", "provider": "v", "requested_settings": settings, "status": "failed"}),
        ("source_reference", "ref1", {"observation_id": "obs", "metadata_artifact_id": "raw", "reference_kind": "citation", "citation_span": span("answer", "Gras")}),
        ("source_reference", "ref2", {"observation_id": "obs", "metadata_artifact_id": "raw", "reference_kind": "search_result", "excerpt": have({**span("extract", "Kühe"), "start": 0, "end": 4}), "duplicate_group": "g"}),
        ("source_reference", "ref3", {"observation_id": "obs2", "reference_kind": "citation"}),
        ("text_unit", "head", {**run, "observation_id": "obs", "unit_kind": "heading", "span": span("answer", ANSWER)}),
        ("text_unit", "unit", {**run, "observation_id": "obs", "unit_kind": "sentence", "parent_unit_id": "head", "heading_unit_id": "head", "span": span("answer", "Kühe 🐄 fressen Gras.")}),
        ("text_unit", "unit2", {**run, "observation_id": "obs", "unit_kind": "sentence", "span": span("answer", "Schafe auch.")}),
        ("text_unit", "elsewhere", {**run, "observation_id": "obs2", "input_ids": [], "unit_kind": "heading"}),
        ("claim", "claim", {**run, "observation_id": "obs", "original_span": span("answer", "fressen Gras", "unit"), "context_unit_ids": ["unit", "unit2"], "decision_ids": ["dec"]}),
        ("claim", "claim2", {**run, "observation_id": "obs"}),
        ("extraction_issue", "issue", {**run, "observation_id": "obs", "original_span": span("answer", "Schafe", "unit2"), "context_unit_ids": ["unit2"], "decision_ids": ["dec"]}),
        ("citation_association", "cite", {**run, "observation_id": "obs", "claim_id": "claim", "reference_ids": ["ref1"], "status": "yes", "evidence_spans": [span("answer", "Gras", "unit")]}),
        ("citation_association", "cite2", {**run, "observation_id": "obs", "claim_id": "claim2", "reference_ids": [], "status": "unclear"}),
        ("article_version", "art", {"url": "u", "raw_artifact_id": "page", "raw_text_id": "pagetext", "cleaned_text_id": "cleaned", "heading_spans": [span("cleaned", "Kühe", source=PAGE)], "status": "usable"}),
        ("article_version", "art0", {"url": "u", "status": "failed"}), ("article_version", "art9", {"url": "other", "status": "failed"}),
        ("passage", "pas", {"article_version_id": "art", "span": span("cleaned", "fressen Gras", source=PAGE), "heading_spans": [span("cleaned", "Kühe", source=PAGE)]}),
        ("passage", "pas2", {"article_version_id": "art", "span": span("cleaned", "Gras", source=PAGE), "parent_passage_id": "pas"}),
        ("corpus_manifest", "corp", {"article_version_ids": ["art"], "passage_ids": ["pas", "pas2"], "status": "ready"}),
        ("retrieval_batch", "bat", {**run, "claim_id": "claim", "corpus_manifest_id": "corp", "index_id": "ix", "candidate_pair_ids": ["pair", "pair2"]}),
        ("candidate_pair", "pair", {**run, "claim_id": "claim", "retrieval_batch_id": "bat", "corpus_manifest_id": "corp", "index_id": "ix", "passage_id": "pas", "context_passage_ids": ["pas", "pas2"], "verification_decision_id": "dec"}),
        ("candidate_pair", "pair2", {**run, "claim_id": "claim", "retrieval_batch_id": "bat", "corpus_manifest_id": "corp", "index_id": "ix", "passage_id": "pas2"}),
        ("decision_record", "dec", {**run, "input_artifact_ids": ["raw"], "generation": {"output_artifact_id": "made"}}),
        ("alternative_inspection", "alt", {**run, "observation_id": "obs", "claim_id": "claim", "source_reference_id": "ref2", "excerpt_text_id": "extract", "decision_id": "dec", "duplicate_group": "g"}),
        ("finding", "old", {**run, "created_at": at(1), "observation_id": "obs", "claim_id": "claim", "citation_association_id": "cite", "status": "categorized", "category": 1}),
        ("finding", "fin", {**run, "created_at": at(2), "observation_id": "obs", "claim_id": "claim", "citation_association_id": "cite", "status": "categorized", "category": 1, "candidate_pair_ids": ["pair"],
                            "decision_ids": ["dec"], "alternative_inspection_ids": have(["alt"]), "supersedes_finding_id": "old"}),
        ("finding", "fin2", {**run, "created_at": at(2), "observation_id": "obs", "claim_id": "claim2", "citation_association_id": "cite2", "status": "citation_unclear"}),
        ("run_manifest", "run", {"input_ids": ["obs", "corp"], "observation_ids": ["obs", "obs2"], "corpus_manifest_id": "corp"}), ("run_manifest", "run2", {"observation_ids": ["obs", "obs2"]}),
        ("step_attempt", "step", {**run, "output_ids": ["fin", "raw"]}),
        ("review", "rev", {**run, "created_at": at(3), "finding_id": "fin"}), ("review", "rev2", {**run, "created_at": at(4), "finding_id": "fin", "supersedes_review_id": "rev"}),
    ]
    return {row[1]: {"kind": row[0], "id": row[1], "schema_version": "1", **(row[2] if len(row) > 2 else {})} for row in rows}


WRONG = {"text_id": "extract", "start": 0, "end": 4, "exact_text": "Kühe", "source_unit_id": None}
OFF = {**span("answer", "Gras"), "source_unit_id": None}

#: (record, change, record blamed, code): the record's fields that a copy of the bundle gets.
CASES = [
    ("claim", {"analysis_run_id": "nowhere"}, "claim", "missing_id"), ("unit", {"input_ids": ["nowhere"]}, "unit", "missing_id"), ("cite", {"reference_ids": ["nowhere"]}, "cite", "missing_id"),
    ("rev2", {"supersedes_review_id": "nowhere"}, "rev2", "missing_id"), ("dec", {"generation": {"output_artifact_id": "nowhere"}}, "dec", "missing_id"), ("step", {"output_ids": ["nowhere"]}, "step", "missing_id"),
    ("corp", {"article_version_ids": ["nowhere", "art"]}, "corp", "missing_id"), ("answer", {"source_text_id": "nowhere"}, "answer", "missing_id"),
    ("claim", {"observation_id": "req"}, "claim", "wrong_record_kind"), ("dec", {"input_artifact_ids": ["answer"]}, "dec", "wrong_record_kind"), ("run", {"corpus_manifest_id": "bat"}, "run", "wrong_record_kind"),
    ("claim", {"original_span": {**span("answer", "Gras", "unit"), "text_id": "raw"}}, "claim", "wrong_record_kind"),
    ("claim", {"original_span": {**span("answer", "Gras", "unit"), "exact_text": "Heu!"}}, "claim", "quote_mismatch"),
    ("claim", {"original_span": {**span("answer", "Gras"), "end": 900}}, "claim", "span_out_of_bounds"), ("unit2", {"span": {**span("answer", "Gras"), "start": -1}}, "unit2", "span_out_of_bounds"),
    ("unit2", {"span": {**span("answer", "Gras"), "end": 5}}, "unit2", "span_out_of_bounds"), ("ref2", {"excerpt": {"availability": "available", "data": {**WRONG, "exact_text": "Ziege"}}}, "ref2", "quote_mismatch"),
    ("cite", {"evidence_spans": [{**span("answer", "Gras"), "exact_text": "Heu!"}]}, "cite", "quote_mismatch"), ("pas", {"heading_spans": [{**span("cleaned", "Kühe", source=PAGE), "end": 99}]}, "pas", "span_out_of_bounds"),
    ("claim", {"original_span": span("answer", "fressen Gras", "unit2")}, "claim", "source_unit_mismatch"), ("cite", {"evidence_spans": [span("answer", "Schafe", "unit")]}, "cite", "source_unit_mismatch"),
    ("run", {"observation_ids": ["obs2"]}, "claim", "observation_run_mismatch"), ("run", {"observation_ids": []}, "step", "observation_run_mismatch"),
    ("unit2", {"analysis_run_id": "run2"}, "claim", "run_mismatch"), ("dec", {"analysis_run_id": "run2"}, "fin", "run_mismatch"), ("rev", {"analysis_run_id": "run2"}, "rev2", "run_mismatch"),
    ("step", {"analysis_run_id": "run2"}, "step", "run_mismatch"), ("bat", {"analysis_run_id": "run2"}, "pair", "run_mismatch"), ("claim2", {"input_ids": ["unit"], "analysis_run_id": "run2"}, "claim2", "run_mismatch"),
    ("cite", {"observation_id": "obs2"}, "cite", "observation_mismatch"), ("alt", {"observation_id": "obs2"}, "alt", "observation_mismatch"), ("fin", {"observation_id": "obs2"}, "fin", "observation_mismatch"),
    ("pagetext", {"source_text_id": "cleaned"}, "pagetext", "text_lineage_cycle"), ("pagetext", {"source_text_id": "cleaned"}, "art", "text_lineage_cycle"), ("answer", {"source_text_id": "answer"}, "obs", "text_lineage_cycle"),
    ("req", {"product": "other"}, "obs", "capture_request_mismatch"), ("obs2", {"requested_settings": {"values": {"language": "en"}}}, "obs2", "capture_request_mismatch"),
    ("answer", {"artifact_id": "page"}, "obs", "answer_artifact_provenance_mismatch"), ("answer", {"source_text_id": "pagetext"}, "obs", "answer_artifact_provenance_mismatch"),
    ("obs", {"answer_text_id": "blank"}, "obs", "successful_answer_empty"),
    ("obs", {"source_reference_ids": {"availability": "available", "data": ["ref3"]}}, "obs", "reference_observation_mismatch"), ("cite", {"reference_ids": ["ref3"]}, "cite", "reference_observation_mismatch"),
    ("obs", {"citation_reference_ids": {"availability": "available", "data": ["ref2"]}}, "obs", "not_a_citation_reference"), ("cite", {"reference_ids": ["ref2"]}, "cite", "not_a_citation_reference"),
    ("ref1", {"metadata_artifact_id": "page"}, "ref1", "source_metadata_artifact_mismatch"), ("ref1", {"citation_span": WRONG}, "ref1", "citation_text_mismatch"), ("cite", {"evidence_spans": [OFF, WRONG]}, "cite", "citation_text_mismatch"),
    ("unit2", {"span": WRONG}, "unit2", "unit_text_mismatch"), ("unit", {"parent_unit_id": "elsewhere"}, "unit", "unit_relationship_mismatch"), ("head", {"heading_unit_id": "head"}, "head", "unit_relationship_mismatch"),
    ("unit", {"parent_unit_id": "unit2"}, "unit", "unit_outside_parent"), ("unit", {"heading_unit_id": "unit2"}, "unit", "not_a_heading"),
    ("claim", {"original_span": WRONG}, "claim", "claim_text_mismatch"), ("issue", {"original_span": WRONG}, "issue", "claim_text_mismatch"),
    ("claim", {"context_unit_ids": ["unit2"]}, "claim", "source_unit_not_in_context"), ("issue", {"context_unit_ids": None}, "issue", "source_unit_not_in_context"),
    ("claim", {"context_unit_ids": ["unit", "elsewhere"]}, "claim", "context_observation_mismatch"), ("unit2", {"observation_id": "obs2"}, "issue", "context_observation_mismatch"),
    ("cite", {"status": "no", "observation_id": "obs2"}, "cite", "citation_no_requires_complete_capture"), ("obs", {"citation_reference_ids": {"availability": "available", "data": []}}, "cite", "citation_not_captured"),
    ("art", {"raw_artifact_id": "raw"}, "art", "article_raw_provenance_mismatch"), ("art", {"raw_text_id": "cleaned"}, "art", "article_raw_provenance_mismatch"), ("art", {"raw_text_id": None}, "art", "article_cleaned_lineage_mismatch"),
    ("art", {"cleaned_text_id": "extract"}, "art", "article_cleaned_lineage_mismatch"), ("art", {"heading_spans": [WRONG]}, "art", "article_heading_text_mismatch"),
    ("art", {"previous_version_id": "art9"}, "art", "article_version_mismatch"), ("art", {"previous_version_id": "art"}, "art", "article_version_mismatch"),
    ("pas2", {"span": WRONG}, "pas2", "passage_article_mismatch"), ("pas2", {"article_version_id": "art0"}, "pas2", "passage_article_mismatch"), ("pas", {"heading_spans": [WRONG]}, "pas", "passage_heading_text_mismatch"),
    ("pas2", {"parent_passage_id": "pas2"}, "pas2", "passage_parent_mismatch"), ("pas", {"article_version_id": "art0"}, "pas2", "passage_parent_mismatch"),
    ("corp", {"article_version_ids": ["art", "art0"]}, "corp", "corpus_contains_unusable_article"), ("corp", {"article_version_ids": ["art0"]}, "corp", "corpus_passage_mismatch"),
    ("pair", {"index_id": "other"}, "pair", "pair_batch_mismatch"), ("bat", {"candidate_pair_ids": ["pair"]}, "pair2", "pair_batch_mismatch"), ("bat", {"claim_id": "claim2"}, "pair", "pair_batch_mismatch"), ("pair", {"retrieval_batch_id": None}, "bat", "pair_batch_mismatch"),
    ("pair2", {"passage_id": "pas"}, "bat", "duplicate_candidate_passage"), ("bat", {"candidate_pair_ids": ["pair", "pair", "pair2"]}, "bat", "duplicate_candidate_passage"),
    ("corp", {"passage_ids": ["pas"]}, "pair2", "pair_passage_outside_corpus"), ("corp", {"passage_ids": ["pas"]}, "pair", "pair_passage_outside_corpus"),
    ("ref2", {"observation_id": "obs2"}, "alt", "alternative_observation_mismatch"), ("alt", {"duplicate_group": None}, "alt", "duplicate_group_mismatch"), ("alt", {"excerpt_text_id": "answer"}, "alt", "alternative_excerpt_mismatch"),
    ("alt", {"source_reference_id": "ref1"}, "alt", "alternative_excerpt_mismatch"),
    ("cite", {"claim_id": "claim2"}, "fin", "finding_citation_mismatch"), ("cite", {"status": "no"}, "fin", "category_one_requires_citation"), ("fin", {"category": 3}, "fin", "uncited_finding_requires_no_citation"),
    ("fin2", {"status": "no_match_found"}, "fin2", "uncited_finding_requires_no_citation"), ("fin", {"status": "citation_unclear", "category": None}, "fin", "unclear_finding_requires_unclear_citation"),
    ("pair", {"claim_id": "claim2"}, "fin", "finding_pair_claim_mismatch"), ("alt", {"claim_id": "claim2"}, "fin", "finding_alternative_mismatch"),
    ("old", {"claim_id": "claim2"}, "fin", "finding_history_claim_mismatch"), ("rev", {"finding_id": "old"}, "rev2", "review_history_finding_mismatch"),
    ("fin", {"created_at": "2024-02-01T00:00:00Z"}, "fin", "history_time_reversed"), ("rev2", {"created_at": "2024-02-01T00:00:00Z"}, "rev2", "history_time_reversed"),
    ("fin2", {"supersedes_finding_id": "old"}, "fin", "branched_history"), ("old", {"supersedes_finding_id": "fin"}, "old", "history_cycle"), ("rev", {"supersedes_review_id": "rev2"}, "rev", "history_cycle"),
    ("fin", {"supersedes_finding_id": None}, "fin", "multiple_selected_findings"), ("old", {"supersedes_finding_id": "fin"}, "fin", "multiple_selected_findings"),
]


def prefixed(value, names, tag):
    if isinstance(value, dict):
        return {k: prefixed(v, names, tag) for k, v in value.items()}
    if isinstance(value, list):
        return [prefixed(v, names, tag) for v in value]
    return tag + value if isinstance(value, str) and (value in names or value == "nowhere") else value


def tables(spark, bundles):
    by = {kind: [] for kind in KINDS}
    for b in bundles:
        for r in b:
            by[r["kind"]].append((json.dumps(r),))
    return {kind: spark.createDataFrame(rows or [("{}",)], "j string").where(F.lit(bool(rows))).select(F.from_json("j", schema(kind)).alias("r")).select("r.*").cache() for kind, rows in by.items()}


@pytest.fixture(scope="module")
def found(spark):
    base, bundles = bundle(), []
    for n, case in enumerate([(None, {}, None, None), *CASES, ("claim", None, "claim", "duplicate_id")]):
        changed = copy.deepcopy(base)
        extra = []
        if case[1] is None:
            extra = [changed[case[0]]]
        elif case[0]:
            changed[case[0]].update(case[1])
        names = set(base) - {"u"}
        own = [{**prefixed({k: v for k, v in r.items() if k not in ("kind", "status", "unit_kind", "reference_kind")}, names, f"m{n}."), **{k: r[k] for k in ("kind", "status", "unit_kind", "reference_kind") if k in r}} for r in [*changed.values(), *extra]]
        bundles.append(own)
    rows = links.violations(tables(spark, bundles)).collect()
    out = {}
    for r in rows:
        tag, name = r.id.split(".", 1)
        out.setdefault(int(tag[1:]), set()).add((name, r.code))
    return out


def test_valid_bundle_has_no_violations(found):
    assert found.get(0, set()) == set()


@pytest.mark.parametrize("n", range(1, len(CASES) + 2))
def test_one_change_one_code(found, n):
    record, _, blamed, code = CASES[n - 1] if n <= len(CASES) else ("claim", None, "claim", "duplicate_id")
    assert (blamed, code) in found.get(n, set())


def test_every_code_has_a_case():
    codes = {code for code, *_ in links.edge_rules()} | {m[0] for m in links.MEMBERS} | {o[0] for o in links.OWN} | {x[0] for x in links.LISTED}
    codes |= {"missing_id", "wrong_record_kind", "run_mismatch", "source_unit_mismatch", "span_out_of_bounds", "quote_mismatch", "duplicate_candidate_passage", "branched_history", "history_cycle", "multiple_selected_findings"}
    assert codes == {case[3] for case in CASES}


def test_spans_of_any_depth(spark):
    inner = "struct<text_id:string,start:int,end:int,exact_text:string,source_unit_id:string>"
    rows = [("x", {"deep": [[{"m": {"k": [("t", 0, 1, "a", None), None]}, "n": 1}], None, []], "one": ("t", 1, 2, "b", "u")}), ("y", None)]
    table = spark.createDataFrame(rows, f"id string, body struct<deep:array<array<struct<m:map<string,array<{inner}>>,n:int>>>,one:{inner}>")
    got = links.all_spans({"thing": table, "plain": table.select("id")}).collect()
    assert sorted((r.id, r.kind, r.span.exact_text, r.span.source_unit_id) for r in got) == [("x", "thing", "a", None), ("x", "thing", "b", "u")]
    assert links.spans_in(T.StringType(), F.col("id")) is None


def test_empty_tables(spark):
    assert links.violations(tables(spark, [])).collect() == []
