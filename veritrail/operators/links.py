"""Checks of a whole record graph: every reference of all twenty kinds is one typed edge, resolved by one join, and rules are conditions over the two ends.

1. A *card* per record holds the few values that others look at (its run, observation, span, status ...): short strings and numbers, never texts or lists.
2. Every reference becomes an *edge* (owner, role, target, expected kind) that carries its owner's card.  One join by target id, skewed targets (a run that a third of all
   records belong to) left to Spark's splitting of skewed joins, finds the target's card; all rules over two ends are evaluated there.  Only the edges and the entries of cards that
   the rules asked for read are made.  Cards, lists and texts are joined by merging: written out they look small enough to be broadcast, which the driver would have to hold.
3. Questions whether a list holds an id ("is the observation in its run's list?") are rows (list's owner, role, id) that an anti join with the edges themselves answers,
   so that no list is copied to its members.
4. Spans are found by a walk over the schema that builds the expressions for any depth of structs, arrays and maps; they are compared with their texts by a join.
5. Text lineages are resolved by pointer doubling; cycles end with a root of null.

All functions return violations instead of raising: ``(id, kind, code)``, once for each record and code.  Kinds that are not given have no records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import code_point_slice
from ..runtime import materialise
from .constraints import lineage_roots

DERIVED = ("text_unit", "claim", "extraction_issue", "citation_association", "retrieval_batch", "candidate_pair", "decision_record", "alternative_inspection", "finding", "step_attempt", "review")
OF_OBSERVATION = ("text_unit", "claim", "extraction_issue", "citation_association", "alternative_inspection", "finding")
OF_CLAIM = ("citation_association", "retrieval_batch", "candidate_pair", "alternative_inspection", "finding")
SPAN_FIELDS = {"text_id", "start", "end", "exact_text", "source_unit_id"}
ANY = "*"

#: What a card holds, with its type, and per kind where it is from: a column's name or an expression.
CARD = {
    "run": "string", "observation": "string", "claim": "string", "text": "string", "start": "long", "end": "long", "state": "string", "category": "int", "artifact": "string",
    "source_text": "string", "root": "string", "root_artifact": "string", "cyclic": "boolean", "blank": "boolean", "answer": "string", "cited": "string", "asked": "string",
    "article": "string", "cleaned": "string", "url": "string", "batch": "string", "corpus": "string", "index": "string", "passage": "string", "group": "string",
    "excerpt": "string", "finding": "string", "created": "timestamp",
}
_ASKED = "to_json(struct(query_id, product, provider, requested_settings))"
_SPAN = {"text": "span.text_id", "start": "span.start", "end": "span.end"}
_CARDS: dict[str, dict[str, str]] = {
    "text": {"artifact": "artifact_id", "source_text": "source_text_id", "root": "__root", "cyclic": "__cyclic", "root_artifact": "__root_artifact", "blank": r"not text rlike '[^\\p{IsWhite_Space}\\x1C-\\x1F]'"},
    "capture_request": {"asked": _ASKED},
    "observation": {"asked": _ASKED, "artifact": "raw_artifact_id", "answer": "answer_text_id", "state": "status", "cited": "citation_reference_ids.availability"},
    "source_reference": {"observation": "observation_id", "artifact": "metadata_artifact_id", "state": "reference_kind", "group": "duplicate_group", "excerpt": "excerpt.data.text_id", "text": "citation_span.text_id"},
    "text_unit": {"observation": "observation_id", "state": "unit_kind", **_SPAN},
    "claim": {"observation": "observation_id", "text": "original_span.text_id"},
    "extraction_issue": {"observation": "observation_id", "text": "original_span.text_id"},
    "citation_association": {"observation": "observation_id", "claim": "claim_id", "state": "status"},
    "article_version": {"artifact": "raw_artifact_id", "source_text": "raw_text_id", "cleaned": "cleaned_text_id", "state": "status", "url": "url"},
    "passage": {"article": "article_version_id", **_SPAN},
    "corpus_manifest": {"state": "status"},
    "retrieval_batch": {"claim": "claim_id", "corpus": "corpus_manifest_id", "index": "index_id"},
    "candidate_pair": {"claim": "claim_id", "batch": "retrieval_batch_id", "corpus": "corpus_manifest_id", "index": "index_id", "passage": "passage_id"},
    "alternative_inspection": {"observation": "observation_id", "claim": "claim_id", "excerpt": "excerpt_text_id", "group": "duplicate_group"},
    "finding": {"observation": "observation_id", "claim": "claim_id", "state": "status", "category": "category", "created": "created_at"},
    "review": {"finding": "finding_id", "created": "created_at"},
}

#: Per kind the references: role (the column's name), the expression of its id or ids, the kind that they must have.
EDGES: dict[str, list[tuple[str, str, str]]] = {
    "text": [("artifact_id", "artifact_id", "artifact"), ("source_text_id", "source_text_id", "text")],
    "observation": [
        ("request_id", "request_id", "capture_request"), ("raw_artifact_id", "raw_artifact_id", "artifact"), ("answer_text_id", "answer_text_id", "text"),
        ("source_reference_ids", "source_reference_ids.data", "source_reference"), ("citation_reference_ids", "citation_reference_ids.data", "source_reference"),
    ],
    "source_reference": [("observation_id", "observation_id", "observation"), ("metadata_artifact_id", "metadata_artifact_id", "artifact")],
    "text_unit": [("parent_unit_id", "parent_unit_id", "text_unit"), ("heading_unit_id", "heading_unit_id", "text_unit")],
    "claim": [("context_unit_ids", "context_unit_ids", "text_unit"), ("decision_ids", "decision_ids", "decision_record")],
    "extraction_issue": [("context_unit_ids", "context_unit_ids", "text_unit"), ("decision_ids", "decision_ids", "decision_record")],
    "citation_association": [("reference_ids", "reference_ids", "source_reference")],
    "article_version": [("raw_artifact_id", "raw_artifact_id", "artifact"), ("raw_text_id", "raw_text_id", "text"), ("cleaned_text_id", "cleaned_text_id", "text"), ("previous_version_id", "previous_version_id", "article_version")],
    "passage": [("article_version_id", "article_version_id", "article_version"), ("parent_passage_id", "parent_passage_id", "passage")],
    "corpus_manifest": [("article_version_ids", "article_version_ids", "article_version"), ("passage_ids", "passage_ids", "passage")],
    "retrieval_batch": [("corpus_manifest_id", "corpus_manifest_id", "corpus_manifest"), ("candidate_pair_ids", "candidate_pair_ids", "candidate_pair")],
    "candidate_pair": [
        ("retrieval_batch_id", "retrieval_batch_id", "retrieval_batch"), ("corpus_manifest_id", "corpus_manifest_id", "corpus_manifest"), ("passage_id", "passage_id", "passage"),
        ("context_passage_ids", "context_passage_ids", "passage"), ("decision_ids", "array_compact(array(verification_decision_id, correspondence_decision_id))", "decision_record"),
    ],
    "decision_record": [("input_artifact_ids", "input_artifact_ids", "artifact"), ("output_artifact_id", "generation.output_artifact_id", "artifact")],
    "alternative_inspection": [("source_reference_id", "source_reference_id", "source_reference"), ("excerpt_text_id", "excerpt_text_id", "text"), ("decision_ids", "decision_id", "decision_record")],
    "finding": [
        ("citation_association_id", "citation_association_id", "citation_association"), ("candidate_pair_ids", "candidate_pair_ids", "candidate_pair"), ("decision_ids", "decision_ids", "decision_record"),
        ("alternative_inspection_ids", "alternative_inspection_ids.data", "alternative_inspection"), ("supersedes_finding_id", "supersedes_finding_id", "finding"),
    ],
    "run_manifest": [("input_ids", "input_ids", ANY), ("observation_ids", "observation_ids", "observation"), ("corpus_manifest_id", "corpus_manifest_id", "corpus_manifest")],
    "step_attempt": [("output_ids", "output_ids", ANY)],
    "review": [("finding_id", "finding_id", "finding"), ("supersedes_review_id", "supersedes_review_id", "review")],
}
for _kind in DERIVED:
    EDGES[_kind] = [*EDGES.get(_kind, []), ("analysis_run_id", "analysis_run_id", "run_manifest"), ("input_ids", "input_ids", ANY)]
for _kind in OF_OBSERVATION:
    EDGES[_kind] = [*EDGES[_kind], ("observation_id", "observation_id", "observation")]
for _kind in OF_CLAIM:
    EDGES[_kind] = [*EDGES[_kind], ("claim_id", "claim_id", "claim")]

#: Roles whose target belongs to the owner's run (of any kind: where the target belongs to a run at all).
SAME_RUN = {"parent_unit_id", "heading_unit_id", "context_unit_ids", "decision_ids", "claim_id", "citation_association_id", "alternative_inspection_ids", "supersedes_finding_id", "finding_id", "supersedes_review_id", "output_ids"}


def _same_run(kind: str, role: str) -> bool:
    return role in SAME_RUN or (role == "input_ids" and kind in DERIVED) or (kind, role) in {("candidate_pair", "retrieval_batch_id"), ("finding", "candidate_pair_ids")}


def _o(name: str) -> Column:
    return F.col(f"o.{name}")


def _t(name: str) -> Column:
    return F.col(f"t.{name}")


def _alike(name: str, other: str | None = None) -> Column:
    return _o(name).eqNullSafe(_t(other or name))


def _only_if(condition: Column, rule: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | rule


def edge_rules() -> list[tuple[str, str | None, str, Column]]:
    """(code, owner's kind or None for all, role, condition that must hold) over both ends of an edge."""
    other = F.col("target") != F.col("id")
    of_answer = _alike("text", "answer")
    time = _t("created") <= _o("created")
    return [
        ("text_lineage_cycle", "text", "artifact_id", ~_o("cyclic")),
        ("capture_request_mismatch", "observation", "request_id", _alike("asked")),
        ("text_lineage_cycle", "observation", "answer_text_id", ~_t("cyclic")),
        ("answer_artifact_provenance_mismatch", "observation", "answer_text_id", _t("cyclic") | _alike("artifact", "root_artifact")),
        ("successful_answer_empty", "observation", "answer_text_id", _only_if(_o("state") == "succeeded", ~_t("blank"))),
        ("reference_observation_mismatch", "observation", "source_reference_ids", _t("observation").eqNullSafe(F.col("id"))),
        ("reference_observation_mismatch", "observation", "citation_reference_ids", _t("observation").eqNullSafe(F.col("id"))),
        ("not_a_citation_reference", "observation", "citation_reference_ids", _t("state") == "citation"),
        ("source_metadata_artifact_mismatch", "source_reference", "observation_id", _alike("artifact")),
        ("citation_text_mismatch", "source_reference", "observation_id", _only_if(_o("text").isNotNull(), of_answer)),
        ("unit_text_mismatch", "text_unit", "observation_id", of_answer),
        ("unit_relationship_mismatch", "text_unit", "parent_unit_id", _alike("observation") & other),
        ("unit_relationship_mismatch", "text_unit", "heading_unit_id", _alike("observation") & other),
        ("unit_outside_parent", "text_unit", "parent_unit_id", (_t("start") <= _o("start")) & (_o("end") <= _t("end"))),
        ("not_a_heading", "text_unit", "heading_unit_id", _t("state") == "heading"),
        *[("claim_text_mismatch", kind, "observation_id", _only_if(_o("text").isNotNull(), of_answer)) for kind in ("claim", "extraction_issue")],
        *[("context_observation_mismatch", kind, "context_unit_ids", _alike("observation")) for kind in ("claim", "extraction_issue")],
        *[("observation_mismatch", kind, "claim_id", _alike("observation")) for kind in ("citation_association", "alternative_inspection", "finding")],
        ("citation_no_requires_complete_capture", "citation_association", "observation_id", _only_if(_o("state") == "no", _t("cited") == "available")),
        ("reference_observation_mismatch", "citation_association", "reference_ids", _alike("observation")),
        ("not_a_citation_reference", "citation_association", "reference_ids", _only_if(_o("state") == "yes", _t("state") == "citation")),
        ("article_raw_provenance_mismatch", "article_version", "raw_text_id", _alike("artifact") & _t("source_text").isNull()),
        ("text_lineage_cycle", "article_version", "cleaned_text_id", ~_t("cyclic")),
        ("article_cleaned_lineage_mismatch", "article_version", "cleaned_text_id", _t("cyclic") | _alike("source_text", "root")),
        ("article_version_mismatch", "article_version", "previous_version_id", _alike("url") & other),
        ("passage_article_mismatch", "passage", "article_version_id", (_t("state") == "usable") & _alike("text", "cleaned")),
        ("passage_parent_mismatch", "passage", "parent_passage_id", _alike("article") & other),
        ("corpus_contains_unusable_article", "corpus_manifest", "article_version_ids", _only_if(_o("state") == "ready", _t("state") == "usable")),
        ("pair_batch_mismatch", "retrieval_batch", "candidate_pair_ids", _t("batch").eqNullSafe(F.col("id"))),
        ("pair_batch_mismatch", "candidate_pair", "retrieval_batch_id", _alike("claim") & _alike("corpus") & _alike("index")),
        ("alternative_observation_mismatch", "alternative_inspection", "source_reference_id", _alike("observation")),
        ("duplicate_group_mismatch", "alternative_inspection", "source_reference_id", _alike("group")),
        ("alternative_excerpt_mismatch", "alternative_inspection", "source_reference_id", _only_if(_o("excerpt").isNotNull(), _alike("excerpt"))),
        ("finding_citation_mismatch", "finding", "citation_association_id", _alike("claim")),
        ("category_one_requires_citation", "finding", "citation_association_id", _only_if(_o("category") == 1, _t("state") == "yes")),
        ("uncited_finding_requires_no_citation", "finding", "citation_association_id", _only_if(_o("category").isin(2, 3, 4) | (_o("state") == "no_match_found"), _t("state") == "no")),
        ("unclear_finding_requires_unclear_citation", "finding", "citation_association_id", _only_if(_o("state") == "citation_unclear", _t("state") == "unclear")),
        ("finding_pair_claim_mismatch", "finding", "candidate_pair_ids", _alike("claim")),
        ("finding_alternative_mismatch", "finding", "alternative_inspection_ids", _alike("claim")),
        ("finding_history_claim_mismatch", "finding", "supersedes_finding_id", _alike("claim")),
        ("history_time_reversed", "finding", "supersedes_finding_id", time),
        ("review_history_finding_mismatch", "review", "supersedes_review_id", _alike("finding")),
        ("history_time_reversed", "review", "supersedes_review_id", time),
    ]


#: Membership: (code, owner's kind or None for all, role, whose list: a card's entry or "id", list's role, condition over the edge, member: a card's entry or "id", or of the target).
MEMBERS: list[tuple[str, str | None, str, Callable[[], Column], str, Callable[[], Column], Callable[[], Column]]] = [
    ("observation_run_mismatch", None, "observation_id", lambda: _o("run"), "observation_ids", lambda: F.col("kind").isin(*OF_OBSERVATION), lambda: F.col("target")),
    ("observation_run_mismatch", None, "input_ids", lambda: _o("run"), "observation_ids", lambda: F.col("kind").isin(*DERIVED) & (F.col("target_kind") == "observation"), lambda: F.col("target")),
    ("citation_not_captured", "citation_association", "reference_ids", lambda: _o("observation"), "citation_reference_ids", lambda: _t("state") == "citation", lambda: F.col("target")),
    ("corpus_passage_mismatch", "corpus_manifest", "passage_ids", lambda: F.col("id"), "article_version_ids", lambda: F.lit(True), lambda: _t("article")),
    ("pair_batch_mismatch", "candidate_pair", "retrieval_batch_id", lambda: F.col("target"), "candidate_pair_ids", lambda: F.lit(True), lambda: F.col("id")),
    ("pair_passage_outside_corpus", "candidate_pair", "passage_id", lambda: _o("corpus"), "passage_ids", lambda: F.lit(True), lambda: F.col("target")),
    ("pair_passage_outside_corpus", "candidate_pair", "context_passage_ids", lambda: _o("corpus"), "passage_ids", lambda: F.lit(True), lambda: F.col("target")),
]

#: Rules within one record, over texts of its own spans: (code, kind, condition).
OWN: list[tuple[str, str, str]] = [
    ("article_heading_text_mismatch", "article_version", "forall(coalesce(heading_spans, array()), s -> s.text_id <=> cleaned_text_id)"),
    *[("source_unit_not_in_context", kind, "original_span.source_unit_id is null or array_contains(coalesce(context_unit_ids, array()), original_span.source_unit_id)") for kind in ("claim", "extraction_issue")],
]
#: Spans of one list that must be on a text of the target's card: (code, kind, role, list, card's entry).
LISTED: list[tuple[str, str, str, str, str]] = [
    ("citation_text_mismatch", "citation_association", "observation_id", "evidence_spans", "answer"),
    ("passage_heading_text_mismatch", "passage", "article_version_id", "heading_spans", "cleaned"),
]


def spans_in(kind: T.DataType, value: Column) -> Column | None:
    """All spans inside a value, as an array: found from its type alone at any depth of structs, arrays and maps; None if the type holds none."""
    none = F.array().cast(T.ArrayType(_span_type()))
    if isinstance(kind, T.StructType):
        if set(kind.names) >= SPAN_FIELDS:
            return F.when(value.isNull(), none).otherwise(F.array(F.struct(*[value[f].cast(t).alias(f) for f, t in _span_fields()])))
        parts = [p for p in (spans_in(f.dataType, value[f.name]) for f in kind.fields) if p is not None]
        return F.concat(*parts) if parts else None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    if inner is None or spans_in(inner, value) is None:
        return None
    values = value if isinstance(kind, T.ArrayType) else F.map_values(value)
    return F.coalesce(F.flatten(F.transform(values, lambda x: spans_in(inner, x))), none)


def _span_fields() -> list[tuple[str, str]]:
    return [("text_id", "string"), ("start", "long"), ("end", "long"), ("exact_text", "string"), ("source_unit_id", "string")]


def _span_type() -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in _span_fields()])


def all_spans(records: dict[str, DataFrame]) -> DataFrame | None:
    """(id, kind, span) of every span in any record."""
    parts = []
    for kind, table in records.items():
        found = [p for p in (spans_in(f.dataType, F.col(f.name)) for f in table.schema.fields) if p is not None]
        if found:
            parts.append(table.select("id", F.lit(kind).alias("kind"), F.explode(F.concat(*found)).alias("span")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def text_roots(texts: DataFrame) -> DataFrame:
    """(id, root, cyclic) of each text: the text it was made from in the end; a source that is not there ends the lineage without a root."""
    there = texts.select(F.col("id").alias("source_text_id"), F.lit(True).alias("__there"))
    links = texts.select("id", "source_text_id").join(there.hint("merge"), "source_text_id", "left")
    gone = F.col("source_text_id").isNotNull() & F.col("__there").isNull()
    found = lineage_roots(links.select("id", F.when(~gone, F.col("source_text_id")).alias("parent")), "id", "parent")
    return found.select("id", F.col("root").alias("__root"), (F.col("depth") == -1).alias("__cyclic"))


def cards(records: dict[str, DataFrame], entries: Iterable[str] = tuple(CARD)) -> DataFrame:
    """(id, kind, card) of all records with some entries of their cards, one row per id: of repeated ids the least kind and card."""
    parts, kept = [], {name: of for name, of in CARD.items() if name in set(entries)} or {"run": CARD["run"]}
    for kind, table in records.items():
        made = dict(_CARDS.get(kind, {}))
        if kind in DERIVED:
            made["run"] = "analysis_run_id"
        if kind == "text" and kept.keys() & {"root", "root_artifact", "cyclic"}:
            roots = materialise(text_roots(table), "roots")
            of_root = table.select(F.col("id").alias("__root"), F.col("artifact_id").alias("__root_artifact"))
            table = table.join(roots.hint("merge"), "id", "left").join(of_root.hint("merge"), "__root", "left")
        values = [(F.expr(made[name]) if name in made else F.lit(None)).cast(of).alias(name) for name, of in kept.items()]
        parts.append(table.select("id", F.lit(kind).alias("kind"), F.struct(*values).alias("card")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min(F.struct("kind", "card")).alias("one")).select("id", "one.kind", "one.card")


def _references(ids: Column, role: str, expected: str) -> Column:
    return F.transform(ids, lambda x: F.struct(F.lit(role).alias("role"), x.alias("target"), F.lit(expected).alias("expected")))


def _entries(end: str, conditions: Iterable[Column]) -> set[str]:
    """The entries of the card ``o`` or ``t`` that some conditions read."""
    return {name for c in conditions for name in re.findall(rf"\b{end}\.(\w+)", str(c))} & CARD.keys()


def edges(records: dict[str, DataFrame], only: set[tuple[str | None, str]] | None = None) -> DataFrame | None:
    """(id, kind, role, target, expected) of every reference of all records, or of ``only`` some (kind or None for all, role); ids in lists come as often as listed.  None where no kind has any."""
    parts = []
    for kind, table in records.items():
        made = []
        for role, ids, expected in EDGES.get(kind, []):
            if only is not None and not only & {(kind, role), (None, role)}:
                continue
            found = F.expr(ids)
            found = found if isinstance(table.select(found).schema[0].dataType, T.ArrayType) else F.array(found)
            made.append(_references(found, role, expected))
        if made:
            none = F.array().cast("array<struct<role string, target string, expected string>>")
            parts.append(table.select("id", F.lit(kind).alias("kind"), F.explode(F.concat(*[F.coalesce(m, none) for m in made])).alias("e")).select("id", "kind", "e.*"))
    return reduce(DataFrame.unionByName, parts).where("target is not null") if parts else None


def _codes(rows: DataFrame, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """(id, kind, code) where a rule's column is true."""
    return rows.select("id", "kind", F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))).alias("code"))


def _broken(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(False))


def _met(records: dict[str, DataFrame], owners: dict[str, DataFrame], spans: DataFrame | None, only: set[tuple[str | None, str]] | None, of_owner: set[str], of_target: set[str]) -> DataFrame | None:
    """The edges of ``only`` some roles of the owners, with their owner's card ``o`` and their target's kind and card ``t``, each of the entries named."""
    none = F.lit(None).cast("struct<start:bigint,end:bigint,text_id:string>")
    parts = [made.withColumn("span", none) for made in [edges(owners, only)] if made is not None]
    ends = [(role, field, expected) for role, field, expected in (("span_text", "text_id", "text"), ("span_unit", "source_unit_id", "text_unit")) if only is None or (None, role) in only]
    if spans is not None and ends:
        place = F.struct("span.start", "span.end", "span.text_id")
        made = [F.struct(F.lit(role).alias("role"), F.col(f"span.{field}").alias("target"), F.lit(expected).alias("expected")) for role, field, expected in ends]
        parts.append(spans.select("id", "kind", F.explode(F.array(*made)).alias("e"), place.alias("span")).select("id", "kind", "e.*", "span").where("target is not null"))
    if not parts:
        return None
    owned, card = reduce(DataFrame.unionByName, parts), cards(records, of_owner | of_target)
    if of_owner:
        card = materialise(card, "cards")
        owned = owned.join(card.select("id", _part("card", of_owner).alias("o")).hint("merge"), "id", "left")
    of_target = of_target or {"run"} & set(card.schema["card"].dataType.names)
    target = card.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), *([_part("card", of_target).alias("t")] if of_target else []))
    return owned.join(target.hint("merge"), "target", "left")


def _part(card: str, entries: set[str]) -> Column:
    return F.struct(*[F.col(f"{card}.{name}").alias(name) for name in CARD if name in entries])


def _within_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans outside their text or with another quote than the text has there."""
    both = spans.select("id", "kind", "span.*").join(texts.groupBy(F.col("id").alias("text_id")).agg(F.min("text").alias("text")).hint("merge"), "text_id")
    outside = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text"))
    return _codes(both, [("span_out_of_bounds", outside), ("quote_mismatch", ~outside & ~code_point_slice(F.col("text"), F.col("start"), F.col("end")).eqNullSafe(F.col("exact_text")))])


def violations(records: dict[str, DataFrame], codes: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """(id, kind, code) of everything that is wrong with the links of a set of records, given as one table per kind with that kind's schema; with ``codes`` of those alone, with ``kinds`` of records of those alone."""
    wanted = None if codes is None else set(codes)
    asked = lambda *some: wanted is None or bool(wanted & set(some))
    owners = records if kinds is None else {kind: records[kind] for kind in kinds if kind in records}
    spans = all_spans(owners)
    at = lambda kind, role: (F.col("role") == role) & (F.lit(True) if kind is None else F.col("kind") == kind)
    right_kind = (F.col("expected") == ANY) | (F.col("target_kind") == F.col("expected"))
    run_roles = {(kind, role) for kind, found in EDGES.items() for role, _, _ in found if _same_run(kind, role)}
    unit = (_t("text") == F.col("span.text_id")) & (_t("start") <= F.col("span.start")) & (F.col("span.start") < F.col("span.end")) & (F.col("span.end") <= _t("end"))
    same_run = reduce(Column.__or__, [at(kind, role) for kind, role in sorted(run_roles)])
    # A code, where edges break it, and the (kind, role) of those edges: None for all.
    rules: list[tuple[str, Column, set[tuple[str | None, str]] | None]] = [
        ("missing_id", F.col("target_kind").isNull(), None),
        ("wrong_record_kind", F.col("target_kind").isNotNull() & ~right_kind, None),
        ("run_mismatch", right_kind & F.col("target_kind").isin(*DERIVED) & same_run & ~_alike("run"), run_roles),
        ("source_unit_mismatch", right_kind & (F.col("role") == "span_unit") & _broken(unit), {(None, "span_unit")}),
        *[(code, right_kind & at(kind, role) & _broken(rule), {(kind, role)}) for code, kind, role, rule in edge_rules() if kind in owners],
    ]
    rules = [x for x in rules if asked(x[0])]
    found: list[DataFrame | None] = []
    members = [m for m in MEMBERS if asked(m[0]) and (m[1] is None or m[1] in owners)]
    listed = [x for x in LISTED if x[1] in owners and asked(x[0])]
    twice = asked("duplicate_candidate_passage") and "retrieval_batch" in owners
    roles = [some for _, _, some in rules] + [{(m[1], m[2])} for m in members] + [{(x[1], x[2])} for x in listed] + ([{("retrieval_batch", "candidate_pair_ids")}] if twice else [])
    if roles:
        read = [broken for _, broken, _ in rules] + [make() for m in members for make in (m[3], m[5], m[6])] + [_t(x[4]) for x in listed] + ([_t("passage")] if twice else [])
        met = _met(records, owners, spans, None if None in roles else set().union(*roles), _entries("o", read), _entries("t", read))
        uses = bool(rules) + bool(members) + len(listed) + twice
        met = materialise(met, "links") if met is not None and uses > 1 else met
        if met is not None:
            found.append(_codes(met, [(code, broken) for code, broken, _ in rules]) if rules else None)
            for code, kind, role, column, entry in listed:
                own = records[kind].select("id", F.transform(F.coalesce(column, F.array().cast(records[kind].schema[column].dataType)), lambda s: s["text_id"]).alias("texts"))
                found.append(_codes(met.where(at(kind, role) & right_kind).join(own.hint("merge"), "id"), [(code, _broken(_all_are(F.col("texts"), _t(entry))))]))
            lists = edges(records, {(None, m[4]) for m in members}) if members else None
            found.append(_members(met, lists, right_kind, at, members) if members else None)
            found.append(_twice(met, right_kind) if twice else None)
    found += [_codes(records[kind].withColumn("kind", F.lit(kind)), [(code, _broken(F.expr(rule)))]) for code, kind, rule in OWN if kind in owners and asked(code)]
    if asked("branched_history", "history_cycle", "multiple_selected_findings"):
        found.append(_histories(records))
    if spans is not None and "text" in records and asked("span_out_of_bounds", "quote_mismatch"):
        found.append(_within_spans(spans, records["text"]))
    if asked("duplicate_id"):
        ids = reduce(DataFrame.unionByName, [t.select("id", F.lit(kind).alias("kind")) for kind, t in records.items()])
        found.append(ids.groupBy("id").agg(F.min("kind").alias("kind"), F.count("*").alias("n")).where("n > 1").select("id", "kind", F.lit("duplicate_id").alias("code")))
    out = reduce(DataFrame.unionByName, [f for f in found if f is not None])
    out = out if kinds is None else out.where(F.col("kind").isin(*owners))
    return (out if wanted is None else out.where(F.col("code").isin(*wanted))).distinct()


def _all_are(values: Column, one: Column) -> Column:
    return F.forall(values, lambda x: x.eqNullSafe(one))


def _members(met: DataFrame, lists: DataFrame | None, right_kind: Column, at: Callable[[str | None, str], Column], members: list) -> DataFrame:
    """Violations of membership: asked for as rows, answered by the edges that are the lists' entries."""
    asked = F.array_compact(F.array(*[
        F.when(right_kind & at(kind, role) & F.coalesce(where(), F.lit(False)), F.struct(owner().alias("list_of"), F.lit(listed).alias("list"), member().alias("member"), F.lit(code).alias("code")))
        for code, kind, role, owner, listed, where, member in members
    ]))
    rows = met.select("id", "kind", F.explode(asked).alias("q")).select("id", "kind", "q.*")
    if lists is not None:
        held = lists.select(F.col("id").alias("list_of"), F.col("role").alias("list"), F.col("target").alias("member"))
        rows = rows.join(held.hint("merge"), ["list_of", "list", "member"], "left_anti")
    return rows.select("id", "kind", "code")


def _twice(met: DataFrame, right_kind: Column) -> DataFrame:
    """Batches whose pairs name a passage twice."""
    pairs = met.where((F.col("kind") == "retrieval_batch") & (F.col("role") == "candidate_pair_ids") & right_kind)
    return pairs.groupBy("id", "kind", "t.passage").agg(F.count("*").alias("n")).where("n > 1").select("id", "kind", F.lit("duplicate_candidate_passage").alias("code"))


def _histories(records: dict[str, DataFrame]) -> DataFrame | None:
    """Branches, cycles and selections of the histories of findings and reviews."""
    out = []
    for kind, column in (("finding", "supersedes_finding_id"), ("review", "supersedes_review_id")):
        if kind not in records:
            continue
        rows = records[kind].select("id", F.col(column).alias("old"))
        say = lambda df, code, kind=kind: df.select("id", F.lit(kind).alias("kind"), F.lit(code).alias("code"))
        branched = rows.where("old is not null").groupBy("old").agg(F.count("*").alias("n")).where("n > 1")
        out.append(say(rows.join(branched, "old", "left_semi"), "branched_history"))
        there = rows.join(rows.select(F.col("id").alias("old"), F.lit(1).alias("known")).distinct(), "old", "left")
        roots = lineage_roots(there.select("id", F.when(F.col("known") == 1, F.col("old")).alias("parent")), "id", "parent")
        out.append(say(roots.where("depth = -1"), "history_cycle"))
        if kind == "finding":
            of = records[kind].select("id", "analysis_run_id", "claim_id", "supersedes_finding_id")
            newer = of.select(F.col("supersedes_finding_id").alias("id")).where("id is not null").distinct().withColumn("newer", F.lit(1))
            counted = of.join(newer, "id", "left").groupBy("analysis_run_id", "claim_id").agg(F.count_if(F.col("newer").isNull()).alias("n"), F.min("id").alias("id")).where("n <> 1")
            out.append(say(counted, "multiple_selected_findings"))
    return reduce(DataFrame.unionByName, out) if out else None

