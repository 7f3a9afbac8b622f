"""Graph constraints and metrics over records derived from the tables, with injected faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as G
from ..operators import links
from . import bundle
from .base import Plans

plans = Plans()


def _m(column: str, n: int):
    return F.col(column) % n


@plans.add("SELECT md5(text) AS id, 'duplicate_id' AS code FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t):
    return G.duplicate_ids(t("documents").select(F.md5("text").alias("id")))


# Lineage: document n was made from n // 2, 0 is the root; ids 7 and 14 to 15 of each thousand form cycles.
_PARENT = "CASE WHEN doc_id = 0 THEN NULL WHEN doc_id % 1000 = 7 THEN doc_id + 7 ELSE doc_id // 2 END"


@plans.add(
    f"""WITH RECURSIVE p AS (SELECT doc_id, {_PARENT} AS parent FROM documents), up(doc_id, pos, depth) AS (
  SELECT doc_id, doc_id, 0 FROM p UNION ALL SELECT u.doc_id, p.parent, u.depth + 1 FROM up u JOIN p ON p.doc_id = u.pos WHERE p.parent IS NOT NULL AND u.depth < 40)
SELECT doc_id, coalesce(max(CASE WHEN pos = 0 THEN 0 END), -1)::BIGINT AS root, coalesce(max(CASE WHEN pos = 0 THEN depth END), -1)::BIGINT AS depth FROM up GROUP BY 1"""
)
def lineage_root(t):
    parent = F.when(F.col("doc_id") == 0, F.lit(None).cast("long")).when(_m("doc_id", 1000) == 7, F.col("doc_id") + 7).otherwise(F.floor(F.col("doc_id") / 2))
    return G.lineage_roots(t("documents").select("doc_id", parent.alias("parent")), "doc_id", "parent").select("doc_id", F.coalesce("root", F.lit(-1)).cast("long").alias("root"), F.col("depth").cast("long").alias("depth"))


@plans.add("SELECT source, count(*) FILTER (doc_id % 25 <> 4) AS usable, count(*) AS articles, CASE WHEN count(*) FILTER (doc_id % 25 = 4) = 0 THEN 'ready' WHEN count(*) FILTER (doc_id % 25 <> 4) > 0 THEN 'incomplete' ELSE 'failed' END AS status FROM documents GROUP BY 1")
def manifest_readiness(t):
    return G.manifest_state(t("documents"), "source", _m("doc_id", 25) != 4)


# Findings: an event supersedes the one ten before it; every 50th branches off an older one, ids 30 and 40 form a loop.
_PREV = "CASE WHEN event_id = 30 THEN 40 WHEN event_id >= 10 AND event_id % 50 <> 0 THEN event_id - 10 WHEN event_id >= 50 THEN event_id - 20 END"


def _previous():
    e = F.col("event_id")
    return F.when(e == 30, 40).when((e >= 10) & (e % 50 != 0), e - 10).when(e >= 50, e - 20).cast("long")


@plans.add(
    f"""WITH h AS (SELECT event_id, event_id % 10 AS subject, ts, {_PREV} AS prev FROM events)
SELECT prev AS event_id, 'branched_history' AS code FROM h WHERE prev IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT h.event_id, 'history_time_reversed' FROM h JOIN h o ON h.prev = o.event_id WHERE h.ts < o.ts
UNION ALL SELECT h.event_id, 'history_subject_mismatch' FROM h JOIN h o ON h.prev = o.event_id WHERE h.subject <> o.subject
UNION ALL SELECT event_id, 'history_cycle' FROM h WHERE event_id % 10 = 0 AND event_id >= 30"""
)
def history_violations(t):
    h = t("events").select("event_id", (F.col("event_id") % 10).alias("subject"), "ts", _previous().alias("prev"))
    return G.history_violations(h, "event_id", "prev", "subject", "ts")


@plans.add(f"WITH h AS (SELECT event_id, user_id, {_PREV} AS prev FROM events), s AS (SELECT * FROM h WHERE event_id NOT IN (SELECT prev FROM h WHERE prev IS NOT NULL)) SELECT u.user_id, count(s.event_id) AS n FROM (SELECT DISTINCT user_id FROM h) u LEFT JOIN s USING (user_id) GROUP BY 1 HAVING count(s.event_id) <> 1")
def selected_finding(t):
    h = t("events").select("event_id", "user_id", _previous().alias("prev"))
    return G.selection_violations(h, "event_id", "prev", ["user_id"])


_REVIEW = """r AS (SELECT event_id AS review_id, user_id, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'rejected' ELSE 'corrected' END AS decision, CASE WHEN event_id % 2 = 1 THEN event_id - 1 END AS supersedes FROM events WHERE user_id % 4 <> 0),
state AS (SELECT u.user_id, coalesce(arg_max(r.decision, r.review_id), 'unreviewed') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM r WHERE review_id NOT IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL)) r USING (user_id) GROUP BY 1)"""


def _reviews(t):
    e = t("events")
    decision = F.when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "view", "rejected").otherwise("corrected")
    reviews = e.where("user_id % 4 <> 0").select(F.col("event_id").alias("review_id"), "user_id", decision.alias("decision"), F.when(_m("event_id", 2) == 1, F.col("event_id") - 1).alias("supersedes"))
    return G.review_state(e.select("user_id").distinct(), reviews, "user_id")


@plans.add(f"WITH {_REVIEW} SELECT * FROM state")
def review_status(t):
    return _reviews(t)


@plans.add(f"WITH {_REVIEW} SELECT state, count(*) AS findings FROM state GROUP BY 1")
def review_counts(t):
    return _reviews(t).groupBy("state").agg(F.count("*").alias("findings"))


@plans.add(
    """WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 3 AS dst FROM documents), c(id) AS (SELECT doc_id FROM labels UNION SELECT dst FROM c JOIN e ON e.src = c.id)
SELECT id::BIGINT AS id FROM c"""
)
def record_closure(t):
    edges = t("documents").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 3).alias("dst"))
    return G.closure(t("labels").select(F.col("doc_id").alias("id")), edges, limit=None)


@plans.add(
    """WITH o AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'monitoring' ELSE 'diagnostic' END AS purpose, CASE WHEN event_id % 3 = 0 THEN 'reanalysis' ELSE 'capture' END AS mode, event_type <> 'error' AS ok, value > 10 AS cited, event_id % 4 <> 0 AS available FROM events)
SELECT purpose, mode, count(*) FILTER (ok AND cited) AS numerator, count(*) FILTER (ok AND (cited OR available)) AS denominator, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND NOT (cited OR available)) AS not_assessable FROM o GROUP BY 1, 2"""
)
def citation_rate(t):
    e = t("events")
    rows = e.select(F.when(_m("user_id", 2) == 0, "monitoring").otherwise("diagnostic").alias("purpose"), F.when(_m("event_id", 3) == 0, "reanalysis").otherwise("capture").alias("mode"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (F.col("value") > 10).alias("cited"), F.when(_m("event_id", 4) == 0, "incomplete").otherwise("available").alias("availability"))
    return G.citation_rate(rows, ["purpose", "mode"])


@plans.add("SELECT source, count(*) AS articles, sum(len(string_split(text, chr(10))))::BIGINT AS passages FROM documents GROUP BY 1")
def corpus_status(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("articles"), F.sum(F.size(F.split("text", "\n"))).alias("passages"))


@plans.add("SELECT event_type AS operation, user_id % 5 AS code, count(*) AS failures, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events WHERE event_type = 'error' OR value > 50 GROUP BY 1, 2")
def failure_ledger(t):
    bad = t("events").where("event_type = 'error' or value > 50")
    return bad.groupBy(F.col("event_type").alias("operation"), (F.col("user_id") % 5).alias("code")).agg(F.count("*").alias("failures"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))


# Links of the record graph in bundle.py: the operator finds all violations of the given kinds, the twins state each rule over the records' columns.


def _links(name: str, kinds: str, owners: str, codes: str, rules: str):
    """Register the query of some codes of some owners; ``rules`` selects (id, code), rows may repeat."""
    owner_list, code_list, kind_list = owners.split(), codes.split(), kinds.split()

    def query(t):
        return links.violations(bundle.records(t("documents"), kind_list), code_list, owner_list).select("id", "code")

    query.__name__ = name
    plans.add(f"WITH RECURSIVE {bundle.ctes(*kind_list)}{_LINEAGE if 'text' in kind_list and 'root' in rules else ''}\nSELECT DISTINCT id, code FROM ({rules}) WHERE code IS NOT NULL")(query)


#: Each text's root: null on a cycle, or where the lineage ends at a text that isn't there.
_LINEAGE = """,
up(id, pos, depth) AS (SELECT id, id, 0 FROM text_ UNION ALL SELECT u.id, x.source_text_id, u.depth + 1 FROM up u JOIN text_ x ON x.id = u.pos WHERE x.source_text_id IS NOT NULL AND u.depth < 60),
root_ AS (SELECT u.id, x.id AS root, x.artifact_id AS root_artifact FROM up u JOIN text_ x ON x.id = u.pos WHERE x.source_text_id IS NULL),
cycle_ AS (SELECT id FROM text_ WHERE id NOT IN (SELECT id FROM root_))"""

_links(
    "observation_violations", "capture_request observation text source_reference", "observation",
    "capture_request_mismatch answer_artifact_provenance_mismatch successful_answer_empty reference_observation_mismatch not_a_citation_reference text_lineage_cycle",
    """SELECT o.id, 'capture_request_mismatch' AS code FROM observation_ o JOIN capture_request_ q ON q.id = o.request_id WHERE (o.query_id, o.product, o.provider) <> (q.query_id, q.product, q.provider)
UNION ALL SELECT o.id, 'answer_artifact_provenance_mismatch' FROM observation_ o JOIN root_ r ON r.id = o.answer_text_id WHERE r.root_artifact <> o.raw_artifact_id
UNION ALL SELECT o.id, 'successful_answer_empty' FROM observation_ o JOIN text_ x ON x.id = o.answer_text_id WHERE o.status = 'succeeded' AND trim(x.text) = ''
UNION ALL SELECT o.id, 'text_lineage_cycle' FROM observation_ o JOIN cycle_ c ON c.id = o.answer_text_id
UNION ALL SELECT o.id, 'reference_observation_mismatch' FROM (SELECT id, unnest(list_concat(source_reference_ids__data, citation_reference_ids__data)) AS ref FROM observation_) o JOIN source_reference_ r ON r.id = o.ref WHERE r.observation_id <> o.id
UNION ALL SELECT o.id, 'not_a_citation_reference' FROM (SELECT id, unnest(citation_reference_ids__data) AS ref FROM observation_) o JOIN source_reference_ r ON r.id = o.ref WHERE r.reference_kind <> 'citation'""",
)
_links(
    "source_reference_violations", "source_reference observation", "source_reference", "source_metadata_artifact_mismatch citation_text_mismatch",
    """SELECT r.id, unnest([CASE WHEN r.metadata_artifact_id <> o.raw_artifact_id THEN 'source_metadata_artifact_mismatch' END, CASE WHEN r.citation_span__text_id <> o.answer_text_id THEN 'citation_text_mismatch' END]) AS code
FROM source_reference_ r JOIN observation_ o ON o.id = r.observation_id""",
)
_links(
    "unit_violations", "text_unit observation", "text_unit", "unit_text_mismatch unit_relationship_mismatch unit_outside_parent not_a_heading",
    """SELECT u.id, 'unit_text_mismatch' AS code FROM text_unit_ u JOIN observation_ o ON o.id = u.observation_id WHERE u.span__text_id <> o.answer_text_id
UNION ALL SELECT u.id, 'unit_relationship_mismatch' FROM text_unit_ u JOIN text_unit_ x ON x.id IN (u.parent_unit_id, u.heading_unit_id) WHERE x.observation_id <> u.observation_id OR x.id = u.id
UNION ALL SELECT u.id, 'unit_outside_parent' FROM text_unit_ u JOIN text_unit_ x ON x.id = u.parent_unit_id WHERE u.span__start < x.span__start OR u.span__end > x.span__end
UNION ALL SELECT u.id, 'not_a_heading' FROM text_unit_ u JOIN text_unit_ x ON x.id = u.heading_unit_id WHERE x.unit_kind <> 'heading'""",
)
_links(
    "claim_violations", "claim extraction_issue observation text_unit", "claim extraction_issue", "claim_text_mismatch source_unit_not_in_context context_observation_mismatch",
    """SELECT c.id, 'claim_text_mismatch' AS code FROM claim_ c JOIN observation_ o ON o.id = c.observation_id WHERE c.original_span__text_id <> o.answer_text_id
UNION ALL SELECT id, 'source_unit_not_in_context' FROM claim_ WHERE NOT list_contains(context_unit_ids, original_span__source_unit_id)
UNION ALL SELECT c.id, 'context_observation_mismatch' FROM (SELECT id, observation_id, unnest(context_unit_ids) AS unit FROM claim_ UNION ALL SELECT id, observation_id, unnest(context_unit_ids) FROM extraction_issue_) c
 JOIN text_unit_ u ON u.id = c.unit WHERE u.observation_id <> c.observation_id""",
)
_links(
    "citation_violations", "citation_association observation source_reference", "citation_association", "citation_no_requires_complete_capture citation_not_captured not_a_citation_reference reference_observation_mismatch citation_text_mismatch",
    """SELECT x.id, 'citation_no_requires_complete_capture' AS code FROM citation_association_ x JOIN observation_ o ON o.id = x.observation_id WHERE x.status = 'no' AND o.citation_reference_ids__availability <> 'available'
UNION ALL SELECT x.id, 'citation_text_mismatch' FROM citation_association_ x JOIN observation_ o ON o.id = x.observation_id WHERE x.evidence_spans__text_id <> o.answer_text_id
UNION ALL SELECT id, unnest([CASE WHEN other THEN 'reference_observation_mismatch' END, CASE WHEN status = 'yes' AND reference_kind <> 'citation' THEN 'not_a_citation_reference' END, CASE WHEN reference_kind = 'citation' AND NOT held THEN 'citation_not_captured' END])
 FROM (SELECT x.id, x.status, r.reference_kind, r.observation_id <> x.observation_id AS other, list_contains(o.citation_reference_ids__data, r.id) AS held
  FROM (SELECT id, status, observation_id, unnest(reference_ids) AS ref FROM citation_association_) x JOIN source_reference_ r ON r.id = x.ref JOIN observation_ o ON o.id = x.observation_id)""",
)
_links(
    "article_violations", "article_version text", "article_version", "article_raw_provenance_mismatch article_cleaned_lineage_mismatch article_heading_text_mismatch article_version_mismatch text_lineage_cycle",
    """SELECT w.id, 'article_raw_provenance_mismatch' AS code FROM article_version_ w JOIN text_ x ON x.id = w.raw_text_id WHERE x.artifact_id <> w.raw_artifact_id OR x.source_text_id IS NOT NULL
UNION ALL SELECT w.id, 'article_cleaned_lineage_mismatch' FROM article_version_ w JOIN root_ r ON r.id = w.cleaned_text_id WHERE r.root <> w.raw_text_id
UNION ALL SELECT w.id, 'text_lineage_cycle' FROM article_version_ w JOIN cycle_ c ON c.id = w.cleaned_text_id
UNION ALL SELECT id, 'article_heading_text_mismatch' FROM article_version_ WHERE heading_spans__text_id <> cleaned_text_id
UNION ALL SELECT w.id, 'article_version_mismatch' FROM article_version_ w JOIN article_version_ b ON b.id = w.previous_version_id WHERE b.url <> w.url OR b.id = w.id""",
)
_links(
    "passage_violations", "passage article_version", "passage", "passage_article_mismatch passage_heading_text_mismatch passage_parent_mismatch",
    """SELECT p.id, 'passage_article_mismatch' AS code FROM passage_ p JOIN article_version_ w ON w.id = p.article_version_id WHERE w.status <> 'usable' OR p.span__text_id <> w.cleaned_text_id
UNION ALL SELECT p.id, 'passage_heading_text_mismatch' FROM passage_ p JOIN article_version_ w ON w.id = p.article_version_id WHERE p.heading_spans__text_id <> w.cleaned_text_id
UNION ALL SELECT p.id, 'passage_parent_mismatch' FROM passage_ p JOIN passage_ x ON x.id = p.parent_passage_id WHERE x.article_version_id <> p.article_version_id OR x.id = p.id""",
)
_links(
    "manifest_violations", "corpus_manifest article_version passage", "corpus_manifest", "corpus_contains_unusable_article corpus_passage_mismatch",
    """SELECT m.id, 'corpus_contains_unusable_article' AS code FROM (SELECT id, unnest(article_version_ids) AS one FROM corpus_manifest_) m JOIN article_version_ w ON w.id = m.one WHERE w.status <> 'usable'
UNION ALL SELECT m.id, 'corpus_passage_mismatch' FROM (SELECT id, article_version_ids, unnest(passage_ids) AS one FROM corpus_manifest_) m JOIN passage_ p ON p.id = m.one WHERE NOT list_contains(m.article_version_ids, p.article_version_id)""",
)
_links(
    "batch_violations", "retrieval_batch candidate_pair corpus_manifest passage", "retrieval_batch candidate_pair", "pair_batch_mismatch duplicate_candidate_passage pair_passage_outside_corpus",
    """SELECT z.id, 'pair_batch_mismatch' AS code FROM candidate_pair_ z JOIN retrieval_batch_ b ON b.id = z.retrieval_batch_id
 WHERE (z.claim_id, z.corpus_manifest_id, z.index_id) <> (b.claim_id, b.corpus_manifest_id, b.index_id) OR NOT list_contains(b.candidate_pair_ids, z.id)
UNION ALL SELECT b.id, 'pair_batch_mismatch' FROM (SELECT id, unnest(candidate_pair_ids) AS pair FROM retrieval_batch_) b JOIN candidate_pair_ z ON z.id = b.pair WHERE z.retrieval_batch_id <> b.id
UNION ALL SELECT b.id, 'duplicate_candidate_passage' FROM (SELECT id, unnest(candidate_pair_ids) AS pair FROM retrieval_batch_) b JOIN candidate_pair_ z ON z.id = b.pair GROUP BY b.id, z.passage_id HAVING count(*) > 1
UNION ALL SELECT z.id, 'pair_passage_outside_corpus' FROM (SELECT id, corpus_manifest_id, unnest(list_append(context_passage_ids, passage_id)) AS one FROM candidate_pair_) z JOIN passage_ p ON p.id = z.one
 JOIN corpus_manifest_ m ON m.id = z.corpus_manifest_id WHERE NOT list_contains(m.passage_ids, z.one)""",
)
_links(
    "alternative_violations", "alternative_inspection source_reference", "alternative_inspection", "alternative_observation_mismatch duplicate_group_mismatch alternative_excerpt_mismatch",
    """SELECT y.id, unnest([CASE WHEN r.observation_id <> y.observation_id THEN 'alternative_observation_mismatch' END, CASE WHEN r.duplicate_group IS DISTINCT FROM y.duplicate_group THEN 'duplicate_group_mismatch' END,
 CASE WHEN r.excerpt__data__text_id <> y.excerpt_text_id THEN 'alternative_excerpt_mismatch' END]) AS code FROM alternative_inspection_ y JOIN source_reference_ r ON r.id = y.source_reference_id""",
)
_links(
    "decision_lineage", "decision_record extraction_issue claim finding artifact text run_manifest observation text_unit", "decision_record extraction_issue claim finding", "missing_id wrong_record_kind run_mismatch",
    """WITH cited AS (SELECT id, analysis_run_id AS run, unnest(decision_ids) AS one FROM claim_ UNION ALL SELECT id, analysis_run_id, unnest(decision_ids) FROM extraction_issue_ UNION ALL SELECT id, analysis_run_id, unnest(decision_ids) FROM finding_),
 units AS (SELECT id, analysis_run_id AS run, unnest(context_unit_ids) AS one FROM claim_ UNION ALL SELECT id, analysis_run_id, unnest(context_unit_ids) FROM extraction_issue_),
 used AS (SELECT id, unnest(list_append(input_artifact_ids, generation__output_artifact_id)) AS one FROM decision_record_)
SELECT id, CASE WHEN k.run IS NULL THEN 'missing_id' WHEN k.run <> c.run THEN 'run_mismatch' END AS code FROM cited c LEFT JOIN (SELECT id AS one, analysis_run_id AS run FROM decision_record_) k USING (one)
UNION ALL SELECT id, CASE WHEN u.run IS NULL THEN 'missing_id' WHEN u.run <> c.run THEN 'run_mismatch' END FROM units c LEFT JOIN (SELECT id AS one, analysis_run_id AS run FROM text_unit_) u USING (one)
UNION ALL SELECT id, CASE WHEN one IN (SELECT id FROM text_) THEN 'wrong_record_kind' ELSE 'missing_id' END FROM used WHERE one NOT IN (SELECT id FROM artifact_)
UNION ALL SELECT f.id, CASE WHEN c.id IS NULL THEN 'missing_id' WHEN c.analysis_run_id <> f.analysis_run_id THEN 'run_mismatch' END FROM finding_ f LEFT JOIN claim_ c ON c.id = f.claim_id
UNION ALL SELECT f.id, CASE WHEN o.id IS NULL THEN 'missing_id' WHEN o.analysis_run_id <> f.analysis_run_id THEN 'run_mismatch' END FROM finding_ f LEFT JOIN finding_ o ON o.id = f.supersedes_finding_id WHERE f.supersedes_finding_id IS NOT NULL
UNION ALL SELECT id, 'missing_id' FROM finding_""",
)
_links(
    "run_manifest_check", "run_manifest step_attempt review finding observation artifact corpus_manifest", "step_attempt review run_manifest", "missing_id run_mismatch review_history_finding_mismatch history_time_reversed",
    """SELECT s.id, CASE WHEN f.id IS NULL AND s.one NOT IN (SELECT id FROM artifact_) THEN 'missing_id' WHEN f.analysis_run_id <> s.run THEN 'run_mismatch' END AS code
 FROM (SELECT id, analysis_run_id AS run, unnest(output_ids) AS one FROM step_attempt_) s LEFT JOIN finding_ f ON f.id = s.one
UNION ALL SELECT g.id, CASE WHEN f.id IS NULL THEN 'missing_id' WHEN f.analysis_run_id <> g.analysis_run_id THEN 'run_mismatch' END FROM review_ g LEFT JOIN finding_ f ON f.id = g.finding_id
UNION ALL SELECT g.id, unnest([CASE WHEN o.analysis_run_id <> g.analysis_run_id THEN 'run_mismatch' END, CASE WHEN o.finding_id <> g.finding_id THEN 'review_history_finding_mismatch' END, CASE WHEN o.created_at > g.created_at THEN 'history_time_reversed' END])
 FROM review_ g JOIN review_ o ON o.id = g.supersedes_review_id
UNION ALL SELECT id, 'missing_id' FROM (SELECT id, unnest(observation_ids) AS one FROM run_manifest_) WHERE one NOT IN (SELECT id FROM observation_)""",
)
_links(
    "finding_violations", "finding citation_association candidate_pair alternative_inspection", "finding",
    "category_one_requires_citation uncited_finding_requires_no_citation unclear_finding_requires_unclear_citation finding_pair_claim_mismatch finding_alternative_mismatch finding_citation_mismatch finding_history_claim_mismatch history_time_reversed branched_history history_cycle multiple_selected_findings",
    """SELECT f.id, unnest([CASE WHEN x.claim_id <> f.claim_id THEN 'finding_citation_mismatch' END, CASE WHEN f.category = 1 AND x.status <> 'yes' THEN 'category_one_requires_citation' END,
  CASE WHEN (f.category IN (2, 3, 4) OR f.status = 'no_match_found') AND x.status <> 'no' THEN 'uncited_finding_requires_no_citation' END, CASE WHEN f.status = 'citation_unclear' AND x.status <> 'unclear' THEN 'unclear_finding_requires_unclear_citation' END]) AS code
 FROM finding_ f JOIN citation_association_ x ON x.id = f.citation_association_id
UNION ALL SELECT f.id, 'finding_pair_claim_mismatch' FROM (SELECT id, claim_id, unnest(candidate_pair_ids) AS one FROM finding_) f JOIN candidate_pair_ z ON z.id = f.one WHERE z.claim_id <> f.claim_id
UNION ALL SELECT f.id, 'finding_alternative_mismatch' FROM (SELECT id, claim_id, unnest(alternative_inspection_ids__data) AS one FROM finding_) f JOIN alternative_inspection_ y ON y.id = f.one WHERE y.claim_id <> f.claim_id
UNION ALL SELECT f.id, unnest([CASE WHEN o.claim_id <> f.claim_id THEN 'finding_history_claim_mismatch' END, CASE WHEN o.created_at > f.created_at THEN 'history_time_reversed' END]) FROM finding_ f JOIN finding_ o ON o.id = f.supersedes_finding_id
UNION ALL SELECT id, 'branched_history' FROM finding_ WHERE supersedes_finding_id IN (SELECT supersedes_finding_id FROM finding_ GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT min(id), 'multiple_selected_findings' FROM finding_ GROUP BY analysis_run_id, claim_id HAVING count(*) FILTER (id NOT IN (SELECT supersedes_finding_id FROM finding_ WHERE supersedes_finding_id IS NOT NULL)) <> 1""",
)
_links(
    "span_violations", "text text_unit claim source_reference citation_association article_version passage", "text_unit claim source_reference citation_association article_version passage", "span_out_of_bounds quote_mismatch source_unit_mismatch",
    """WITH s(id, t, a, b, q, u) AS (
  SELECT id, span__text_id, span__start, span__end, span__exact_text, NULL FROM text_unit_ UNION ALL SELECT id, original_span__text_id, original_span__start, original_span__end, original_span__exact_text, original_span__source_unit_id FROM claim_
  UNION ALL SELECT id, excerpt__data__text_id, excerpt__data__start, excerpt__data__end, excerpt__data__exact_text, NULL FROM source_reference_ UNION ALL SELECT id, citation_span__text_id, citation_span__start, citation_span__end, citation_span__exact_text, NULL FROM source_reference_
  UNION ALL SELECT id, evidence_spans__text_id, evidence_spans__start, evidence_spans__end, evidence_spans__exact_text, NULL FROM citation_association_ UNION ALL SELECT id, heading_spans__text_id, heading_spans__start, heading_spans__end, heading_spans__exact_text, NULL FROM article_version_
  UNION ALL SELECT id, span__text_id, span__start, span__end, span__exact_text, NULL FROM passage_ UNION ALL SELECT id, heading_spans__text_id, heading_spans__start, heading_spans__end, heading_spans__exact_text, NULL FROM passage_)
SELECT s.id, CASE WHEN a < 0 OR b <= a OR b > length(x.text) THEN 'span_out_of_bounds' WHEN substring(x.text, a + 1, b - a) <> q THEN 'quote_mismatch' END AS code FROM s JOIN text_ x ON x.id = s.t
UNION ALL SELECT s.id, 'source_unit_mismatch' FROM s JOIN text_unit_ v ON v.id = s.u WHERE v.span__text_id <> s.t OR v.span__start > s.a OR s.a >= s.b OR s.b > v.span__end""",
)
_links(
    "run_mismatch", "text_unit claim extraction_issue decision_record run_manifest observation", "text_unit claim extraction_issue", "run_mismatch observation_run_mismatch",
    """WITH own AS (SELECT id, analysis_run_id AS run, observation_id FROM text_unit_ UNION ALL SELECT id, analysis_run_id, observation_id FROM claim_ UNION ALL SELECT id, analysis_run_id, observation_id FROM extraction_issue_),
 refs AS (SELECT id, analysis_run_id AS run, unnest([parent_unit_id, heading_unit_id]) AS one FROM text_unit_ UNION ALL SELECT id, analysis_run_id, unnest(list_concat(context_unit_ids, decision_ids)) FROM claim_ UNION ALL SELECT id, analysis_run_id, unnest(list_concat(context_unit_ids, decision_ids)) FROM extraction_issue_),
 all_ AS (SELECT id AS one, analysis_run_id AS run FROM text_unit_ UNION ALL SELECT id, analysis_run_id FROM decision_record_)
SELECT o.id, 'observation_run_mismatch' AS code FROM own o JOIN run_manifest_ r ON r.id = o.run WHERE NOT list_contains(r.observation_ids, o.observation_id)
UNION ALL SELECT r.id, 'run_mismatch' FROM refs r JOIN all_ a USING (one) WHERE a.run <> r.run""",
)
_links(
    "observation_mismatch", "citation_association alternative_inspection finding claim", "citation_association alternative_inspection finding", "observation_mismatch",
    """WITH own AS (SELECT id, observation_id, claim_id FROM citation_association_ UNION ALL SELECT id, observation_id, claim_id FROM alternative_inspection_ UNION ALL SELECT id, observation_id, claim_id FROM finding_)
SELECT o.id, 'observation_mismatch' AS code FROM own o JOIN claim_ c ON c.id = o.claim_id WHERE c.observation_id <> o.observation_id""",
)
_links(
    "dangling_refs", "decision_record artifact text run_manifest observation corpus_manifest article_version passage", "decision_record text article_version corpus_manifest", "missing_id wrong_record_kind",
    """WITH known AS (SELECT id AS one, 'artifact' AS kind FROM artifact_ UNION ALL SELECT id, 'text' FROM text_ UNION ALL SELECT id, 'run_manifest' FROM run_manifest_ UNION ALL SELECT id, 'observation' FROM observation_ UNION ALL SELECT id, 'article_version' FROM article_version_ UNION ALL SELECT id, 'passage' FROM passage_),
 refs AS (SELECT id, unnest(list_append(input_artifact_ids, generation__output_artifact_id)) AS one, 'artifact' AS want FROM decision_record_ UNION ALL SELECT id, artifact_id, 'artifact' FROM text_ UNION ALL SELECT id, source_text_id, 'text' FROM text_
  UNION ALL SELECT id, raw_artifact_id, 'artifact' FROM article_version_ UNION ALL SELECT id, raw_text_id, 'text' FROM article_version_ UNION ALL SELECT id, previous_version_id, 'article_version' FROM article_version_
  UNION ALL SELECT id, unnest(article_version_ids), 'article_version' FROM corpus_manifest_ UNION ALL SELECT id, unnest(passage_ids), 'passage' FROM corpus_manifest_ UNION ALL SELECT id, analysis_run_id, 'run_manifest' FROM decision_record_)
SELECT r.id, CASE WHEN k.kind IS NULL THEN 'missing_id' WHEN k.kind <> r.want THEN 'wrong_record_kind' END AS code FROM refs r LEFT JOIN known k USING (one) WHERE r.one IS NOT NULL""",
)
