"""The twenty-one boundaries, each a function from DataFrames to a DataFrame with a status per row; nothing here collects.

Model calls take an injected function from a pandas frame of requests to one of answers, so tests and offline runs use scripted models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import identity
from .operators import claims, corpus, guards, retrieval, store, textunits

Model = Callable[[pd.DataFrame], pd.DataFrame]


def capture(responses: DataFrame, language: str = "de") -> DataFrame:
    """Captured responses (id, http_status, body, tag) with the outcome of the first failing check; network capture itself is out of scope."""
    return responses.withColumn("status", corpus.response_failure(F.col("http_status"), F.col("body"), F.col("tag"), language))


def index_answer(answers: DataFrame, key: str, text: str) -> DataFrame:
    return textunits.units(answers, key, text)


def build_context(units: DataFrame, targets: DataFrame, key: str, before: int = 1, after: int = 1, clip: bool = True) -> DataFrame:
    return textunits.context_window(units, targets, key, before, after, clip)


def extract_claims(candidates: DataFrame, validations: DataFrame, key: str) -> DataFrame:
    """Candidates with ``outcome``: claim, or rejected where not all three validations agree."""
    return candidates.join(claims.accepted(validations, key), key, "left").withColumn("outcome", F.when(F.coalesce("accepted", F.lit(False)), "claim").otherwise("rejected")).drop("accepted")


def map_citations(rows: DataFrame, references: DataFrame, claim: str, domain: str) -> DataFrame:
    return claims.citation_routing(rows, references, claim, domain)


def ingest(pages: DataFrame, receipts: DataFrame, key: str = "page_id", language: str | None = "de") -> DataFrame:
    """Pages with their parsed text and an article status."""
    parsed = corpus.parse_pages(pages, key, language=language)
    return parsed.drop("reason").join(corpus.article_status(receipts, parsed, key), key)


def retrieve(queries: DataFrame, passages: DataFrame, query: str, claim: str, key: str, text: str, semantic: DataFrame, k: int = retrieval.K) -> DataFrame:
    """Fused candidates of the lexical path and a given semantic score table (query, key, score)."""
    lexical = retrieval.top_k(retrieval.bm25_scores(queries, passages, query, claim, key, text), query, key, k)
    return retrieval.rrf_fuse(retrieval.top_k(semantic, query, key, k), lexical, query, key)


def expand_context(pairs: DataFrame, passages: DataFrame, article: str, order: str, key: str, headings: str) -> DataFrame:
    return pairs.join(retrieval.neighbours(passages, article, order, key, headings), key, "left")


def _call(requests: DataFrame, receipts: DataFrame, model: Model, schema: str) -> DataFrame:
    """Send every request without a receipt once, by work key."""
    keyed = requests.withColumn("work_key", F.sha2("request", 256))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield model(frame)

    return claims.pending_requests(keyed, receipts).select("work_key", "request").mapInPandas(run, schema)


def decide(requests: DataFrame, receipts: DataFrame, model: Model) -> DataFrame:
    """(work_key, label, allowed, probabilities) of an injected decision model, with the code of an invalid decision."""
    answers = _call(requests, receipts, model, "work_key string, label string, allowed array<string>, probabilities map<string,double>")
    return answers.withColumn("code", guards.decision_code(F.col("label"), F.col("allowed"), F.col("probabilities")))


def generate(requests: DataFrame, receipts: DataFrame, model: Model, schema: dict) -> DataFrame:
    """(work_key, answer, status) of an injected generation model, checked against a JSON Schema."""
    answers = _call(requests, receipts, model, "work_key string, answer string")
    return answers.withColumn("status", guards.generation_status(F.col("answer"), schema))


def verify_candidate(pairs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return claims.screen_candidates(pairs, decisions, key)


def judge_correspondence(pairs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Pairs with their correspondence; without a decision it is pending, never negative."""
    return pairs.join(decisions.select(key, "label"), key, "left").withColumn("correspondence", F.coalesce("label", F.lit("pending"))).drop("label")


def inspect_alternatives(excerpts: DataFrame, claim: str, text: str) -> DataFrame:
    return claims.duplicate_groups(excerpts, claim, text)


def classify(rows: DataFrame, **guard: Column) -> DataFrame:
    """Rows with ``status`` and ``category``; the keyword arguments are those of ``claims.finding``."""
    status = claims.finding(**guard)
    return rows.withColumn("status", status).withColumn("category", claims.finding_category(F.col("status"), guard["citation"], guard["proposed"]))


def put_artifact(payloads: DataFrame) -> DataFrame:
    return store.put_artifacts(payloads)


def get_artifact(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    return store.artifact_status(refs, payloads)


def put_record(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return store.upsert_plan(incoming, existing)


def get_record(requests: DataFrame, records: DataFrame) -> DataFrame:
    return store.lookup(requests, records)


def list_records(records: DataFrame, limit: int = 100, after: int = 0, through: int | None = None, kind: str | None = None, run: str | None = None) -> DataFrame:
    return store.page(records, limit, after, through, kind, run)


def append_decision(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return store.upsert_plan(incoming, existing)


def append_review(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return store.upsert_plan(incoming, existing)


def record_id(role: str, **fields: Column) -> Column:
    """A content-derived id."""
    return identity(role, **fields)
