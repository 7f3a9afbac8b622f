"""Record-graph constraints as violation queries, (code, id) each: an empty result is a valid bundle.  Metrics over the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import code_point_slice
from ..runtime import discard, materialise

RUN = 1 << 18  # rows of neighbouring keys that a task follows at once


def duplicate_ids(records: DataFrame, key: str = "id") -> DataFrame:
    """Ids that several records have."""
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate_id").alias("code"))


def dangling(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(src, dst, code) of edges (src, dst, expected) to no record or to one of another kind."""
    both = edges.join(records.select(F.col("id").alias("dst"), "kind"), "dst", "left")
    code = F.when(F.col("kind").isNull(), "missing_id").when(F.col("kind") != F.col("expected"), "wrong_record_kind")
    return both.select("src", "dst", code.alias("code")).where("code is not null")


def linked_violations(rows: DataFrame, others: DataFrame, on: list[str], key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for every rule, over a row and the record it links to, that does not hold; a missing record breaks all rules."""
    both = rows.join(others, on, "left")
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return both.select(key, F.explode(codes).alias("code"))


def span_violations(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(owner, code) of spans (owner, text_id, start, end, exact_text) outside their text or with another quote than the text has there."""
    both = spans.join(texts.select("text_id", "text"), "text_id")
    code = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text")), "span_out_of_bounds").when(code_point_slice(F.col("text"), F.col("start"), F.col("end")) != F.col("exact_text"), "quote_mismatch")
    return both.select("owner", code.alias("code")).where("code is not null")


def _followed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, parent) in order of their keys as (key, at, depth, done), each followed to the last ancestor within its run of about ``most`` rows; on a cycle inside a run at and depth are null."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            yield _run_followed(pa.Table.from_batches(held))
            held = []
    if sum(x.num_rows for x in held):
        yield _run_followed(pa.Table.from_batches(held))


def _run_followed(rows: pa.Table) -> pa.RecordBatch:
    keys, parents = (pa.concat_arrays(c.chunks) for c in rows.columns)
    known = keys.dictionary_encode()
    code = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.zeros(len(known.dictionary) + 1, np.int64)
    at[code] = np.arange(len(code))
    alone = np.bincount(code + 1, minlength=len(at))[1:] == 1
    alone = np.append(alone, False)
    alone[[code[0], code[-1], -1]] = False  # a key at the edge may have further rows beside this run, a repeated one has several ways up
    to = pc.index_in(parents, value_set=known.dictionary, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
    up = np.where(alone[to], at[to], -1)
    far, hops = np.where(up >= 0, up, np.arange(len(up))), (up >= 0).astype(np.int64)
    for _ in range(len(up).bit_length() + 1):
        hops, further = hops + hops[far], far[far]
        if (further == far).all():
            break
        far = further
    cyclic = up[far] >= 0
    root = parents.is_null().to_numpy(zero_copy_only=False)[far]
    ends = pc.coalesce(parents, keys).take(pa.array(far))
    none = pa.array(cyclic)
    arrays = [keys, pc.if_else(none, pa.scalar(None, ends.type), ends), pa.array(hops + ~root, pa.int64(), mask=cyclic), pa.array(root | cyclic)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "at", "depth", "done"])


def lineage_roots(links: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): the ancestor without a parent; on a cycle root is null and depth -1.

    Rows are first followed within runs of neighbouring keys, without a shuffle a step; the distance looked up is then doubled in each round, only for ancestors that rows of other runs
    are left with.  Where parents lie near their rows that is a small share; where they are scattered it is all rows, in as many rounds as the logarithm of the depth.
    """
    both = links.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    kind = both.select(F.coalesce("up", "id").alias("x")).schema["x"].dataType.simpleString()
    rows, most = both.select(F.col("id").cast(kind).alias("id"), F.col("up").cast(kind).alias("up")), RUN
    sorted_ = rows.repartitionByRange("id").sortWithinPartitions("id")
    start = materialise(sorted_.mapInArrow(lambda batches: _followed(batches, most), f"id {kind}, at {kind}, depth long, done boolean"), "lineage")
    asked = materialise(start.where("not done").select(F.col("at").alias("id")).distinct(), "asked")
    state = materialise(start.join(asked, "id", "left_semi"), "lineage")
    looked_up = lambda df: df.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("depth").alias("more"), F.col("done").alias("ends"))
    moved = lambda df, up: df.where("not done").join(up, "at").select("id", F.col("far").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done")).unionByName(df.where("done"))
    open_rows = state.where("not done").count()
    while open_rows:
        new = materialise(moved(state, looked_up(state).hint("merge")), "lineage")
        discard(state)
        state, before, open_rows = new, open_rows, new.where("not done").count()
        if open_rows == before:  # depths are contiguous, so a round without progress leaves only cycles
            break
    found = moved(start, looked_up(state))
    good = F.col("done") & F.col("depth").isNotNull()
    return found.select(F.col("id").cast(links.schema[key].dataType).alias(key), F.when(good, F.col("at")).alias("root"), F.when(good, F.col("depth")).otherwise(-1).alias("depth"))


def version_violations(articles: DataFrame, key: str, previous: str, url: str) -> DataFrame:
    """(key, code) of versions whose predecessor is missing or of another url (told at that step alone), and of all whose chain ends in a cycle."""
    known = articles.select(F.col(key).alias(previous), F.col(url).alias("__url"), F.lit(True).alias("__known"))
    steps = articles.select(key, previous, url).join(known, previous, "left").select(key, previous, "__known", (~F.col(url).eqNullSafe(F.col("__url"))).alias("__other"))
    code = F.when(F.col(previous).isNotNull() & F.col("__known").isNull(), "missing_id").when(F.col("__known") & F.col("__other"), "previous_article_url_mismatch")
    cyclic = lineage_roots(steps.select(key, F.when(F.col("__known"), F.col(previous)).alias(previous)), key, previous).where("depth = -1")
    return steps.select(key, code.alias("code")).where("code is not null").unionByName(cyclic.select(key, F.lit("article_history_cycle").alias("code")))


def history_violations(rows: DataFrame, key: str, supersedes: str, subject: str, created: str) -> DataFrame:
    """(key, code) of histories that change subject, go back in time, branch, or are cyclic."""
    old = rows.select(F.col(key).alias("__old"), F.col(subject).alias("__s"), F.col(created).alias("__t"))
    steps = rows.join(old, F.col(supersedes) == F.col("__old"))
    codes = F.array_compact(F.array(F.when(F.col(subject) != F.col("__s"), F.lit("history_subject_mismatch")), F.when(F.col(created) < F.col("__t"), F.lit("history_time_reversed"))))
    pairs = steps.select(key, F.explode(codes).alias("code"))
    branched = rows.where(F.col(supersedes).isNotNull()).groupBy(supersedes).agg(F.count("*").alias("n")).where("n > 1").select(F.col(supersedes).alias(key), F.lit("branched_history").alias("code"))
    cyclic = lineage_roots(rows.select(key, F.col(supersedes).alias("parent")), key, "parent")  # a chain that ends at a missing row isn't cyclic
    cyclic = cyclic.where("depth = -1").select(key, F.lit("history_cycle").alias("code"))
    return pairs.unionByName(branched).unionByName(cyclic)


def selected(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """The rows that no other row supersedes."""
    return rows.join(rows.select(F.col(supersedes).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def selection_violations(rows: DataFrame, key: str, supersedes: str, subject: list[str]) -> DataFrame:
    """Subjects without exactly one unsuperseded row."""
    kept = selected(rows, key, supersedes).groupBy(*subject).agg(F.count("*").alias("n"))
    return rows.select(*subject).distinct().join(kept, subject, "left").na.fill(0, ["n"]).where("n <> 1").select(*subject, "n")


def review_state(findings: DataFrame, reviews: DataFrame, finding: str) -> DataFrame:
    """(finding, state): the decision of the last review that no other supersedes, or unreviewed."""
    last = selected(reviews, "review_id", "supersedes").groupBy(finding).agg(F.max_by("decision", "review_id").alias("state"))
    return findings.select(finding).join(last, finding, "left").select(finding, F.coalesce("state", F.lit("unreviewed")).alias("state"))


def closure(roots: DataFrame, edges: DataFrame, limit: int | None = 100_000) -> DataFrame:
    """All ids reachable from the roots over (src, dst), level by level; more than ``limit`` ids is an error, None sets no limit."""
    known = materialise(roots.select("id").distinct(), "closure")
    fresh = known
    while True:
        step = materialise(fresh.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti"), "frontier")
        if not step.limit(1).count():
            discard(step)
            if fresh is not known:
                discard(fresh)
            return known
        grown = materialise(known.unionByName(step), "closure")
        discard(known)
        if fresh is not known:
            discard(fresh)
        if limit is not None and grown.count() > limit:
            raise ValueError("record_closure_limit")
        known, fresh = grown, step


def citation_rate(observations: DataFrame, by: list[str]) -> DataFrame:
    """Numerator, denominator and exclusions per group: successful captures that decide presence or absence of a target citation.

    A captured target citation proves presence even when capture was incomplete; absence needs an available list.
    """
    ok = F.col("status") == "succeeded"
    decides = ok & (F.col("cited") | (F.col("availability") == "available"))
    return observations.groupBy(*by).agg(F.count_if(decides & F.col("cited")).alias("numerator"), F.count_if(decides).alias("denominator"), F.count_if(~ok).alias("failed"), F.count_if(ok & ~decides).alias("not_assessable"))


def manifest_state(articles: DataFrame, batch: str, usable: Column) -> DataFrame:
    """(batch, status, usable, articles): ready with all articles usable, incomplete with some, failed with none."""
    by = articles.groupBy(batch).agg(F.count_if(usable).alias("usable"), F.count("*").alias("articles"))
    return by.withColumn("status", F.when(F.col("usable") == F.col("articles"), "ready").when(F.col("usable") > 0, "incomplete").otherwise("failed"))


def first_violation(violations: DataFrame, key: str, order: dict[str, int]) -> DataFrame:
    """The first code of each record by a given order of checks."""
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return violations.groupBy(key).agg(F.min_by("code", place[F.col("code")]).alias("code"))


def neighbours_changed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, per key in order."""
    return rows.where(~F.col(value).eqNullSafe(F.lag(value).over(W.partitionBy(key).orderBy(order))))
