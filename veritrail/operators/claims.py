"""Claim extraction as set operations: regions, coverage, stages, budgets, acceptance, accounting; evidence routing and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import host_matches, host_of


def region_groups(targets: DataFrame, key: str) -> DataFrame:
    """(key, region, start, end, n): ordered targets merged while they overlap the region so far, or follow a sibling sentence with only white space between.

    Targets have ord, start, end, kind, parent, and gap (whether only white space lies before them).
    """
    w = W.partitionBy(key).orderBy("ord")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    sibling = (F.col("kind") == "sentence") & (F.lag("kind").over(w) == "sentence") & F.lag("parent").over(w).eqNullSafe(F.col("parent")) & F.col("gap")
    joins = (F.col("start") < reach) | sibling
    numbered = targets.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("region", F.sum("__new").over(w))
    return numbered.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def covered_units(regions: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, region, ord) of the units that lie inside a region."""
    u = units.select(key, "ord", F.col("start").alias("a"), F.col("end").alias("b"))
    return regions.join(u, key).where((F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end"))).select(key, "region", "ord")


def stage_route(selected: Column, mixed: Column, ambiguity: Column, located: Column, validated: Column) -> Column:
    """Where a candidate ends: claim, or the issue of the first stage that stops it."""
    return (
        F.when(selected.isNull(), "failed")
        .when(selected == "nonfactual", "excluded")
        .when(selected == "uncertain", "unresolved")
        .when((selected == "mixed") & (mixed == "unresolved"), "unresolved")
        .when(ambiguity == "unresolvable", "unresolved")
        .when(located == 0, "unlocatable")
        .when(located > 1, "ambiguous")
        .when(~validated, "invalid")
        .otherwise("claim")
    )


def budget_admission(calls: DataFrame, run: str, order: list[str], most_calls: int, most_cost: float) -> DataFrame:
    """The calls with ``admitted``: a call is refused when the count or the reserved cost would pass its limit, and then every later one of the run."""
    w = W.partitionBy(run).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    fits = (F.count("*").over(upto) <= most_calls) & (F.sum("reservation").over(upto) <= most_cost + 1e-12)
    return calls.withColumn("__fits", fits).withColumn("admitted", F.min("__fits").over(upto)).drop("__fits")


@dataclass(frozen=True)
class Limits:
    """What a run may spend: model calls in all, of them generations and decisions, and reserved cost."""

    calls: int
    generations: int
    decisions: int
    cost: float


def stage_budgets(calls: DataFrame, run: str, order: list[str], limits: Limits) -> DataFrame:
    """The calls with ``admitted`` and ``stopped_by``: an ordered gate per run that one refusal closes for good.

    Calls have ``generation`` (else a decision), ``reservation``, and ``halts``: whether the call's outcome, once it is sent, stops the run.  The first call past a limit, or
    after a call that halts, is refused with its reason (calls, cost, generations, decisions, halted), every later one with ``stopped``.

    Up to its first refusal a run has admitted every call, so running counts over all calls are the gate's state there.  And a refusal comes at call ``limits.calls + 1``
    at the latest: only so many calls of a run enter the window (a group limit that Spark applies before it shuffles), and a run of any length costs one comparison per call.
    """
    at = F.struct(*order)
    w = W.partitionBy(run).orderBy("__at")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    first = calls.select(run, at.alias("__at"), "generation", "reservation", "halts").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limits.calls + 1)
    made = lambda which: F.coalesce(F.sum(F.when(which, 1).otherwise(0)).over(before), F.lit(0))
    spent = F.coalesce(F.sum("reservation").over(before), F.lit(0.0)) + F.col("reservation")
    reason = (
        F.when(F.coalesce(F.max("halts").over(before), F.lit(False)), "halted")
        .when(F.col("__n") > limits.calls, "calls")
        .when(spent > limits.cost + 1e-12, "cost")
        .when(F.col("generation") & (made(F.col("generation")) >= limits.generations), "generations")
        .when(~F.col("generation") & (made(~F.col("generation")) >= limits.decisions), "decisions")
    )
    stops = first.withColumn("__reason", reason).where("__reason is not null").groupBy(run).agg(F.min(F.struct("__at", "__reason")).alias("__stop"))
    both = calls.withColumn("__at", at).join(stops, run, "left")
    stopped = F.when(F.col("__at") == F.col("__stop.__at"), F.col("__stop.__reason")).when(F.col("__at") > F.col("__stop.__at"), "stopped")
    return both.withColumn("stopped_by", stopped).withColumn("admitted", F.col("stopped_by").isNull()).drop("__at", "__stop")


def cost_slots(calls: DataFrame, run: str, operation: str, order: str, most: float) -> DataFrame:
    """(run, operation, slot, reserved, granted): one slot per operation, reused when it is asked for again; granted while the run's sum stays within the limit."""
    first = calls.groupBy(run, operation).agg(F.min(order).alias(order), F.min_by("reservation", order).alias("reservation"))
    w = W.partitionBy(run).orderBy(order)
    reserved = F.round(F.sum("reservation").over(w.rowsBetween(W.unboundedPreceding, 0)), 9)
    return first.select(run, operation, F.row_number().over(w).cast("long").alias("slot"), reserved.alias("reserved"), (reserved <= most + 1e-12).alias("granted"))


def accepted(validations: DataFrame, key: str) -> DataFrame:
    """(key, accepted): three validations, each with the label expected of it."""
    return validations.groupBy(key).agg((F.bool_and(F.col("label") == F.col("expected")) & (F.count("*") == 3)).alias("accepted"))


def dedup_candidates(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The candidates with ``outcome``: the first of each key is kept, the others are excluded as duplicates."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1
    return candidates.withColumn("outcome", F.when(first, "kept").otherwise("excluded"))


def target_accounting(targets: DataFrame, claims: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, ord, claims, issues, outcome): every target has a claim that overlaps it or an issue, else ``target_not_represented``."""
    c = claims.select(key, F.col("start").alias("a"), F.col("end").alias("b"))
    hit = targets.join(c, key).where((F.col("a") < F.col("end")) & (F.col("start") < F.col("b"))).groupBy(key, "ord").agg(F.count("*").alias("claims"))
    issue = issues.groupBy(key, "ord").agg(F.count("*").alias("issues"))
    both = targets.select(key, "ord").join(hit, [key, "ord"], "left").join(issue, [key, "ord"], "left").na.fill(0, ["claims", "issues"])
    return both.withColumn("outcome", F.when(F.col("claims") > 0, "claimed").when(F.col("issues") > 0, "issue").otherwise("target_not_represented"))


def audit_state(accounting: DataFrame, key: str) -> DataFrame:
    """(key, state): all_targets_failed, partial_failure or complete."""
    bad = F.col("outcome") != "claimed"
    return accounting.groupBy(key).agg(F.when(F.bool_and(bad), "all_targets_failed").when(F.bool_or(bad), "partial_failure").otherwise("complete").alias("state"))


def citation_routing(claims: DataFrame, references: DataFrame, claim: str, domain: str) -> DataFrame:
    """(claim, status, cited): yes if a captured reference is of the domain; no if capture was complete without one; else unclear.

    ``claims`` has ``availability`` of the citation list; incomplete capture can prove presence, not absence.
    """
    ours = references.where(host_matches(host_of(F.col("url")), domain)).groupBy(claim).agg(F.count("*").alias("cited"))
    both = claims.join(ours, claim, "left").na.fill(0, ["cited"])
    return both.select(claim, F.when(F.col("cited") > 0, "yes").when(F.col("availability") == "available", "no").otherwise("unclear").alias("status"), "cited")


def screen_candidates(pairs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The pairs with ``screen``: dropped only if judged clearly irrelevant, pending without a decision, else kept."""
    both = pairs.join(decisions.select(key, "label"), key, "left")
    return both.withColumn("screen", F.when(F.col("label").isNull(), "pending").when(F.col("label") == "clearly_irrelevant", "dropped").otherwise("kept"))


def duplicate_groups(excerpts: DataFrame, claim: str, text: str) -> DataFrame:
    """(claim, excerpts, groups): exact duplicates of an excerpt are one group and count once."""
    return excerpts.groupBy(claim).agg(F.count("*").alias("excerpts"), F.countDistinct(F.sha2(F.col(text), 256)).alias("groups"))


def finding(failed: Column, citation: Column, complete: Column, full: Column, partial: Column, alternatives: Column, assessable: Column, proposed: Column) -> Column:
    """The status of a claim's finding, by ordered guards; ``categorized`` with a category is told apart by ``finding_category``."""
    return (
        F.when(failed, "processing_failed")
        .when(citation == "yes", "categorized")
        .when(citation == "unclear", "citation_unclear")
        .when(~complete, "pending")
        .when((full == 0) & (partial == 0), "no_match_found")
        .when(full == 0, "not_enough_evidence")
        .when((alternatives == 0) | (proposed == 4) & ~assessable, "not_enough_evidence")
        .otherwise("categorized")
    )


def finding_category(status: Column, citation: Column, proposed: Column) -> Column:
    """1 for a cited claim, the proposed category 2 to 4 for another categorized one, 0 for none."""
    return F.when(status != "categorized", 0).when(citation == "yes", 1).otherwise(proposed)


def latest_attempts(attempts: DataFrame, key: str = "work_key") -> DataFrame:
    """The last attempt of each work key; of equal numbers the later one by id."""
    return attempts.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("attempt"), F.desc("id")))).where("__r = 1").drop("__r")


def pending_work(work: DataFrame, attempts: DataFrame, key: str = "work_key") -> DataFrame:
    """Work to be done: no attempt succeeded, and none timed out with an uncertain outcome."""
    closed = attempts.where("status = 'succeeded' or outcome_uncertain").select(key)
    return work.join(closed, key, "left_anti")


def pending_requests(prepared: DataFrame, receipts: DataFrame) -> DataFrame:
    """Prepared requests without a receipt; the work key is the hash of the whole request, so a repeated one is dispatched once."""
    return prepared.dropDuplicates(["work_key"]).join(receipts.select("work_key"), "work_key", "left_anti")
