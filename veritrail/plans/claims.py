"""Claim and evidence queries: conversations are observations, benchmark items claims, events work and calls."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import dispatch as X
from ..operators.textunits import lf_lines
from ..runtime import materialise, mounted_dir
from .base import Plans

plans = Plans()

# Targets: the even lines of a document; spans by line offsets; claims: every third line; issues: every fifth.
_LINES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i - 1 AS ord, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start, length(l[i]) AS n FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
units AS (SELECT doc_id, ord, start, start + n AS "end", CASE WHEN n < 40 THEN 'heading' ELSE 'sentence' END AS kind FROM lines),
targets AS (SELECT *, coalesce(lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) = ord - 1, false) AS gap FROM units WHERE ord % 4 <> 3),
marked AS (SELECT *, CASE WHEN kind = 'sentence' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY ord), '') = 'sentence' AND gap THEN 0 ELSE 1 END AS new FROM targets),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS region FROM marked),
regions AS (SELECT doc_id, region::BIGINT AS region, min(start) AS start, max("end") AS "end", count(*) AS n FROM grouped GROUP BY 1, 2)"""


def _units(t):
    lines = lf_lines(t("documents"), "doc_id", "text")
    return lines.withColumn("kind", F.when(F.col("end") - F.col("start") < 40, "heading").otherwise("sentence"))


def _targets(t):
    rows = _units(t).where("ord % 4 <> 3").withColumn("parent", F.lit(0))
    return rows.withColumn("gap", F.coalesce(F.lag("ord").over(W.partitionBy("doc_id").orderBy("ord")) == F.col("ord") - 1, F.lit(False)))


@plans.add(f'WITH {_LINES} SELECT doc_id, region, start, "end", n FROM regions')
def region_groups(t):
    return C.region_groups(_targets(t), "doc_id")


@plans.add(f'WITH {_LINES} SELECT r.doc_id, r.region, u.ord FROM regions r JOIN units u ON u.doc_id = r.doc_id AND r.start <= u.start AND u."end" <= r."end"')
def covered_units(t):
    return C.covered_units(C.region_groups(_targets(t), "doc_id"), _units(t), "doc_id")


_STAGE = """CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 11 = 1 THEN 'excluded' WHEN doc_id % 11 = 2 THEN 'unresolved' WHEN doc_id % 11 = 3 AND doc_id % 2 = 0 THEN 'unresolved'
  WHEN doc_id % 7 = 0 THEN 'unresolved' WHEN doc_id % 5 = 0 THEN 'unlocatable' WHEN doc_id % 5 = 1 THEN 'ambiguous' WHEN doc_id % 3 = 0 THEN 'invalid' ELSE 'claim' END"""


def _stages(t):
    d, m = t("documents"), lambda n: F.col("doc_id") % n
    selected = F.when(m(11) == 1, "nonfactual").when(m(11) == 2, "uncertain").when(m(11) == 3, "mixed").when(m(11) != 0, "factual")
    route = C.stage_route(selected, F.when(m(2) == 0, "unresolved").otherwise("resolved"), F.when(m(7) == 0, "unresolvable").otherwise("clear"), F.when(m(5) == 0, 0).when(m(5) == 1, 2).otherwise(1), m(3) != 0)
    return d.select("doc_id", route.alias("outcome"))


@plans.add(f"SELECT doc_id, {_STAGE} AS outcome FROM documents")
def stage_routing(t):
    return _stages(t)


@plans.add(f"SELECT {_STAGE} AS issue, count(*) AS n FROM documents WHERE {_STAGE} <> 'claim' GROUP BY 1")
def issue_types(t):
    return _stages(t).where("outcome <> 'claim'").groupBy(F.col("outcome").alias("issue")).agg(F.count("*").alias("n"))


@plans.add(
    """WITH c AS (SELECT user_id, event_id, count(*) OVER w AS n, sum(value) OVER w AS cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT user_id, event_id, n <= 40 AND cost <= 500 + 1e-12 AS fits FROM c)
SELECT user_id, event_id, bool_and(fits) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS admitted FROM f"""
)
def budget_admission(t):
    return C.budget_admission(t("events").withColumn("reservation", F.col("value")), "user_id", ["event_id"], 40, 500.0).select("user_id", "event_id", "admitted")


# Calls of a run (a user's events in order): clicks are generations, errors of a high value halt the run.  The twin walks call by call.
@plans.add(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'click' AS gen, value AS cost, event_type = 'error' AND value > 40 AS halts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run(user_id, event_id, n, calls, gens, decs, spent, stopped, why) AS (
  SELECT user_id, NULL::BIGINT, 0, 0, 0, 0, 0.0::DOUBLE, false, NULL::VARCHAR FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT user_id, event_id, n, calls + ok, gens + ok * gen::INT, decs + ok * (1 - gen::INT), spent + ok * cost, why IS NOT NULL OR halts OR was, CASE WHEN was AND closed THEN 'stopped' WHEN was THEN 'halted' ELSE why END
  FROM (SELECT *, CASE WHEN why IS NULL AND NOT was THEN 1 ELSE 0 END AS ok FROM (
    SELECT e.user_id, e.event_id, e.n, e.gen, e.cost, e.halts, r.calls, r.gens, r.decs, r.spent, r.stopped AS was, r.why IS NOT NULL AS closed,
      CASE WHEN r.calls >= 60 THEN 'calls' WHEN r.spent + e.cost > 1500 + 1e-12 THEN 'cost' WHEN e.gen AND r.gens >= 14 THEN 'generations' WHEN NOT e.gen AND r.decs >= 50 THEN 'decisions' END AS why
    FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id, event_id, why IS NULL AS admitted, coalesce(why, '') AS stopped_by FROM run WHERE n > 0"""
)
def stage_budgets(t):
    halts = (F.col("event_type") == "error") & (F.col("value") > 40)
    calls = t("events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("generation"), F.col("value").alias("reservation"), halts.alias("halts"))
    gated = C.stage_budgets(calls, "user_id", ["ts", "event_id"], C.Limits(calls=60, generations=14, decisions=50, cost=1500.0))
    return gated.select("user_id", "event_id", "admitted", F.coalesce("stopped_by", F.lit("")).alias("stopped_by"))


@plans.add(
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS reservation FROM events GROUP BY 1, 2),
s AS (SELECT user_id, event_type, row_number() OVER w AS slot, round(sum(reservation) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS reserved FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT *, reserved <= 40 + 1e-12 AS granted FROM s"""
)
def cost_slots(t):
    return C.cost_slots(t("events").withColumn("reservation", F.col("value")), "user_id", "event_type", "event_id", 40.0)


@plans.add("SELECT doc_id, doc_id % 4 <> 2 AS accepted FROM documents")
def acceptance(t):
    checks = t("documents").select("doc_id", F.explode(F.array(*map(F.lit, ("supported", "faithful", "complete")))).alias("expected"))
    label = F.when((F.col("doc_id") % 4 == 2) & (F.col("expected") == "faithful"), "unfaithful").otherwise(F.col("expected"))
    return C.accepted(checks.withColumn("label", label), "doc_id")


@plans.add("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'kept' ELSE 'excluded' END AS outcome FROM documents")
def candidate_dedup(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return C.dedup_candidates(rows, ["content"], "doc_id").select("doc_id", "outcome")


_ACCOUNT = f"""WITH {_LINES}, hit AS (SELECT t.doc_id, t.ord, count(*) AS claims FROM targets t JOIN units c ON c.doc_id = t.doc_id AND c.ord % 3 = 0 AND c.start < t."end" AND t.start < c."end" GROUP BY 1, 2),
account AS (SELECT t.doc_id, t.ord, coalesce(h.claims, 0) AS claims, CASE WHEN t.ord % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS issues,
  CASE WHEN h.claims > 0 THEN 'claimed' WHEN t.ord % 5 = 0 THEN 'issue' ELSE 'target_not_represented' END AS outcome FROM targets t LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.ord = t.ord)"""


def _accounting(t):
    u, targets = _units(t), _targets(t)
    return C.target_accounting(targets, u.where("ord % 3 = 0"), targets.where("ord % 5 = 0"), "doc_id")


@plans.add(_ACCOUNT + " SELECT * FROM account")
def target_accounting(t):
    return _accounting(t)


@plans.add(_ACCOUNT + " SELECT doc_id, CASE WHEN bool_and(outcome <> 'claimed') THEN 'all_targets_failed' WHEN bool_or(outcome <> 'claimed') THEN 'partial_failure' ELSE 'complete' END AS state FROM account GROUP BY 1")
def audit_state(t):
    return C.audit_state(_accounting(t), "doc_id")


@plans.add(
    f"""WITH {_LINES}, b AS (SELECT r.doc_id, r.region, min(u.ord) AS first_unit, max(u.ord) AS last_unit, count(*) FILTER (u.kind = 'heading') AS headings FROM regions r JOIN units u ON u.doc_id = r.doc_id AND u.start < r."end" AND r.start < u."end" GROUP BY 1, 2)
SELECT * FROM b"""
)
def stage_context(t):
    regions = C.region_groups(_targets(t), "doc_id").withColumnRenamed("start", "a").withColumnRenamed("end", "b")
    both = regions.join(_units(t), "doc_id").where("start < b and a < end")
    return both.groupBy("doc_id", "region").agg(F.min("ord").alias("first_unit"), F.max("ord").alias("last_unit"), F.count_if(F.col("kind") == "heading").alias("headings"))


@plans.add("SELECT DISTINCT sha256('{\"model\":\"m1\",\"text\":\"' || event_type || user_id || '\"}') AS work_key FROM events WHERE user_id % 3 <> 0")
def request_keys(t):
    from ..functions.text import canonical

    prepared = t("events").select("user_id", F.sha2(canonical(model=F.lit("m1"), text=F.concat("event_type", "user_id")), 256).alias("work_key"))
    return C.pending_requests(prepared, prepared.where("user_id % 3 = 0")).select("work_key")


# Answers: a label by event type, its probability by the event's value; some calls fail, some answer with no JSON, a foreign label, or probabilities that don't add up.
_BODY = """CASE WHEN event_id % 31 = 4 THEN 'no json' WHEN event_id % 29 = 5 THEN concat('{"label":"', event_type, '"}')
  ELSE concat('{"label":"', event_type, '","probabilities":{"', event_type, '":', CASE WHEN value < 30 THEN '0.75' WHEN value < 60 THEN '0.5' ELSE '0.25' END, ',"click":', CASE WHEN event_id % 37 = 6 THEN '0.5' WHEN value < 30 THEN '0.25' WHEN value < 60 THEN '0.5' ELSE '0.75' END, '}}') END"""
_LABELS = ("click", "view", "purchase", "uncertain")


@plans.add(
    """WITH e AS (SELECT event_id, event_type, event_id % 31 = 4 AS broken, event_id % 29 = 5 AS bare, event_id % 37 = 6 AS off, CASE WHEN value < 30 THEN 0.75 WHEN value < 60 THEN 0.5 ELSE 0.25 END AS p, event_id % 23 = 3 AS failed, event_id % 23 = 7 AS unsure FROM events WHERE event_type <> 'click'),
f AS (SELECT *, CASE WHEN off THEN 0.5 ELSE 1 - p END AS q FROM e),
g AS (SELECT *, CASE WHEN unsure THEN 'outcome_uncertain' WHEN failed THEN 'rate_limited' WHEN broken THEN 'invalid_response' WHEN event_type NOT IN ('view', 'purchase') THEN 'label_not_allowed' WHEN bare THEN 'missing_probabilities'
  WHEN p + q <> 1 THEN 'invalid_probabilities' WHEN p < q THEN 'label_not_most_probable' END AS error FROM f)
SELECT event_id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS status, coalesce(error, '') AS error, CASE WHEN error IS NOT NULL THEN '' WHEN p = q THEN 'uncertain' ELSE event_type END AS label, coalesce(error = 'rate_limited', false) AS retryable FROM g"""
)
def response_records(t):
    e, n = t("events").where("event_type <> 'click'"), F.col("event_id")
    outcome = F.when(n % 23 == 3, "failed").when(n % 23 == 7, "outcome_uncertain").otherwise("answered")
    responses = e.select(n.cast("string").alias("work_key"), outcome.alias("outcome"), F.expr(_BODY).alias("body"), F.when(n % 23 == 3, "rate_limited").alias("error"))
    made = X.decision_records(responses, list(_LABELS))
    return made.select(F.col("work_key").cast("long").alias("event_id"), "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("label", F.lit("")).alias("label"), "retryable")


def _answer(request: str) -> str:
    """The injected sender of the query below: it answers by the user's number, or fails."""
    import json

    user = json.loads(request)["user"]
    if user % 10 == 7:
        raise TimeoutError(request)
    return json.dumps({"label": "odd" if user % 2 else "even", "probabilities": {"odd": float(user % 2), "even": float(1 - user % 2)}})


@plans.add(
    """SELECT event_type, user_id, CASE WHEN user_id % 10 = 7 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN user_id % 10 = 7 THEN 'TimeoutError' WHEN user_id % 2 = 1 THEN 'odd' ELSE 'even' END AS answer, count(*) AS requests, true AS replayed
FROM events GROUP BY 1, 2"""
)
def request_replay(t):
    """All requests are sent in a first run and replayed from their receipts in a second."""
    prepared = X.prepared_requests(t("events").select("user_id", "event_type"), "m1", user="user_id", task="event_type")
    ledger = X.FolderLedger(mounted_dir(prepared.sparkSession, "ledger"))
    materialise(X.dispatched(prepared, _answer, ledger), "responses")
    again = X.dispatched(prepared, _answer, ledger)
    records = X.decision_records(again, ["odd", "even"]).join(again.select("work_key", "replayed"), "work_key")
    asked = prepared.groupBy("work_key", "event_type", "user_id").agg(F.count("*").alias("requests"))
    return asked.join(records, "work_key").select("event_type", "user_id", "status", F.coalesce("label", "error").alias("answer"), "requests", "replayed")


@plans.add("SELECT event_id AS id, event_id + 100 AS input_id FROM events WHERE event_id + 100 NOT IN (SELECT event_id FROM events)")
def request_lineage(t):
    e = t("events").select(F.col("event_id").alias("id"), (F.col("event_id") + 100).alias("input_id"))
    return e.join(t("events").select(F.col("event_id").alias("input_id")), "input_id", "left_anti").select("id", "input_id")


# Citations: a page's url is its claim's reference; the host is a lookalike on every fourth.
_REF = "CASE WHEN page_id % 4 = 0 THEN replace(url, '.example.', '.example.com.evil.') ELSE url END"


def _routing(t):
    url = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit(".example."), F.lit(".example.com.evil."))).otherwise(F.col("url"))
    pages = t("pages").select("page_id", url.alias("url"), F.when(F.col("page_id") % 3 == 0, "incomplete").otherwise("available").alias("availability"))
    return C.citation_routing(pages.select("page_id", "availability"), pages.select("page_id", "url"), "page_id", "example.com")


_ROUTE = f"""r AS (SELECT page_id, CASE WHEN regexp_matches(regexp_extract(lower({_REF}), '^https?://([^/?#:]+)', 1), '(^|\\.)example\\.com$') THEN 1 ELSE 0 END::BIGINT AS cited FROM pages),
routing AS (SELECT page_id, CASE WHEN cited > 0 THEN 'yes' WHEN page_id % 3 = 0 THEN 'unclear' ELSE 'no' END AS status, cited FROM r)"""


@plans.add(f"WITH {_ROUTE} SELECT * FROM routing")
def citation_routing(t):
    return _routing(t)


@plans.add("SELECT screen, count(*) AS pairs FROM (SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 0 THEN 'dropped' ELSE 'kept' END AS screen FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def candidate_screening(t):
    decisions = t("labels").select("doc_id", F.when(F.col("quality") == 0, "clearly_irrelevant").otherwise("relevant").alias("label"))
    return C.screen_candidates(t("documents").select("doc_id"), decisions, "doc_id").groupBy("screen").agg(F.count("*").alias("pairs"))


@plans.add("SELECT source, count(*) AS excerpts, count(DISTINCT sha256(text)) AS groups FROM documents GROUP BY 1")
def duplicate_groups(t):
    return C.duplicate_groups(t("documents"), "source", "text")


_FINDING = f"""{_ROUTE}, f AS (SELECT page_id, status AS citation, CASE WHEN page_id % 13 = 0 THEN 'processing_failed' WHEN status = 'yes' THEN 'categorized' WHEN status = 'unclear' THEN 'citation_unclear' WHEN page_id % 7 = 0 THEN 'pending'
  WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'no_match_found' WHEN page_id % 5 = 0 THEN 'not_enough_evidence' WHEN page_id % 6 = 0 OR (page_id % 3 + 2 = 4 AND page_id % 4 <> 1) THEN 'not_enough_evidence' ELSE 'categorized' END AS status FROM routing),
finding AS (SELECT page_id, status, (CASE WHEN status <> 'categorized' THEN 0 WHEN citation = 'yes' THEN 1 ELSE page_id % 3 + 2 END)::BIGINT AS category FROM f)"""


def _findings(t):
    m = lambda n: F.col("page_id") % n
    rows = _routing(t).withColumnRenamed("status", "citation")
    status = C.finding(m(13) == 0, F.col("citation"), m(7) != 0, F.when(m(5) == 0, 0).otherwise(1), F.when(m(2) == 0, 0).otherwise(1), F.when(m(6) == 0, 0).otherwise(2), m(4) == 1, m(3) + 2)
    rows = rows.withColumn("status", status)
    return rows.select("page_id", "status", C.finding_category(F.col("status"), F.col("citation"), m(3) + 2).cast("long").alias("category"))


@plans.add(f"WITH {_FINDING} SELECT * FROM finding")
def finding_status(t):
    return _findings(t)


@plans.add(f"WITH {_FINDING} SELECT status, category, count(*) AS findings FROM finding GROUP BY 1, 2")
def finding_counts(t):
    return _findings(t).groupBy("status", "category").agg(F.count("*").alias("findings"))


def _attempts(t):
    e = t("events")
    return e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("-"), F.col("user_id")).alias("work_key"), F.floor(F.col("event_id") / 500).alias("attempt"), F.when(F.col("value") < 5, "succeeded").otherwise("failed").alias("status"), (F.col("value") > 100).alias("outcome_uncertain"))


@plans.add("WITH a AS (SELECT event_id AS id, event_type || '-' || user_id AS work_key, event_id // 500 AS attempt, CASE WHEN value < 5 THEN 'succeeded' ELSE 'failed' END AS status FROM events) SELECT work_key, id, attempt, status FROM (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY attempt DESC, id DESC) AS r FROM a) WHERE r = 1")
def latest_attempt(t):
    return C.latest_attempts(_attempts(t)).select("work_key", "id", "attempt", "status")


@plans.add("WITH a AS (SELECT event_type || '-' || user_id AS work_key, value FROM events) SELECT work_key FROM a GROUP BY 1 HAVING NOT bool_or(value < 5 OR value > 100)")
def pending_work(t):
    attempts = _attempts(t)
    return C.pending_work(attempts.select("work_key").distinct(), attempts)
