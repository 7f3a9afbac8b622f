"""The record and artifact store: lookups, snapshot pages, immutable upserts, content-addressed artifacts, integrity."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.raw import inflated


def lookup(requests: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """One row per request with the record's columns and a status; a missing record is ``not_found``, never an empty success."""
    found = records.withColumn("__found", F.lit(True))
    return requests.join(found, key, "left").withColumn("status", F.when(F.col("__found"), "succeeded").otherwise("not_found")).drop("__found")


def high_water(records: DataFrame, seq: str = "seq") -> DataFrame:
    """The largest sequence number, 0 of an empty store."""
    return records.agg(F.coalesce(F.max(seq), F.lit(0)).alias("max_seq"))


def write_cursor(store: str, kind: str | None, run: str | None, after: int, through: int) -> str:
    """An opaque cursor."""
    return base64.urlsafe_b64encode(json.dumps({"after": after, "kind": kind, "run": run, "store": store, "through": through}, sort_keys=True).encode()).decode()


def read_cursor(cursor: str, store: str, kind: str | None, run: str | None) -> tuple[int, int]:
    """(after, through) of a cursor; ``invalid_cursor`` where it is damaged, too long, or of another store or filter."""
    try:
        if len(cursor) > 8192:
            raise ValueError
        held = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if (held["store"], held["kind"], held["run"]) != (store, kind, run) or not 0 <= held["after"] <= held["through"]:
            raise ValueError
        return int(held["after"]), int(held["through"])
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid_cursor") from error


def page(records: DataFrame, limit: int, after: int = 0, through: int | None = None, kind: str | None = None, run: str | None = None) -> DataFrame:
    """Up to ``limit`` records after a position in sequence order; ``through`` hides what came after the first page.

    The position must be a record that fits the filter, else the cursor is ``invalid_cursor``; that is looked up at once, by one sequence number.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    rows = records
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if run is not None:
        rows = rows.where(F.col("analysis_run_id") == run)
    if after and not rows.where(F.col("seq") == after).select("seq").head(1):
        raise ValueError("invalid_cursor")
    rows = rows.where(F.col("seq") > after)
    if through is not None:
        rows = rows.where(F.col("seq") <= through)
    return rows.orderBy("seq").limit(limit)


def upsert_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, sha256, outcome, seq) per distinct incoming record: appended with the next seq, idempotent with the old one, or a conflict.

    Several incoming rows of one id with different bytes are conflicts among themselves.
    """
    distinct = incoming.groupBy("id").agg(F.min("sha256").alias("sha256"), F.countDistinct("sha256").alias("kinds"))
    both = distinct.join(existing.select("id", F.col("sha256").alias("held"), F.col("seq").alias("old")), "id", "left")
    outcome = F.when(F.col("kinds") > 1, "immutable_id_conflict").when(F.col("held").isNull(), "appended").when(F.col("held") == F.col("sha256"), "idempotent").otherwise("immutable_id_conflict")
    both = both.withColumn("outcome", outcome)
    new = both.where("outcome = 'appended'")
    # Numbers by ranges of ids: counts of each range, then places within it, so no single task sees all rows.
    ranged = new.select("id", F.substring(F.sha2("id", 256), 1, 2).alias("part"))
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("id"))).join(F.broadcast(starts), "part")  # at most 256 rows
    top = existing.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    given = numbered.crossJoin(F.broadcast(top)).select("id", (F.col("top") + F.col("start") + F.col("place")).alias("new"))  # top is one row
    return both.join(given, "id", "left").select("id", "sha256", "outcome", F.coalesce("new", "old", F.lit(0)).cast("long").alias("seq"))


def put_artifacts(payloads: DataFrame) -> DataFrame:
    """(access, sha256, content, status), one row per distinct access, digest and status: ``stored`` with the decoded content, or without it ``invalid_base64`` or ``artifact_hash_mismatch``.

    A digest that one payload has and another has not gives both rows; a null payload or digest is an error as well.
    """
    content = F.try_to_binary("content_base64", F.lit("base64"))
    status = F.when(content.isNull(), "invalid_base64").when(F.sha2(content, 256) == F.col("sha256"), "stored").otherwise("artifact_hash_mismatch")
    rows = payloads.select("access", "sha256", content.alias("content"), status.alias("status"))
    return rows.withColumn("content", F.when(F.col("status") == "stored", F.col("content"))).dropDuplicates(["access", "sha256", "status"])


def artifact_status(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per reference: succeeded, artifact_data_missing, storage_corrupt (length) or artifact_hash_mismatch."""
    held = payloads.select("sha256", F.col("content").alias("held"), F.col("byte_length").alias("stated"))
    status = F.when(F.col("held").isNull(), "artifact_data_missing").when(F.length("held") != F.col("stated"), "storage_corrupt").when(F.sha2("held", 256) != F.col("sha256"), "artifact_hash_mismatch").otherwise("succeeded")
    return refs.join(held, "sha256", "left").select("id", status.alias("status"))


def integrity_violations(records: DataFrame) -> DataFrame:
    """(id, code) where the stored hash is not that of the stored JSON, or an index column differs from the JSON's field."""
    j = lambda name: F.get_json_object("canonical_json", f"$.{name}")
    code = F.when(F.sha2("canonical_json", 256) != F.col("sha256"), "record_hash_mismatch").when(~j("id").eqNullSafe(F.col("id")), "record_id_mismatch").when(~j("kind").eqNullSafe(F.col("kind")), "record_kind_mismatch")
    return records.select("id", code.alias("code")).where("code is not null")


def strict_json(text: Column) -> Column:
    """ok, or invalid_json where the text is no JSON, repeats a key or goes on after its value."""
    # The parser stops at the first whole value; within brackets anything that follows is an error or a second element.
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(boxed.isNull() | F.try_variant_get(boxed, "$[0]", "variant").isNull() | F.try_variant_get(boxed, "$[1]", "variant").isNotNull(), "invalid_json").otherwise("ok")


def allowed_headers(headers: Column, names: tuple[str, ...]) -> Column:
    """The headers of an allow list, names in lower case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*names))


def response_receipts(responses: DataFrame, names: tuple[str, ...], limit: int) -> DataFrame:
    """What is kept of each response (key columns, headers, body, complete, error): headers of the allow list and the names of the others, the body's role, and whether the whole is complete.

    A body that is null, was cut off or is over the limit is never decoded: ``missing_body``, the response's own error or ``response_too_large``, and a ``partial-body``.  Any other is decoded within
    the limit: ``content`` of role ``raw-html`` or ``response-body``, with ``encoded`` (the body as received) where it was compressed.  A body that can't be decoded leaves its error and what was received.
    """
    kept = F.transform_keys(allowed_headers(F.col("headers"), names), lambda k, _: F.lower(k))
    lower = F.transform(F.map_keys("headers"), F.lower)
    rows = responses.withColumns({"__kept": kept, "__omitted": F.array_sort(F.array_distinct(F.filter(lower, lambda x: ~x.isin(*names))))})
    encoding = F.lower(F.trim(F.coalesce(F.col("__kept")["content-encoding"], F.lit(""))))
    media = F.lower(F.trim(F.split_part(F.coalesce(F.col("__kept")["content-type"], F.lit("")), F.lit(";"), F.lit(1))))
    cut = F.col("body").isNotNull() & (~F.coalesce("complete", F.lit(False)) | F.col("error").isNotNull() | (F.octet_length("body") > limit))
    rows = rows.withColumns({"__encoding": encoding, "__cut": cut})
    rows = rows.withColumn("__got", inflated(F.when(~F.col("__cut"), F.col("body")), F.col("__encoding"), limit))
    whole = F.col("body").isNotNull() & ~F.col("__cut") & (F.col("__got.status") == "ok")
    fault = F.when(F.col("body").isNull(), F.coalesce("error", F.lit("missing_body"))).when(F.col("__cut"), F.coalesce("error", F.when(F.octet_length("body") > limit, "response_too_large").otherwise("incomplete_body")))
    role = F.when(F.col("__cut"), "partial-body").when(~whole, None).when(media == "text/html", "raw-html").otherwise("response-body")
    keys = [c for c in responses.columns if c not in ("headers", "body", "complete", "error")]
    return rows.select(
        *keys, F.col("__kept").alias("headers"), F.col("__omitted").alias("omitted"), role.alias("role"), F.when(whole, F.col("__got.content")).when(F.col("__cut"), F.col("body")).alias("content"),
        F.when(~F.col("__cut") & ~F.col("__encoding").isin("", "identity"), F.col("body")).alias("encoded"), whole.alias("complete"), F.when(~whole, F.coalesce(fault, F.col("__got.status"))).alias("error"),
        F.octet_length("body").cast("long").alias("received"), F.when(whole, F.octet_length("__got.content")).cast("long").alias("decoded"),
    )


def registry_status(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Per wanted (name, version, sha256): ok, resource_missing or resource_hash_mismatch."""
    held = registry.select("name", "version", F.col("sha256").alias("held"))
    status = F.when(F.col("held").isNull(), "resource_missing").when(F.col("held") != F.col("sha256"), "resource_hash_mismatch").otherwise("ok")
    return wanted.join(held, ["name", "version"], "left").select("name", "version", status.alias("status"))
