"""Predicates, projections and guards over records, model answers and transport results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status classes and error codes: fixed values.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def valid_url(url: Column) -> Column:
    """An http or https url with a host and no white space."""
    return F.coalesce(url.rlike(r"^https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def available(status: Column, data: Column) -> Column:
    """The data where it is available; incomplete and unavailable data are null, never empty."""
    return F.when(status == "available", data)


def integer(text: Column) -> Column:
    """A strict JSON integer; booleans, floats and strings are null."""
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]*)$"), text.cast("long"))


def money(text: Column) -> Column:
    """A finite JSON number of 0 or more."""
    value = F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.cast("double"))
    return F.when((value >= 0) & (value < float("inf")), value)


def status_error(status: Column) -> Column:
    """The error code of a transport status, null for success."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status == 401, "authentication").when(status == 402, "payment_required").when(status == 403, "forbidden").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status.isin(408, 504), "timeout").when(status >= 500, "provider_unavailable").otherwise("provider_rejected")


def retryable(status: Column) -> Column:
    """Whether a failed request may be sent again."""
    return status.isin(*RETRYABLE)


def cost_agrees(a: Column, b: Column, ceiling: float) -> Column:
    """Two stated costs are equal within 1e-9 and neither is above the ceiling."""
    return (F.greatest(a, b) <= ceiling) & (F.abs(a - b) <= 1e-9)


def usage_cost(fresh: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Estimated cost from token counts and prices per million; unknown counts give an unknown cost, never 0."""
    return (fresh * prices[0] + cached * prices[1] + output * prices[2]) / 1e6


def decision_code(label: Column, allowed: Column, probabilities: Column) -> Column:
    """Why a decision is invalid, or null: label not allowed, odd probabilities, incomplete or unnormalised, label not the largest."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(~F.array_contains(allowed, label), "label_not_allowed")
        .when(F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)), "invalid_probability")
        .when(F.size(F.array_except(allowed, F.map_keys(probabilities))) > 0, "incomplete_distribution")
        .when(F.abs(total - 1) > 1e-6, "probabilities_not_normalised")
        .when(F.element_at(probabilities, label) < F.array_max(values), "label_not_maximal")
    )


def tie_label(probabilities: Column) -> Column:
    """The label of the largest probability; ``uncertain`` where several share it."""
    top = F.array_max(F.map_values(probabilities))
    best = F.map_keys(F.map_filter(probabilities, lambda k, v: v == top))
    return F.when(F.size(best) == 1, best[0]).otherwise("uncertain")


def schema_check(value: object, schema: dict) -> str | None:
    """The first violation of a JSON Schema subset (type, enum, required, properties, additionalProperties, items, minLength, minItems), or null."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return "type"
    if "enum" in schema and value not in schema["enum"]:
        return "enum"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return "minLength"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return "minItems"
        return next((x for v in value if (x := schema_check(v, schema.get("items", {})))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if set(schema.get("required", [])) - set(value):
            return "required"
        if schema.get("additionalProperties") is False and set(value) - set(known):
            return "additionalProperties"
        return next((x for k, v in value.items() if k in known and (x := schema_check(v, known[k]))), None)
    return None


def generation_status(answer: Column, schema: dict) -> Column:
    """ok, invalid_json, or the violated keyword of a structured model answer."""

    def run(answers: pd.Series) -> pd.Series:
        out = []
        for text in answers:
            try:
                out.append(schema_check(json.loads(text, parse_constant=lambda c: 1 / 0), schema) or "ok")
            except (ValueError, TypeError, ZeroDivisionError):
                out.append("invalid_json")
        return pd.Series(out)

    return F.pandas_udf(run, T.StringType())(answer)


def record_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for every rule, a condition that must hold, that a row breaks; an unknown condition counts as broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return rows.select(key, F.explode(codes).alias("code"))


#: Keywords that structured decoders enforce while they generate; the others are checked afterwards.
GUIDED = ("type", "enum", "required", "properties", "additionalProperties", "items")


def guided_schema(schema: dict) -> dict:
    """The part of a JSON Schema a structured decoder can enforce; the full schema still judges the answer."""
    out = {k: v for k, v in schema.items() if k in GUIDED}
    if "properties" in out:
        out["properties"] = {k: guided_schema(v) for k, v in out["properties"].items()}
    if "items" in out:
        out["items"] = guided_schema(out["items"])
    return out


def version_mismatches(pins: dict[str, str]) -> list[tuple[str, str, str]]:
    """(package, pinned, found) of every package that is missing or of another version; a driver-side preflight."""
    from importlib import metadata

    found = {}
    for name in pins:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = ""
    return [(name, version, found[name]) for name, version in pins.items() if found[name] != version]
