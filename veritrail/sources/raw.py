"""Byte-level sources: bounded content decoding, charset rules, robots rules and file fingerprints."""

from __future__ import annotations

import codecs
import re
import urllib.robotparser
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARSETS = ("utf-8", "utf8", "iso-8859-1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii")
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def inflate(data: bytes, encoding: str, limit: int) -> tuple[bytes | None, str]:
    """Undo gzip or deflate within a size limit; trailing data, truncation and other encodings are errors."""
    if encoding in ("", "identity"):
        return (data, "ok") if len(data) <= limit else (None, "body_too_large")
    if encoding not in ("gzip", "deflate"):
        return None, "unsupported_encoding"
    tool = zlib.decompressobj(31 if encoding == "gzip" else 15)
    try:
        out = tool.decompress(data, limit + 1)
    except zlib.error:
        return None, "decode_failed"
    if len(out) > limit:
        return None, "body_too_large"
    if not tool.eof:
        return None, "truncated_body"
    return (None, "trailing_data") if tool.unused_data else (out, "ok")


def inflated(data: Column, encoding: Column, limit: int) -> Column:
    """(content, status) of transported bytes, inflated within the limit."""

    def run(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        rows = [inflate(bytes(body), enc or "", limit) if body is not None else (None, "missing_body") for body, enc in zip(bodies, encodings, strict=True)]
        return pd.DataFrame(rows, columns=["content", "status"])

    return F.pandas_udf(run, T.StructType([T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())]))(data, encoding)


def decode_html(data: bytes, declared: str | None) -> tuple[str | None, str]:
    """Charset by BOM, then HTTP header, then meta element, then UTF-8; conflicts, unknown charsets and bad bytes are errors."""
    bom = next((name for mark, name in _BOMS if data.startswith(mark)), None)
    if bom == "utf-16":
        return None, "unsupported_charset"
    meta = re.search(rb"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)""", data[:2048], re.IGNORECASE)
    named = [x.lower() for x in (bom, declared, meta[1].decode() if meta else None) if x]
    if any(x not in CHARSETS for x in named):
        return None, "unsupported_charset"
    if len({codecs.lookup(x).name for x in named}) > 1:
        return None, "charset_conflict"
    try:
        return data.decode("utf-8-sig" if bom else (named or ["utf-8"])[0]), "ok"
    except UnicodeDecodeError:
        return None, "invalid_bytes"


def bounded_decode(data: Column, encoding: Column, declared: Column, limit: int) -> Column:
    """(text, status) of transported page bytes: inflate within the limit, then decode strictly."""

    def run(bodies: pd.Series, encodings: pd.Series, charsets: pd.Series) -> pd.DataFrame:
        rows = []
        for body, enc, cs in zip(bodies, encodings, charsets, strict=True):
            raw, status = inflate(bytes(body), enc or "", limit) if body is not None else (None, "missing_body")
            rows.append((None, status) if raw is None else decode_html(raw, cs))
        return pd.DataFrame(rows, columns=["text", "status"])

    return F.pandas_udf(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())]))(data, encoding, declared)


def robots(body: Column, status: Column, agent: str, url: Column, spacing: float) -> Column:
    """(allowed, delay): 404 and 410 allow all; crawl-delay and request-rate lengthen the spacing; rates that can't be read forbid."""

    def run(bodies: pd.Series, statuses: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = []
        for text, code, where in zip(bodies, statuses, urls, strict=True):
            if code in (404, 410):
                rows.append((True, spacing))
                continue
            lines = (text or "").splitlines()
            odd = any(re.match(r"(?i)\s*crawl-delay\s*:", x) and not re.fullmatch(r"(?i)\s*crawl-delay\s*:\s*\d+(\.0+)?\s*(#.*)?", x) or re.match(r"(?i)\s*request-rate\s*:", x) and not re.fullmatch(r"(?i)\s*request-rate\s*:\s*\d+/\d+\s*(#.*)?", x) for x in lines)
            if code != 200 or odd:
                rows.append((False, spacing))
                continue
            rules = urllib.robotparser.RobotFileParser()
            rules.parse(lines)
            rate = rules.request_rate(agent)
            rows.append((rules.can_fetch(agent, where), float(max(spacing, rules.crawl_delay(agent) or 0, rate.seconds / rate.requests if rate and rate.requests else 0))))
        return pd.DataFrame(rows, columns=["allowed", "delay"])

    return F.pandas_udf(run, T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("delay", T.DoubleType())]))(body, status, url)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path: its name, length and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"), F.sha2("content", 256).alias("sha256"))
