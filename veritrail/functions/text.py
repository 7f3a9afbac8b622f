"""Scalar text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical token pattern: units, words with digits and marks, numbers, comparison signs.  A fixed value.
TOKEN = r"mmol/l|mg/dl|[0-9]*[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*|[0-9]+(?:[.,][0-9]+)*|<=|>=|[<>≤≥%]"
PIECE = 1024  # code points of a piece of a text
QUERY_TEMPLATE = "Instruct: Given a claim, retrieve passages that support or refute the claim\nQuery: "


# Every character that composition can change or join to the one before: marks, Hangul letters, and ranges around the characters with a canonical equivalent.
COMPOSABLE = (
    r"[\p{M}\u0340-\u0345\u0374\u037E\u0387\u0958-\u0FFF\u1100-\u11FF\u1F00-\u2001\u2126-\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4F"
    r"\x{11000}-\x{16FFF}\x{1D100}-\x{1D1FF}\x{2F800}-\x{2FA1F}]"
)


def nfc(text: Column) -> Column:
    """The text in normal form C.  Only texts with a character that composition may change go through Python; of all others a null does."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(F.pandas_udf(run, "string")(F.when(F.rlike(text, F.lit(COMPOSABLE)), text)), text)


def tokens(text: Column) -> Column:
    """Lower-cased lexical tokens in text order; no stemming, no stop words.  A null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def code_point_slice(text: Column, start: Column, end: Column) -> Column:
    """The half-open range [start, end) in code points."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def pieces(text: Column) -> Column:
    """The text as an array of ``PIECE`` code points each (the last has the rest), from which spans are cut without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def slice_of_pieces(cut: Column, start: Column, end: Column) -> Column:
    """``code_point_slice`` of a text in pieces, for a start of 0 or more: only the pieces that the span touches are read."""
    first = F.floor(start / PIECE).cast("int")
    touched = F.slice(cut, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
    return code_point_slice(F.array_join(touched, ""), start - first * PIECE, end - first * PIECE)


def canonical(**fields: Column) -> Column:
    """Canonical JSON of the fields: sorted keys, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def identity(role: str, **fields: Column) -> Column:
    """A content-derived id: the role and the SHA-256 of the fields' canonical JSON."""
    return F.concat(F.lit(role + "-"), F.sha2(canonical(**fields), 256))


def trimmed_span(text: Column) -> tuple[Column, Column]:
    """Start and end of the text without surrounding white space, in code points."""
    start = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    end = F.length(F.regexp_replace(text, r"\s+$", ""))
    return start, F.greatest(start, end)


def document_text(headings: Column, passage: Column) -> Column:
    """Dense representation of a passage: its headings by line, an empty line, the passage; without headings the passage alone."""
    return F.when(F.size(headings) > 0, F.concat(F.array_join(headings, "\n"), F.lit("\n\n"), passage)).otherwise(passage)


def query_text(claim: Column) -> Column:
    """Dense representation of a claim."""
    return F.concat(F.lit(QUERY_TEMPLATE), claim)


def host_of(url: Column) -> Column:
    """Lower-cased host of an http(s) url, null where it is malformed."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1), F.lit("")))


def host_matches(host: Column, domain: str) -> Column:
    """The domain or one of its subdomains; lookalikes that only end in the same letters do not match."""
    return F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False))
