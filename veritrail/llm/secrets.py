"""Secret scans with structural confirmation.

Base kinds are plain patterns (assign, access, hex).  The method adds spans only where decoding proves a structure:

* ``jwt``: three base64url parts, the first a JSON object with a string ``alg``, and either the second a JSON object or, as payloads
  may be any bytes, the third a signature of the length that ``alg`` gives;
* ``key``: base64 or hex that decodes to a private key: PKCS#1, PKCS#8 (with the key inside its octet string, by its algorithm) or SEC1 in DER with
  every nested length exact, or the OpenSSH container with its magic and every length field consistent;
* ``pem``: an armoured private key, from the last begin line before its end line, whose body decodes as above.

Offsets are code points with an exclusive end.  Defined results: null or empty text has no spans; texts are scanned whole, each on its own.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

KINDS = ("assign", "access", "hex", "jwt", "key", "pem")
MASK = "[SECRET]"

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,-]*")
# Signature bytes by algorithm: fixed values; RSA's are those of a key of 1024 bits or more.
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
# Object identifiers of key algorithms in DER: fixed values.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{47,}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]{40,})={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")


def unbase64(text: str) -> bytes | None:
    """Decode base64 or base64url with or without padding; None where it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if not body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, object]] | None:
    """The (tag, content) list in data[at:end], sequences as nested lists; None unless all lengths fit exactly and are minimal."""
    end = len(data) if end is None else end
    out: list[tuple[int, object]] = []
    while at < end:
        if at + 2 > end or depth > 8:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 128 or n >> 8 * (k - 1) == 0:
                return None
        if at + n > end:
            return None
        if tag in (0x30, 0xA0, 0xA1):
            inner = der(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def _ssh(data: bytes) -> bool:
    """The OpenSSH private key container: cipher, kdf, options, key count, public keys, one private block, nothing after."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        if n < 0 or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= count <= 16 and all(string() is not None for _ in range(count)) and bool(string()) and at == len(data)


def private_key(data: bytes | None) -> bool:
    """Whether the bytes are one private key in a known encoding."""
    if not data:
        return False
    if data[0] != 0x30:
        return _ssh(data)
    top = der(data)
    if not top or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [tag for tag, _ in parts]
    if tags[:1] != [0x02] or parts[0][1] not in (b"\0", b"\1"):
        encrypted = tags == [0x30, 0x04] and parts[0][1][:1] and parts[0][1][0][0] == 0x06
        return bool(encrypted)  # an encrypted PKCS#8 key
    if _pkcs1(parts):
        return True
    if tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return bool(parts[1][1]) and parts[1][1][0][0] == 0x06 and _inner(parts[1][1][0][1], parts[2][1])
    return _sec1(parts)


def _pkcs1(parts: list[tuple[int, object]]) -> bool:
    """An RSA key's nine integers, or the six of DSA's older form."""
    return len(parts) in (6, 9) and all(t == 0x02 and v for t, v in parts) and parts[0][1] in (b"\0", b"\1")


def _sec1(parts: list[tuple[int, object]]) -> bool:
    """Version 1, the key's octets, and the curve and public key if any."""
    return len(parts) >= 2 and parts[0] == (0x02, b"\1") and parts[1][0] == 0x04 and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t, _ in parts[2:])


def _inner(algorithm: bytes, octets: bytes) -> bool:
    """Whether PKCS#8's octet string holds one key of the algorithm it names."""
    found = der(octets)
    if not found or len(found) != 1:
        return False
    tag, content = found[0]
    if algorithm == _RSA:
        return tag == 0x30 and _pkcs1(content)
    if algorithm == _EC:
        return tag == 0x30 and _sec1(content)
    if algorithm in _CURVES:
        return tag == 0x04 and len(content) == _CURVES[algorithm]
    return tag in (0x02, 0x04, 0x30) and bool(content)  # others hold one integer, string or sequence


def _armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of each end line with the begin line right before it, in one pass."""
    begun = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "END" and begun is not None and begun[2] == m[2]:
            body = text[begun.end() : m.start()]
            if _BODY.fullmatch(body):
                yield begun.start(), m.end(), body
        begun = m if m[1] == "BEGIN" else None


def _signed(head: dict, payload: str, signature: str) -> bool:
    """Whether the parts after a token's header fit it."""
    if _object(payload) is not None:
        return True
    alg, sign = head["alg"], unbase64(signature)
    if unbase64(payload) is None or sign is None:
        return False
    return len(sign) == _SIGNED[alg] if alg in _SIGNED else alg[:2] in ("RS", "PS") and len(sign) >= 128


def _object(part: str) -> dict | None:
    raw = unbase64(part)
    if not raw or raw[:1] != b"{":
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded structure confirms a token or key."""
    out = []
    if "ey" in text or "ew" in text:  # a brace and what may follow it
        for m in _JWT.finditer(text):
            head = _object(m[1])
            if head is not None and isinstance(head.get("alg"), str) and _signed(head, m[2], m[3]):
                out.append((m.start(), 3, m.end()))
    if "PRIVATE KEY-----" in text:
        for start, end, body in _armoured(text):
            lines = body.replace("\\n", "\n").split("\n")
            if private_key(unbase64("".join(re.sub(r"\s", "", x) for x in lines if ":" not in x))):
                out.append((start, 5, end))
    armoured = deque((a, b) for a, kind, b in out if kind == 5)
    for m in _BASE64.finditer(text):
        while armoured and armoured[0][1] <= m.start():
            armoured.popleft()
        if not (armoured and armoured[0][0] <= m.start()) and private_key(unbase64(m[0])):
            out.append((m.start(), 4, m.end()))
    for m in _HEXKEY.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0])):
            out.append((m.start(), 4, m.end()))
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    """All spans by start, then kind as listed in KINDS."""
    return sorted(base_spans(text) + added_spans(text))


def redact(text: str) -> tuple[str, int]:
    """The text with each run of overlapping spans replaced by a mask, and the number of masks."""
    out, at, n = [], 0, 0
    for start, _, end in spans(text):
        if start >= at or n == 0:
            out += [text[at:start], MASK]
            n += 1
            at = end
        else:
            at = max(at, end)
    return ("".join(out) + text[at:], n) if n else (text, 0)


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secret_columns(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the counts of the base kinds, the SHA-256 of the base spans' list and all spans as a list in text form."""
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for value in batch.column(1).to_pylist():
                base = base_spans(value) if value else []
                more = added_spans(value) if value else []
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + more)), len(more)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return documents.select(key, text).mapInArrow(run, schema)


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced by a mask; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            column = pa.array([v if v is None else redact(v)[0] for v in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)


def explode_spans(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per span from ``secret_columns``: the key, kind, start and end."""
    each = scanned.where(F.col("spans") != "").select(key, F.explode(F.split("spans", ",")).alias("one"))
    parts = each.select(key, F.split("one", ":").alias("part"))
    return parts.select(key, F.col("part")[0].alias("kind"), F.col("part")[1].cast("long").alias("start"), F.col("part")[2].cast("long").alias("end"))
