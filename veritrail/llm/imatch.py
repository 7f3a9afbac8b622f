"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon holds the terms (words cut at white space and ASCII punctuation, A-Z lower-cased) whose document frequency lies in a band given by
parameters: a share of at least ``LEAST_SHARE`` and at most ``MOST_SHARE`` of all documents (an inverse document frequency between ln 5 and ln 100,000), and at least
``LEAST_DOCUMENTS``.  Frequencies count every document.  The band goes by shares, so it doesn't change with the corpus's size, and holds at most
(distinct terms per document) / LEAST_SHARE terms, a bound that doesn't grow.  What is broadcast is a cascade of Bloom filters that tells the band's terms from all others of
the corpus without error, 64 bits or more for each term of the band (2**32 bits at most, an error beyond; the bound of the band keeps below for up to 670 distinct terms per document on average).
Terms that only an edited text has, at the cut, are no terms of the corpus; of those less than one in a thousand passes.

A document keeps its distinct lexicon terms in sorted order.  Of the lexicon, ``HALVES`` random subsets hold half of the terms each, and for each number in ``PARTS`` the
lexicon is dealt at random to so many subsets more.  A signature is the hash of a document's sorted distinct terms of one subset, 0 where it has none.  Large subsets
tell whether texts are all but equal; small ones survive larger edits.  The likeness of two fingerprints is the largest share of equal signatures of any size of
subsets, over the subsets that either fills; equal fingerprints: 1.

Defined results: null and empty texts have an all-zero fingerprint; equal texts have equal fingerprints; a text
without any lexicon term uses all its terms instead.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .batches import slices
from .filters import cascade, member
from .words import Words, distinct, mix

MOST_SHARE = 0.2
LEAST_SHARE = 1e-5
LEAST_DOCUMENTS = 2
HALVES = 8
PARTS = (16, 64, 256)
_ROOT = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(column, terms=True)
    return distinct(w.hash, w.first)


def document_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each hashed term occurs; each task sums what it has read before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([terms, *waiting])
            weight = np.concatenate([counts, np.ones(sum(map(len, waiting)), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            waiting.clear()
            return every[edge], np.add.reduceat(weight, edge) if len(edge) else weight

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])

        for batch in slices(batches):
            waiting.append(_terms(batch.column(0))[0])
            size += len(waiting[-1])
            if size > 4_000_000:
                (terms, counts), size = settle(), 0
                if len(terms) > 4_000_000:  # bounded memory whatever the partition's size
                    yield rows()
                    terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        terms, counts = settle()
        yield rows()

    return documents.select(F.col(text).alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(documents: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS, share: float = MOST_SHARE, least_share: float = LEAST_SHARE, bits: int | None = None) -> list[np.ndarray]:
    """The band's terms as a cascade of filters; ``bits`` sets the size of the first."""
    counts = materialise(document_frequencies(documents, text), "terms")
    total = documents.count()
    inside = F.col("n").between(max(least, least_share * total), max(2.0, share * total))
    return cascade(counts.where(inside), counts.where(~inside), "term", bits)


def _hashed(terms: np.ndarray, subset: np.ndarray, number: int) -> np.ndarray:
    """The hash of the terms of each subset, in their order; ``subset`` doesn't fall, and subsets without terms have 0."""
    out = np.zeros(number, np.uint64)
    if len(terms):
        edge = np.flatnonzero(np.concatenate([[True], subset[1:] != subset[:-1]]))
        place = np.arange(len(terms)) - np.repeat(edge, np.diff(np.append(edge, len(terms))))
        power = np.full(int(place.max()) + 1, _STEP)
        power[0] = 1
        out[subset[edge]] = mix(np.add.reduceat(mix(terms) * np.multiply.accumulate(power)[place], edge)) | np.uint64(1)
    return out


def fingerprints(column: pa.Array, band: list[np.ndarray]) -> np.ndarray:
    """Two bytes per text and subset: the halves, then the parts of each number."""
    terms, begin = _terms(column)
    n = len(begin) - 1
    owner = np.repeat(np.arange(n), np.diff(begin))
    kept = member(terms, band)
    kept |= (np.bincount(owner[kept], minlength=n) == 0)[owner]
    terms, owner = terms[kept], owner[kept]
    halves, signs = mix(terms ^ np.uint64(_ROOT)), []
    for i in range(HALVES):
        ok = (halves >> np.uint64(i) & np.uint64(1)).astype(bool)
        signs.append(_hashed(terms[ok], owner[ok], n).reshape(n, 1))
    for level, parts in enumerate(PARTS):
        part = (mix(terms ^ np.uint64((level + 2) * _ROOT & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(20)) % np.uint64(parts)
        subset = owner * parts + part.astype(np.int64)
        order = np.argsort(subset, kind="stable")
        signs.append(_hashed(terms[order], subset[order], n * parts).reshape(n, parts))
    every = np.concatenate(signs, axis=1)
    folded = (mix(every) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    folded[every == 0] = 0
    return folded


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 per row of two stacks of fingerprints; sizes with under four filled subsets count as four."""
    out, at = np.zeros(len(a)), 0
    for size in (HALVES, *PARTS):
        x, y = a[:, at : at + size], b[:, at : at + size]
        filled = ((x > 0) | (y > 0)).sum(1)
        out = np.maximum(out, ((x == y) & (x > 0)).sum(1) / np.maximum(4, filled))
        at += size
    out[(a == b).all(1)] = 1.0
    return out


def fingerprint_columns(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the key and its ``fingerprint`` in hex."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon(documents, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprints(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in found], pa.string())], names=[key, "fingerprint"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text whose last floor(n / 2) code points are replaced by the first as many (or all) of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(documents: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """Rows (place, key, halo, blob) in ranges of the key, each range followed by the first document of the next.

    Ranges come from approximate quantiles of the key; only their bounds and first keys, one per range, reach the driver.  The last range is followed by
    the first document of all.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(key).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 2 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts)))
    place = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(int(b)) for b in bounds])
        place = F.size(F.filter(edges, lambda b: b <= F.col("key")))
    firsts = {r["place"]: r["first"] for r in rows.select(place.alias("place"), "key").groupBy("place").agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array([int(b) for b in bounds], np.int64)
        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            blobs = [zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()]
            where = np.searchsorted(cut, keys, side="right")
            halo = [i for i, k in enumerate(keys.tolist()) if k in before]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([where, [before[int(keys[i])] for i in halo]]).astype(np.int32)), pa.array(np.concatenate([keys, keys[halo]])), pa.array([*batch.column(1).to_pylist(), *batch.column(1).take(pa.array(halo, pa.int64())).to_pylist()], pa.bool_()), pa.array([False] * len(keys) + [True] * len(halo)), pa.array(blobs + [blobs[i] for i in halo], pa.binary())],
                names=["place", "key", "none", "halo", "blob"],
            )

    packed = rows.mapInArrow(pack, "place int, key long, none boolean, halo boolean, blob binary")
    return packed.repartition(2 * parts, "place").sortWithinPartitions("place", "halo", "key", F.desc("none"), "blob"), len(order)


def edit_columns(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to the edited text and to the next document.

    The next document is the next by key (null first), rows of one key in an order fixed by their text's compressed bytes; the last is followed by the first.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon(documents, text))
    rows, _ = in_order(documents, text, key)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(held: list[tuple]) -> pa.RecordBatch:
        texts = [t for *_, t in held]
        other = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        n = len(other)
        found = fingerprints(pa.array([*texts, *other], pa.large_string()), shared.value)
        own, after, changed = found[:n], found[1 : n + 1], found[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if none else k for _, k, none, _, _ in held[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other], pa.string()),
                pa.array([x.tobytes().hex() for x in own], pa.string()),
                pa.array([x.tobytes().hex() for x in changed], pa.string()),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, after)),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range; the last is kept as the first of what follows
        size = 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (*row[:2], row[2], row[3], zlib.decompress(row[4]).decode())
                if held and (row[0] != held[-1][0] or held[-1][3]):
                    if len(held) > 1:
                        yield finish(held)
                    held, size = ([] if row[0] != held[-1][0] else held[-1:]), 0
                if row[3] and held and held[-1][3]:
                    continue  # only the first document of the next range counts
                held.append(row)
                size += len(row[4])
                if size > 2 << 20 and len(held) > 1:
                    yield finish(held)
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield finish(held)

    return rows.mapInArrow(run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
