"""Bloom filters over 64-bit keys, aggregated on executors and looked up in numpy; cascades of them that make no mistake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

BITS = 1 << 27
TASKS = 16  # each task sends a filter of its own, so few tasks build it: what they send doesn't grow with the rows


def bits_for(n: int, least: int = 20, most: int = 32, spare: int = 64) -> int:
    """How many bits keep the share of others that pass under one in a thousand: a power of two, ``spare`` for each of n keys; more than 2**``most`` is an error."""
    found = max(least, (spare * max(1, n) - 1).bit_length())
    if found > most:
        raise ValueError(f"{n} keys need a filter of 2**{found} bits; the most is 2**{most}")
    return 1 << found


def bloom(rows: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """The filter over a column of well mixed longs, ``bits`` / 8 bytes whatever it holds: two bits for each key, from its low and its high half."""
    mask = F.lit(bits - 1)
    at = rows.coalesce(TASKS).select(F.explode(F.array(F.col(key).bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))).alias("bit"))
    maps = at.groupBy(F.shiftright("bit", 15).alias("of")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(1 << 15))).alias("map")).toArrow()
    out = np.zeros(bits // 8, np.uint8).reshape(-1, 4096)
    for of, found in zip(maps["of"].to_pylist(), maps["map"], strict=True):
        out[of] = np.frombuffer(found.as_py(), np.uint8)
    return out.reshape(-1)


def hit(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through: all that it was built from, of others a share of (1 - exp(-2 n / bits))**2 for n keys in it."""
    mask = np.uint64(len(known) * 8 - 1)
    one, two = ((known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in (keys & mask, (keys >> np.uint64(32)) & mask))
    return (one & two).astype(bool)


def cascade(inside: DataFrame, outside: DataFrame, key: str, bits: int | None = None) -> list[np.ndarray]:
    """Filters that tell two known sets of keys apart without error: the first is over the inside, the next over those of the outside that pass it, the next over those of
    the inside that pass that one, and so on until none passes by mistake.  ``bits`` sets the first filter's size; by default it goes by the number of keys.
    """
    levels: list[np.ndarray] = []
    own, other = inside.select(key), outside.select(key)
    while True:
        n = own.count()
        if not n:
            return levels
        size = bits if bits and not levels else bits_for(n, least=15)
        levels.append(bloom(own, key, size))
        own, other = _passing(other, key, levels[-1]), own


def _passing(rows: DataFrame, key: str, known: np.ndarray) -> DataFrame:
    """The rows whose key passes a filter, written as a table."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), shared.value)))

    return materialise(rows.mapInArrow(run, f"`{key}` long"), "passing")


def member(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Which keys a cascade counts as inside; exact for keys of both of its sets, others pass like those of the outside would before the second filter."""
    found = np.zeros(len(keys), bool)
    asked = np.arange(len(keys))
    for level, known in enumerate(levels):
        asked = asked[hit(keys[asked], known)]
        found[asked] = level % 2 == 0
    return found
