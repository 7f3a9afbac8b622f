"""Embedding with an injected encoder behind a gate: no text is encoded before every text has passed the preflight, none is cut, and no faulty vector gets through."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

BATCH_TOKENS = 16_384


class Encoder(Protocol):
    """What tasks get by pickling: a tokenizer's lengths and a model's vectors."""

    max_tokens: int
    dimensions: int

    def lengths(self, texts: list[str]) -> list[int]: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


def preflight(texts: DataFrame, encoder: Encoder, key: str, text: str) -> DataFrame:
    """(key, text, tokens, code): the length of each text in the encoder's tokens; ``empty_text``, ``text_too_long``, or null where it may be encoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = frame[text].notna() & (frame[text] != "")
            frame["tokens"] = 0
            if known.any():
                frame.loc[known, "tokens"] = encoder.lengths(frame.loc[known, text].tolist())
            yield frame

    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, `{text}` string, tokens int"
    counted = texts.select(key, text).mapInPandas(run, schema)
    return counted.withColumn("code", F.when(F.col("tokens") < 1, "empty_text").when(F.col("tokens") > encoder.max_tokens, "text_too_long"))


def batches(tokens: list[int], budget: int) -> list[slice]:
    """Runs of texts, in order of length, whose number times their longest stays within the budget; a text alone may exceed it."""
    out, start, longest = [], 0, 0
    for i, n in enumerate(tokens):
        if i > start and max(longest, n) * (i - start + 1) > budget:
            out.append(slice(start, i))
            start, longest = i, 0
        longest = max(longest, n)
    return [*out, slice(start, len(tokens))] if tokens else out


def checked(vectors: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The vectors, if they are as many and as long as they must be, finite, and not zero."""
    vectors = np.asarray(vectors, np.float64)
    if vectors.shape != (n, dimensions):
        raise ValueError(f"invalid_vectors: shape {vectors.shape}, not {(n, dimensions)}")
    if not np.isfinite(vectors).all() or not (np.abs(vectors).max(axis=1, initial=0) > 0).all():
        raise ValueError("invalid_vectors: not finite, or zero")
    return vectors


def embedded(texts: DataFrame, encoder: Encoder, key: str, text: str, budget: int = BATCH_TOKENS) -> DataFrame:
    """(key, tokens, vector) of every text, or an error that names how many texts fail the preflight and why.

    Lengths are written as a table first, in parts dealt by hash and sorted by length, so that a batch holds texts of like length and a lost task encodes its part again and no
    other; one aggregate over it is the gate.  Keys may repeat.
    """
    dealt = preflight(texts, encoder, key, text).repartition(F.xxhash64(key, text)).sortWithinPartitions("tokens")
    counted = materialise(dealt, "preflight")
    faults = {r.code: r.n for r in counted.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
    if faults:
        raise ValueError("preflight: " + ", ".join(f"{code} {n}" for code, n in sorted(faults.items())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("tokens", kind="stable")
            said, lengths = frame[text].tolist(), frame["tokens"].tolist()
            vectors = [checked(encoder.encode(said[part]), part.stop - part.start, encoder.dimensions) for part in batches(lengths, budget)]
            yield pd.DataFrame({key: frame[key].to_numpy(), "tokens": lengths, "vector": [v for rows in vectors for v in rows.tolist()]})

    return counted.select(key, text, "tokens").mapInPandas(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, tokens int, vector array<double>")
