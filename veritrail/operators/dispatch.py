"""Model requests with intents: each work key is sent at most once, whatever task, attempt or run it is in, and a repeated run replays what was answered.

A request's *work key* is the hash of all that determines its answer.  Before a task sends a request it *claims* the key in a ledger, atomically; after the answer it stores the
*receipt*.  A key with a receipt is replayed.  A key that was claimed without one was perhaps sent by a task that was lost since: it is ``outcome_uncertain`` and not sent again.
So a task that Spark runs again, a speculative copy, and a whole second run all send nothing twice.

The ledger is an object that tasks get by pickling; it needs three methods, ``claim(key) -> bool`` (true for the first caller only), ``receipt(key) -> bytes | None`` and
``store(key, receipt)``.  :class:`FolderLedger` keeps it in a folder mounted on all machines, by exclusive creation of files; an object store or database with conditional
writes serves as well.  The sending function is given too; no model is part of this library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical

RESPONSE = "work_key string, outcome string, body string, error string, replayed boolean"


class Ledger(Protocol):
    """Where intents and receipts are kept."""

    def claim(self, key: str) -> bool: ...

    def receipt(self, key: str) -> bytes | None: ...

    def store(self, key: str, receipt: bytes) -> None: ...


@dataclass(frozen=True)
class FolderLedger:
    """A ledger in a folder that all machines mount: an intent is a file that only one caller can create, a receipt one that appears whole."""

    folder: str

    def _path(self, key: str, what: str) -> Path:
        return Path(self.folder, key[:2], f"{key}.{what}")

    def claim(self, key: str) -> bool:
        path = self._path(key, "intent")
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def receipt(self, key: str) -> bytes | None:
        try:
            return self._path(key, "receipt").read_bytes()
        except FileNotFoundError:
            return None

    def store(self, key: str, receipt: bytes) -> None:
        path = self._path(key, "receipt")
        part = path.with_suffix(f".{os.getpid()}.part")
        part.write_bytes(receipt)
        part.rename(path)


def prepared_requests(rows: DataFrame, model: str, **fields: str) -> DataFrame:
    """(work_key, request, plus the input's columns): the canonical request and its hash; rows that ask for the same share a key."""
    request = canonical(model=F.lit(model), **{name: F.col(column) for name, column in fields.items()})
    return rows.withColumn("request", request).withColumn("work_key", F.sha2("request", 256))


def dispatched(requests: DataFrame, send: Callable[[str], str], ledger: Ledger) -> DataFrame:
    """(work_key, outcome, body, error, replayed), one row per work key of ``requests`` (work_key, request).

    Outcomes: ``answered``; ``failed`` with the error's name, where the sender raised, also kept as the receipt so that it is not sent again; ``outcome_uncertain``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, request in zip(frame["work_key"], frame["request"], strict=True):
                held = ledger.receipt(key)
                if held is None and ledger.claim(key):
                    try:
                        made = {"outcome": "answered", "body": send(request), "error": None}
                    except Exception as e:  # whatever the sender raises is the request's outcome
                        made = {"outcome": "failed", "body": None, "error": type(e).__name__}
                    ledger.store(key, json.dumps(made).encode())
                    out.append((key, *made.values(), False))
                    continue
                held = held or ledger.receipt(key)  # another task may have answered meanwhile
                made = {"outcome": "outcome_uncertain", "body": None, "error": "uncertain"} if held is None else json.loads(held)
                out.append((key, *made.values(), held is not None))
            yield pd.DataFrame(out, columns=["work_key", "outcome", "body", "error", "replayed"])

    return requests.select("work_key", "request").dropDuplicates(["work_key"]).mapInPandas(run, RESPONSE)


#: Names of errors after which the same request may be sent again under a new key.
RETRYABLE = ("rate_limited", "transport_error", "TimeoutError", "ConnectionError")
ANSWER = "label string, probabilities map<string,double>, usage struct<input_tokens:bigint,output_tokens:bigint>"


def decision_records(responses: DataFrame, labels: list[str]) -> DataFrame:
    """Responses as decisions: (work_key, status, label, probability, error, retryable), the first fault in a fixed order.

    A tie for the greatest probability is ``uncertain`` where that label is allowed, else a fault.
    """
    parsed = responses.withColumn("a", F.from_json("body", ANSWER))
    p = F.col("a.probabilities")
    best = F.array_max(F.map_values(p))
    at_best = F.size(F.filter(F.map_values(p), lambda x: x == best))
    label = F.when((at_best > 1) & F.lit("uncertain" in labels), "uncertain").otherwise(F.col("a.label"))
    error = (
        F.when(F.col("outcome") == "outcome_uncertain", "outcome_uncertain")
        .when(F.col("outcome") == "failed", F.coalesce("error", F.lit("transport_error")))
        .when(F.col("a.label").isNull(), "invalid_response")
        .when(~F.col("a.label").isin(*labels), "label_not_allowed")
        .when(p.isNull() | (F.size(p) == 0), "missing_probabilities")
        .when(F.exists(F.map_keys(p), lambda k: ~k.isin(*labels)), "label_not_allowed")
        .when(F.exists(F.map_values(p), lambda x: ~x.between(0, 1)) | (F.abs(F.aggregate(F.map_values(p), F.lit(0.0), lambda s, x: s + x) - 1) > 1e-6), "invalid_probabilities")
        .when((at_best > 1) & F.lit("uncertain" not in labels), "tied_labels")
        .when(F.coalesce(F.element_at(p, F.col("a.label")), F.lit(-1.0)) < best, "label_not_most_probable")
    )
    good = error.isNull()
    return parsed.select(
        "work_key", F.when(good, "succeeded").otherwise("failed").alias("status"), F.when(good, label).alias("label"), F.when(good, best).alias("probability"), error.alias("error"), F.coalesce(error.isin(*RETRYABLE), F.lit(False)).alias("retryable"),
    )
