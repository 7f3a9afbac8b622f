"""Hashes of source closures over the record graph, level by level, and what a changed source makes stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity
from ..runtime import materialise

_CHUNKS = [(1 + 8 * i, 8) for i in range(8)]  # a SHA-256's 64 hexadecimal digits as eight numbers of 32 bits: 2**31 of each fit into a long


def _sums(digest: str) -> list[Column]:
    return [F.sum(F.conv(F.substring(digest, a, n), 16, 10).cast("long")).alias(f"s{i}") for i, (a, n) in enumerate(_CHUNKS)]


def closure_hashes(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, closure) of records (id, digest) that refer to others by edges (src, dst): a Merkle hash of a record and all that it rests on.

    ``closure`` is the SHA-256 of the record's own digest, the number of its sources, and the sums of the eight parts of their closures: sums don't depend on order and are
    added up before anything is shuffled, so a corpus of any number of passages is no group in one task.  Level 0 rests on nothing; each round hashes the records of which all
    sources are hashed.  A missing source, a cycle, and all that rests on one, have no closure: level -1 and null.  Repeated edges count once.
    """
    links = materialise(edges.select("src", "dst").distinct(), "links")
    need = records.select("id", "digest").join(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("need")), "id", "left").na.fill(0, ["need"])
    need = materialise(need.withColumn("closure", F.when(F.col("need") == 0, F.sha2(F.concat_ws(":", "digest", F.lit(0)), 256))), "need")
    names = [f"s{i}" for i in range(len(_CHUNKS))]
    full = F.concat_ws(":", "digest", "n", *[F.col(s).cast("string") for s in names])
    level, fresh, waiting = 0, need.where("closure is not null").select("id", "closure"), None
    parts = [fresh.withColumn("level", F.lit(0))]
    while fresh.limit(1).count():
        level += 1
        heard = links.join(fresh.select(F.col("id").alias("dst"), "closure"), "dst").groupBy("src").agg(F.count("*").alias("n"), *_sums("closure"))
        if waiting is not None:
            heard = heard.unionByName(waiting.select("src", "n", *names)).groupBy("src").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        heard = heard.join(need.select(F.col("id").alias("src"), "digest", "need"), "src")
        state = materialise(heard.withColumn("closure", F.when(F.col("n") == F.col("need"), F.sha2(full, 256))), f"level{level}")
        fresh, waiting = state.where("closure is not null").select(F.col("src").alias("id"), "closure"), state.where("closure is null")
        parts.append(fresh.withColumn("level", F.lit(level)))
    hashed = reduce(DataFrame.unionByName, parts)
    return records.select("id").join(hashed, "id", "left").select("id", F.coalesce("level", F.lit(-1)).alias("level"), "closure")


def prepared_indexes(closures: DataFrame, manifests: DataFrame, model: str, dimensions: int) -> DataFrame:
    """(id, index, index_id) of corpus manifests: an index's identity holds its corpus's closure and the model, so it changes with any source below it and with nothing else."""
    made = manifests.select("id").join(closures.where("closure is not null"), "id")
    return made.select("id", "closure", identity("index", corpus=F.col("id"), sources=F.col("closure"), model=F.lit(model), dimensions=F.lit(dimensions)).alias("index_id"))


def stale(prepared: DataFrame, now: DataFrame) -> DataFrame:
    """(id, code) of prepared indexes (id, index_id) that are not what their corpus would be indexed as now: ``index_corpus_mismatch``, or ``index_source_missing`` without a closure."""
    both = prepared.select("id", "index_id").join(now.select("id", F.col("index_id").alias("__now")), "id", "left")
    code = F.when(F.col("__now").isNull(), "index_source_missing").when(F.col("__now") != F.col("index_id"), "index_corpus_mismatch")
    return both.select("id", code.alias("code")).where("code is not null")
