"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each document has a fixed hash.  Tokens are summed by source and hash bucket; a running sum over the
buckets finds, for each of a source's nested passes, the bucket in which the pass's budget runs out.  Only that
boundary bucket is cut into finer buckets, level by level, so a level reads a tiny part of the rows after the
first.  The result is one hash threshold per source and pass, and the mix is a filter: nothing is sorted.

The passes are nested: the first takes documents up to the source's target, the second, needed where a target exceeds the
source, takes documents up to the rest once more.  A document thus comes 0, 1 or 2 times.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own, last in
order; rows of equal key share a hash, so repeated rows stand or fall together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
LEVELS = 3
BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(key: Column) -> Column:
    """36 bits of the key's MD5, the same in every SQL dialect; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source its size, weight and target.

    Sharing by weight with caps and resharing until no source is above its cap is filling with water: the k sources with the smallest
    ratio of cap to weight are at their caps and the others get the rest by weight.
    """
    by = sizes.groupBy(source).agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    before = W.orderBy("ratio", F.col(source).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("rest", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("rest") / F.col("left"))
    # The first source, by ratio, that its share doesn't fill sets the level for all that follow.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return by.withColumn("final", level).select(source, "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame, source: str, repeats: int = REPEATS) -> DataFrame:
    """Per source and pass the first hash that is no longer taken.

    A bucket of the finest level is taken if that brings the pass's sum nearer to its budget, or as near.
    """
    passes = aims.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("budget", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("pass") * F.col("source_size"))))
    state = passes.select(F.col(source).alias("s"), "pass", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        at_level = F.shiftright(F.col("hash"), shift)
        if level == 1:
            counted = sized.groupBy(F.col(source).alias("s"), at_level.alias("bucket")).agg(F.sum("size").alias("n"))
            joined = state.alias("a").join(counted.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")), "left")
        else:  # the rows of boundary buckets alone
            parent = F.shiftright(F.col("bucket"), BITS)
            edges = materialise(state.select("s", "prefix").distinct(), f"edges{level}")  # a row per source and pass: its size on disk decides how it is joined
            inside = sized.select(F.col(source).alias("s"), at_level.alias("bucket"), "size").withColumn("prefix", parent)
            inside = inside.alias("x").join(edges.alias("e"), F.col("x.s").eqNullSafe(F.col("e.s")) & (F.col("x.prefix") == F.col("e.prefix")), "left_semi")
            counted = inside.groupBy("s", "bucket", "prefix").agg(F.sum("size").alias("n"))
            joined = state.alias("a").join(counted.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.prefix") == F.col("b.prefix")), "left")
        run = W.partitionBy("s", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        joined = joined.select("a.s", "pass", "budget", "used", F.col("a.prefix").alias("old"), "bucket", "n").withColumn("upto", F.col("used") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        if level < LEVELS:
            over = F.col("upto") > F.col("budget")
            state = joined.groupBy("s", "pass", "budget").agg(
                F.coalesce(F.min(F.when(over, F.col("bucket"))), (F.max("old") + 1) * (1 << BITS)).alias("prefix"),
                F.coalesce(F.min(F.when(over, F.col("upto") - F.col("n"))), F.max("upto")).cast("long").alias("used"),
            )
        else:
            fits = F.col("upto") + (F.col("upto") - F.col("n")) <= 2 * F.col("budget")
            state = joined.groupBy("s", "pass").agg(F.coalesce(F.min(F.when(~fits, F.col("bucket"))), (F.max("old") + 1) * (1 << BITS)).alias("stop"))
    return state.groupBy("s").agg(F.sort_array(F.collect_list("stop"), asc=False).alias("stops"))


def mix_plan(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): per document its key, source, size and hash; per source its size, target and the thresholds of its passes."""
    sized = materialise(documents.select(F.col(key), F.col(source), n_words(F.col(text)).alias("size"), document_hash(F.col(key)).alias("hash")), "sizes")
    aims = targets(sized, source, share, weights, repeats)
    stops = thresholds(sized, aims, source, repeats)
    plan = materialise(aims.join(stops, aims[source].eqNullSafe(stops["s"]), "left").select(F.col(source).alias("plan_source"), "source_size", "target", "stops"), "plan")
    return sized, plan


def _times(hashed: Column) -> Column:
    return F.size(F.filter("stops", lambda stop: hashed < stop)).cast("long")


def mix_columns(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per document: the key, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words the mix takes, repeats counted)."""
    sized, plan = mix_plan(documents, text, source, key, share, weights, repeats)
    joined = sized.join(plan, sized[source].eqNullSafe(plan["plan_source"]), "left")
    return joined.select(key, "size", "source_size", "target", (F.col("size") * _times(F.col("hash"))).alias("taken"))


def mixed(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: the rows of the input, each as often as the mix takes it; documents without words are not taken."""
    _, plan = mix_plan(documents, text, source, key, share, weights, repeats)
    names = documents.columns
    plan = plan.select(F.col("plan_source").alias("__source"), F.col("stops").alias("__stops"))
    joined = documents.join(plan, documents[source].eqNullSafe(plan["__source"]))
    times = F.size(F.filter("__stops", lambda stop: document_hash(F.col(key)) < stop))
    taken = joined.where(F.coalesce(F.col(text).rlike(WORD), F.lit(False))).withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*names)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS hash
  FROM documents),
by_source AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source)),
ratios AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM by_source),
levels AS (
  SELECT *, ((SELECT SUM(source_size) FROM ratios)::DOUBLE * 1.5 - COALESCE(SUM(cap) OVER w, 0.0))
            / ((SELECT SUM(weight) FROM ratios) - COALESCE(SUM(weight) OVER w, 0.0)) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, LEAST(cap, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1)) AS target FROM levels),
groups AS (
  SELECT source, hash, SUM(size)::BIGINT AS n FROM sized GROUP BY source, hash),
running AS (
  SELECT source, hash, n, SUM(n) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM groups),
times AS (
  SELECT r.source, r.hash,
         (CASE WHEN 2 * upto - n <= 2 * LEAST(source_size, target) THEN 1 ELSE 0 END
        + CASE WHEN 2 * upto - n <= 2 * GREATEST(0, target - source_size) THEN 1 ELSE 0 END)::BIGINT AS k, source_size, target
  FROM running r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source)
SELECT d.doc_id, d.size, t.source_size, t.target, d.size * t.k AS taken
FROM sized d JOIN times t ON d.source IS NOT DISTINCT FROM t.source AND d.hash = t.hash
"""
