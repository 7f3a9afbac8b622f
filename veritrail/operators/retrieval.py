"""Hybrid retrieval: BM25 and cosine paths, top-k with traces, reciprocal rank fusion and context."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, K, RRF = 1.2, 0.75, 50, 60
SMALL = 1 << 17  # query terms that are broadcast
ASKED, SEARCHED, AT_ONCE = 2048, 16384, 256  # queries and passages of a cell of a search, and the queries that are scored at once


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): one row per passage and term, with the passage's length in tokens."""
    cut = passages.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return cut.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, df)."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(queries: DataFrame, passages: DataFrame, query: str, claim: str, key: str, text: str) -> DataFrame:
    """(query, key, score) of every passage that shares a term with a query.

    The Lucene variant without the (k1 + 1) factor; a term counts as often as the query repeats it.  Passage terms outside all queries
    are dropped before anything is shuffled.  Texts are cut into tokens once: an empty term stands for each passage as a whole, so that
    counts, document frequencies and lengths all come from one shuffled table.  It is dealt by passages, and up to SMALL query terms are
    brought to it, so that scores are made where the passages are and only the best of each part travel.
    """
    asked = queries.select(query, F.explode(tokens(F.col(claim))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    whole = F.lit("")  # no token is empty
    small = asked.limit(SMALL + 1).count() <= SMALL
    brought = F.broadcast if small else lambda df: df
    wanted = asked.select("term").unionByName(passages.sparkSession.range(1).select(whole.alias("term"))).distinct()
    cut = passages.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.array_append("t", whole)).alias("term"))
    held = cut.join(brought(wanted), "term", "left_semi").groupBy(key).agg(F.collect_list(F.struct("dl", "term")).alias("terms"))
    tf = held.select(key, F.explode("terms").alias("e")).select(key, "e.term", "e.dl").groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
    # No use filters the table and each reads all its columns, so that the plans are equal and the shuffle is reused; queries have no empty term.
    counted, is_whole = F.col("tf") * F.col("dl") >= 0, F.col("term") == whole
    corpus = tf.agg(F.count_if(counted & is_whole).alias("n"), F.avg(F.when(is_whole, F.col("dl"))).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count_if(counted).alias("df"))
    weight = df.crossJoin(F.broadcast(corpus)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # corpus is one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (K1 * (1 - B + B * F.col("dl") / F.col("avgdl")) + F.col("tf"))
    return tf.join(brought(asked.join(weight, "term")), "term").groupBy(query, key).agg(F.round(F.sum(part), 9).alias("score"))


def cosine_scores(queries: DataFrame, passages: DataFrame, query: str, key: str, vector: str) -> DataFrame:
    """(query, key, score) of every pair of a stated query set and all passages, vectors scaled to length 1 first."""
    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: x.cast("double") / norm)

    asked = queries.select(query, unit(F.col(vector)).alias("q"))
    rows = passages.select(key, unit(F.col(vector)).alias("p"))
    dot = F.aggregate(F.zip_with("q", "p", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rows.join(asked, F.lit(True)).select(query, key, F.round(dot, 6).alias("score"))


def _units(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1; sums go from the first entry to the last, as in cosine_scores."""
    v = np.stack(vectors.to_list()).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, halves up, as Spark rounds them: those next to a half by their decimal digits.  Of NaN, which Spark puts above all numbers, infinity."""
    x = scores * 1e6
    out = np.where(np.isnan(x), np.inf, np.floor(x + 0.5))
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        out[i] = float((Decimal(repr(float(scores[i]))) * 1000000).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    return out


def _best_of_cell(asked: pd.DataFrame, rows: pd.DataFrame, query: str, key: str, k: int) -> pd.DataFrame:
    """The best k rows of a cell for each of its queries: a matrix product finds what can be among them, and those are scored as cosine_scores does it."""
    if asked.empty or rows.empty:
        return pd.DataFrame({query: asked[query][:0], key: rows[key][:0], "score": pd.Series([], dtype="float64")})
    rows = rows.sort_values(key, kind="stable")
    q, p = _units(asked["__v"]), _units(rows["__v"])
    odd = not (np.isfinite(q).all() and np.isfinite(p).all())
    found = []
    for start in range(0, len(q), AT_ONCE):
        near = q[start : start + AT_ONCE] @ p.T
        if odd:
            near[np.isnan(near)] = np.inf
        last = np.partition(near, len(p) - k, axis=1)[:, len(p) - k, None] if len(p) > k else np.full((len(near), 1), -np.inf)
        a, b = np.nonzero(near >= last - 2e-6)  # a millionth apart, scores may still be equal when rounded
        score = np.concatenate([np.cumsum(q[start + a[i : i + 65536]] * p[b[i : i + 65536]], axis=1)[:, -1] for i in range(0, len(a), 65536)])
        order = np.lexsort((b, -_rounded(score), a))
        a, b, score = a[order], b[order], score[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < k
        found.append((start + a[kept], b[kept], score[kept]))
    a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({query: asked[query].to_numpy()[a], key: rows[key].to_numpy()[b], "score": score})


def _search(queries: DataFrame, passages: DataFrame, query: str, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, key, score) of all pairs that can be among the best k of cosine_scores, and (query, eligible) with the number of scores of each query.

    Queries and passages are dealt by their ids into cells of a few thousand each; every pair of cells is one group, in which all its pairs are scored, and gives k rows a query.
    Vectors with a null, or of another size than most, are scored pair by pair.
    """
    v = F.col(vector)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    sizes = passages.where(whole).groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    fits = F.coalesce(whole & (F.size(v) == size) & (F.size(v) > 0), F.lit(False))
    n_asked, all_asked, all_rows = *queries.agg(F.count_if(fits), F.count("*")).first(), passages.count()
    groups = {"__g": max(1, -(-n_asked // ASKED)), "__h": max(1, -(-n // SEARCHED))}
    dealt = lambda column, of: F.pmod(F.xxhash64(column), F.lit(groups[of]))
    copies = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[of] - 1).cast("long"))).alias(of)
    asked = queries.where(fits).select(query, v.alias("__v"), dealt(query, "__g").alias("__g")).select("*", copies("__h"))
    rows = passages.where(fits).select(key, v.alias("__v"), dealt(key, "__h").alias("__h")).select("*", copies("__g"))
    schema = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {passages.schema[key].dataType.simpleString()}, score double"
    cells = asked.groupBy("__g", "__h").cogroup(rows.groupBy("__g", "__h"))
    best = cells.applyInPandas(lambda a, b: _best_of_cell(a, b, query, key, k), schema).withColumn("score", F.round("score", 6))
    eligible = queries.where(fits).select(query, F.lit(n).cast("long").alias("eligible"))
    if n_asked < all_asked or n < all_rows:
        others = cosine_scores(queries.where(~fits), passages, query, key, vector).unionByName(cosine_scores(queries.where(fits), passages.where(~fits), query, key, vector))
        best = best.unionByName(others)
        eligible = eligible.unionByName(others.groupBy(query).agg(F.count("score").alias("eligible")))
    return best, eligible.groupBy(query).agg(F.sum("eligible").alias("eligible"))


def nearest(queries: DataFrame, passages: DataFrame, query: str, key: str, vector: str, k: int = K) -> DataFrame:
    """top_k of cosine_scores, without a row for every pair."""
    return top_k(_search(queries, passages, query, key, vector, k)[0], query, key, k)


def nearest_trace(queries: DataFrame, passages: DataFrame, query: str, key: str, vector: str, k: int = K) -> DataFrame:
    """path_trace of cosine_scores, of which all are counted as scored."""
    best, eligible = _search(queries, passages, query, key, vector, k + 1)
    return _trace(top_k(best, query, key, k + 1), eligible, query, F.col("eligible"), k)


def top_k(scores: DataFrame, query: str, key: str, k: int = K) -> DataFrame:
    """The best k per query with ranks; of equal scores the smaller key comes first."""
    order = W.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def path_trace(scores: DataFrame, query: str, key: str, scored: Column, k: int = K) -> DataFrame:
    """Per query: scored, eligible and omitted passages and whether the k-th and the next score are equal."""
    counted = scores.groupBy(query).agg(F.count("score").alias("eligible"))  # reads the score, so that the scores' shuffle is reused
    return _trace(top_k(scores, query, key, k + 1), counted, query, scored, k)


def _trace(best: DataFrame, counted: DataFrame, query: str, scored: Column, k: int) -> DataFrame:
    border = best.groupBy(query).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == k + 1, F.col("score"))).alias("b"))
    return counted.join(border, query).select(query, scored.alias("scored"), "eligible", F.greatest(F.col("eligible") - k, F.lit(0)).alias("omitted"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("tied_at_boundary"))


def rrf_fuse(semantic: DataFrame, lexical: DataFrame, query: str, key: str, c: int = RRF) -> DataFrame:
    """Both paths' hits without duplicates: each path's rank and score, the fused score and rank, without a cutoff.

    The order is that of exact fractions: sums rounded to 12 places order and tie alike for ranks up to 50.
    """
    a = semantic.select(query, key, F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    b = lexical.select(query, key, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    both = a.join(b, [query, key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    both = both.withColumn("fused", F.round(part("semantic_rank") + part("lexical_rank"), 12))
    return both.withColumn("fused_rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("fused"), F.asc(key))))


def membership_violations(hits: DataFrame, query: str, key: str) -> DataFrame:
    """(query, code): duplicate passages, ranks that are not 1..n, scores that are not finite."""
    by = hits.groupBy(query).agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"), F.count_if(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))).alias("odd"))
    code = F.array_compact(F.array(F.when(F.col("keys") < F.col("n"), F.lit("path_membership_mismatch")), F.when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")), F.lit("path_rank_mismatch")), F.when(F.col("odd") > 0, F.lit("invalid_path_scores"))))
    return by.select(query, F.explode(code).alias("code"))


def rescore_violations(saved: DataFrame, fresh: DataFrame, query: str, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(query, key, code) where saved hits (score, rank) differ from hits scored again: hit_missing, hit_unexpected, score_mismatch or rank_mismatch, the first that fits."""
    a = saved.select(query, key, F.col("score").alias("old_score"), F.col("rank").alias("old_rank"))
    b = fresh.select(query, key, F.col("score").alias("new_score"), F.col("rank").alias("new_rank"))
    code = (
        F.when(F.col("old_rank").isNull(), "hit_missing")
        .when(F.col("new_rank").isNull(), "hit_unexpected")
        .when(F.abs(F.col("old_score") - F.col("new_score")) > tolerance, "score_mismatch")
        .when(F.col("old_rank") != F.col("new_rank"), "rank_mismatch")
    )
    return a.join(b, [query, key], "full_outer").select(query, key, code.alias("code")).where("code is not null")


def neighbours(passages: DataFrame, article: str, order: str, key: str, headings: str) -> DataFrame:
    """(key, context): the passage with its direct predecessor and successor of the same section, in order."""
    w = W.partitionBy(article).orderBy(order)
    same = lambda other: F.when(other(headings) == F.col(headings), other(key))
    return passages.select(key, F.array_compact(F.array(same(lambda c: F.lag(c).over(w)), F.col(key), same(lambda c: F.lead(c).over(w)))).alias("context"))


def vector_violations(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, code) of vectors of another size, with values that are not finite, or of length 0."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    code = F.when(v.isNull() | (F.size(v) != size), "vector_dimension").when(bad, "vector_not_finite").when(norm == 0, "vector_zero")
    return vectors.select(key, code.alias("code")).where("code is not null")


def index_violations(index: DataFrame, passages: DataFrame, key: str, most_tokens: int) -> DataFrame:
    """(key, code) where an index (key, text, token_count) isn't that of the passages (key, text): passage_not_indexed, index_without_passage, indexed_twice, index_representation_mismatch, invalid_index_lengths.

    Both sides are joined by the hashes of their texts, not by the texts; passages have one row each, of an index with several rows for one each is compared, and a null text equals only a null.
    """
    held = index.select(key, F.sha2("text", 256).alias("__held"), "token_count")
    held = held.groupBy(key).agg(F.count("*").alias("__rows"), F.collect_set(F.coalesce("__held", F.lit(""))).alias("__texts"), F.bool_and(F.coalesce(F.col("token_count").between(1, most_tokens), F.lit(False))).alias("__fits"))
    both = passages.select(key, F.coalesce(F.sha2("text", 256), F.lit("")).alias("__text")).join(held, key, "full_outer")
    known, there = F.col("__text").isNotNull(), F.col("__rows").isNotNull()
    codes = F.array(
        F.when(~there, "passage_not_indexed"), F.when(~known, "index_without_passage"), F.when(F.col("__rows") > 1, "indexed_twice"),
        F.when(known & there & (F.col("__texts") != F.array("__text")), "index_representation_mismatch"), F.when(there & ~F.col("__fits"), "invalid_index_lengths"),
    )
    return both.select(key, F.explode(F.array_compact(codes)).alias("code"))


def sparse_violations(index: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """(key, code) of passages whose postings (key, term, tf, dl) are no sound state: invalid_frequency (a count below one), invalid_vocabulary (a null or empty term, or one twice), invalid_length (lengths that
    differ or aren't the sum of the counts), unknown_passage (postings of a passage that isn't there).  Passages without a term have no postings."""
    terms = index.groupBy(key, "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.bool_and(F.coalesce(F.col("tf") > 0, F.lit(False))).alias("counted"), F.min("dl").alias("low"), F.max("dl").alias("high"))
    sound = (F.col("n") == 1) & F.coalesce(F.col("term") != "", F.lit(False))
    rows = terms.groupBy(key).agg(F.bool_and("counted").alias("counted"), F.bool_and(sound).alias("sound"), F.sum("tf").alias("tf"), F.min("low").alias("low"), F.max("high").alias("high"))
    known = passages.select(F.col(key).alias("__known")).distinct()
    rows = rows.join(known, F.col(key) == F.col("__known"), "left")
    fits = F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("tf")), F.lit(False))
    codes = F.array(F.when(~F.col("counted"), "invalid_frequency"), F.when(~F.col("sound"), "invalid_vocabulary"), F.when(~fits, "invalid_length"), F.when(F.col("__known").isNull(), "unknown_passage"))
    return rows.select(key, F.explode(F.array_compact(codes)).alias("code"))


def corpus_order_violations(passages: DataFrame, article: str, order: str) -> DataFrame:
    """Articles whose passage orders are not exactly 0..n-1."""
    by = passages.groupBy(article).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"), F.countDistinct(order).alias("kinds"))
    return by.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("kinds") != F.col("n"))).select(article, "n")
