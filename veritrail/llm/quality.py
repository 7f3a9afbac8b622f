"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Training text: all documents labelled of good quality and not toxic, but for a quarter, chosen by hash, that is held out for the thresholds.
Bigram counts, context totals, continuation counts and discounts are grouped and joined by hashed words, so every shard of the
count tables meets only its own keys.

For a seen bigram ``p(w|u) = (c(uw) - D) / c(u) + g(u) * q(w)``, for an unseen one ``g(u) * q(w)``, where q is the continuation distribution,
itself discounted and interpolated with the uniform one.  A document's log probability is thus a sum of ``log q(w) + log g(w)`` over
its words plus a correction for each seen bigram.  The values of the most frequent words and bigrams (at most ``FREQUENT`` of each) are looked up on the
map side, those of all others by a join on the sharded tables, in ``PASSES`` parts of the key space one after the other, so that only one part's
shuffle is on disk at a time; for the same reason bigrams are counted and given their values in parts of their contexts, and counts are deleted once used.  A Bloom filter of fixed size keeps bigrams that the model has never seen, of which the value is 0, out of it.  Values are whole multiples of 2**-24, so that sums do not depend on the order in which shards add up.

A document is kept if its perplexity is at most the ``QUANTILE`` of the trusted documents of its language that the model was not trained on (of all
languages where a language has fewer than ``LEAST`` of them).

Defined results: a null, empty or blank text has no words, a null perplexity and is not kept; a null language is a language of its own; without trusted text every
document with words is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise, release
from .batches import slices
from .filters import bloom, hit
from .words import Words, mix

FREQUENT = 1 << 20
PASSES = 5
COUNTED = 2  # parts of the contexts that bigrams are counted in, one after the other
JOINED = 8  # parts that their values are made in, a multiple of COUNTED
UNIT = float(1 << 24)
QUANTILE = 0.99
LEAST = 20
START, END = 1, 2
_PAIR = np.uint64(0xD1342543DE82EF95)
_WORD = np.uint64(0x2545F4914F6CDD1D)


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) hashes of all bigrams, START and END included; texts without words have none."""
    w = Words(column, lower=False)
    number = w.counts()
    full = np.flatnonzero(number)
    first = w.first[:-1][full]
    context = np.insert(w.hash, first, np.uint64(START))
    word = np.insert(w.hash, first[1:], np.uint64(END)) if len(full) else w.hash
    word = np.append(word, np.uint64(END)) if len(full) else word
    return context, word, np.repeat(full, number[full] + 1)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of documents labelled of quality 1 and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select(key).where(F.col(key).isNotNull()).distinct()


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of types that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _PAIR + w)


def _word_keys(w: np.ndarray) -> np.ndarray:
    return mix(w ^ _WORD)


def _part(column: str, i: int, of: int) -> Column:
    """Whether a key is in the i-th of so many parts of the key space."""
    return F.shiftright(F.shiftrightunsigned(column, 32) * of, 32) == i


def _in_part(keys: np.ndarray, i: int, of: int) -> np.ndarray:
    """The same over an array of keys."""
    return (keys >> np.uint64(32)) * np.uint64(of) >> np.uint64(32) == i


def _least(rows: DataFrame, n: str, most: int) -> int:
    """The least count c, of powers of 2 ** (1 / 8), such that at most ``most`` rows have n >= c."""
    bucket = F.floor(F.log2(F.col(n)) * 8)
    total, least = 0, None
    for r in sorted(rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("k"), F.min(n).alias("low")).collect(), key=lambda r: -r["b"]):
        total += r["k"]
        if total > most:
            break
        least = r["low"]
    return least if least is not None else 1 << 62


def train(documents: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", most: int | None = None) -> tuple[dict, DataFrame]:
    """(model, keys it was trained on): the model has the words' and bigrams' values, each as sorted arrays of the frequent keys and a table of the others.

    ``most`` is for callers that want a smaller model; without it all trusted text counts.
    """
    share = 1.0 if most is None else min(1.0, most / max(1, trusted.count()))
    chosen = materialise(trusted.where(F.pmod(F.xxhash64(F.col(key), F.lit("trusted")), F.lit(1 << 20)) < int(share * 0.75 * (1 << 20))), "chosen")  # a quarter stays out for the thresholds
    picked = documents.select(key, text).join(chosen, key, "left_semi").select(text)

    def count(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                u, w, _ = _sequences(batch.column(0))
                mine = _in_part(u, part, COUNTED)
                u, w = u[mine], w[mine]
                order = np.lexsort((w, u))
                u, w = u[order], w[order]
                edge = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.zeros(0, np.int64)
                n = np.diff(np.append(edge, len(u)))
                yield pa.RecordBatch.from_arrays([pa.array(u[edge].view(np.int64)), pa.array(w[edge].view(np.int64)), pa.array(n.astype(np.int64))], names=["u", "w", "n"])

        return run

    spark = documents.sparkSession
    counted = []
    for part in range(COUNTED):
        counted.append(materialise(picked.mapInArrow(count(part), "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n")), "bigrams"))
        release(spark)
    types = reduce(DataFrame.unionByName, counted)
    d = _discounts({r["n"]: r["k"] for r in types.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()})
    contexts = types.groupBy("u").agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") >= 3).alias("n3"))
    contexts = materialise(contexts.select("u", "total", ((F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("total")).alias("g")), "contexts")
    follow = materialise(types.groupBy("w").agg(F.count("*").alias("before"), F.sum("n").alias("times")), "continuations")
    e = _discounts({r["before"]: r["k"] for r in follow.where("before <= 4").groupBy("before").agg(F.count("*").alias("k")).collect()})
    row = follow.agg(F.sum("before").alias("all"), F.count("*").alias("v"), *[F.count_if(F.col("before") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("before") >= 3).alias("n3")).first()
    if not row["v"]:
        return {}, chosen
    uniform = (row["n1"] * e[0] + row["n2"] * e[1] + row["n3"] * e[2]) / row["all"] / (row["v"] + 1)
    cut = F.when(F.col("before") == 1, e[0]).when(F.col("before") == 2, e[1]).otherwise(e[2])
    words = follow.select("w", "times", ((F.col("before") - cut) / float(row["all"]) + uniform).alias("q"))
    # START is never predicted and END never a context, so their values enter on their own.
    start, end = contexts.where(F.col("u") == START).first(), words.where(F.col("w") == END).first()
    unknown = math.log(uniform)
    alone = words.join(contexts.select(F.col("u").alias("w"), "g"), "w").where(F.col("w") != END)
    values = materialise(alone.select("w", "times", _units(F.log("q") + F.log(F.greatest("g", F.lit(1e-12))) - unknown).alias("more")), "words")
    less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    low = F.col("g") * F.col("q")
    more = F.greatest(F.log(((F.col("n") - less) / F.col("total") + low) / low), F.lit(0.0))
    often, seen = _least(types, "n", FREQUENT), []
    release(spark)
    for i in range(JOINED):
        own = counted[i * COUNTED // JOINED].where(_part("u", i, JOINED))
        joined = own.join(contexts.where(_part("u", i, JOINED)).hint("shuffle_hash"), "u").join(words.hint("shuffle_hash"), "w")
        keyed = joined.select("u", "w", "n", _units(more).alias("more")).mapInArrow(_keyed(_pair_keys, 2), "k long, n long, more int")
        seen.append(materialise(keyed, "pairs"))
        del own, joined, keyed  # a reference would keep their shuffle files
        if (i + 1) * COUNTED % JOINED == 0:
            discard(counted[i * COUNTED // JOINED])
        release(spark)
    usual = _least(values, "times", FREQUENT)
    single = materialise(values.select("w", "times", "more").mapInArrow(_keyed(_word_keys, 1), "k long, n long, more int"), "words")
    for done in (*counted, contexts, follow, values):
        discard(done)
    release(spark)
    model = {"unknown": unknown, "ends": math.log(start["g"]) + math.log(end["q"]), "tables": [single, *seen]}
    model["words"], model["pairs"] = _split(single, usual), _split(reduce(DataFrame.unionByName, seen), often)
    return model, chosen


def _units(value: Column) -> Column:
    return F.round(value * UNIT).cast("int")


def _keyed(keys: Callable[..., np.ndarray], number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (k, n, more) of rows whose first ``number`` columns make the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = keys(*(batch.column(i).to_numpy().view(np.uint64) for i in range(number)))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *batch.columns[number:]], names=["k", "n", "more"])

    return run


def _split(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(sorted keys of the rows with n >= least, their values, the rows (k, more) of the others)."""
    found = rows.where(F.col("n") >= least).select("k", "more").toArrow()
    k = found["k"].to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], found["more"].to_numpy()[order], rows.where(F.col("n") < least).select("k", "more")


def _find(asked: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in a sorted table and whether it is there."""
    if not len(table):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    order = np.argsort(asked)
    at = np.empty(len(asked), np.int64)
    at[order] = np.minimum(np.searchsorted(table, asked[order]), len(table) - 1)
    return at, table[at] == asked


def _requests(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word keys, their texts, bigram keys, their texts)."""
    u, w, owner = _sequences(column)
    alone = w != np.uint64(END)
    return _word_keys(w[alone]), owner[alone], _pair_keys(u, w), owner


def score_columns(documents: DataFrame, model: dict, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, lang, n_words, perplexity) of every document."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast({name: model[name][:2] for name in ("words", "pairs")} if model else {})
    ends, unknown = (round(model[name] * UNIT) if model else 0 for name in ("ends", "unknown"))
    known = documents.select(key, lang, F.xxhash64(key, text).alias("h"), text)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in slices(batches):
            ask = _requests(batch.column(3))
            n = np.bincount(ask[1], minlength=batch.num_rows).astype(np.int64)
            total = n * unknown + (n > 0) * ends
            for name, asked, owner in (("words", *ask[:2]), ("pairs", *ask[2:])):
                if tables:
                    at, hit = _find(asked, tables[name][0])
                    total += np.bincount(owner[hit], tables[name][1][at[hit]], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(total)], names=[key, lang, "h", "n_words", "total"])

    base = known.mapInArrow(local, f"`{key}` {documents.schema[key].dataType.simpleString()}, `{lang}` string, h long, n_words long, total long")
    if not model:
        return base.select(key, lang, "n_words", F.lit(None).cast("double").alias("perplexity"))
    base, sums = materialise(base, "base"), []
    table = model["words"][2].unionByName(model["pairs"][2])
    rare = spark.sparkContext.broadcast(bloom(table, "k"))
    release(spark)  # what built the filter

    def others(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in slices(batches):
                ask, ids = _requests(batch.column(1)), batch.column(0).to_numpy()
                ks, owners = [], []
                for name, asked, owner in (("words", *ask[:2]), ("pairs", *ask[2:])):
                    mine = np.flatnonzero(_in_part(asked, part, PASSES))
                    mine = mine[hit(asked[mine], rare.value)]
                    rest = mine[~_find(asked[mine], tables[name][0])[1]]
                    ks.append(asked[rest])
                    owners.append(owner[rest])
                k, owner = np.concatenate(ks), np.concatenate(owners)
                order = np.lexsort((k, owner))
                k, owner = k[order], owner[order]
                edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (owner[1:] != owner[:-1])])) if len(k) else np.zeros(0, np.int64)
                n = np.diff(np.append(edge, len(k))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[edge]]), pa.array(k[edge].view(np.int64)), pa.array(n)], names=["h", "k", "n"])

        return run

    for i in range(PASSES):
        asked = known.select("h", text).mapInArrow(others(i), "h long, k long, n int")
        joined = asked.join(table.where(_part("k", i, PASSES)).hint("shuffle_hash"), "k").groupBy("h").agg(F.sum(F.col("more").cast("long") * F.col("n")).alias("sum"))
        sums.append(materialise(joined, "sums"))
        del asked, joined  # a reference would keep their shuffle files
        release(spark)
    # Rows with equal key and text have asked together: each has an equal share.
    whole = reduce(DataFrame.unionByName, sums).groupBy("h").agg(F.sum("sum").alias("sum")).join(base.groupBy("h").agg(F.count("*").alias("copies")), "h")
    total = F.col("total") + F.coalesce(F.expr("sum div copies"), F.lit(0))
    value = F.when(F.col("n_words") > 0, F.exp(-total / UNIT / (F.col("n_words") + 1)))
    return base.join(whole, "h", "left").select(key, lang, "n_words", value.alias("perplexity"))


def judge(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Per document: the key, lang, n_words, perplexity, threshold (its language's) and keep."""
    trusted = materialise(trusted_ids(labels, key), "trusted")
    model, chosen = train(documents, trusted, text, key)
    scored = materialise(score_columns(documents, model, text, key, lang), "scores")
    for done in model.get("tables", ()):
        discard(done)
    release(documents.sparkSession)
    outside = scored.join(trusted.join(chosen, key, "left_anti"), key, "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    by = outside.groupBy(lang).agg(cut.alias("own"), F.count("*").alias("n"))
    whole = outside.agg(cut.alias("whole")).first()["whole"]
    limits = materialise(by.select(F.col(lang).alias("__lang"), F.when(F.col("n") >= LEAST, F.col("own")).alias("own")), "limits")
    both = scored.join(limits, scored[lang].eqNullSafe(limits["__lang"]), "left")
    threshold = F.coalesce("own", F.lit(whole).cast("double"))
    keep = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return both.select(key, lang, "n_words", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
