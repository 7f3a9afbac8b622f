"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item, or all words of a shorter one.  A document word is hit if it lies inside an occurrence of a window.

1. Both sides hash all grams of ``gram`` words and keep the least hash of every run of ``span - gram + 1`` grams.  Equal spans of ``span`` words have equal runs
   and so an equal kept hash: each shared window is found.  An item of m < ``span`` words has one fingerprint, the hash of its m words, looked for among all
   m-grams; only lengths that occur in the benchmark cost a pass.
2. One scan of the documents: a table of the low bits of the benchmark's fingerprints (1024 places for each, 2**24 at most, a byte a place; it lets some others through,
   more of them beyond 2**14 fingerprints, and no result depends on it) is looked up before the least-hash test, and what passes leaves the scan with its words around it.
   Texts are not shuffled.
3. These candidates are joined with the fingerprints, hits are extended to all windows that hold the gram, and those are joined, as words, with the distinct windows of
   the benchmark.  Both tables have one row per key, so that copies of a passage in items and in documents never multiply; Spark broadcasts them only if their files are small.
4. Windows are grouped by the items they occur in, documents by their set of such groups: the list of items is made once for all documents alike.

Grams are compared by hash, which only adds candidates, and windows as words in the last join.

Defined results: a text without words, or null, has no hits; items without words are ignored; an item id counts once however often it occurs, and a null
item id marks words but is neither counted nor listed; repeated documents and rows without an id each get their row; an empty table on either side gives no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

SPAN = 10
GRAM = 5
#: What parts words, and the letters that are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_BITS, MOST_BITS = 14, 24  # of the table of fingerprints' low bits that the scan looks up, one byte each
SPARE = 1024  # places in it for each fingerprint, as long as there are bits


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none if it is null."""
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # the first is faster, and the same for ASCII
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BREAK), "")


def gram_at(words: Column, i: Column, k: int) -> Column:
    """The hash of the k words from place i, which must be there."""
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def kept(words: Column, i: Column, length: int, k: int) -> Column:
    """Winnowing: whether gram i has the least hash of one of the runs around it, those of the grams of a window of ``length`` words."""
    run = length - k + 1
    first, last = F.greatest(i - (run - 1), F.lit(0)), F.least(i, F.size(words) - length)
    own = gram_at(words, i, k)
    return F.exists(upto(last - first + 1), lambda j: F.array_min(F.transform(F.sequence(first + j, first + j + (run - 1)), lambda at: gram_at(words, at, k))) == own)


def families(items: DataFrame, span: int, gram: int) -> list[tuple[int, int]]:
    """(window length, gram length) of the benchmark: one pair for the full windows, one for each shorter length that occurs; at most ``span`` of them."""
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    return [(n, min(gram, n) if n == span else n) for n in lengths]


def fingerprints(words: Column, i: Column, pairs: list[tuple[int, int]]) -> Column:
    """What winnowing keeps of the grams at place i, as (length, print, first, last): the words of all windows that hold the gram are those from first to last."""

    def found(length: int, k: int) -> Column:
        bounds = F.greatest(F.lit(0), i + (k - length)).alias("first"), F.least(F.size(words), i + length).alias("last")
        return F.when((i <= F.size(words) - k) & kept(words, i, length, k), F.struct(F.lit(length).alias("length"), gram_at(words, i, k).alias("print"), *bounds))

    return F.array_compact(F.array(*[found(*pair) for pair in pairs]))


def windows(words: Column, length: Column) -> Column:
    """All windows of a length as strings."""
    return F.transform(upto(F.size(words) - length + 1), lambda i: F.array_join(F.slice(words, i + 1, length), " "))


def presence(prints: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2**bits booleans, true where the low bits of a print say so."""
    at = F.col("print").bitwiseAND(F.lit((1 << bits) - 1))
    by_block = prints.select(F.shiftright(at, 12).alias("block"), at.bitwiseAND(F.lit(4095)).cast("int").alias("slot")).groupBy("block").agg(F.collect_set("slot").alias("slots"))
    every = prints.sparkSession.range(1 << (bits - 12)).select(F.col("id").alias("block")).join(by_block, "block", "left")
    filled = F.when(F.col("slots").isNull(), F.array_repeat(F.lit(False), 4096)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.array_contains("slots", i)))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", filled.alias("slots")))), lambda x: x["slots"])).alias("map"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: the key, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``; see the module's text."""
    rows, classes, met = _scanned(documents, benchmark, text, key, item_text, item_key, span, gram)
    union = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["at"] + x["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(acc["end"], x["at"]))).alias("n")),
    )["n"]
    per_row = met.groupBy("row").agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.sort_array(F.collect_set("class")).alias("groups"))
    per_row = materialise(per_row.select("row", union.cast("long").alias("n_hit"), "groups"), "hit")
    lists = per_row.select("groups").distinct().select("groups", F.explode("groups").alias("class")).join(classes, "class").select("groups", F.explode("items").alias("item")).where("item is not null").distinct()
    listed = F.array_join(F.sort_array(F.collect_list("item")), ",")
    lists = materialise(lists.groupBy("groups").agg(F.count("*").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")), "lists")  # its size on disk decides how it is joined
    found = per_row.join(lists, "groups", "left").select("row", "n_hit", "n_items", "items_sha256")
    zero = F.lit(0).cast("long")
    out = rows.select("row", F.col("key").alias(key), "n_words").join(found, "row", "left")
    return out.select(key, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def hits(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Each occurrence of a window: the document's key, the word it starts at, its length in words, and the items it is from (as strings)."""
    rows, classes, met = _scanned(documents, benchmark, text, key, item_text, item_key, span, gram)
    return met.join(classes, "class").join(rows.select("row", F.col("key").alias(key)), "row").select(key, F.col("at").alias("first_word"), "length", "items")


def _scanned(documents: DataFrame, benchmark: DataFrame, text: str, key: str, item_text: str, item_key: str, span: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their row number, key and n_words; groups of items by window; distinct occurrences of windows)."""
    words, i = F.col("words"), F.col("i")
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    items = materialise(items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(span))), "items")
    known = items.select("item", "length", F.explode(windows(words, F.col("length"))).alias("window")).groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    known = materialise(known.withColumn("class", F.xxhash64("items")), "windows")
    classes = known.groupBy("class").agg(F.first("items").alias("items"))
    pairs = families(items, span, gram)
    row = F.monotonically_increasing_id().alias("row")  # unique, and fixed by writing it
    if not pairs:
        rows = materialise(documents.select(row, F.col(key).alias("key"), F.size(words_of(F.col(text))).cast("long").alias("n_words")), "scan")
        return rows, classes, known.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("at"), "length", "class").where("false")

    places = items.select("length", "words", F.explode_outer(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    prints = places.select(F.explode(F.coalesce(*[F.when(F.col("length") == n, fingerprints(words, i, [(n, k)])) for n, k in pairs])).alias("p"))
    prints = materialise(prints.select("p.length", "p.print").distinct(), "prints")
    bits = max(LEAST_BITS, min(MOST_BITS, (SPARE * prints.count()).bit_length()))

    def may_be(value: Column) -> Column:
        return F.get("map", value.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))

    # The scan walks the places of each text in generated code and cuts out the words around those that pass; place -1 stands for the document itself.
    texts = documents.select(row, F.col(key).alias("key"), words_of(F.col(text)).alias("words")).crossJoin(F.broadcast(presence(prints, bits)))  # one row of bounded size
    places = texts.select("row", "key", "words", "map", F.explode_outer(F.sequence(F.lit(-1), F.size("words") - 1)).alias("i"))
    passed = i < 0
    for _, k in pairs:
        passed = passed | ((i <= F.size(words) - k) & may_be(gram_at(words, i, k)))
    first = F.greatest(F.lit(0), i - span)
    spots = places.where(passed).select("row", "key", F.size(words).alias("n"), first.alias("from"), (i - first).alias("i"), F.slice(words, first + 1, F.when(i < 0, 0).otherwise(2 * span)).alias("words"))
    spots = spots.select("row", "key", "n", "from", "i", "words", F.explode_outer(F.when(i >= 0, fingerprints(words, i, pairs))).alias("p")).where((i < 0) | F.col("p").isNotNull())
    around = F.slice(words, F.col("p.first") + 1, F.col("p.last") - F.col("p.first"))
    scan = spots.select("row", "key", F.when(i < 0, F.col("n").cast("long")).alias("n_words"), "p.length", "p.print", (F.col("from") + F.col("p.first")).alias("from"), F.when(i >= 0, around).alias("words"))
    scan = materialise(scan, "scan")
    spot = scan.where("n_words is null").join(prints, ["length", "print"], "left_semi")
    occurring = spot.select("row", "length", "from", F.posexplode(windows(words, F.col("length"))).alias("place", "window"))
    occurring = occurring.select("row", "length", (F.col("from") + F.col("place")).alias("at"), "window").distinct()
    met = occurring.join(known.select("length", "window", "class"), ["length", "window"]).select("row", "at", "length", "class")
    return scan.where("n_words is not null").select("row", "key", "n_words"), classes, met


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
known AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM known),
spans AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
found AS (SELECT DISTINCT s.r, s.n, s.i, k.item FROM spans s JOIN known k ON s.n = k.n AND s.win = k.win),
places AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM found)) GROUP BY r),
lists AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(p.n_hit, 0)::BIGINT AS n_hit, COALESCE(l.n_items, 0)::BIGINT AS n_items, sha256(COALESCE(l.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places p USING (r) LEFT JOIN lists l USING (r)
"""
