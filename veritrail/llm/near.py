"""Exact Jaccard join of documents on word n-gram sets, by token-combination prefixes.

Tokens are hashed k-word shingles.  A global order puts rare tokens first (by hash), then frequent tokens by frequency
class.  Frequent are tokens whose count, lossy-counted per block of documents, reaches a threshold chosen so that
their list has at most ``FREQUENT_MOST`` entries; only efficiency depends on that list, never the result.  (A token in a share f of the documents
is seen twice in a block of b documents with odds of about (f b)^2, so what goes uncounted has buckets of the order of the square root of the corpus.)

A set x that links to y must share at least ``tau = ceil(threshold * |x|)`` tokens.  Its prefix is extended until
``rare + sum over classes of max(0, tokens in class - 1) >= |x| - tau + 1 + e`` with e half of ``|x| - tau + 1``.  Rare tokens are indexed alone and
frequent ones as pairs within a class (classes: the token's hash modulo a power of two that grows with the set, so that pairs
grow with the prefix and not with its square).  Of two linking sets, let x be the one whose prefix ends first: with r rare tokens and s_c tokens
of class c shared in it, ``r + sum s_c >= 1 + e + classes``, and a class with s_c shared tokens shares at least s_c - 1 pairs, so the two
share at least e + 1 signatures.  Where the set ends before its prefix is full, ``r + sum s_c >= tau`` says the same, as the classes number at most tau - e - 1.

Buckets (the sets that have a signature) with the same members are one bucket, whose weight is their number.  Sets fall into 64 cells by hash, and a set
goes unless for some cell its buckets with another member there weigh e + 1 or more (the least e of any set it can link to); that is done twice.  Sets in a bucket are not paired row by row: nodes (distinct sets) are laid into blocks of
``BLOCK`` neighbours, and a tile (two blocks with a common bucket) is verified exactly in one go by counting shared tokens.

Components take three rounds: each block against itself; then a few members of every large component against those of others that share a
bucket with it; last, pairs of blocks, with only those members of which the other block has some in a different component.  So a large group
of different near copies costs a tile per block, not one per pair of blocks.  Counting each document's links as well (``links=True``) needs all pairs of a group
compared: its tiles are all pairs of blocks with a common bucket, m * m / 2048 rows for m different sets.

Copies (equal sets) are one node from the start.  Every cut is a written table in the shared folder; what is broadcast has a fixed
bound (the frequent tokens, and filters of 2**24 bits that let too much through but never too little).

Defined results: null, empty or blank texts have an empty set and are linked with nothing; a text of fewer than k words has one
shingle, its whole word sequence; component ids are the smallest key reachable; nodes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import discard, materialise, release
from .batches import give_back, slices
from .filters import TASKS
from .words import Words, distinct, mix, shingles

FREQUENT_LEAST = 64
FREQUENT_MOST = 1 << 20
BLOCK = 1024
SLOTS = 1 << 24
_MASK = np.uint64((1 << 48) - 1)
_SINGLE, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _pack(tokens: np.ndarray) -> bytes:
    """48-bit tokens as six bytes each."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64)


def token_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit tokens of each text, segment starts, and each set's 64-bit identity."""
    values, begin = shingles(Words(column), k)
    values, begin = distinct(values & _MASK, begin)
    number = np.diff(begin)
    node = np.zeros(len(number), np.uint64)
    full = number > 0
    if full.any():
        spread = mix(values + np.uint64(1))
        node[full] = mix(np.add.reduceat(spread, begin[:-1][full]) ^ (np.add.reduceat(mix(spread ^ _PAIR), begin[:-1][full]) * _SINGLE)) ^ number[full].astype(np.uint64)
    return values, begin, node.view(np.int64)


def _needed(n: int, num: int, den: int) -> int:
    """Prefix tokens that a set of n must have: |x| - tau + 1."""
    return n + (-num * n // den) + 1


def _extra(n: int, num: int, den: int) -> int:
    """By how many tokens a prefix is extended."""
    return _needed(n, num, den) // 2


def _least_of(n: int, num: int, den: int) -> int:
    """How many signatures a set of n shares with any set it links to, whichever of the two prefixes ends first."""
    low = -(-num * n // den)
    return min(_extra(n, num, den), _extra(low, num, den), low - 2) + 1


def _least(n: str, num: int, den: int) -> Column:
    """``_least_of`` as a column."""

    def extra(size: str) -> str:
        return f"(({size} - ({num} * {size} + {den - 1}) div {den} + 1) div 2)"

    low = f"(({num} * {n} + {den - 1}) div {den})"
    return F.expr(f"least({extra(n)}, {extra(low)}, {low} - 2) + 1")


def _class_count(n: int, num: int, den: int) -> int:
    """How many classes the frequent tokens of a set of n fall into."""
    most = min((_needed(n, num, den) + _extra(n, num, den)) // 2, ((3 * num - den) * n // den - 3) // 2)  # the second is at most tau - e - 1; both grow with n
    return 1 << max(0, most.bit_length() - 1)


def _classes(n: int, num: int, den: int) -> set[int]:
    """The class counts used by sets that a set of n tokens can link to."""
    low, high = -(-num * n // den), den * n // num
    a, b = _class_count(low, num, den), _class_count(high, num, den)
    return {1 << i for i in range(min(a, b).bit_length() - 1, max(a, b).bit_length())}


def signatures(tokens: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, single tokens and pairs; ``rank`` is 0 for rare tokens and grows with frequency for frequent ones."""
    n, none = len(tokens), np.zeros(0, np.uint64)
    if n < 2:  # links to no other set: one token of at most one
        return none, none
    need = _needed(n, num, den) + _extra(n, num, den)
    rare = tokens[rank == 0]
    pairs = [none]
    if len(rare) < need:
        often = np.flatnonzero(rank)
        often = tokens[often[np.argsort(rank[often], kind="stable")]]
        for m in _classes(n, num, den):
            kind = often & np.uint64(m - 1)
            _, first = np.unique(kind, return_index=True)
            gain = np.ones(len(often), np.int64)
            gain[first] = 0
            stop = int(np.searchsorted(np.cumsum(gain), need - len(rare))) + 1
            part, kind = often[:stop], kind[:stop]
            order = np.lexsort((part, kind))
            part, kind = part[order], kind[order]
            for gap in range(1, len(part)):  # pairs of tokens that stand ``gap`` apart in one class
                same = kind[gap:] == kind[:-gap]
                if not same.any():
                    break
                pairs.append(mix(part[:-gap][same] * _PAIR + part[gap:][same]))
    return mix(rare[:need] ^ _SINGLE), np.unique(np.concatenate(pairs))


def in_slots(rows: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame:
    """The rows with a column ``in_slots``: true for those whose key is in ``wanted`` and for few others.

    Two broadcast bitmaps of SLOTS bits, by independent hashes, say so; they are aggregated on executors and never larger, whatever ``wanted``, a written table, holds.
    """
    hit = F.lit(True)
    for seed in (1, 2):
        slot = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), F.lit(SLOTS))
        place, bit, map_, of = (f"__{x}{seed}" for x in ("place", "bit", "map", "of"))
        maps = wanted.coalesce(TASKS).select(F.shiftright(slot, 15).alias(of), F.pmod(slot, F.lit(1 << 15)).alias("at")).groupBy(of).agg(F.bitmap_construct_agg("at").alias(map_))
        rows = rows.withColumns({place: F.shiftright(slot, 15), bit: F.pmod(slot, F.lit(1 << 15))}).join(F.broadcast(maps), F.col(place) == F.col(of), "left")
        hit = hit & F.coalesce(F.expr(f"shiftright(cast(conv(hex(substring(`{map_}`, cast(`{bit}` div 8 + 1 as int), 1)), 16, 10) as int), cast(`{bit}` % 8 as int)) & 1") == 1, F.lit(False))
    return rows.withColumn("in_slots", hit).drop(*[f"__{x}{seed}" for x in ("place", "bit", "map", "of") for seed in (1, 2)])


def only_slots(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in ``wanted`` and few others; see ``in_slots``."""
    return in_slots(rows, [key], wanted).where("in_slots").drop("in_slots")


def _sketch(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per document (key, text, mark) its node, set size and the smallest tokens by hash; per batch a row of tokens counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def counted() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.diff(tokens, prepend=tokens[0] ^ np.uint64(1)))
            count = np.diff(np.append(edge, len(tokens)))
            keep = count > 1
            blob = tokens[edge[keep]].astype("<u8").tobytes() + np.minimum(count[keep], 0x7FFFFFFF).astype("<i4").tobytes()
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64())], names=["key", "node", "size", "blob", "mark"])

        total = 0
        for batch in slices(batches):
            values, begin, node = token_sets(batch.column(1), k)
            sizes = np.diff(begin)
            blobs = []
            for i, n in enumerate(sizes.tolist()):
                mine = values[begin[i] : begin[i + 1]]
                blobs.append(_pack(mine[: 2 * _needed(n, num, den) + 8]) if n > 1 else b"")
                if n and node[i] not in seen:
                    seen.add(node[i])
                    held.append(mine)
                    total += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(sizes.astype(np.int32)), pa.array(blobs, pa.binary()), batch.column(2)], names=["key", "node", "size", "blob", "mark"])
            if total > 2_000_000:
                yield counted()
                total = 0
        if held:
            yield counted()

    return documents.mapInArrow(run, "key long, node long, size int, blob binary, mark long")


def frequent_tokens(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their frequency classes (2, 3, ...), at most FREQUENT_MOST of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = len(blob) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob[: 8 * n], "<i8")), pa.array(np.frombuffer(blob[8 * n :], "<i4").astype(np.int64))], names=["token", "n"])

    counts = sketch.where("size = -1").select("blob").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    counts = materialise(counts.select("token", F.floor(F.log2("n")).cast("int").alias("rank")), "frequent")
    by = {r["rank"]: r["n"] for r in counts.groupBy("rank").agg(F.count("*").alias("n")).collect()}
    least, total = 99, 0
    for rank in sorted(by, reverse=True):
        total += by[rank]
        if total > FREQUENT_MOST:
            break
        least = rank
    found = counts.where(F.col("rank") >= least).toArrow()
    discard(counts)
    token, rank = found["token"].to_numpy().astype(np.uint64), found["rank"].to_numpy()
    order = np.argsort(token)
    return token[order], rank[order].astype(np.int8)


def _rank(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), np.int8)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.where(frequent[at] == tokens, rank[at], 0)


def _signature_rows(parts: list[np.ndarray], nodes: list[int], pair: list[bool] | None = None) -> pa.RecordBatch:
    """Rows (sig, node) of the signatures of each node, with ``pair`` a third column."""
    sig = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sizes = [len(x) for x in parts]
    columns = {"sig": sig.view(np.int64), "node": np.repeat(np.array(nodes, np.int64), sizes)}
    if pair is not None:
        columns["pair"] = np.repeat(np.array(pair, bool), sizes)
    return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})


def all_signatures(documents: DataFrame, sketch: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(sig, node) of every set, single tokens and pairs apart: from the sketch where its rare tokens fill the prefix, else from the text again.

    Equal sets of one task are taken once.
    """
    tokens, ranks = frequent_tokens(sketch)
    shared = documents.sparkSession.sparkContext.broadcast((tokens, ranks))

    def filled(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(key, node, the prefix or None if the sketch doesn't hold it)."""
        frequent, rank = shared.value
        columns = [c.to_pylist() for c in batch.columns]
        blob = b"".join(columns[3])
        every = _unpack(blob)
        rare = _rank(every, frequent, rank) == 0
        at = 0
        for key, node, size, data in zip(*columns, strict=True):
            stop = at + len(data) // 6
            if node not in seen:
                mine = every[at:stop][rare[at:stop]]
                need = _needed(size, num, den) + _extra(size, num, den)
                yield key, node, mine[:need] if len(mine) >= need else None
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
            at = stop

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            found = [(node, prefix) for _, node, prefix in filled(batch, seen) if prefix is not None]
            yield _signature_rows([mix(p ^ _SINGLE) for _, p in found], [x for x, _ in found])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            found = [(key, node) for key, node, prefix in filled(batch, seen) if prefix is None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["key", "node"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in slices(batches):
            values, begin, node = token_sets(batch.column(1), k)
            which = _rank(values, frequent, rank)
            parts = [x for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True) for x in signatures(values[a:b], which[a:b], num, den)]
            yield _signature_rows(parts, np.repeat(node, 2).tolist(), [False, True] * len(node))

    sets = sketch.where("size > 1").drop("mark")
    # One document stands for all equal sets; several rows of one key and set would only repeat themselves.
    again = materialise(sets.mapInArrow(short, "key long, node long").groupBy("node").agg(F.min("key").alias("key")).select("key"), "again")
    heavy = materialise(only_slots(documents, "key", again).select("key", "text").mapInArrow(whole, "sig long, node long, pair boolean"), "heavy")
    discard(again)
    singles = sets.mapInArrow(light, "sig long, node long").unionByName(heavy.where("not pair").drop("pair"))
    return singles, heavy.where("pair").drop("pair")


BUCKET_ROWS = 100_000
CELL_ROWS = 16_384  # 64 cells a row


def _groups(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of sorted rows in portions of about ``rows`` that end where a run of equal values of ``column`` ends; true if the portion
    is a part of one run that is longer than that."""
    held: list[list[np.ndarray]] = []
    count, going = 0, None
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count < rows:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        by = whole[column]
        last = int(np.searchsorted(by, by[-1]))
        if last:
            if going is not None and by[0] == going:
                stop = int(np.searchsorted(by, going, side="right"))
                yield [c[:stop] for c in whole], True
                whole, last = [c[stop:] for c in whole], last - stop
            if last > 0:
                yield [c[:last] for c in whole], False
            held, count, going = [[c[max(last, 0) :] for c in whole]], count, None
            count = len(held[0][0])
        else:
            going = by[0]
            yield whole, True
            held, count = [], 0
    if held and count:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        if going is not None and whole[column][0] == going:
            stop = int(np.searchsorted(whole[column], going, side="right"))
            yield [c[:stop] for c in whole], True
            whole = [c[stop:] for c in whole]
        if len(whole[0]):
            yield whole, False


def shared(rows: DataFrame, seed: int) -> DataFrame:
    """(sig, node, weight, others) of rows (sig, node, weight): the buckets of two nodes or more, those with equal members merged.

    Buckets are dealt out by sig and told apart in sorted order, in a stream; a task packs each bucket's
    nodes into one value and merges equal ones before anything is shuffled again.  A bucket of more than ``BUCKET_ROWS`` rows goes on in parts under its own sig.
    ``others`` says in which of 64 cells, by the node's hash with ``seed``, the bucket has another node.
    """

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, node, weight), part in _groups(batches, 0, BUCKET_ROWS):
            yield packed(sig, node, weight, part)
            del sig, node, weight
        give_back()

    def packed(sig: np.ndarray, node: np.ndarray, weight: np.ndarray, part: bool) -> pa.RecordBatch:
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, weight = sig[new], node[new], weight[new]
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(edge, len(sig)))
        keep = (size > 1) | part
        one, two = (np.add.reduceat(mix(node.view(np.uint64) ^ x), edge) for x in (_SINGLE, _PAIR))
        edge, size, one, two = edge[keep], size[keep], one[keep], two[keep]
        order = np.lexsort((size, two, one))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(x[order].view(np.int64)) != 0 for x in (one, two, size)], axis=0)
        starts = np.flatnonzero(new)
        pick = order[starts]
        weights = np.add.reduceat(weight[edge][order], starts) if len(starts) else np.zeros(0, np.int64)
        data = [node[a : a + n].tobytes() for a, n in zip(edge[pick].tolist(), size[pick].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(sig[edge[pick]], mask=np.full(len(pick), not part)), pa.array(data, pa.binary()), pa.array(weights.astype(np.int64))], names=["sig", "nodes", "weight"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in nodes])
            node, bucket = np.frombuffer(b"".join(nodes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
            cell = mix(node.view(np.uint64) ^ np.uint64(seed)) & np.uint64(63)
            place = bucket.astype(np.uint64) * np.uint64(64) + cell
            found, at, count = np.unique(place, return_inverse=True, return_counts=True)
            bits = np.uint64(1) << (found & np.uint64(63))
            every = np.bitwise_or.reduceat(bits, np.searchsorted(found >> np.uint64(6), np.arange(len(sizes)).astype(np.uint64)))
            others = every[bucket] ^ np.where(count[at] > 1, np.uint64(0), np.uint64(1) << cell)
            others[batch.column(3).to_numpy(zero_copy_only=False)[bucket]] = ~np.uint64(0)  # a part of a bucket: the rest is unknown
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(node), pa.array(np.repeat(batch.column(2).to_numpy(), sizes)), pa.array(others.view(np.int64))], names=["sig", "node", "weight", "others"])

    buckets = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(packs, "sig long, nodes binary, weight long")
    merged = buckets.groupBy("sig", "nodes").agg(F.sum("weight").alias("weight"))
    # Two buckets that fell on one number would only be searched together.
    merged = merged.select(F.coalesce("sig", F.xxhash64("nodes")).alias("sig"), "nodes", "weight", F.col("sig").isNotNull().alias("part"))
    return merged.mapInArrow(spread, "sig long, node long, weight long, others long")


def linkable(rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, node, weight) of the nodes whose buckets weigh enough for a link with nodes of one cell: what a node has in common with many others, a little with each, is spread over the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, node, weight, others, first), part in _groups(batches, 1, CELL_ROWS):
            if part:  # more signatures than a portion has rows: it stays
                yield rows_of(sig[~first], node[~first], weight[~first])
                continue
            edge = np.flatnonzero(first)  # a node's first row has its size
            need = np.array([_least_of(n, num, den) for n in sig[edge].tolist()])
            bits = np.unpackbits(others.view(np.uint8).reshape(-1, 8), axis=1)
            held = np.add.reduceat(bits * np.minimum(weight, 1 << 20).astype(np.int32)[:, None], edge, axis=0, dtype=np.int64).max(1) if len(edge) else np.zeros(0)
            keep = np.repeat(held >= need, np.diff(np.append(edge, len(sig)))) & ~first
            yield rows_of(sig[keep], node[keep], weight[keep])
            del sig, node, weight, others, first, bits, held, keep
        give_back()

    def rows_of(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "node", "weight"])

    sizes = nodes.select(F.col("size").cast("long").alias("sig"), "node", F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("others"), F.lit(True).alias("first"))
    both = rows.withColumn("first", F.lit(False)).unionByName(sizes)
    return both.repartition("node").sortWithinPartitions("node", F.desc("first")).mapInArrow(run, "sig long, node long, weight long")


def shared_pairs(rows: DataFrame) -> DataFrame:
    """(sig, node, weight, others): the buckets of two nodes or more of pairs of frequent tokens, those with equal members merged.

    They can be huge, so they are counted by partial aggregation and joined: a large bucket can be split.
    """
    pairs = materialise(rows.distinct(), "pairs")
    by_sig = pairs.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    kept = materialise(by_sig.groupBy("n", "x", "y", "a", "b").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "weight"), "kept")
    return pairs.join(kept, "sig").withColumn("others", F.lit(-1).cast("long"))


def candidates(documents: DataFrame, sketch: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, node, weight) of the nodes whose buckets weigh enough for a link, and of the buckets that two such nodes or more have."""
    spark = documents.sparkSession
    singles, pairs = all_signatures(documents, sketch, k, num, den)
    found = materialise(shared(singles.withColumn("weight", F.lit(1).cast("long")), 0).unionByName(shared_pairs(pairs)), "found")
    del singles, pairs
    release(spark)
    for seed in (1, 2):  # with fewer nodes the buckets weigh less, and other cells tell others apart
        left = materialise(linkable(found, nodes, num, den), "left")
        discard(found)
        found = materialise(shared(left, seed), "found")
        discard(left)
        release(spark)
    return found.drop("others")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(node, block): nodes in the order of their groups, BLOCK to a block whatever the number of partitions."""
    spark = nodes.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part)), pa.array(ids)], names=["node", "part", "place"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = nodes.repartitionByRange(parts, "group", "node").sortWithinPartitions("group", "node")
    numbered = materialise(ordered.select("node").mapInArrow(number, "node long, part long, place long"), "numbered")
    starts, total = [], 0
    for row in sorted(numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):  # one row per partition
        starts.append((row["part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "part long, first long")
    return numbered.join(F.broadcast(offsets), "part").select("node", F.floor((F.col("first") + F.col("place")) / BLOCK).alias("block"))


def shared_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share."""
    n = len(tokens)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    flat = np.concatenate(tokens) if n else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.diff(flat, prepend=flat[:1] ^ np.uint64(1)))
    count = np.diff(np.append(edge, len(flat)))
    shared = np.zeros(n * n, np.int32)
    for c in range(2, 33):  # tokens of few sets: count their pairs
        at = edge[count == c]
        if len(at):
            who = owner[at[:, None] + np.arange(c)]
            a, b = np.triu_indices(c, 1)
            step = 1 + 1_000_000 // len(a)
            for i in range(0, len(who), step):
                part = who[i : i + step]
                pair, times = np.unique((part[:, a] * n + part[:, b]).ravel(), return_counts=True)
                shared[pair] += times.astype(np.int32)
    shared = shared.reshape(n, n)
    shared += shared.T.copy()
    often = np.flatnonzero(count > 32)
    for i in range(0, len(often), 2048):  # tokens of many sets: a product of 0/1 matrices
        some = often[i : i + 2048]
        column = np.repeat(np.arange(len(some)), count[some])
        row = owner[np.repeat(edge[some], count[some]) + np.arange(len(column)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])]
        one = np.zeros((n, len(some)), np.float32)
        one[row, column] = 1
        shared += (one @ one.T).astype(np.int32)
    return shared


def links(sizes: np.ndarray, tokens: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The matrix of links between sets: den * shared >= num * union, counted exactly."""
    shared = shared_counts(tokens)
    union = sizes[:, None] + sizes[None, :] - shared
    out = (den * shared >= num * union) & (shared > 0)
    np.fill_diagonal(out, False)
    return out


def components(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each."""
    label = np.arange(len(adjacent))
    while True:
        best = np.minimum(label, np.where(adjacent, label[None, :], len(adjacent)).min(1, initial=len(adjacent)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _verify(tiles: DataFrame, sizes: DataFrame, blobs: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root, degree) per tile of rows (one, two, node, block): root is the smallest node of the node's component in the tile, degree its links counted in copies."""

    def run(group: pa.Table) -> pa.Table:
        one, two = group["one"][0].as_py(), group["two"][0].as_py()
        node, where = np.unique(group["node"].to_numpy(), return_index=True)
        tokens = [_unpack(group["blob"][int(i)].as_py()) for i in where]
        block, copies = group["block"].to_numpy()[where], group["copies"].to_numpy()[where]
        adjacent = links(np.array([len(t) for t in tokens]), tokens, num, den)
        if one != two:  # pairs inside a block belong to that block's own tile
            adjacent &= block[:, None] != block[None, :]
        found = adjacent.any(1)
        give_back()
        root, degree = node[components(adjacent)], adjacent @ copies
        return pa.table({"node": node[found], "root": root[found], "degree": degree[found]})

    wanted = only_slots(blobs, "node", tiles)
    return tiles.join(sizes.select("node", "copies"), "node").join(wanted, "node").groupBy("one", "two").applyInArrow(run, "node long, root long, degree long")


def spread_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (node, root); minima pass both ways, then labels jump to their label's label."""
    both = materialise(edges.select("node", "root").unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct(), "both")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("root"), "label"), "root").groupBy("node").agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialise(near.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new.drop("old")
        labels.veritrail_path = new.veritrail_path
        if not moved:
            discard(both)
            return labels


LARGE = 256


def _laid(found: DataFrame) -> DataFrame:
    """(sig, node, weight, block): the candidates in blocks of neighbours.

    Each node follows the smallest node of the bucket that counts most (weight times members), and that one's, three times over.
    """
    bucket = found.groupBy("sig").agg(F.min("node").alias("group"), F.count("*").alias("n"))
    best = F.max(F.struct((F.col("weight") * F.col("n")).alias("much"), "group"))
    lead = materialise(found.join(bucket, "sig").groupBy("node").agg(best.alias("best")).select("node", F.col("best.group").alias("group")), "lead")
    next_ = lead.select(F.col("node").alias("group"), F.col("group").alias("far"))
    group = lead
    for _ in range(3):
        group = group.join(next_, "group").select("node", F.col("far").alias("group"))
    block = materialise(_blocks(group), "blocks")
    out = materialise(found.join(block, "node"), "laid")
    for done in (lead, block):
        discard(done)
    return out


def _own(laid: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The tiles of blocks with themselves: the nodes whose buckets in common with others of their block weigh enough for a link."""
    several = laid.groupBy("sig", "block").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("sig", "block")
    held = laid.join(several, ["sig", "block"]).groupBy("node", "block").agg(F.sum("weight").alias("held")).join(sizes.select("node", "size"), "node")
    return held.where(F.col("held") >= _least("size", num, den)).select(F.col("block").alias("one"), F.col("block").alias("two"), "node", "block")


def _between(laid: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The tiles of two blocks with a common bucket: the nodes whose buckets in common with the other block, as far as that has members of a ``class`` other
    than the node's, weigh enough for a link."""
    spans = laid.groupBy("sig").agg(F.min("block").alias("a"), F.max("block").alias("b"), F.min("class").alias("c"), F.max("class").alias("d"), F.count("*").alias("n")).where("a <> b and c <> d").select("sig", "n")
    wide = laid.join(spans, "sig")
    enough = wide.groupBy("node").agg(F.sum("weight").alias("held")).join(sizes.select("node", "size"), "node").withColumn("least", _least("size", num, den)).where("held >= least").select("node", "least")
    wide = materialise(wide.join(enough, "node"), "wide")
    there = wide.groupBy("sig", "block").agg(F.min("class").alias("low"), F.max("class").alias("high")).select("sig", F.col("block").alias("other"), "low", "high")
    # Of a node's buckets the largest, up to half of the weight that a link needs, are left out and taken off the need.
    order = W.partitionBy("node").orderBy(F.desc("n"), "sig")
    led = wide.withColumn("sum", F.sum("weight").over(order)).withColumn("out", F.col("sum") * 2 < F.col("least"))
    led = led.withColumn("need", F.col("least") - F.coalesce(F.max(F.when(F.col("out"), F.col("sum"))).over(W.partitionBy("node")), F.lit(0))).where("not out")
    met = led.join(there, "sig").where("block <> other and (low <> class or high <> class)")
    members = met.groupBy("node", "block", "other").agg(F.sum("weight").alias("held"), F.max("need").alias("need")).where("held >= need")
    return members.select(F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "block")


def _heads(laid: DataFrame) -> DataFrame:
    """Tiles of the first and last members of large components in the buckets that several of them have, up to ``BLOCK`` at a time."""
    large = laid.select("node", "class").distinct().groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("class")
    ends = laid.groupBy("sig", "class").agg(F.min("node").alias("a"), F.max("node").alias("b")).join(large, "class")
    by_sig = ends.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("n > 1")
    kept = by_sig.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "n")
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") * 2 / BLOCK))
    nodes = ends.join(kept, "sig").select("sig", part.alias("part"), F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.select(F.col("sig").alias("one"), F.col("part").alias("two"), "node", F.col("node").alias("block"))


def _classed(laid: DataFrame, labels: DataFrame) -> DataFrame:
    """``laid`` with each node's ``class``: its label, or the node itself."""
    return laid.join(labels.withColumnRenamed("label", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))


def _edges(laid: DataFrame, blobs: DataFrame, sizes: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """(node, root, degree): edges that connect each component, and each node's links if ``every`` pair is compared."""
    found = materialise(_verify(materialise(_own(laid, sizes, num, den), "tiles"), sizes, blobs, num, den), "edges")
    release(laid.sparkSession)
    rounds = [found]
    if not every:
        for tiles in (_heads, lambda rows: _between(rows, sizes, num, den)):
            labels = spread_labels(found.where("node <> root"))
            classed = materialise(_classed(laid, labels), "classed")
            rounds.append(materialise(_verify(materialise(tiles(classed), "tiles"), sizes, blobs, num, den), "edges"))
            for done in (labels, classed):
                discard(done)
            release(laid.sparkSession)
            found = found.unionByName(rounds[-1])
        return found
    tiles = materialise(_between(laid.withColumn("class", F.col("node")), sizes, num, den), "tiles")
    return found.unionByName(materialise(_verify(tiles, sizes, blobs, num, den), "edges"))


def near_components(documents: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", links: bool = True, mark: Column | None = None) -> DataFrame:
    """Per document: the key, ``n_shingles``, ``component_id`` and, with ``links``, ``n_links`` (documents linked to it, copies counted).

    Two documents link when 100 * shared >= percent * union over their distinct k-word shingles.  With ``mark``, a long, the rows have it as
    ``mark`` and the component's own number as ``class`` (null without words): for tables in which a key may occur twice.
    """
    if not 51 <= percent <= 100:
        raise ValueError("percent must be from 51 to 100")
    num, den, spark = percent, 100, documents.sparkSession
    documents = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), (F.lit(None) if mark is None else mark).cast("long").alias("mark"))
    sketch = materialise(_sketch(documents, k, num, den), "sketch")
    sets = sketch.where("size >= 0").select("key", "node", "size", "mark")
    nodes = materialise(sets.where("size > 0").groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("size").alias("size")), "nodes")
    laid = _laid(candidates(documents, sketch, nodes, k, num, den))
    release(spark)
    stands = materialise(nodes.join(laid.select("node").distinct(), "node"), "stands")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, begin, node = token_sets(batch.column(0), k)
            blobs = [_pack(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(blobs, pa.binary())], names=["node", "blob"])

    # A text too many, or twice, does no harm: tiles name the nodes they want.
    blobs = materialise(only_slots(documents, "key", stands).select("text").mapInArrow(tokens, "node long, blob binary"), "blobs")
    edges = _edges(laid, blobs, stands.select("node", "size", "copies"), num, den, links)
    discard(blobs)
    labels = spread_labels(edges.where("node <> root"))
    degrees = edges.groupBy("node").agg(F.sum("degree").alias("degree"))
    tagged = materialise(_classed(nodes, labels).join(degrees, "node", "left"), "tagged")
    lowest = materialise(tagged.groupBy("class").agg(F.min("key").alias("component_id")), "lowest")  # a table of its own: a join with it can split a large class
    n_links = (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")
    per_node = materialise(tagged.join(lowest, "class").select("node", "class", "component_id", n_links), "classes")
    result = sets.join(per_node, "node", "left").select(
        F.col("key").alias(key),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        *[F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * links,
        *["mark", "class"] * (mark is not None),
    )
    result = materialise(result, "components")
    for done in (sketch, nodes, laid, stands, labels, tagged, lowest, per_node):
        discard(done)
    release(spark)
    return result


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
