"""Byte-level BPE by speculation: propose greedily, verify all adjacent pairs at once, merge only what fails.

1. A text is cut into words by the tokenizer's own pattern (special tokens first).
2. Speculate: each distinct word is covered from the left by the longest vocabulary entries.
3. Verify: a token sequence is what the merges give if and only if every token is what the merges give for its own bytes and no merge
   of lower rank crosses any border between neighbours.  All borders of all new words are tested in one
   vectorised descent through the merge tree; the verdict per pair of tokens is remembered.
4. Only words with a failing border, or a token that merges do not reach, undergo exact merging.

The proof of 3 needs that ids grow with merge ranks; the loader checks that and otherwise sends every word to exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import give_back, slices

# The pattern that splits text before the merges of byte-level vocabularies: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.iinfo(np.int64).max
SHORT = 32  # bytes up to which failing words are merged together, in numpy
CACHE_WORDS = 200_000
CACHE_PAIRS = 100_000
CACHE_CHARS = 64  # longer words are encoded but not remembered, so the memory is bounded


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = _alphabet()
        model = spec["model"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        size = max(self.bytes_of) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = (rank, new)
            if self.left[new] == new:
                self.left[new], self.right[new] = vocab[a], vocab[b]
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        made = np.array([x[1] for x in self.rank.values()], np.int64)
        order = np.argsort(keys)
        self._keys, self._made = keys[order], made[order]
        self.ordered = bool((np.diff(made) > 0).all()) and len(self.rank) == len(model["merges"])
        self.longest = max((len(b) for i, b in self.bytes_of.items() if i not in set(self.special.values())), default=1)
        self._by_two: dict[bytes, int] = {}
        for b in self.id_of:
            if len(b) > 1:
                self._by_two[b[:2]] = max(self._by_two.get(b[:2], 0), len(b))
        self.words = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._seen: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self.whole: set[int] = set()
        if self.ordered:
            self.whole = {i for b, i in self.id_of.items() if self.merge(b) == [i]}
        self.stats = {"words": 0, "merged": 0}
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self._at = np.concatenate([[0], np.cumsum(lengths)])
        self._flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging with a heap: n log n in the word's length."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := self.rank.get((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[j]], r[1]))
            if before[i] >= 0 and (r := self.rank.get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], new, r[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that merging a and b makes, or a huge number; ids stand for ranks here."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._made[at], _NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words at once: each round does the best merge of every word."""
        if not words:
            return []
        width = max(map(len, words))
        sizes = np.array([len(w) for w in words])
        single = np.array([self.id_of[bytes((i,))] for i in range(256)])
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < sizes[:, None]] = single[np.frombuffer(b"".join(words), np.uint8)]
        made = self.lookup(ids[:, :-1], ids[:, 1:])
        columns, done, live = np.arange(width + 1), [None] * len(words), np.arange(len(words))
        while len(live):
            at = made.argmin(1)
            best = made[np.arange(len(live)), at]
            going = best < _NEVER
            for i, row in zip(live[~going].tolist(), ids[~going].tolist(), strict=True):
                done[i] = row[: row.index(-1)]
            live, ids, made, at, best = live[going], ids[going], made[going], at[going], best[going]
            if not len(live):
                break
            rows = np.arange(len(live))
            ids = ids[rows[:, None], np.minimum(columns + (columns > at[:, None]), width)]
            ids[:, width] = -1
            ids[rows, at] = best
            made = made[rows[:, None], np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 1)]
            made[rows, at] = self.lookup(best, ids[rows, at + 1])
            before = np.maximum(at - 1, 0)
            made[rows, before] = np.where(at > 0, self.lookup(ids[rows, before], best), made[rows, before])
        return done

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        if (whole := self.id_of.get(word)) is not None:
            return [whole]
        out, at, n, get, longest = [], 0, len(word), self.id_of.get, self._by_two.get
        while at < n:
            stop = min(n, at + longest(word[at : at + 2], 1))
            while (found := get(word[at:stop])) is None:
                stop -= 1
            out.append(found)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between tokens a and b, for arrays of pairs.

        Undo the merges of both tokens from the latest on; at each step the two tokens at the border must not have a
        merge of a rank below that of the last merge undone.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            crossing = (self._keys[at] == key) & (self._made[at] < most)
            good[live[crossing]] = False
            live, x, y, most = live[~crossing], x[~crossing], y[~crossing], most[~crossing]
            # Of equal ids the left one merged first, so the right one is undone first.
            can_a, can_b = self.left[x] != x, self.left[y] != y
            undo_a = can_a & (~can_b | (x > y))
            undo_b = can_b & ~undo_a
            limit[live[undo_a]] = x[undo_a]
            limit[live[undo_b]] = y[undo_b] + 1
            a[live[undo_a]] = self.right[x[undo_a]]
            b[live[undo_b]] = self.left[y[undo_b]]
            live = live[undo_a | undo_b]
        return good

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, each as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        self.stats["words"] += len(raw)
        if not self.ordered:
            return {w: np.array(self.merge(r), "<u4").tobytes() for w, r in zip(words, raw, strict=True)}
        proposed = [self.propose(r) for r in raw]
        flat = np.fromiter((t for p in proposed for t in p), np.int64)
        ends = np.cumsum([len(p) for p in proposed])
        inner = np.ones(max(0, len(flat) - 1), bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        keys = flat[at] << 32 | flat[at + 1]
        distinct, back = np.unique(keys, return_inverse=True)
        known = [self._pairs.get(k) for k in distinct.tolist()]
        unknown = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        verdict = np.array([bool(k) for k in known], bool)
        if len(unknown):
            ask = distinct[unknown]
            verdict[unknown] = self.compatible(ask >> 32, ask & 0xFFFFFFFF)
            if len(self._pairs) + len(ask) > CACHE_PAIRS:
                self._pairs.clear()
            self._pairs.update(zip(ask.tolist(), verdict[unknown].tolist(), strict=True))
        owner = np.searchsorted(ends, at, side="right")
        failed = np.zeros(len(words), bool)
        failed[owner[~verdict[back]]] = True
        data, start, out = flat.astype("<u4").tobytes(), 0, {}
        again: list[int] = []
        for i, (w, p) in enumerate(zip(words, proposed, strict=True)):
            stop = start + 4 * len(p)
            if failed[i] or not self.whole.issuperset(p):
                again.append(i)
            else:
                out[w] = data[start:stop]
            start = stop
        self.stats["merged"] += len(again)
        short = sorted((i for i in again if len(raw[i]) <= SHORT), key=lambda i: len(raw[i]))
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            for i, ids in zip(part, self.merge_all([raw[i] for i in part]), strict=True):
                out[words[i]] = struct.pack(f"<{len(ids)}I", *ids)
        for i in again:
            if len(raw[i]) > SHORT:
                out[words[i]] = np.array(self.merge(raw[i]), "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        find, special = self.words.findall, {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        pieces = []
        for text in texts:
            if self._cut is not None and any(s in text for s in special):
                pieces.append([x for part in self._cut.split(text) for x in ([part] if part in special else find(part))])
            else:
                pieces.append(find(text))
        distinct = set().union(*pieces)
        new = [w for w in distinct if w not in self._seen and w not in special]
        fresh = self.learn(new) if new else {}
        if len(self._seen) + len(fresh) > CACHE_WORDS:
            table = {w: self._seen[w] for w in distinct if w in self._seen} | fresh | special
            self._seen = {w: v for w, v in table.items() if len(w) <= CACHE_CHARS and w not in special} if len(table) <= CACHE_WORDS else {}  # start again with this batch's words
        else:
            self._seen.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_CHARS)
            long = {w: v for w, v in fresh.items() if len(w) > CACHE_CHARS}
            table = self._seen if not long and not (special.keys() & distinct) else {w: self._seen[w] for w in distinct if w in self._seen} | long | special
        look = table.__getitem__
        return [b"".join(map(look, p)) for p in pieces]

    def forget(self) -> None:
        """Drop the words held so far: workers outlive tasks and stages, and their memory is the executor's."""
        self._seen = {}
        give_back()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, read from the flat table of all tokens."""
        which = np.frombuffer(ids, "<u4")
        begin, size = self._at[which], self._at[which + 1] - self._at[which]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        place = np.arange(ends[-1])
        place += np.repeat(begin - (ends - size), size)
        return self._flat[place].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_columns(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encode every whole text with the vocabulary file at ``path`` (on every executor) and decode it again.

    One row per input row: the key, ``n_tokens``, the SHA-256 of the ids and of the decoded text, and with ``ids`` the ids.
    A null text is empty: no tokens.  Other columns of the input are left out, so their names cannot clash.
    """
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in slices(batches, 1 << 20):
            encoded = tool.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            arrays = [
                batch.column(0),
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array([hashlib.sha256(tool.decode(e).encode()).hexdigest() for e in encoded], pa.string()),
            ]
            if ids:
                arrays.append(pa.array([np.frombuffer(e, "<i4") for e in encoded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
        tool.forget()

    return documents.select(key, text).mapInArrow(run, schema)
