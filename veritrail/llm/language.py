"""Language identification with spans.

Training: per language, hashed counts of character 2-, 3- and 4-grams inside words, taken from at most ``TRAIN_DOCS``
labelled documents of a language (chosen by hash, so reruns agree); the model is a fixed-size table per language.

Prediction: script ranges narrow each word's candidate languages; the word's score under a candidate is
its n-grams' log likelihood, averaged over the orders; Viterbi over the words with a penalty for switching gives spans.  A
single-language path is accepted without the recursion when no run of words could pay for leaving it, which is
the same result.  The document's label is the language of most letters.

Defined results: null text or text without a letter is ``und`` with score 0 and no spans; a document whose letters are all in
scripts no learned language uses gets the most frequent learned language with score 0; equal texts get equal labels.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .words import mix

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
TRAIN_DOCS = 4000
SWITCH = 14.0
WORD_LIMIT = 12.0
UNKNOWN = "und"
SLICE = 1 << 19  # bytes of texts taken at once: a byte has n-grams of three orders, with some hundred bytes of arrays

# Script ranges: fixed values of the Unicode blocks, first and last code point.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
}
NAMES = tuple(SCRIPTS)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its script's number (0: other)."""
    if not _TABLES:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.int8)
        for i, name in enumerate(NAMES):
            for a, b in SCRIPTS[name]:
                script[a : b + 1] = i + 1
        _TABLES.update(letter=letter, script=script)
    return _TABLES["letter"], _TABLES["script"]


class Letters:
    """The words (runs of letters) of a batch: first letters, lengths, texts' first words, scripts and hashed n-grams."""

    def __init__(self, texts: list[str | None]):
        letter, script = _tables()
        lowered = [t.lower() if t else "" for t in texts]
        lengths = np.array([len(t) + 1 for t in lowered])
        code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter[code]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.bounds)
        self.script = script[code[self.start]].astype(np.int64)
        self.code = np.where(inside, code, np.uint32(32)).astype(np.uint64)
        self.inside = inside

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct word, and for every word which of them it is; words are told apart by 64-bit hashes."""
        size = self.end - self.start
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        power = np.full(int(size.max(initial=1)), np.uint64(0x9E3779B97F4A7C15))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        part = mix(self.code[place + self.start[word]]) * power[place]
        _, at, back = np.unique(np.add.reduceat(part, np.cumsum(size) - size), return_index=True, return_inverse=True)
        return at, back

    def grams(self, order: int, words: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The bucket and the word (by its place in ``words``) of every n-gram of this order that crosses no word; a word is read with a blank at either end."""
        start, end = self.start[words], self.end[words]
        size = end - start
        number = np.maximum(size + 2 - order + 1, 1)
        word = np.repeat(np.arange(len(size)), number)
        at = np.arange(len(word)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(start - 1, number)
        h = np.full(len(at), order, np.uint64)
        last = np.repeat(end, number)
        for j in range(order):
            p = np.minimum(at + j, last)
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(p < 0, np.uint64(32), self.code[np.maximum(p, 0)]) + np.uint64(1)
        return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), word


def gram_counts(batches: Iterator[pa.RecordBatch], langs: list[str]) -> pa.RecordBatch:
    """(g, slot, n) of all rows (language, text): how often each language, by its place, has the n-grams of each bucket and the letters of each script."""
    index = {g: i for i, g in enumerate(langs)}
    tables = np.zeros((len(langs), len(ORDERS), BUCKETS), np.int64)
    letters = np.zeros((len(langs), len(NAMES) + 1), np.int64)
    for batch in slices(batches, SLICE):
        labels = np.array([index[g] for g in batch.column(0).to_pylist()])
        w = Letters(batch.column(1).to_pylist())
        owner = labels[np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1]
        np.add.at(letters, (owner, w.script), w.end - w.start)
        for o, order in enumerate(ORDERS):
            bucket, word = w.grams(order)
            tables[:, o] += np.bincount(owner[word] * BUCKETS + bucket, minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
    flat = np.concatenate([tables.reshape(len(langs), -1), letters], axis=1)
    which, slot = np.nonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(slot, pa.int32()), pa.array(flat[which, slot], pa.int64())], names=["g", "slot", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = TRAIN_DOCS) -> bytes:
    """A model from at most about ``most`` documents of each non-null language: a pickled dict of fixed-size tables."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).where("g is not null and t is not null")
    share = {r["g"]: min(1.0, most / r["n"]) for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not share:
        return pickle.dumps({"langs": [], "tables": None})
    langs = sorted(share)
    place = F.pmod(F.xxhash64("k", F.lit("train")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    limit = F.coalesce(*[F.when(F.col("g") == g, F.lit(s)) for g, s in share.items()])
    chosen = rows.where(place < limit).select("g", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield gram_counts(batches, langs)

    summed = chosen.mapInArrow(count, "g int, slot int, n long").groupBy("g", "slot").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros((len(langs), len(ORDERS) * BUCKETS + len(NAMES) + 1))
    flat[summed["g"].to_numpy(), summed["slot"].to_numpy()] = summed["n"].to_numpy()
    letters = flat[:, len(ORDERS) * BUCKETS :]
    counts = flat[:, : len(ORDERS) * BUCKETS].reshape(len(langs), len(ORDERS), BUCKETS) + 0.5
    tables = np.log(counts / counts.sum(2, keepdims=True)) / len(ORDERS)
    scripts = letters >= 0.01 * np.maximum(letters.sum(1, keepdims=True), 1)
    return pickle.dumps({"langs": langs, "tables": np.ascontiguousarray(tables.transpose(1, 2, 0).astype(np.float32)), "scripts": scripts, "common": int(letters.sum(1).argmax())})


def word_scores(w: Letters, model: dict) -> np.ndarray:
    """Log likelihood per word and language, at most WORD_LIMIT below the word's best; no script of the word's candidates: all 0."""
    at, back = w.distinct()
    scores = np.zeros((len(at), len(model["langs"])), np.float64)
    for o, order in enumerate(ORDERS):
        bucket, word = w.grams(order, at)
        found = model["tables"][o][bucket]
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        scores += np.add.reduceat(found, begin, axis=0)
    allowed = model["scripts"][:, w.script[at]].T
    scores = np.where(allowed, scores, -np.inf)
    best = scores.max(1, keepdims=True)
    return np.where(np.isfinite(best), np.maximum(scores - np.where(np.isfinite(best), best, 0), -WORD_LIMIT), 0.0)[back]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, with a penalty for each change; of equal paths the one that stays, then the first language."""
    n, k = scores.shape
    rows = scores.tolist()
    value, back = rows[0][:], []
    for row in rows[1:]:
        top = max(value)
        lead = value.index(top)
        into = [j if value[j] >= top - switch else lead for j in range(k)]
        value = [row[j] + (value[j] if into[j] == j else top - switch) for j in range(k)]
        back.append(into)
    state = value.index(max(value))
    path = [state]
    for into in reversed(back):
        state = into[state]
        path.append(state)
    return np.array(path[::-1])


def label(texts: list[str | None], model: dict, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text its language, a score from 0 to 1 and its spans (start, end, language) in code points of the lower-cased text."""
    w = Letters(texts)
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    langs = model["langs"]
    if not len(w.start) or not langs:
        return out
    scores = word_scores(w, model)
    known = scores.any(1) if len(langs) > 1 else model["scripts"][0][w.script]
    full = np.flatnonzero(np.diff(w.first))
    begin, number = w.first[full], np.diff(w.first)[full]
    total = np.add.reduceat(scores, begin, axis=0)
    best = total.argmax(1)
    mine = np.repeat(best, number)
    rest = scores.copy()
    rest[np.arange(len(rest)), mine] = -np.inf
    gain = (rest.max(1) if len(langs) > 1 else np.full(len(rest), -WORD_LIMIT)) - scores[np.arange(len(rest)), mine]
    size = w.end - w.start
    for i, doc in enumerate(full.tolist()):
        a, b = begin[i], begin[i] + number[i]
        sums = np.cumsum(gain[a:b])
        low = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        if (sums - low).max() <= switch:  # no run of words gains more than one switch costs
            path = None
            weight = np.zeros(len(langs))
            weight[best[i]] = size[a:b].sum()
        else:
            path = viterbi(scores[a:b], switch)
            weight = np.bincount(path, size[a:b], minlength=len(langs))
        lead = int(weight.argmax())
        sure = known[a:b]
        if not sure.any():
            out[doc] = (langs[model["common"]], 0.0, [])
            continue
        lengths = size[a:b]
        margin = -float(np.where(np.arange(len(langs)) == lead, -np.inf, (scores[a:b] - scores[a:b, lead : lead + 1])[path == lead if path is not None else slice(None)].sum(0)).max()) if len(langs) > 1 else WORD_LIMIT
        score = float(weight[lead] / weight.sum() * lengths[sure].sum() / lengths.sum() * (1 - 0.5 * np.exp(-max(0.0, margin))))
        base = w.bounds[doc]
        if path is None:
            spans = [(int(w.start[a] - base), int(w.end[b - 1] - base), langs[lead])]
        else:
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = [(int(w.start[a + x] - base), int(w.end[a + y - 1] - base), langs[path[x]]) for x, y in zip(cuts, cuts[1:], strict=False)]
        out[doc] = (langs[lead], min(1.0, max(0.0, score)), spans)
    return out


def language_columns(documents: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The columns in ``keep`` (default all) with ``lang_pred``, ``score`` and, if asked for, ``lang_spans``, in place of any columns of these names."""
    added = ["lang_pred", "score", *["lang_spans"] * spans]
    names = [c for c in (documents.columns if keep is None else keep) if c not in added]
    source = documents.select(*names, F.col(text).alias("__veritrail_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "lang_pred string", "score double", *["lang_spans array<struct<start:long,end:long,lang:string>>"] * spans])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in slices(batches, SLICE):
            found = label(batch.column(batch.num_columns - 1).to_pylist(), known)
            arrays = [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                arrays.append(pa.array([[{"start": a, "end": b, "lang": g} for a, b, g in x[2]] for x in found], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    return source.mapInArrow(run, schema)


def held_out(key) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
