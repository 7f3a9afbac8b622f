"""Retrieval queries: benchmark items are claims, documents are passages, embeddings are vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding as B
from ..operators import lineage as L
from ..operators import retrieval as R
from .base import Plans

plans = Plans()
_TOKENS = r"regexp_extract_all(lower(text), 'mmol/l|mg/dl|[0-9]*[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*|[0-9]+(?:[.,][0-9]+)*|<=|>=|[<>≤≥%]')"
_BM25 = f"""
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
cut AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM cut),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM cut) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
lexical AS (
  SELECT q.item_id, tf.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.2 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN corpus GROUP BY 1, 2)"""
_TOP = "SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {k}) AS rank FROM {t}"
_COSINE = """
unit AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings),
semantic AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] / a.norm * (b.v[i] / b.norm))), 6) AS score
  FROM unit a CROSS JOIN unit b WHERE a.vec_id % 20 = 0)"""


def _lexical(t):
    return R.bm25_scores(t("benchmark"), t("documents"), "item_id", "text", "doc_id", "text")


def _semantic(t, search=R.nearest):
    vectors = t("embeddings")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # the stated query set of searches
    return search(asked, vectors, "query_id", "vec_id", "embedding")


_APART = {"é": "e\u0301", "è": "e\u0300", "ó": "o\u0301", "ñ": "n\u0303", "ü": "u\u0308", "ç": "c\u0327", "ê": "e\u0302"}  # letters taken apart, to be composed again


@plans.add(f"SELECT item_id, i AS place, t[i] AS token FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)")
def lexical_tokens(t):
    apart = F.reduce(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in _APART.items()]), F.col("text"), lambda text, x: F.replace(text, x["c"], x["d"]))
    return t("benchmark").select("item_id", T.nfc(apart).alias("text")).select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "token")).select("item_id", (F.col("p") + 1).cast("long").alias("place"), "token")


@plans.add(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1")
def bm25_index(t):
    return R.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@plans.add(f"WITH {_BM25}, top AS ({_TOP.format(q='item_id', k='doc_id', t='lexical')}) SELECT item_id, doc_id, score, rank FROM top WHERE rank <= 50")
def bm25_topk(t):
    return R.top_k(_lexical(t), "item_id", "doc_id").select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@plans.add(
    f"""WITH {_BM25}, top AS ({_TOP.format(q='item_id', k='doc_id', t='lexical')})
SELECT item_id, (SELECT count(*) FROM documents) AS scored, count(*) AS eligible, greatest(count(*) - 50, 0) AS omitted,
  coalesce(max(CASE WHEN rank = 50 THEN score END) = max(CASE WHEN rank = 51 THEN score END), false) AS tied_at_boundary FROM top GROUP BY 1"""
)
def bm25_path_trace(t):
    return R.path_trace(_lexical(t), "item_id", "doc_id", F.lit(t("documents").count()).cast("long"))


@plans.add(f"WITH {_COSINE}, top AS ({_TOP.format(q='query_id', k='vec_id', t='semantic')}) SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 50")
def cosine_topk(t):
    return _semantic(t).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@plans.add(
    f"""WITH {_COSINE}, top AS ({_TOP.format(q='query_id', k='vec_id', t='semantic')})
SELECT query_id, count(*) AS scored, count(*) AS eligible, greatest(count(*) - 50, 0) AS omitted,
  coalesce(max(CASE WHEN rank = 50 THEN score END) = max(CASE WHEN rank = 51 THEN score END), false) AS tied_at_boundary FROM top GROUP BY 1"""
)
def semantic_path_trace(t):
    return _semantic(t, R.nearest_trace)


# Fusion: item i asks with the vector 20 * i where there is one; vector ids and document ids name the same passages.
_FUSED = f"""WITH {_BM25}, {_COSINE},
lex AS (SELECT * FROM ({_TOP.format(q='item_id', k='doc_id', t='lexical')}) WHERE rank <= 50),
sem AS (SELECT query_id // 20 AS item_id, vec_id AS doc_id, score, rank FROM ({_TOP.format(q='query_id', k='vec_id', t='semantic')}) WHERE rank <= 50),
fused AS (
  SELECT coalesce(s.item_id, l.item_id) AS item_id, coalesce(s.doc_id, l.doc_id) AS doc_id, s.rank AS semantic_rank, l.rank AS lexical_rank,
    round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 12) AS fused
  FROM sem s FULL OUTER JOIN lex l ON s.item_id = l.item_id AND s.doc_id = l.doc_id)"""


def _fused(t):
    sem = _semantic(t).select(F.floor(F.col("query_id") / 20).alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return R.rrf_fuse(sem, R.top_k(_lexical(t), "item_id", "doc_id"), "item_id", "doc_id")


@plans.add(_FUSED + " SELECT item_id, doc_id, coalesce(semantic_rank, 0) AS semantic_rank, coalesce(lexical_rank, 0) AS lexical_rank, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS fused_rank FROM fused")
def rrf_fuse(t):
    return _fused(t).select("item_id", "doc_id", F.coalesce("semantic_rank", F.lit(0)).cast("long").alias("semantic_rank"), F.coalesce("lexical_rank", F.lit(0)).cast("long").alias("lexical_rank"), "fused", F.col("fused_rank").cast("long").alias("fused_rank"))


@plans.add(_FUSED + " SELECT item_id, count(*) AS candidates, count(semantic_rank) AS semantic, count(lexical_rank) AS lexical, count(*) FILTER (semantic_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS shared FROM fused GROUP BY 1")
def retrieval_batch(t):
    both = F.col("semantic_rank").isNotNull() & F.col("lexical_rank").isNotNull()
    return _fused(t).groupBy("item_id").agg(F.count("*").alias("candidates"), F.count("semantic_rank").alias("semantic"), F.count("lexical_rank").alias("lexical"), F.count_if(both).alias("shared"))


@plans.add("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'vector_dimension' WHEN label = 3 THEN 'vector_zero' END AS code FROM embeddings WHERE len(embedding) <> 64 OR label = 3")
def vector_validity(t):
    broken = F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))  # an injected fault
    return R.vector_violations(t("embeddings").withColumn("embedding", broken), "vec_id", "embedding", 64)


@plans.add(f"SELECT count(*) AS texts, count(*) FILTER (trim(text) = '') AS blank, max(len({_TOKENS})) AS longest, bool_and(trim(text) <> '' AND len({_TOKENS}) BETWEEN 1 AND 32768) AS ready FROM documents")
def embedding_preflight(t):
    n = F.size(T.tokens(F.col("text")))
    return t("documents").agg(F.count("*").alias("texts"), F.count_if(F.trim("text") == "").alias("blank"), F.max(n).cast("long").alias("longest"), F.bool_and((F.trim("text") != "") & n.between(1, 32768)).alias("ready"))


@plans.add(
    f"""WITH {_BM25}, hits AS (SELECT item_id, doc_id, score, rank + CASE WHEN item_id = 3 AND rank > 10 THEN 1 ELSE 0 END AS rank FROM ({_TOP.format(q='item_id', k='doc_id', t='lexical')}) WHERE rank <= 50)
SELECT item_id, 'path_rank_mismatch' AS code FROM hits GROUP BY item_id HAVING min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*)"""
)
def path_membership(t):
    hits = R.top_k(_lexical(t), "item_id", "doc_id")
    return R.membership_violations(hits.withColumn("rank", F.when((F.col("item_id") == 3) & (F.col("rank") > 10), F.col("rank") + 1).otherwise(F.col("rank"))), "item_id", "doc_id")


# Passages: the lines of a document; a line's section is the last line of under 40 characters up to it.
_LINES = """lines AS (SELECT doc_id, i - 1 AS ord, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
passages AS (SELECT doc_id, ord, line, count(CASE WHEN length(line) < 40 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM lines)"""


def _passages(t):

    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.count(F.when(F.length("line") < 40, 1)).over(w)).withColumn("ord", F.col("ord").cast("long"))


@plans.add(
    f"""WITH {_LINES}
SELECT doc_id, ord, concat_ws(',', CASE WHEN lag(section) OVER w = section THEN lag(ord) OVER w END, ord, CASE WHEN lead(section) OVER w = section THEN lead(ord) OVER w END) AS context
FROM passages WINDOW w AS (PARTITION BY doc_id ORDER BY ord)"""
)
def context_neighbors(t):
    rows = _passages(t).withColumn("id", F.struct("doc_id", "ord"))
    near = R.neighbours(rows, "doc_id", "ord", "id", "section")
    return near.select("id.doc_id", "id.ord", F.array_join(F.transform("context", lambda c: c["ord"].cast("string")), ",").alias("context"))


@plans.add(f"WITH {_LINES}, broken AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND ord > 0 THEN ord + 1 ELSE ord END AS ord FROM passages) SELECT doc_id, count(*) AS n FROM broken GROUP BY 1 HAVING min(ord) <> 0 OR max(ord) <> count(*) - 1 OR count(DISTINCT ord) <> count(*)")
def corpus_order_check(t):
    broken = F.when((F.col("doc_id") % 10 == 0) & (F.col("ord") > 0), F.col("ord") + 1).otherwise(F.col("ord"))  # an injected fault
    return R.corpus_order_violations(_passages(t).withColumn("ord", broken), "doc_id", "ord")


@plans.add(
    f"""WITH {_LINES} SELECT doc_id, ord, md5(CASE WHEN section > 0 THEN source || chr(10) || section || chr(10) || chr(10) || line ELSE line END) AS digest
FROM passages JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"""
)
def dense_passage_text(t):
    rows = _passages(t).join(t("documents").select("doc_id", "source"), "doc_id")
    headings = F.when(F.col("section") > 0, F.array("source", F.col("section").cast("string"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "ord", F.md5(T.document_text(headings, F.col("line"))).alias("digest"))


@plans.add(f"SELECT item_id, '{T.QUERY_TEMPLATE}' || text AS query_text FROM benchmark")
def dense_query_text(t):
    return t("benchmark").select("item_id", T.query_text(F.col("text")).alias("query_text"))


# The index has the vectors' ids, texts without accents on e and the texts' words as lengths, of which 300 at most are allowed.
@plans.add("""WITH e AS (SELECT vec_id AS id, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT coalesce(d.doc_id, e.id) AS id, d.doc_id IS NOT NULL AS known, e.id IS NOT NULL AS there, n, text FROM documents d FULL OUTER JOIN e ON d.doc_id = e.id)
SELECT id, unnest(list_filter([CASE WHEN NOT there THEN 'passage_not_indexed' END, CASE WHEN NOT known THEN 'index_without_passage' END, CASE WHEN n > 1 THEN 'indexed_twice' END,
  CASE WHEN known AND there AND contains(text, 'é') THEN 'index_representation_mismatch' END, CASE WHEN there AND NOT coalesce(len(string_split(text, ' ')) <= 300, false) THEN 'invalid_index_lengths' END], lambda x: x IS NOT NULL)) AS code FROM b""")
def index_validation(t):
    passages = t("documents").select(F.col("doc_id").alias("id"), "text")
    index = t("embeddings").select(F.col("vec_id").alias("id")).join(passages, "id", "left")
    index = index.select("id", F.replace("text", F.lit("é"), F.lit("e")).alias("text"), F.size(F.split("text", " ")).alias("token_count"))
    return R.index_violations(index, passages, "id", 300)


# The index of the texts before their first line end, checked against counts of the whole texts that are one off where the first line's length is odd; passages in French are gone.
@plans.add(f"""WITH p AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS text FROM documents), x AS (SELECT doc_id, lang, length(text) % 2 AS odd, {_TOKENS} AS t FROM p)
SELECT doc_id, unnest(list_filter([CASE WHEN odd = 1 AND len(t) = len(list_distinct(t)) THEN 'invalid_frequency' END, CASE WHEN odd = 1 THEN 'invalid_length' END, CASE WHEN lang = 'fr' THEN 'unknown_passage' END], lambda x: x IS NOT NULL)) AS code
FROM x WHERE len(t) > 0""")
def sparse_state_check(t):
    first = t("documents").select("doc_id", F.split("text", "\n")[0].alias("text"))
    odd = first.select("doc_id", (F.length("text") % 2).alias("odd"))
    index = R.postings(first, "doc_id", "text").join(odd, "doc_id")
    most = F.max("tf").over(W.partitionBy("doc_id"))
    index = index.withColumn("tf", F.when((F.col("odd") == 1) & (F.col("tf") == most), F.col("tf") - 1).otherwise(F.col("tf")))
    return R.sparse_violations(index, t("documents").where("lang is distinct from 'fr'"), "doc_id")


@plans.add(
    f"""WITH {_BM25}, hits AS (SELECT item_id, doc_id FROM ({_TOP.format(q='item_id', k='doc_id', t='lexical')}) WHERE rank <= 5)
SELECT item_id, doc_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id - 20) THEN d.doc_id - 20 END, d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id + 20) THEN d.doc_id + 20 END) AS context
FROM hits JOIN documents d USING (doc_id)"""
)
def expand_context(t):
    hits = R.top_k(_lexical(t), "item_id", "doc_id", 5).select("item_id", "doc_id")
    near = R.neighbours(t("documents").select("doc_id", "source", F.lit("").alias("h")), "source", "doc_id", "doc_id", "h")  # a source's documents follow each other by 20
    return hits.join(near, "doc_id").select("item_id", "doc_id", F.array_join(F.transform("context", lambda c: c.cast("string")), ",").alias("context"))


# Saved hits: of documents with an odd text length the score is off, of ranks 11 and 12 the ranks are, the last hit is gone and one of rank 51 is there instead.
@plans.add(
    f"""WITH {_BM25}, top AS ({_TOP.format(q='item_id', k='doc_id', t='lexical')}), fresh AS (SELECT * FROM top WHERE rank <= 50),
saved AS (SELECT item_id, doc_id, score + length(text) % 2 AS score, CASE WHEN rank IN (11, 12) THEN 23 - rank WHEN rank = 51 THEN 50 ELSE rank END AS rank FROM top JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE rank <= 51 AND rank <> 50)
SELECT * FROM (SELECT coalesce(s.item_id, f.item_id) AS item_id, coalesce(s.doc_id, f.doc_id) AS doc_id,
  CASE WHEN s.rank IS NULL THEN 'hit_missing' WHEN f.rank IS NULL THEN 'hit_unexpected' WHEN abs(s.score - f.score) > 1e-6 THEN 'score_mismatch' WHEN s.rank <> f.rank THEN 'rank_mismatch' END AS code
  FROM saved s FULL OUTER JOIN fresh f ON s.item_id = f.item_id AND s.doc_id = f.doc_id) WHERE code IS NOT NULL"""
)
def rescore_replay(t):
    off = t("documents").select("doc_id", (F.length("text") % 2).alias("off"))
    rank = F.when(F.col("rank").isin(11, 12), 23 - F.col("rank")).when(F.col("rank") == 51, 50).otherwise(F.col("rank"))
    hits = R.top_k(_lexical(t), "item_id", "doc_id", 51).where("rank <> 50").join(off, "doc_id")
    saved = hits.select("item_id", "doc_id", (F.col("score") + F.col("off")).alias("score"), rank.alias("rank"))
    return R.rescore_violations(saved, R.top_k(_lexical(t), "item_id", "doc_id"), "item_id", "doc_id")


# Sources of an index: artifact, text, article, passage, corpus of 25 documents; then one document in 40 is captured anew.
def _sources(t, changed: bool):
    d, n = t("documents"), F.col("doc_id")
    body = F.when(n % 40 == 17, F.concat("text", F.lit(" "))).otherwise(F.col("text")) if changed else F.col("text")
    corpus = F.concat(F.lit("m"), F.floor(n / 25).cast("long"))
    made = [("a", F.sha2(body, 256)), ("t", F.sha2(F.lit("text"), 256)), ("w", F.sha2("source", 256)), ("p", F.sha2(F.col("lang"), 256))]
    records = d.select(F.explode(F.array(*[F.struct(F.concat(F.lit(k), n).alias("id"), h.alias("digest")) for k, h in made])).alias("r")).select("r.*")
    records = records.unionByName(d.select(corpus.alias("id")).distinct().withColumn("digest", F.sha2("id", 256)))
    links = [("t", "a"), ("w", "t"), ("p", "w")]
    edges = d.select(F.explode(F.array(*[F.struct(F.concat(F.lit(a), n).alias("src"), F.concat(F.lit(b), n).alias("dst")) for a, b in links], F.struct(corpus.alias("src"), F.concat(F.lit("p"), n).alias("dst")))).alias("e"))
    # A translation rests on the text of the document with half its number as well.
    more = d.where("lang = 'de' and doc_id > 0").select(F.struct(F.concat(F.lit("t"), n).alias("src"), F.concat(F.lit("t"), F.floor(n / 2).cast("long")).alias("dst")).alias("e"))
    return records, edges.unionByName(more).select("e.*"), records.where("id like 'm%'")


@plans.add(
    """WITH RECURSIVE e AS (SELECT 'm' || doc_id // 25 AS src, doc_id AS dst FROM documents), t AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE lang = 'de' AND doc_id > 0),
up(id, pos) AS (SELECT src, dst FROM e UNION SELECT u.id, t.dst FROM up u JOIN t ON t.src = u.pos)
SELECT id, 'index_corpus_mismatch' AS code FROM up WHERE pos % 40 = 17 AND pos IN (SELECT doc_id FROM documents) GROUP BY 1"""
)
def stale_indexes(t):
    prepared, now = (L.prepared_indexes(L.closure_hashes(records, edges), manifests, "injected", 64) for records, edges, manifests in (_sources(t, False), _sources(t, True)))
    return L.stale(prepared, now)


@plans.add(
    """WITH RECURSIVE t AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE lang = 'de' AND doc_id > 0), up(doc_id, pos, depth) AS (SELECT doc_id, doc_id, 1 FROM documents UNION ALL SELECT u.doc_id, t.dst, u.depth + 1 FROM up u JOIN t ON t.src = u.pos),
d AS (SELECT doc_id, max(depth) AS n FROM up GROUP BY 1), level AS (SELECT n AS level FROM d UNION ALL SELECT 0 FROM d UNION ALL SELECT n + 1 FROM d UNION ALL SELECT n + 2 FROM d UNION ALL SELECT max(n) + 3 FROM d GROUP BY doc_id // 25)
SELECT level, count(*) AS records FROM level GROUP BY 1"""
)
def closure_levels(t):
    records, edges, _ = _sources(t, False)
    return L.closure_hashes(records, edges).groupBy("level").agg(F.count("*").alias("records"))


class WordEncoder:
    """The injected encoder of the query below: words are tokens, and a vector tells a text's length."""

    max_tokens, dimensions = 1 << 20, 3

    def lengths(self, texts):
        return [len(x.split(" ")) for x in texts]

    def encode(self, texts):
        return [[1.0, float(len(x) % 7), 0.5] for x in texts]


@plans.add("SELECT doc_id, len(string_split(text, ' '))::INT AS tokens, 1.0::DOUBLE AS a, (length(text) % 7)::DOUBLE AS b, 0.5::DOUBLE AS c FROM documents")
def embedded_texts(t):
    made = B.embedded(t("documents"), WordEncoder(), "doc_id", "text")
    return made.select("doc_id", "tokens", *[F.col("vector")[i].alias(c) for i, c in enumerate("abc")])
