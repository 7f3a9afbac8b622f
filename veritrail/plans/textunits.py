"""Text unit queries: documents are answers, their lines sentences, lines of under 40 characters headings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import textunits as U
from ..runtime import materialise
from .base import Plans

plans = Plans()

_LINES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
lines AS (SELECT doc_id, i - 1 AS ord, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
units AS (
  SELECT doc_id, ord, start, start + length(line) AS "end", CASE WHEN length(line) < 40 THEN 'heading' ELSE 'sentence' END AS kind, line,
    coalesce(max(CASE WHEN length(line) < 40 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS heading FROM lines)"""


def _units(t):
    lines = U.lf_lines(t("documents"), "doc_id", "text", keep=True)
    short = F.col("end") - F.col("start") < 40  # not the line itself, which only queries that give it then need to shuffle
    kind = F.when(short, "heading").otherwise("sentence")
    before = F.last(F.when(short, F.col("ord")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("kind", kind).withColumn("heading", F.coalesce(before, F.lit(-1)))


@plans.add(f'WITH {_LINES} SELECT doc_id, ord, start, "end" FROM units')
def line_spans(t):
    return U.lf_lines(t("documents"), "doc_id", "text")


@plans.add()
def block_units(t):
    marked = F.concat(F.lit("# Titel\n\n"), F.regexp_replace("text", r"\. ", ".\n\n- "), F.lit("\n\n## Ende\nDr. Müller nennt z. B. 3,5 und 3.5. Danach geht er."))
    return U.units(t("documents").select("doc_id", marked.alias("text")), "doc_id", "text")


@plans.add(f"WITH {_LINES} SELECT kind, count(*) AS units FROM units GROUP BY 1")
def unit_kind_counts(t):
    return _units(t).groupBy("kind").agg(F.count("*").alias("units"))


@plans.add(f"WITH {_LINES} SELECT doc_id, ord, heading FROM units")
def heading_attach(t):
    return _units(t).select("doc_id", "ord", "heading")


# Levels of headings follow from their length; the twin looks for each one's parent among all headings before it.
@plans.add(
    f"""WITH {_LINES}, h AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'heading' THEN length(line) % 4 + 1 END AS level FROM units),
up AS (SELECT u.doc_id, u.ord, u.kind, max(h.ord) FILTER (u.kind <> 'heading') AS active, max(h.ord) FILTER (u.kind = 'heading' AND h.level < u.level) AS above
  FROM h u LEFT JOIN h ON h.doc_id = u.doc_id AND h.kind = 'heading' AND h.ord < u.ord GROUP BY ALL),
on_stack AS (SELECT u.doc_id, u.ord, a.ord AS open FROM h u JOIN h a ON a.doc_id = u.doc_id AND a.kind = 'heading' AND a.ord < u.ord AND (u.level IS NULL OR a.level < u.level)
  WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.kind = 'heading' AND b.ord > a.ord AND b.ord < u.ord AND b.level <= a.level))
SELECT u.doc_id, u.ord, coalesce(u.active, -1) AS active, coalesce(u.above, -1) AS above, coalesce(p.path, '') AS path
FROM up u LEFT JOIN (SELECT doc_id, ord, string_agg(open, '/' ORDER BY open) AS path FROM on_stack GROUP BY 1, 2) p USING (doc_id, ord)"""
)
def heading_stack(t):
    u = _units(t).withColumn("level", F.when(F.col("kind") == "heading", F.length("line") % 4 + 1))
    stacked = U.heading_stack(u, "doc_id")
    return stacked.select("doc_id", "ord", F.coalesce("active", F.lit(-1)).alias("active"), F.coalesce("above", F.lit(-1)).alias("above"), F.array_join("path", "/").alias("path"))


# Quotes of each document: twelve characters from the end of a line to the next; units named: that line, both, or the next two.
@plans.add(
    f"""WITH {_LINES}, q AS (SELECT u.doc_id, u.ord AS anchor, substr(d.text, greatest(u."end" - 7, 0) + 1, CASE WHEN u.ord % 3 = 2 THEN 3 ELSE 12 END) AS quote,
  CASE u.ord % 4 WHEN 0 THEN [u.ord] WHEN 1 THEN [u.ord, u.ord + 1] WHEN 2 THEN [u.ord + 1, u.ord] ELSE [u.ord, u.ord + 1, u.ord + 2] END AS named, d.text FROM units u JOIN documents d USING (doc_id)),
named AS (SELECT q.doc_id, q.anchor, q.quote, q.named, q.text, n.ord, n.start, n."end" FROM (SELECT *, unnest(named) AS one FROM q) q LEFT JOIN units n ON n.doc_id = q.doc_id AND n.ord = q.one),
hull AS (SELECT doc_id, anchor, quote, named, text, count(*) FILTER (ord IS NULL) AS unknown, min(start) AS low, max("end") AS high FROM named GROUP BY ALL),
hits AS (SELECT h.doc_id, h.anchor, list(p) AS places FROM (SELECT *, unnest(range(low, high)) AS p FROM hull WHERE unknown = 0) h WHERE substr(text, p + 1, length(quote)) = quote AND p + length(quote) <= high GROUP BY 1, 2),
one AS (SELECT h.*, coalesce(len(x.places), 0) AS n, x.places[1] AS a, x.places[1] + length(h.quote) AS b FROM hull h LEFT JOIN hits x USING (doc_id, anchor)),
facts AS (SELECT o.*, (SELECT bool_or(NOT (m.start < o.b AND o.a < m."end")) FROM named m WHERE m.doc_id = o.doc_id AND m.anchor = o.anchor) AS apart,
  (SELECT arg_min(m.ord, (m."end" - m.start, m.ord)) FROM named m WHERE m.doc_id = o.doc_id AND m.anchor = o.anchor AND m.start <= o.a AND o.b <= m."end") AS unit,
  (SELECT count(*) FROM units s WHERE s.doc_id = o.doc_id AND s.kind = 'sentence' AND s.start < o.b AND o.a < s."end" AND NOT list_contains(o.named, s.ord)) AS unnamed FROM one o),
told AS (SELECT *, CASE WHEN unknown > 0 THEN 'invalid_source_units' WHEN named <> list_sort(named) THEN 'invalid_source_order' WHEN n = 0 THEN 'quote_missing' WHEN n > 1 THEN 'location_ambiguous'
  WHEN apart THEN 'invalid_source_units' WHEN unit IS NULL AND unnamed > 0 THEN 'incomplete_source_units' ELSE 'located' END AS status FROM facts)
SELECT doc_id, anchor, status, CASE WHEN status = 'located' THEN a ELSE -1 END AS start, CASE WHEN status = 'located' THEN coalesce(unit, -1) ELSE -1 END AS unit FROM told"""
)
def anchor_location(t):
    u, o = materialise(_units(t).select("doc_id", "ord", "start", "end", "kind"), "units"), F.col("ord")
    first = F.greatest(F.col("end") - 7, F.lit(0))
    quote = T.slice_of_pieces(F.col("__pieces"), first, first + F.when(o % 3 == 2, 3).otherwise(12))
    named = F.when(o % 4 == 0, F.array(o)).when(o % 4 == 1, F.array(o, o + 1)).when(o % 4 == 2, F.array(o + 1, o)).otherwise(F.array(o, o + 1, o + 2))
    d = t("documents").select("doc_id", "text")
    anchors = u.join(d.select("doc_id", T.pieces(F.col("text")).alias("__pieces")).hint("merge"), "doc_id").select("doc_id", o.alias("anchor"), quote.alias("quote"), named.alias("named"))
    found = U.locate_in_units(anchors, u, d, "doc_id")
    return found.select("doc_id", "anchor", "status", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("unit", F.lit(-1)).alias("unit"))


@plans.add(
    r"""WITH p AS (SELECT doc_id, chr(32) || chr(10) || text || chr(9) || chr(32) AS padded FROM documents), s AS (SELECT *, length(regexp_replace(padded, '^[\x09-\x0D ]+', '')) AS rest, length(regexp_replace(padded, '[\x09-\x0D ]+$', '')) AS fin FROM p)
SELECT doc_id, length(padded) - rest AS start, greatest(length(padded) - rest, fin) AS "end" FROM s"""
)
def trimmed_spans(t):
    d = t("documents")
    start, end = T.trimmed_span(F.concat(F.lit(" \n"), "text", F.lit("\t ")))
    return d.select("doc_id", start.cast("long").alias("start"), end.cast("long").alias("end"))


@plans.add(
    f"""WITH {_LINES}, broken AS (SELECT doc_id, ord, kind, CASE WHEN doc_id % 10 = 1 AND heading >= 0 THEN heading + 1 ELSE heading END AS h, heading FROM units)
SELECT doc_id, 'not_a_heading' AS code FROM broken WHERE h <> heading"""
)
def unit_validation(t):
    broken = F.when((F.col("doc_id") % 10 == 1) & (F.col("heading") >= 0), F.col("heading") + 1).otherwise(F.col("heading"))  # an injected fault
    return U.unit_violations(_units(t).withColumn("heading", broken).withColumn("opaque", F.lit(False)).withColumn("parent", F.lit(-1).cast("long")), "doc_id")


@plans.add(
    f"""WITH {_LINES}, said AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM units WHERE kind = 'sentence'),
near AS (SELECT DISTINCT s.doc_id, s.ord, s.heading FROM said s JOIN said a ON a.doc_id = s.doc_id AND s.place BETWEEN a.place - 1 AND a.place + 1 AND s.heading = a.heading)
SELECT doc_id, ord FROM near UNION SELECT doc_id, heading FROM near WHERE heading >= 0 UNION SELECT doc_id, ord FROM units WHERE kind = 'heading'"""
)
def context_window(t):
    u = _units(t)
    return U.context_window(u, u.select("doc_id", "ord"), "doc_id")


# Answers: each document's lines, and after a line a marker: plain, after "!", inside an open bracket, or of a url that was not captured.
_MARKED = "CASE ord % 5 WHEN 0 THEN ' ' WHEN 1 THEN '!' WHEN 2 THEN ' [see ' WHEN 3 THEN ' (see [x]) ' ELSE ' [' END"


@plans.add(
    f"""WITH {_LINES}, l2 AS (SELECT doc_id, ord, line || {_MARKED} AS before, '[[' || (ord + 1) || ']](https://' || CASE WHEN ord % 7 = 6 THEN 'other' ELSE 'a' END || '.example/' || doc_id || ')' AS mark, CASE WHEN ord % 5 IN (2, 4) THEN ']' ELSE '' END AS after FROM lines),
placed AS (SELECT *, coalesce(sum(length(before || mark || after) + 1) OVER w, 0) + length(before) AS start, coalesce(string_agg(before || mark || after, chr(10)) OVER w, '') || before AS upto,
  bool_or(regexp_matches(before, '[`<>\\\\]|^(    |\\t)')) OVER (PARTITION BY doc_id) AS unsafe FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, ord + 1 AS number, 'https://a.example/' || doc_id AS url, start::BIGINT AS start, (start + length(mark))::BIGINT AS "end" FROM placed
WHERE NOT unsafe AND ord % 7 <> 6 AND right(upto, 1) NOT IN ('!', '[') AND length(replace(upto, '[', '')) = length(replace(upto, ']', ''))"""
)
def citation_markers(t):
    lines = U.lf_lines(t("documents"), "doc_id", "text", keep=True)
    mark = F.concat(F.lit("[["), F.col("ord") + 1, F.lit("]](https://"), F.when(F.col("ord") % 7 == 6, "other").otherwise("a"), F.lit(".example/"), "doc_id", F.lit(")"))
    said = F.concat("line", F.expr(_MARKED), mark, F.when((F.col("ord") % 5).isin(2, 4), "]").otherwise(""))
    answers = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    captured = t("documents").select("doc_id", F.concat(F.lit("https://a.example/"), "doc_id").alias("url"))
    return U.citation_markers(answers, captured, "doc_id", "text", "url")


@plans.add(
    f"""WITH {_LINES}, said AS (SELECT *, lag(ord) OVER (PARTITION BY doc_id, heading ORDER BY ord) AS before FROM units WHERE kind = 'sentence')
SELECT doc_id, ord, coalesce(before, heading) AS context FROM said WHERE regexp_matches(line, '(?i)(^|[^\\p{{L}}])({U.CUES})([^\\p{{L}}]|$)')"""
)
def reference_cues(t):
    return U.cue_context(_units(t).withColumn("cue", U.reference_cue(F.col("line"))), "doc_id")


@plans.add(
    """WITH q AS (SELECT doc_id, text, substr(text, 11, 12) AS quote FROM documents)
SELECT doc_id, CASE WHEN instr(text, quote) = 0 THEN 'quote_missing' WHEN instr(substr(text, instr(text, quote) + 1), quote) > 0 THEN 'location_ambiguous' ELSE 'located' END AS status,
  CASE WHEN instr(text, quote) > 0 AND instr(substr(text, instr(text, quote) + 1), quote) = 0 THEN instr(text, quote) - 1 ELSE -1 END AS start FROM q"""
)
def quote_location(t):
    d = t("documents").select("doc_id", U.locate_quote(F.col("text"), F.substring("text", 11, 12)).alias("q"))
    return d.select("doc_id", "q.status", "q.start")


@plans.add(
    f"""WITH {_LINES}, env AS (SELECT doc_id, min(start) AS start, max("end") AS "end" FROM units WHERE ord IN (1, 2) GROUP BY 1)
SELECT e.doc_id, e.start, e."end", coalesce(arg_min(u.ord, u."end" - u.start), -1) AS unit FROM env e LEFT JOIN units u ON u.doc_id = e.doc_id AND u.start <= e.start AND u."end" >= e."end" GROUP BY 1, 2, 3"""
)
def support_envelope(t):
    u = _units(t)
    return U.smallest_unit(U.support_envelope(u.where("ord in (1, 2)"), ["doc_id"]), u, "doc_id").select("doc_id", "start", "end", "unit")


@plans.add("SELECT doc_id, 'text-' || sha256('{\"lang\":\"' || lang || '\",\"note\":null,\"source\":\"' || source || '\"}') AS id FROM documents")
def canonical_ids(t):
    return t("documents").select("doc_id", T.identity("text", source=F.col("source"), lang=F.col("lang"), note=F.lit(None).cast("string")).alias("id"))


@plans.add("SELECT item_id, CASE WHEN length(text) <= 700 THEN replace(replace(text, '%', '%25'), '+', '%2B') END AS keyword, 'tag-' || substr(sha256(text), 1, 16) AS tag, length(text) > 700 AS too_long FROM benchmark")
def request_encoding(t):
    keyword = F.when(F.length("text") <= 700, F.replace(F.replace("text", F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")))  # a longer one is rejected, never cut
    return t("benchmark").select("item_id", keyword.alias("keyword"), F.concat(F.lit("tag-"), F.substring(F.sha2("text", 256), 1, 16)).alias("tag"), (F.length("text") > 700).alias("too_long"))
