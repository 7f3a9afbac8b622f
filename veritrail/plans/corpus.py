"""Corpus queries over pages, documents and capture responses derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as G
from ..operators import corpus as K
from ..operators import layout as L
from .base import Plans

plans = Plans()


@plans.add()
def page_articles(t):
    parsed = K.parse_pages(t("pages"), language=None)
    return parsed.select("page_id", "reason", "title", F.sha2("text", 256).alias("text_sha256"), F.size("blocks").alias("blocks"), F.size("links").alias("links"), F.size("excluded").alias("excluded"))


@plans.add()
def page_blocks(t):
    parsed = K.parse_pages(t("pages"), language=None)
    return parsed.select("page_id", F.posexplode("blocks").alias("ord", "b")).select("page_id", "ord", "b.kind", "b.level", "b.start", "b.end", "b.locator")


# The article's body put into boxes that its headings don't reach beyond; rows only, as a parser is the point.
@plans.add()
def page_sections(t):
    boxed = F.regexp_replace("html", r"(?s)(<h2[^>]*>.*?</h2>\s*<p[^>]*>.*?)(?=<h2|<p|</article)", "<div class='accordion-item'>$1</div>")
    parsed = K.parse_pages(t("pages").select("page_id", "url", boxed.alias("html")), language=None)
    blocks = parsed.select("page_id", F.posexplode("blocks").alias("ord", "b"))
    return blocks.where("b.kind = 'heading'").select("page_id", "ord", "b.level", "b.start", "b.section_end", F.array_join("b.headings", "/").alias("above"))


@plans.add("SELECT page_id, CASE WHEN lower(regexp_extract(html, '<html[^>]*lang=\"([a-zA-Z]+)', 1)) NOT IN ('', 'de') THEN 'non_german_page' WHEN len(regexp_extract_all(html, '<article')) <> 1 THEN 'root_not_unique' ELSE 'eligible' END AS gate FROM pages")
def page_language_gate(t):
    lang = F.lower(F.regexp_extract("html", r'<html[^>]*lang="([a-zA-Z]+)', 1))
    return t("pages").select("page_id", F.when(~lang.isin("", "de"), "non_german_page").when(F.regexp_count("html", F.lit("<article")) != 1, "root_not_unique").otherwise("eligible").alias("gate"))


@plans.add("SELECT page_id, href, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2")
def page_links(t):
    found = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("links"))


@plans.add("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'failed' WHEN html NOT LIKE '%<html lang=\"de\"%' THEN 'unusable' ELSE 'usable' END AS status FROM pages")
def article_status(t):
    pages = t("pages")
    receipts = pages.select("page_id", F.when(F.col("page_id") % 11 == 0, "timeout").alias("error"))
    gate = pages.select("page_id", F.when(F.contains("html", F.lit('<html lang="de"')), "").otherwise("wrong_language").alias("reason"))
    return K.article_status(receipts, gate, "page_id").select("page_id", "status")


# Blocks: the lines of a document; under 40 characters a heading, lines that start with O or T list items, lines ending in a comma-less period end no list.
_BLOCKS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, i - 1 AS ord, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
blocks AS (SELECT *, start + length(line) AS fin, CASE WHEN length(line) < 40 THEN 'heading' WHEN substr(line, 1, 1) IN ('O', 'T') THEN 'list_item' ELSE 'paragraph' END AS kind,
  count(CASE WHEN length(line) < 40 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS headings, substr(line, -2, 1) IN ('e', 'n') AS colon FROM b),
m AS (SELECT *, CASE WHEN kind = 'list_item' AND lag(kind) OVER w = 'list_item' AND lag(headings) OVER w = headings THEN 0 ELSE 1 END AS new FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS unit FROM m),
u AS (SELECT doc_id, unit, min(ord) AS first, min(start) AS start, max(fin) AS fin, arg_min(kind, ord) AS kind, arg_min(headings, ord) AS headings, arg_max(colon, ord) AS colon FROM n GROUP BY 1, 2),
x AS (SELECT *, coalesce(kind = 'paragraph' AND colon AND lead(kind) OVER w = 'list_item' AND lead(headings) OVER w = headings, false) AS takes, lead(fin) OVER w AS next_fin,
  coalesce(lag(kind) OVER w = 'paragraph' AND lag(colon) OVER w AND kind = 'list_item' AND lag(headings) OVER w = headings, false) AS taken FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
passages AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit) - 1 AS ord, start, CASE WHEN takes THEN next_fin ELSE fin END AS "end", first FROM x WHERE NOT taken AND kind <> 'heading')"""


def _passages(t):
    from pyspark.sql import Window as W

    from ..operators.textunits import lf_lines

    d = t("documents")
    lines = lf_lines(d, "doc_id", "text", keep=True)
    kind = F.when(F.length("line") < 40, "heading").when(F.substring("line", 1, 1).isin("O", "T"), "list_item").otherwise("paragraph")
    heads = F.count(F.when(F.length("line") < 40, 1)).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return K.passages(lines.select("doc_id", "ord", "start", "end", kind.alias("kind"), heads.alias("headings"), F.substring("line", -2, 1).isin("e", "n").alias("colon")), "doc_id", "ord")


@plans.add(f'WITH {_BLOCKS} SELECT doc_id, ord, start, "end", first FROM passages')
def passages(t):
    return _passages(t)


@plans.add(f"WITH {_BLOCKS} SELECT doc_id, ord FROM passages WHERE doc_id % 10 = 6")
def passage_roundtrip(t):
    rows = _passages(t).join(t("documents").select("doc_id", "text"), "doc_id")
    exact = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return K.roundtrip_violations(rows.withColumn("exact_text", F.when(F.col("doc_id") % 10 == 6, F.concat(exact, F.lit("!"))).otherwise(exact)), ["doc_id", "ord"])


# Versions: document n of a source was preceded by n - 20.
@plans.add("SELECT doc_id, doc_id % 20 AS root, doc_id // 20 AS depth FROM documents")
def version_chain(t):
    links = t("documents").select("doc_id", F.when(F.col("doc_id") >= 20, F.col("doc_id") - 20).alias("previous"))
    return G.lineage_roots(links, "doc_id", "previous")


# Versions whose predecessor's number follows from the text's length: some are missing, some of another source, some chains run in a circle.
@plans.add("""WITH RECURSIVE v AS (SELECT doc_id, source, CASE WHEN length(text) % 3 > 0 THEN length(text) END AS previous FROM documents),
step AS (SELECT v.doc_id, v.previous, v.source, o.doc_id IS NOT NULL AS known, o.source AS other FROM v LEFT JOIN v o ON o.doc_id = v.previous),
up(doc_id, pos) AS (SELECT doc_id, doc_id FROM step UNION SELECT u.doc_id, s.previous FROM up u JOIN step s ON s.doc_id = u.pos WHERE s.known)
SELECT doc_id, 'missing_id' AS code FROM step WHERE previous IS NOT NULL AND NOT known
UNION ALL SELECT doc_id, 'previous_article_url_mismatch' FROM step WHERE known AND source IS DISTINCT FROM other
UNION ALL SELECT doc_id, 'article_history_cycle' FROM (SELECT doc_id, bool_or(NOT known) AS ends FROM up JOIN (SELECT doc_id AS pos, known FROM step) USING (pos) GROUP BY 1) WHERE NOT ends""")
def version_violations(t):
    length = F.length("text").cast("long")
    return G.version_violations(t("documents").select("doc_id", "source", F.when(length % 3 > 0, length).alias("previous")), "doc_id", "previous", "source")


@plans.add("SELECT doc_id, CASE WHEN doc_id % 30 = 1 THEN 'member_missing' ELSE 'member_hash_mismatch' END AS code FROM documents WHERE doc_id % 30 IN (1, 2)")
def completion_check(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = d.where("doc_id % 30 <> 1").withColumn("sha256", F.when(F.col("doc_id") % 30 == 2, "x").otherwise(F.col("sha256")))
    return K.membership_mismatch(d, stored, "doc_id")


# Pages of a documentary kind out of each document's lines: a table of contents that links to the lines' lengths modulo 5, sections with the lengths modulo 7 as ids, and a question a line whose ids fit by its
# length; what is broken follows from the lines alone.
_LENGTHS = """d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l, lang FROM documents), n AS (SELECT r, doc_id, lang, i, length(l[i]) AS n FROM d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""


@plans.add(f"""WITH {_LENGTHS},
links AS (SELECT DISTINCT r, doc_id, n % 5 AS x FROM n), targets AS (SELECT r, n % 7 AS x, count(*) AS c FROM n GROUP BY 1, 2),
found AS (
  SELECT doc_id, 'site_toc_target_mismatch' AS code FROM links LEFT JOIN targets USING (r, x) WHERE coalesce(c, 0) <> 1
  UNION ALL SELECT doc_id, 'duplicate_element_id' FROM targets JOIN (SELECT r, doc_id FROM d) USING (r) WHERE c > 1
  UNION ALL SELECT doc_id, 'site_faq_mismatch' FROM n WHERE n % 6 <> n % 12 OR n % 11 = 0
  UNION ALL SELECT doc_id, 'site_unselected_content' FROM d WHERE lang = 'fr' OR lang IS NULL
  UNION ALL SELECT doc_id, 'site_faq_group_missing' FROM d WHERE len(l) % 2 = 0)
SELECT doc_id, code, count(*) AS violations FROM found GROUP BY 1, 2""")
def layout_check(t):
    d = t("documents").where("text is not null").select("doc_id", "lang", F.transform(F.split("text", "\n"), F.length).alias("n"))
    part = lambda f: F.array_join(F.transform("n", f), "")
    links = F.array_join(F.transform(F.array_distinct(F.transform("n", lambda n: n % 5)), lambda x: F.format_string('<li><a href="#s%d">x</a>', x)), "")
    sections = part(lambda n: F.format_string('<p id="s%d">x', n % 7))
    questions = part(
        lambda n, i: F.concat(
            F.format_string('<div class="accordion-item"><button class="accordion-headline" id="q%d.%d" aria-controls="a%d"><h2>x</h2></button>', i, n % 6, i),
            F.format_string('<div class="accordion-content" id="a%d" aria-labelledby="q%d.%d">%s</div></div>', i, i, n % 12, F.when(n % 11 == 0, "x").otherwise("<ul><li>x</ul>")),
        )
    )
    title = F.when(F.size("n") % 2 == 0, "<h2>x</h2>").otherwise("<header><h2>x</h2></header>")
    stray = F.when((F.col("lang") == "fr") | F.col("lang").isNull(), "<aside>x</aside>").otherwise("")
    html = F.concat(F.lit('<div class="content"><div class="frame"><nav class="toc"><ul>'), links, F.lit("</ul></nav>"), sections, F.lit("</div>"), stray, F.lit('<div class="frame"><div>'), title, F.lit('</div><div class="accordion">'), questions, F.lit("</div></div></div>"))
    return L.layout_violations(d.select("doc_id", html.alias("html")), "doc_id", "html").groupBy("doc_id", "code").agg(F.count("*").alias("violations"))


# A gallery out of each document's source and language; listed for a source is the one of its first language, with a signature put together from the JSON of its parts.
@plans.add("""SELECT doc_id, 'gallery' AS kind, sha256('["div",[["class","gallery"]],[{"element":"' || sha256('["figure",[],[{"element":"' || sha256('["img",[["src","' || coalesce(source, '') || '.png"]],[]]') || '"},{"element":"'
  || sha256('["figcaption",[],["© ' || coalesce(lang, '') || '"]]') || '"}]]') || '"}]]') AS signature
FROM documents LEFT JOIN (SELECT source, min(coalesce(lang, '')) AS first FROM documents GROUP BY 1) f USING (source) WHERE coalesce(lang, '') IS DISTINCT FROM first""")
def media_allow_list(t):
    d = t("documents").select("doc_id", "source", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("lang"))
    html = F.format_string('<article><div class=gallery><figure>\n <img src="%s.png"><figcaption> © %s\n</figcaption></figure></div><p>x</article>', "s", "lang")
    first = d.groupBy("source", "s").agg(F.min("lang").alias("lang"))
    node = lambda tag, attrs, *inside: F.sha2(F.concat(F.lit(f'["{tag}",['), attrs, F.lit("],["), F.concat_ws(",", *inside), F.lit("]]")), 256)
    within = lambda signature: F.concat(F.lit('{"element":"'), signature, F.lit('"}'))
    image = node("img", F.concat(F.lit('["src","'), "s", F.lit('.png"]')))
    caption = node("figcaption", F.lit(""), F.concat(F.lit('"© '), "lang", F.lit('"')))
    whole = node("div", F.lit('["class","gallery"]'), within(node("figure", F.lit(""), within(image), within(caption))))
    allowed = first.select(F.col("source").alias("url"), F.lit("gallery").alias("kind"), whole.alias("signature"))
    found = L.media_violations(d.select("doc_id", "source", html.alias("html")), allowed, "doc_id", "source", "html", {"gallery": "gallery"})
    return found.select("doc_id", "kind", "signature")


@plans.add("SELECT source AS name, CASE WHEN source = 'src5' THEN 'resource_missing' WHEN source = 'src6' THEN 'resource_hash_mismatch' ELSE 'ok' END AS status, count(*) AS uses FROM documents GROUP BY 1, 2")
def nontext_pins(t):
    from ..operators.store import registry_status

    uses = t("documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("uses")).withColumn("version", F.lit("1")).withColumn("sha256", F.md5("name"))
    pins = uses.where("name <> 'src5'").withColumn("sha256", F.when(F.col("name") == "src6", "x").otherwise(F.col("sha256")))
    return registry_status(uses, pins).join(uses.select("name", "uses"), "name").select("name", "status", "uses")


def _responses(t):
    c = t("conversations").where("role = 'assistant'")
    k = (F.col("conv_id") * 5 + F.col("turn")) % 9
    item = F.struct(F.when(k == 7, " ").otherwise(F.col("text")).alias("markdown"), F.array(F.struct(F.concat(F.lit("https://a.example/"), "conv_id").alias("url"), F.lit("t").alias("title"))).alias("references"))
    result = F.struct(F.when(k == 6, "en").otherwise("de").alias("language_code"), F.array(item).alias("items"))
    task = F.struct(F.struct(F.when(k == 5, "x").otherwise(F.col("conv_id").cast("string")).alias("tag")).alias("data"), F.array(result).alias("result"))
    body = F.to_json(F.struct(F.when(k == 3, 40000).otherwise(20000).alias("status_code"), F.when(k == 4, 2).otherwise(1).alias("tasks_count"), F.array(task).alias("tasks")))
    return c.select("conv_id", "turn", k.alias("k"), F.when(k == 0, F.lit(None)).when(k == 1, 503).otherwise(200).alias("status"), F.when(k == 2, F.concat(body, F.lit("}{"))).otherwise(body).alias("body"))


@plans.add("SELECT conv_id, turn, CASE (conv_id * 5 + turn) % 9 WHEN 0 THEN 'transport_error' WHEN 1 THEN 'http_503' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'provider_error' WHEN 4 THEN 'task_count' WHEN 5 THEN 'tag_mismatch' WHEN 6 THEN 'language_mismatch' WHEN 7 THEN 'blank_answer' ELSE 'succeeded' END AS outcome FROM conversations WHERE role = 'assistant'")
def response_failure(t):
    return _responses(t).select("conv_id", "turn", K.response_failure(F.col("status"), F.col("body"), F.col("conv_id").cast("string"), "de").alias("outcome"))


# Answers as nested structures out of the conversations: the line count of a text decides how many references an element has, and its length what is wrong with them.
@plans.add("""WITH c AS (SELECT conv_id, turn, len(string_split(text, chr(10))) % 4 AS k, length(text) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND trim(text, ' ') <> '')
SELECT conv_id, turn, CASE WHEN n % 5 = 0 OR (n % 7 = 0 AND k > 0) OR n % 3 = 0 THEN 'incomplete' ELSE 'available' END AS state,
  array_to_string(list_filter([CASE WHEN n % 7 = 0 AND k > 0 THEN 'malformed_reference' END, CASE WHEN n % 5 = 0 THEN 'unsupported_source_fields' END], lambda x: x IS NOT NULL), ',') AS diagnostics,
  CASE WHEN n % 7 = 0 AND k > 0 THEN k - 1 ELSE k END AS sources, CASE WHEN k > (n % 7 = 0)::INT THEN '/tasks/0/result/0/items/0/components/0/items/0/references/' || (n % 7 = 0)::INT END AS first
FROM c""")
def reference_walk(t):
    c = t("conversations").where("role = 'assistant' and text is not null and trim(text) <> ''")
    c = c.select("conv_id", "turn", (F.size(F.split("text", "\n")) % 4).alias("k"), F.length("text").alias("n"))
    entry = lambda i: F.struct(F.lit("ai_overview_reference").alias("type"), F.when((F.col("n") % 7 == 0) & (i == 0), "no url").otherwise(F.concat(F.lit("https://a.example/"), i.cast("string"))).alias("url"))
    listed = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("k")), entry)
    nothing = F.array().cast(c.select(listed.alias("x")).schema["x"].dataType)
    inner = F.struct(F.lit("ai_overview_element").alias("type"), listed.alias("references"), F.when(F.col("n") % 5 == 0, "x").alias("colour"))
    component = F.struct(F.lit("ai_overview_expanded_component").alias("type"), F.when(F.col("n") % 3 != 0, nothing).alias("references"), F.array(inner).alias("items"))
    item = F.struct(F.lit("ai_overview").alias("type"), F.lit("An answer.").alias("markdown"), nothing.alias("references"), F.array(component).alias("components"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(item).alias("items"))).alias("result"))).alias("tasks")))
    key = F.struct("conv_id", "turn")
    walked = K.walk_references(c.select(F.to_json(key).alias("answer"), body.alias("body")), "answer", "body").withColumn("key", F.from_json("answer", "conv_id bigint, turn bigint"))
    return walked.select("key.conv_id", "key.turn", "state", F.array_join("diagnostics", ",").alias("diagnostics"), F.size("sources").cast("long").alias("sources"), F.get("sources", F.lit(0))["location"].alias("first"))


# Every node of the clicks' properties; one name is changed so that it has both signs that pointers escape.
@plans.add(r"""SELECT click_id, replace(regexp_replace(replace(substr(j.fullkey, 2), '.', '/'), '\[(\d+)\]', '/\1', 'g'), '/device', '/de~1vi~0ce') AS pointer,
  CASE j.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
  CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(j.value, '$') END AS value
FROM (SELECT click_id, props FROM clicks WHERE json_valid(props)) c, json_tree(c.props) j
UNION ALL SELECT click_id, '', 'invalid', NULL FROM clicks WHERE NOT json_valid(props)""")
def json_pointers(t):
    props = F.replace("props", F.lit('"device"'), F.lit('"de/vi~ce"'))
    return K.json_pointers(t("clicks").select("click_id", props.alias("props")), "click_id", "props")


@plans.add("SELECT doc_id, lang, 'first' AS side FROM documents WHERE doc_id % 40 = 3 UNION ALL SELECT doc_id, 'xx', 'second' FROM documents WHERE doc_id % 40 = 3")
def replay_equality(t):
    d = t("documents").select("doc_id", "lang")
    return K.replay_differences(d, d.withColumn("lang", F.when(F.col("doc_id") % 40 == 3, "xx").otherwise(F.col("lang"))))
