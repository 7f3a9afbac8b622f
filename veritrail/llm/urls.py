"""URL filters: fixed host and path rules, and association rules mined with FP-growth for the urls no fixed rule fits.

The labels are the fixed rules' own: a page that a rule fits has that rule's verdict, and what its url shares with others (path, ending, query, subdomain, domain) carries it
over to pages that no rule fits.  Every url becomes a set of at most ``TOKENS`` tokens: scheme, subdomain, domain without its top level, host, first path segment, first two, the last
one (numbers generalised), its ending, the set of query keys, fragment.  So a url of any length costs no more than another: its tokens multiply to at most 2**TOKENS sets.

FP-growth mines frequent sets of the labelled urls (a set must occur in ``MIN_SUPPORT`` of them and in ``LEAST_PAGES`` at least).  Rules ``tokens -> allow or block`` stay if they reach ``MIN_CONFIDENCE``
and no rule with one token less is as confident.  Matching uses an inverted index: each rule hangs on its rarest token, distinct token sets look their tokens up, and only
rules found that way are compared in full.  The most confident match decides (then the one of most support, the longer one, block before allow); without a match a url is allowed.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and no tokens, and is allowed; when there are no labelled pages, no rule
is mined; equal urls get equal verdicts; very long urls have as many tokens as others; key ties and repeated rows are kept as they are.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

# The fixed rules: verdict, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.002
LEAST_PAGES = 10
MIN_CONFIDENCE = 0.9
TOKENS = 11
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null where none fits.  A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url in sorted order, ``TOKENS`` at most; an empty array where it has no host."""
    labels = F.split(host, r"\.")
    said = lambda kind, value: F.when(value != "", F.concat(F.lit(kind + ":"), value))
    general = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    segments = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda s: s != "")
    first = F.coalesce(F.get(segments, F.lit(0)), F.lit(""))
    second = F.when(F.size(segments) > 1, F.concat(first, F.lit("/"), F.get(segments, F.lit(1)))).otherwise("")
    last = F.when(F.size(segments) > 0, F.get(segments, F.size(segments) - 1)).otherwise("")
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))))
    every = F.array(
        said("scheme", F.lower(F.substring_index(url, "://", 1))), said("host", host), said("sub", F.when(F.size(labels) > 2, labels[0]).otherwise("")),
        said("domain", F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise("")), said("top", F.element_at(labels, -1)), said("first", general(first)), said("second", general(second)),
        said("last", general(last)), said("ending", F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))), said("keys", F.array_join(keys, "&")), F.when(F.instr(url, "#") > 0, F.lit("fragment")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(every))))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, least: int = LEAST_PAGES) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, anchor) from rows (tokens, verdict), the verdict allow or block."""
    spark = labelled.sparkSession
    total = labelled.count()
    schema = "tokens array<string>, verdict string, confidence double, support double, anchor string"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, max(support, least / total))
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= share * total)
    counts = materialise(counts, "token_counts")  # at most TOKENS / share rows
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    is_label = F.startswith(F.col("consequent")[0], F.lit("verdict:"))
    rules = model.associationRules.where(is_label & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict:"))))
    rules = materialise(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support"), "mined")
    smaller = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("had"))
    parts = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("gone")).withColumn("part", F.array_remove("tokens", F.col("gone")))
    beaten = parts.join(smaller, ["part", "verdict"]).where("had >= confidence").select("tokens", "verdict").distinct()
    rules = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    rarest = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    return materialise(rules.join(rarest, ["tokens", "verdict"]), "rules").select("tokens", "verdict", "confidence", "support", "anchor")


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[tuple[str, str, str], ...] = RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, least: int = LEAST_PAGES) -> DataFrame:
    """Per page: the key, host, path, the fixed rule that fits or null, the verdict, and the confidence of a mined rule where one decided."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict})
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    mined = mine(rows.where("given is not null").select(tokens.alias("tokens"), F.col("given").alias("verdict")), support, confidence, least)
    open_sets = rows.where("given is null").select(tokens.alias("tokens")).distinct()
    hung = mined.select(F.col("anchor").alias("token"), F.col("tokens").alias("needs"), "verdict", "confidence", "support")
    order = F.struct("confidence", "support", F.size("needs").alias("length"), F.col("verdict"))
    found = open_sets.withColumn("token", F.explode("tokens")).join(hung, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = found.groupBy("tokens").agg(F.max(order).alias("best"))
    # A table of its own: the join with it can split a token set that very many pages share.
    best = materialise(best.select("tokens", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence")), "verdicts")
    rows = rows.withColumn("tokens", F.when(F.col("given").isNull(), tokens))
    joined = rows.join(best, "tokens", "left")
    return joined.select(key, "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"), "confidence")


def rule_columns(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per page: the key, host, path, the fixed rule that fits and its verdict, null where none does."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return rows.select(key, "host", "path", rule.alias("rule"), verdict.alias("given"))


ORACLE_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS given FROM h JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, given FROM h LEFT JOIN fit USING (page_id)
"""
