"""URL filtering by fixed rules and mined association rules.

Fixed rules are (host, path) prefixes: a rule fits its host and all subdomains if the url's path starts with the
rule's; the longest rule wins. Where none fits, mined rules decide: each url becomes a transaction of up to eight
tokens (scheme, host, domain, first and second host label, first path segment, file suffix, names in the query),
Spark's FP-growth finds the token sets of at least ``min_support`` (and ``MIN_ROWS`` rows) among the labelled urls,
and sets that meet the block label in at least ``min_confidence`` of their urls become rules; a rule with a smaller
rule inside it is pruned. Rules are matched through an inverted index: each rule is filed under its rarest token and
urls with that token are checked for the others. Distinct token sets are matched once, so copies of a url cost nothing.

A transaction has at most TOKENS tokens and a label, so there are at most 2**9 / min_support frequent sets.

Defined results: a null url, and one without "://", has an empty host and path, no tokens, no rule and verdict allow.
Labels without a page, and null labels, are not learned from; without labels nothing is mined and verdict is allow.
Repeated rows are judged alike; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT = 0.001
MIN_ROWS = 20
MIN_CONFIDENCE = 0.8
BLOCK, ALLOW = "=block", "=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://", ASCII lower case) and path (up to "?" or "#"); both empty without "://"."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits; null if none does. A handful of rules is meant."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's tokens; an array without repeats, empty for an empty host."""
    labels = F.split(host, r"\.")
    several = F.size(labels) >= 2
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]))), ",")
    parts = [
        F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([^:]*)://", 1)),
        F.concat(F.lit("host:"), host),
        F.when(several, F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), "."))),
        F.concat(F.lit("label1:"), labels[0]),
        F.when(several, F.concat(F.lit("label2:"), F.get(labels, F.lit(1)))),
        F.concat(F.lit("segment:"), F.regexp_extract(path, r"^/([^/]*)", 1)),
        F.concat(F.lit("suffix:"), F.regexp_extract(path, r"\.(\w+)$", 1)),
        F.concat(F.lit("query:"), names),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*parts)))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(items, token, support, confidence) of the pruned block rules from rows of (tokens, blocked)."""
    rows = labelled.select(F.concat("tokens", F.array(F.when(F.col("blocked"), BLOCK).otherwise(ALLOW))).alias("items"))
    n = rows.count()
    spark = labelled.sparkSession
    if not n:
        return spark.createDataFrame([], "items array<string>, token string, support double, confidence double")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_ROWS / n)), minConfidence=1.0).fit(rows).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), "freq")
    bad = sets.filter(F.array_contains("items", BLOCK)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("bad")).filter(F.size("items") > 0)
    rules = sets.join(bad, "items").withColumn("confidence", F.col("bad") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    # proper subsets, by bit mask over at most eight tokens
    masks = F.expr("sequence(1, shiftleft(1, size(items)) - 2)")
    inside = F.when(F.size("items") > 1, F.transform(masks, lambda m: F.filter("items", lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))).otherwise(F.array().cast("array<array<string>>"))
    smaller = rules.select("items", F.explode(inside).alias("part")).join(rules.select(F.col("items").alias("part")), "part", "left_semi").select("items").distinct()
    rules = rules.join(smaller, "items", "left_anti")
    single = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    filed = rules.select("items", F.explode("items").alias("token"), (F.col("bad") / n).alias("support"), "confidence").join(single, "token")
    rarest = filed.groupBy("items").agg(F.min(F.struct("token_freq", "token")).alias("r"), F.first("support").alias("support"), F.first("confidence").alias("confidence"))
    return rarest.select("items", F.col("r.token").alias("token"), "support", "confidence")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``tokens`` that hold all tokens of a rule."""
    index = rules.select("token", F.col("items").alias("rule_items"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.filter(F.size(F.array_except("rule_items", "tokens")) == 0).select("tokens").distinct()


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    labels: page_id and blocked (boolean); a page with several labels is one to block if one of them says so.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), "blocked").filter("blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    mined = mined_rules(rows.filter(F.size("tokens") > 0).join(known, "page_id").select("tokens", "blocked"), min_support, min_confidence)
    caught = matched(rows.filter("fixed is null").select("tokens").distinct(), mined).withColumn("caught", F.lit(True))
    judged = rows.join(caught, "tokens", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("caught"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"))
