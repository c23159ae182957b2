"""URL filters by association rules, in DataFrame operations and Spark's FP-growth only.

A list of rules, each a host with a path, decides urls outright: a rule fits its host and all
subdomains if the url's path starts with the rule's, and the longest fitting rule wins. Urls that
it decides are the labelled examples: FP-growth mines the frequent combinations of their tokens
with their verdicts, and combinations that foretell a verdict with enough confidence become
association rules. A rule is pruned if leaving out one of its tokens loses no confidence. So a token whose urls all
have one verdict is a rule by itself and needs no mining, and tokens that stand in the same urls are mined as one;
without these two a long url with frequent tokens would have as many frequent combinations as it has subsets. What is
left grows with the subsets of tokens of both verdicts that do not stand together. The remaining rules stand in an inverted index under their rarest token; the distinct token sets of
all other urls look their tokens up there, and the most confident rule whose tokens they all have
decides. Where none fits the more frequent label decides, or `allow` where nothing is labelled.

Tokens: scheme, labels of the host, path segments (digits after a number's first as #) and names of
query parameters.

Defined cases: a url may be of any length; a null url, or one without ://, has empty host and path and no tokens, and fits no
rule; equal urls get equal verdicts, each row its own; ties between association rules go to the
greater support, then the fewer tokens, then `block`; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut, cut_table, scope

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Share of the labelled urls that must have a combination, and of its urls that must have the verdict.
SUPPORT, CONFIDENCE = 0.002, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "="


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url."""
    scheme = F.transform(F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), lambda x: F.concat(F.lit("s:"), F.lower(x)))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"(?<=\d)\d", "#")))
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    found = F.filter(F.concat(scheme, labels, segments, names), lambda x: F.length(x) > 2)
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Association rules (tokens, says, confidence, n) from rows of (tokens, verdict), and (token, like) of all frequent
    tokens: rules name tokens by the first of those that stand in the same urls."""
    rows = cut(labelled.select("tokens", "verdict")).withColumn("id", F.monotonically_increasing_id())
    least = math.ceil(support * rows.count())
    each = rows.select("id", "verdict", F.explode("tokens").alias("token"))
    sign = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit((1 << 31) - 1)))  # noqa: E731  one for each set of urls
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "block").cast("long")).alias("blocks"), sign(1).alias("x"), sign(2).alias("y"))
    tokens = cut_table(tokens.where(F.col("n") >= least))
    pure = tokens.where("blocks = 0 OR blocks = n")
    rules = pure.select(F.array("token").alias("tokens"), F.when(F.col("blocks") == 0, "allow").otherwise("block").alias("says"), F.lit(1.0).alias("confidence"), "n")
    mixed = tokens.where("blocks > 0 AND blocks < n")
    first = mixed.groupBy("n", "blocks", "x", "y").agg(F.min("token").alias("like"))
    like = cut_table(mixed.join(first, ["n", "blocks", "x", "y"]).select("token", "like"))
    known = like.unionByName(pure.select("token", F.col("token").alias("like")))
    # a token is frequent in a share of the urls, so there are at most 1 / support times as many as tokens in a url
    items = each.join(F.broadcast(like.withColumnRenamed("token", "t")), F.col("token") == F.col("t")).groupBy("id", "verdict").agg(F.collect_set("like").alias("tokens"))
    items = cut(items.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items")))
    if not (n := items.count()):
        return rules.where(F.col("confidence") >= confidence), known
    found = _rules(cut(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))), confidence)
    return found.unionByName(rules), known


def _rules(frequent: DataFrame, confidence: float) -> DataFrame:
    """Association rules from frequent combinations, without those that a shorter one makes needless."""
    label = F.filter("items", lambda x: x.startswith(_LABEL))
    both = frequent.where(F.size(label) == 1).select(F.filter("items", lambda x: ~x.startswith(_LABEL)).alias("tokens"), F.substring(label[0], 2, 1000).alias("says"), "n").where("size(tokens) > 0")
    alone = frequent.where(F.size(label) == 0).select(F.col("items").alias("of"), F.col("n").alias("of_n"))
    rules = cut(both.join(alone, F.col("tokens") == F.col("of")).select("tokens", "says", (F.col("n") / F.col("of_n")).alias("confidence"), "n").where(F.col("confidence") >= confidence))
    less = F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x)))
    shorter = rules.select(F.col("tokens").alias("of"), F.col("says").alias("of_says"), F.col("confidence").alias("of_confidence"))
    reduced = rules.where("size(tokens) > 1").withColumn("rest", less)
    needless = reduced.join(shorter, (F.col("rest") == F.col("of")) & (F.col("says") == F.col("of_says")) & (F.col("of_confidence") >= F.col("confidence"))).select(F.col("tokens").alias("t"), F.col("says").alias("s")).distinct()
    return rules.join(needless, (F.col("tokens") == F.col("t")) & (F.col("says") == F.col("s")), "left_anti")


def named_alike(patterns: DataFrame, known: DataFrame) -> DataFrame:
    """Patterns (key, tokens) with their frequent tokens as the rules name them."""
    each = patterns.select("key", F.explode("tokens").alias("t"))
    return each.join(F.broadcast(known), F.col("t") == F.col("token")).groupBy("key").agg(F.collect_set("like").alias("tokens"))


def matched(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, says) of the patterns (key, tokens) that a rule decides."""
    rules = cut(rules)
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("rules"))
    spelt = patterns.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    rare = often.join(spelt, "token", "left").select(F.col("token").alias("of"), F.coalesce("seen", F.lit(0)).alias("seen"))
    under = rules.withColumn("token", F.explode("tokens")).join(rare, F.col("token") == F.col("of"))
    index = cut_table(under.groupBy("tokens", "says", "confidence", "n").agg(F.min(F.struct("seen", "token"))["token"].alias("token")).withColumnRenamed("tokens", "needs"))
    looked = patterns.select("key", "tokens", F.explode("tokens").alias("look")).join(index, F.col("look") == F.col("token"))
    fired = looked.where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "n", -F.size("needs"), F.col("says")))
    return fired.groupBy("key").agg(best["says"].alias("says"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    spelt = F.coalesce(tokens_of(F.col("url"), F.col("host"), F.col("path")), F.array().cast("array<string>"))
    labelled = rows.where("rule is not null").select(spelt.alias("tokens"), "verdict")
    counts = {r[0]: r[1] for r in labelled.groupBy("verdict").agg(F.count("*")).collect()}
    usual = "block" if counts.get("block", 0) > counts.get("allow", 0) else "allow"
    # distinct token sets of the other urls: equal ones, however many, are matched once
    key = F.xxhash64(F.array_join("tokens", " "), F.size("tokens"))
    others = rows.where("rule is null").select(spelt.alias("tokens"))
    patterns = cut(others.groupBy("tokens").agg(F.count("*")).select(key.alias("key"), "tokens"))
    decided = rows.where("rule is not null").select("page_id", "host", "path", "rule", "verdict")
    rest = rows.where("rule is null").select("page_id", "host", "path", "rule", spelt.alias("tokens")).withColumn("at", key)
    if counts:
        with scope(pages.sparkSession) as keep:
            found, known = mined(labelled)
            says = keep(cut_table(matched(cut(named_alike(patterns, known)), found).select(F.col("key").alias("of"), "says")))
        rest = rest.join(says, F.col("at") == F.col("of"), "left")
    else:
        rest = rest.withColumn("says", F.lit(None).cast("string"))
    return decided.unionByName(rest.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit(usual)).alias("verdict")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
