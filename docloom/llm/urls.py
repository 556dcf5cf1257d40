"""URL filters by association rules, with DataFrame functions and Spark's FP-growth only.

Labelled URLs become sets of tokens (labels of the host, parts of the path). FP-growth
mines token combinations that come with a label; rules below the confidence or the
support are dropped, as are rules that a part of theirs already decides. Labels count
alike, however many rows each has: the confidence compares the share of a label's rows
that hold the tokens with that of any other label's, by the ends of both shares' 95 %
intervals that speak against the rule. So tokens that are as common elsewhere make no
rule, nor do a few rows that may be chance. A URL is matched through an inverted index:
a rule stands under its rarest token, and a URL looks up its own tokens only. The
matching rule of the highest confidence decides.

A list of given rules (host and path prefixes) goes first: a rule fits its host and
all subdomains if the path starts with the rule's path; the longest fitting rule wins.

Results for odd input: a null URL or one without ``://`` has an empty host and path,
no rule and no token, and gets the default verdict; repeated rows get the same verdict;
very long URLs are used whole; without labels no rule is mined.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: (verdict, host and path) of the given rules.
GIVEN_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Rows that a rule rests on at least, however few there are: fewer can't show more than chance.
FEWEST = 4


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased, the path up to the query or fragment; empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=GIVEN_RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. For lists of parameters; they become one expression."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, none)


def tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: ``h:`` labels of the host and their parts, ``p:`` parts of the path."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(host, r"[.]", "-"), "-"), lambda x: x != "")
    paths = F.filter(F.split(path, r"[/._-]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(F.concat(labels, parts), lambda x: F.concat(F.lit("h:"), x)), F.transform(paths, lambda x: F.concat(F.lit("p:"), x))))


def _merged(tokens_of: DataFrame) -> DataFrame:
    """(token, n, stands): of tokens (row, token) that stand in the same rows, one stands for all.

    Mining takes time by the subsets of what comes together: a path that many rows share
    counts as one token. Rows are compared by two sums of their hashes.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)"))
    seen = tokens_of.groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("s1"), mark(2).alias("s2"))
    least = seen.groupBy("n", "s1", "s2").agg(F.min("token").alias("stands"))
    return seen.join(least, ["n", "s1", "s2"]).select("token", "n", "stands")


def interval(n: Column, of: Column, side: int, z: float = 1.96) -> Column:
    """The lower (``side`` -1) or upper (1) end of the score interval of a share of ``n`` of ``of``."""
    p = n / of
    return (p + z * z / 2 / of + side * z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / of + z * z / 4 / of / of)) / (1 + z * z / of)


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (id, anchor, items, label, confidence, support) from ``labelled`` (items, label).

    Rows with a null label are a background that no rule speaks for: what is as common
    in it as among a label's rows makes no rule either.

    Tokens below the support are left out before mining, as no rule can have them; the
    count of the rest is bounded by the tokens of a URL over the support. Tokens that
    always come together are mined as one, and a rule names the one that stands for them.
    """
    from pyspark.ml.fpm import FPGrowth

    schema = "id long, anchor string, items array<string>, label string, confidence double, support double"
    labelled = labelled.withColumn("label", F.coalesce("label", F.lit("")))
    counted = checkpoint(labelled.select(F.monotonically_increasing_id().alias("row"), "items", "label"))
    rows = counted.count()
    if not rows:
        return labelled.sparkSession.createDataFrame([], schema)
    fewest = max(FEWEST, math.ceil(rows * support))
    every = counted.select("row", F.explode(F.array_distinct("items")).alias("token"))
    common = every.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    common = checkpoint(_merged(every.join(common.select("token"), "token")).where("token = stands"))
    kept = every.join(common, "token").groupBy("row").agg(F.collect_set("token").alias("kept"))
    baskets = counted.join(kept, "row").select(F.concat("kept", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    # supports are shares of all rows, also of those without a common token
    share = fewest / max(fewest, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=1.0, predictionCol="unused").fit(baskets)
    found = model.freqItemsets.select(F.filter("items", lambda x: F.startswith(x, F.lit("label:"))).alias("of"), F.sort_array(F.filter("items", lambda x: ~F.startswith(x, F.lit("label:")))).alias("items"), "freq")
    # combinations with a label, and (label null) how often each is there at all
    found = checkpoint(found.where((F.size("of") < 2) & (F.size("items") > 0)).select("items", F.substr(F.get("of", F.lit(0)), F.lit(len("label:") + 1)).alias("label"), "freq"))
    totals = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}  # a row for each label
    kinds = F.array(*(F.struct(F.lit(k).alias("other"), F.lit(n).alias("rows")) for k, n in sorted(totals.items())))
    rated = found.where("label != ''").select("*", F.filter(kinds, lambda k: k["other"] != F.col("label")).alias("others"), F.filter(kinds, lambda k: k["other"] == F.col("label"))[0]["rows"].alias("own"))
    rated = rated.join(found.where("label is null").select("items", F.col("freq").alias("all")), "items")
    # with another label below the support: taken to be just below it, if there are as many rows
    below = F.least(F.lit(fewest - 1), F.col("rows"), F.col("all") - F.col("freq"))
    against = rated.select("items", "label", "freq", "all", F.inline("others")).join(found.select("items", F.col("label").alias("other"), F.col("freq").alias("seen")), ["items", "other"], "left")
    against = against.groupBy("items", "label").agg(F.max(interval(F.coalesce("seen", below), F.col("rows"), 1)).alias("most"))
    least = interval(F.col("freq"), F.col("own"), -1)
    rules = rated.join(against, ["items", "label"], "left").select("items", "label", (least / (least + F.coalesce("most", F.lit(0.0)))).alias("confidence"), (F.col("freq") / rows).alias("support"))
    rules = checkpoint(rules.where(F.col("confidence") >= confidence).withColumn("id", F.xxhash64("items", "label")))
    # a rule is idle if the rule without one of its tokens says the same with no less confidence
    less = rules.where(F.size("items") > 1).select("id", "confidence", "label", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
    known = rules.select(F.col("items").alias("part"), "label", F.col("confidence").alias("before"))
    idle = less.join(known, ["part", "label"]).where("before >= confidence").select("id").distinct()
    rules = rules.join(idle, "id", "left_anti")
    rare = rules.select("id", F.explode("items").alias("token")).join(common, "token").groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    return rules.join(rare, "id").select("id", "anchor", "items", "label", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, label, confidence): for each row of ``urls`` (row, items) that a rule fits, the best rule's label."""
    looked = urls.select("row", "items", F.explode("items").alias("anchor"))
    hit = looked.join(rules.select("anchor", F.col("items").alias("need"), "label", "confidence", "support"), "anchor").where(F.size(F.array_except("need", "items")) == 0)
    return hit.groupBy("row").agg(F.max_by(F.struct("label", "confidence"), F.struct("confidence", "support", F.size("need"), "label")).alias("best")).select("row", "best.*")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=GIVEN_RULES, default: str = "allow", labels: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, confidence) for each row of ``pages``.

    ``labels`` (url, label) train the method. By default the URLs that a given rule
    decides do, with its verdict, before the background of the others: mined rules carry
    the list over to URLs that it does not name where their tokens are those of URLs
    that it names. Where no mined rule fits either, the verdict is ``default``.
    """
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn("items", tokens(F.col("host"), F.col("path"))).withColumn("row", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    if labels is None:
        labelled = rows.select("items", F.col("given.verdict").alias("label"))
    else:
        lh, lp = parsed(F.col("url"))
        labelled = labels.where("label is not null").select(tokens(lh, lp).alias("items"), "label")
    best = match(rows.where("given is null").select("row", "items"), checkpoint(mine(labelled)))
    out = rows.join(best, "row", "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "label", F.lit(default)).alias("verdict"), "confidence")


def op1_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
