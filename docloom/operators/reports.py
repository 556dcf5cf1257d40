"""Reports over pages and logs: snapshots of a repository, their differences, cost estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_of, fence_body, flow_words, frontmatter_fields, round_half_up, sections, without_frontmatter

# Dollars for a token in and out, share that cached input costs, tokens out for a page.
RATES = {"first": (3 / 1_000_000, 15 / 1_000_000, 0.5), "second": (0.27 / 1_000_000, 1.10 / 1_000_000, 1.0)}
OUTPUT_TOKENS = 3_000


def page_snapshots(pages: DataFrame) -> DataFrame:
    """(doc_id, body_hash, fence_hash, keys, headings, n_lines, words): what a page is, its fence apart."""
    body = pages.select("doc_id", "page", body_of(F.col("page")).alias("body"))
    return body.select(
        "doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"), F.sha2(fence_body(F.col("page")).cast("binary"), 256).alias("fence_hash"), F.array_join(F.array_sort(F.map_keys(frontmatter_fields(F.col("page")))), ",").alias("keys"),
        F.array_join(sections(F.col("body")), "|").alias("headings"), F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("n_lines"), flow_words(without_frontmatter(F.col("page"))).alias("words"),
    )


def repo_snapshots(pages: DataFrame, retried: DataFrame | None = None) -> DataFrame:
    """One row for each repo of ``pages`` (repo, confidence, words, n_lines): counts, means and the share of high confidence.

    ``retried`` (repo, issues: array of struct with field and severity) adds the count of
    retries and of their warnings by field (null: ``unknown``); repos of retries alone have no pages.
    """
    level = lambda c: F.count_if(F.col("confidence") == c)
    out = pages.groupBy("repo").agg(F.count("*").alias("pages"), level("high").alias("high"), level("medium").alias("medium"), level("low").alias("low"), F.sum(F.coalesce("words", F.lit(0))).alias("w"), F.sum(F.coalesce("n_lines", F.lit(0))).alias("l"))
    if retried is not None:
        times = retried.groupBy("repo").agg(F.count("*").alias("retried"))
        warned = retried.select("repo", F.explode("issues").alias("i")).where("i.severity = 'warn'").groupBy("repo", F.coalesce("i.field", F.lit("unknown")).alias("field")).agg(F.count("*").alias("n"))
        warned = warned.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "n"))), ",").alias("warnings"))
        out = out.join(times.join(warned, "repo", "left"), "repo", "full_outer")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("pages", "high", "medium", "low", "w", "l", "retried")}
        out = out.withColumns(zero | {"warnings": F.coalesce("warnings", F.lit(""))})
    mean = lambda c: F.when(F.col("pages") == 0, 0.0).otherwise(round_half_up(F.col(c) / F.greatest(F.col("pages"), F.lit(1))))
    rated = F.col("high") + F.col("medium") + F.col("low")
    share = F.when(rated == 0, 0.0).otherwise(round_half_up(F.col("high") / F.greatest(rated, F.lit(1)) * 100))
    return out.select("repo", "pages", "high", "medium", "low", mean("w").alias("avg_words"), mean("l").alias("avg_lines"), share.alias("high_pct"), *(["retried", "warnings"] if retried is not None else []))


def diff(prior: DataFrame, current: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(repo, only_in, delta_pp, regressed, any_regressed): a repo regressed if its share of high confidence fell by ``threshold`` points.

    ``any_regressed`` says so of all repos together; repos of one side alone do not count.
    """
    p, c = prior.alias("p"), current.alias("c")
    both = p.join(c, F.col("p.repo") == F.col("c.repo"), "full_outer")
    delta = round_half_up(F.col("c.high_pct") - F.col("p.high_pct"))
    out = both.select(F.coalesce("p.repo", "c.repo").alias("repo"), F.when(F.col("c.repo").isNull(), "prior").when(F.col("p.repo").isNull(), "current").alias("only_in"), delta.alias("delta_pp"), F.coalesce(-delta >= threshold, F.lit(False)).alias("regressed"))
    return out.join(F.broadcast(out.agg(F.coalesce(F.bool_or("regressed"), F.lit(False)).alias("any_regressed"))))  # one row


def cost(tokens: DataFrame, tier: str = "first") -> DataFrame:
    """One row: what drafts of ``tokens`` (system_tokens, user_tokens) cost. Zero for none."""
    rate_in, rate_out, cached = RATES[tier]
    t = tokens.agg(F.count("*").alias("pages"), F.coalesce(F.sum("system_tokens"), F.lit(0)).alias("system"), F.coalesce(F.sum("user_tokens"), F.lit(0)).alias("user"))
    costs = t.withColumns({"cached_usd": F.col("system") * rate_in * cached, "uncached_usd": F.col("user") * rate_in, "output_usd": F.col("pages") * OUTPUT_TOKENS * rate_out})
    return costs.withColumn("total_usd", F.col("cached_usd") + F.col("uncached_usd") + F.col("output_usd"))


def over_budget(estimate: DataFrame, dollars: float = 5.0) -> DataFrame:
    """``estimate`` with ``stop``: whether its total is above ``dollars``, so that nothing may be written."""
    return estimate.withColumn("stop", F.col("total_usd") > dollars)
