"""Texts that hold others: a join by containment through an inverted index of letter groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kebab_name
from ..sources.scratch import new_folder, shared_folder

#: Letters in a group of the index; shorter needles are groups of their own length.
GROUP = 3
#: Groups of needles (some 100 bytes each) that may be broadcast.
BROADCAST_GROUPS = 100_000


def groups(text: Column, size: int) -> Column:
    """The distinct groups of ``size`` letters that stand in a text."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_distinct(F.when(F.length(text) >= size, some).otherwise(F.array().cast("array<string>")))


def holding(needles: DataFrame, stacks: DataFrame, needle: str = "needle", stack: str = "stack") -> DataFrame:
    """(needle, stack): the distinct pairs in which a text of ``stacks`` holds one of ``needles``. Null and empty needles are in none.

    A needle is looked up by that of its groups which the fewest texts hold, so a pair is
    formed only of texts that share a needle's rarest group; then it is verified. The
    index has the needles' groups alone, and is not shuffled where these are few.
    """
    ask = needles.where(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    texts = stacks.where(F.col(stack).isNotNull()).select(F.col(stack).alias("stack")).distinct()
    sizes = [r["size"] for r in ask.select(F.least(F.length("needle"), F.lit(GROUP)).alias("size")).distinct().collect()]  # at most GROUP rows
    own = F.when(F.length("needle") < GROUP, F.array("needle")).otherwise(groups(F.col("needle"), GROUP))
    asked = ask.select("needle", F.explode(own).alias("group"))
    few = asked.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda df: df
    every = F.flatten(F.array(*(groups(F.col("stack"), n) for n in sorted(sizes)))) if sizes else F.array().cast("array<string>")
    index = texts.select("stack", F.explode(every).alias("group"))
    found = index.join(small(asked.select("group").distinct()), "group", "left_semi").groupBy("group").agg(F.count("*").alias("texts"))
    # a group that no text holds leaves its needle without a pair
    rated = asked.join(found, "group", "left")
    probe = rated.groupBy("needle").agg(F.min_by("group", F.struct(F.coalesce("texts", F.lit(0)), "group")).alias("group"))
    return index.join(small(probe), "group").where(F.contains("stack", F.col("needle"))).select("needle", "stack")


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def slug_pairs(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """(name, slug): the distinct pairs of ``names`` (name) and ``slugs`` (slug) that ``slug_matches`` accepts, without a nested loop.

    A slug holds the kebab name, or the kebab name holds the slug's first part; a slug
    that begins with a dash has an empty first part, which every name holds. Names and
    slugs are written to the shared folder, as each is read several times. The three kinds
    of pairs exclude one another, so that pairs are not compared again.
    """
    kebabs = _written(names.select("name").distinct().select("name", kebab_name(F.col("name")).alias("kebab")).where("kebab <> ''"), "kebabs")
    parts = _written(slugs.where("slug is not null").select("slug").distinct().select("slug", F.split("slug", "-")[0].alias("part")), "parts")
    by_slug = holding(kebabs, parts, "kebab", "slug").toDF("kebab", "slug").join(kebabs, "kebab")
    by_name = holding(parts.where("part <> ''"), kebabs, "part", "kebab").toDF("part", "kebab").join(kebabs, "kebab").join(parts, "part")
    # a slug without a first part (a title never gives one) goes with every name: an equality that all rows fulfil deals these out by no key
    every = lambda c: F.least(F.length(c), F.lit(0)).alias("every")
    bare = parts.where("part = ''").select("slug", every("part")).join(kebabs.select("name", "kebab", every("kebab")), "every")
    by_name, bare = (df.where(~F.contains("slug", F.col("kebab"))) for df in (by_name, bare))
    return by_slug.select("name", "slug").union(by_name.select("name", "slug")).union(bare.select("name", "slug"))


def ranked_titles(pages: DataFrame, folder: Column, collation: str = "UNICODE") -> DataFrame:
    """(folder, pages, rank, title): the titles of each folder, in the order of a collation and then of code points, numbered from 1.

    Rows are dealt out by ranges of folder and title, and a range's rows are numbered
    after those before it, which one row for each range and folder counts: no folder is
    gathered, however many pages it has. The sorted rows are written to the checkpoint folder.
    """
    spark = pages.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    order = (F.col("folder"), F.collate("title", collation), F.col("title"))
    rows = pages.select(folder.alias("folder"), "title")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).checkpoint()
    counts = rows.groupBy("folder", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("folder").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("folder", "range", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("n").over(Window.partitionBy("folder")).alias("pages"))
    return rows.join(counts, ["folder", "range"]).select("folder", "pages", (F.col("at") + F.col("shift")).alias("rank"), "title")
