"""Taking over pages that people wrote, with a journal and steps that can be taken back.

All pages are read first, and what is to be done with each is written down before
anything changes: its old text, its new one and its version. Then each page goes
through its states in one task: ``planned`` -> ``written`` (the new text) -> ``claimed``
(its labels). Where the labels fail the old text comes back (``rolled back``); where
that fails too the wiki is left in between (``aborted``), which a log must tell. A task
that runs again finds by the page itself which step was the last, and goes on there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import publish
from .scratch import new_folder
from .wiki import connected, tasks
from .wiki_client import Wiki, WikiError

PLAN = "page_id string, key string, space string, owner string, title string, version long, body string, failure string"
DONE = "page_id string, key string, state string, message string"


def read_pages(asked: DataFrame, options: dict) -> DataFrame:
    """``asked`` (page_id, key) with what each page is now (``owner``: the key that manages it), or the failure to read it."""

    def run(batches):
        import pyarrow as pa

        wiki = connected(options)
        for batch in batches:
            rows = []
            for page_id, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict.fromkeys(("space", "owner", "title", "version", "body", "failure")) | {"page_id": page_id, "key": key}
                try:
                    page = wiki.version(page_id)
                    row |= {"space": wiki.space_of(page_id), "owner": page.key, "title": page.title, "version": page.version, "body": page.body}
                except WikiError as e:
                    row["failure"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in PLAN.split(", ")]))

    return asked.select(F.col("page_id").cast("string").alias("page_id"), F.col("key").cast("string").alias("key")).mapInArrow(run, PLAN)


def planned(pages: DataFrame, space: str, banner: str, placement: str = "below") -> DataFrame:
    """``pages`` with ``error`` (null: can be taken over), ``body_hash`` of the text before, and the ``new_body``."""
    error = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("owner").isNotNull(), F.concat(F.lit("already managed: "), "owner")).when(F.col("space") != space, F.concat(F.lit("in another space: "), "space"))
    # of several claims of one page, and of one key, the first goes on
    first = F.min(F.struct("page_id", "key"))
    own = pages.groupBy("page_id").agg(F.min("key").alias("own_key"))
    keyed = pages.groupBy("key").agg(first.alias("own_page"))
    out = pages.withColumn("error", error).join(own, "page_id").join(keyed, "key")
    twice = (F.col("key") != F.col("own_key")) | (F.col("page_id") != F.col("own_page.page_id"))
    out = out.withColumn("error", F.coalesce("error", F.when(twice, "claimed twice"))).drop("own_key", "own_page")
    old = F.coalesce("body", F.lit(""))
    return out.withColumns({"body_hash": F.concat(F.lit("sha256:"), F.sha2(old.cast("binary"), 256)), "new_body": publish.claimed(old, F.lit(banner), F.col("key"), placement)})


def take_over(wiki: Wiki, row: dict, label: str) -> tuple[str, str | None]:
    """(state, message) of one page, from whatever state it is in."""
    try:
        now = wiki.version(row["page_id"])
        if now.body == row["new_body"]:
            version = now.version  # an earlier run wrote it
        elif now.body == (row["body"] or ""):
            version = wiki.update(row["page_id"], now.version, now.title, row["new_body"]).version
        else:
            return "failed", "the page was changed meanwhile"
    except WikiError as e:
        return "failed", str(e)
    try:
        wiki.label(row["page_id"], [wiki.mark + row["key"], label])
        return "claimed", None
    except WikiError as failed:
        try:
            wiki.update(row["page_id"], version, now.title, row["body"] or "")
        except WikiError as also:
            return "aborted", f"{failed} / {also}"
        return "rolled back", str(failed)


def claim(asked: DataFrame, banner: str, placement: str = "below", label: str = "docloom", **options) -> DataFrame:
    """Take over the pages ``asked`` (page_id, key) of a wiki; an entry of the log for each.

    Rows (page_id, key, operation, outcome, content_hash, state, message): the operation is
    ``claim``, or ``claim_aborted`` where a page is left in between; the hash is that of the
    text before. The journal is three tables in the shared folder: what was read, what was
    planned and what was done. The options are those of the wiki source. An empty list gives no rows.
    """
    spark = asked.sparkSession
    journal = new_folder(spark, "claims")
    asked = asked.where("page_id is not null and key is not null").select("page_id", "key")
    # the plan looks at the pages three times, which are read once
    read_pages(asked.repartition(tasks(spark), "page_id", "key").distinct(), options).write.parquet(f"{journal}/read")
    plan = planned(spark.read.parquet(f"{journal}/read"), options.get("space", "MAIN"), banner, placement)
    plan.write.parquet(f"{journal}/planned")
    plan = spark.read.parquet(f"{journal}/planned")

    def run(batches):
        import pyarrow as pa

        wiki = connected(options)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                state, message = take_over(wiki, row, label)
                rows.append({"page_id": row["page_id"], "key": row["key"], "state": state, "message": message})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], pa.string()) for c in DONE.split(", ")]))

    plan.where("error is null").select("page_id", "key", "body", "new_body").repartition(tasks(spark), "page_id").mapInArrow(run, DONE).write.parquet(f"{journal}/done")
    done = spark.read.schema(DONE).parquet(f"{journal}/done")
    every = plan.select("page_id", "key", "error", "failure", "body_hash").join(done, ["page_id", "key"], "left")
    state = F.coalesce("state", F.lit("rejected"))
    return every.select("page_id", "key", F.when(state == "aborted", "claim_aborted").otherwise("claim").alias("operation"), F.when(state == "claimed", "updated").otherwise("error").alias("outcome"), F.when(F.col("failure").isNull(), F.col("body_hash")).alias("content_hash"), state.alias("state"), F.coalesce("message", "error").alias("message"))
