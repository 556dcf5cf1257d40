"""Readers and writers of a repository's files, logs and reports, as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.candidates import language_of, scanned, with_extension
from ..operators.pages import page_files


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(relative_path, language, content) of the files below ``root`` that are scanned (or have an extension).

    Paths are pruned before any content is read: ``binaryFile`` reads a file's content
    only for rows that remain.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^\\Q"), base, F.lit("\\E")), "")
    keep = with_extension(F.col("relative_path"), *extensions) if extensions else scanned(F.col("relative_path"))
    rows = files.select(path.alias("relative_path"), "content").where(keep)
    return rows.select("relative_path", language_of(F.col("relative_path")).alias("language"), F.decode("content", "utf-8").alias("content"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, raw) of a log of JSON lines, in its order, without blank lines.

    The order within a file is that of its rows; several files follow one another by
    name. A row's place is its number in the part of a file that a task reads, after
    the rows of the parts before; these are counted in a table of one row for each part.
    """
    rows = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    parts = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.where("raw != ''").join(parts, ["file", "start"]).select((F.col("at") + F.col("shift")).alias("seq"), "raw")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """The public keys of a registry file: an object whose ``keys`` is a list of them."""
    return spark.read.schema(f"keys array<struct<{audit.KEYS.replace(' string', ':string')}>>").json(path, multiLine=True).select(F.inline("keys"))


def add_keys(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append keys (few) to a registry file, which is made if it isn't there; keys of before stay, so what they signed can still be verified."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = read_keys(spark, path) if files.exists(hadoop) else spark.createDataFrame([], audit.KEYS)
    keys = [r.asDict() for r in (*known.collect(), *rows.collect())]
    with_bytes = bytearray((json.dumps({"keys": keys}, indent=2) + "\n").encode())
    out = files.create(hadoop, True)
    out.write(with_bytes)
    out.close()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, ...) of Markdown files with what their frontmatter names; files without a key, title or slug are dropped."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("page"))
    return page_files(files).where(F.size("missing") == 0).drop("missing")


def write_pages(pages: DataFrame, path: str) -> None:
    """A file ``<slug>.md`` for each page (slug, page, seq): of pages of one slug the last one stays. Tasks write their own files.

    ``path`` is a folder that all tasks can write to. A file gets its name when it is
    whole, so a task that is tried again, or twice at once, leaves no torn one.
    """
    last = pages.groupBy("slug").agg(F.max_by("page", "seq").alias("page"))

    def put(rows) -> None:
        import uuid
        from pathlib import Path

        folder = Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        for r in rows:
            part = folder / f".{uuid.uuid4().hex}.part"
            part.write_text(r["page"] or "", encoding="utf-8")
            part.replace(folder / f"{r['slug']}.md")

    last.foreachPartition(put)


def write_report(rows: DataFrame, path: str, stamp: str | None = None) -> str:
    """Rows as JSON in a folder; with a ``stamp`` in a folder of that time below it, so that no report overwrites another."""
    at = path if stamp is None else f"{path}/{stamp.replace(':', '-').replace('.', '-')}"
    rows.write.mode("errorifexists").json(at)
    return at


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
