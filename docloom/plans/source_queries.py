"""Queries on sources: a repository that the tables are written to and read from."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..sources import claims, git, scratch, wiki
from .base import query
from .views import table


def _commit(files, root: str, message: str, parent: str | None) -> str:
    """Write files (path of three parts, content) as a commit; returns its name."""
    level = git.write_loose(files.select(F.lit("blob").alias("type"), "content", "path"), root).withColumn("mode", F.lit("100644"))
    for _ in range(3):
        # name and folder of what is written: the folders are trees, the last of them the root
        up = level.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "mode", F.substring_index("path", "/", -1).alias("name"), "sha")
        level = git.write_loose(git.tree_rows(up, "folder"), root).withColumnRenamed("folder", "path").withColumn("mode", F.lit("040000"))
    tree = level.first()["sha"]
    text = f"tree {tree}\n" + (f"parent {parent}\n" if parent else "") + "author a <a@b> 1700000000 +0000\ncommitter a <a@b> 1700000000 +0000\n\n" + message + "\n"
    spark = files.sparkSession
    return git.write_loose(spark.createDataFrame([("commit", text.encode())], "type string, content binary"), root).first()["sha"]


_PATH = "coalesce(source, 'none') || '/' || (doc_id % 50) || '/' || doc_id || '.txt'"


@query(f"""WITH d AS (SELECT {_PATH} AS path, coalesce(text, '') AS text, doc_id FROM documents),
  a AS (SELECT path, text FROM d WHERE doc_id % 11 <> 4), b AS (SELECT path, text || CASE WHEN doc_id % 7 = 3 THEN ' changed' ELSE '' END AS text FROM d WHERE doc_id % 11 <> 5),
  c AS (SELECT coalesce(a.path, b.path) AS path, a.text AS old, b.text AS new FROM a FULL JOIN b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text),
  come AS (SELECT new AS text, count(*) AS n FROM c WHERE old IS NULL GROUP BY 1),
  moved AS (SELECT path FROM (SELECT path, n, row_number() OVER (PARTITION BY old ORDER BY path) AS r FROM c JOIN come ON c.old = come.text WHERE c.new IS NULL) WHERE r <= n)
  SELECT path FROM c WHERE path NOT IN (SELECT path FROM moved)""")
def git_changed(spark, sf_dir):
    """Documents as two commits of a repository: files that came, went and changed between them."""
    root = scratch.new_folder(spark, "repository").removeprefix("file:")
    Path(root, "refs/heads").mkdir(parents=True)
    Path(root, "objects").mkdir()
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i, F.concat_ws("/", F.coalesce("source", F.lit("none")), i % 50, F.concat(i, F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    first = _commit(d.where(i % 11 != 4), root, "first", None)
    second = _commit(d.where(i % 11 != 5).withColumn("content", F.when(i % 7 == 3, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))), root, "second", first)
    Path(root, "HEAD").write_text("ref: refs/heads/main\n")
    Path(root, "refs/heads/main").write_text(second + "\n")
    return git.changed_since(spark, root, first).select("path")


@query("SELECT page_id::VARCHAR AS key, CASE WHEN page_id % 3 = 0 THEN 'rejected' ELSE 'claimed' END AS state, CASE WHEN page_id % 3 = 0 THEN 'already managed: own-' || page_id END AS message, 'sha256:' || sha256(coalesce(html, '')) AS content_hash, md5(CASE WHEN page_id % 3 = 0 THEN coalesce(html, '') ELSE '<p>ours</p>' || chr(10) || '<!-- managed:start id=' || page_id || ' -->' || chr(10) || '<!-- managed:end -->' || chr(10) || '<hr/>' || chr(10) || '<h2>Original content (preserved)</h2>' || chr(10) || coalesce(html, '') END) AS body FROM pages")
def wiki_claims(spark, sf_dir):
    """All web pages as pages of a wiki, a third of them managed already; the claims' log with what each page is afterwards."""
    at = {"url": "folder:" + scratch.new_folder(spark, "claimed").removeprefix("file:"), "space": "DOCS"}
    i = F.col("page_id")
    web = table(spark, sf_dir, "pages").select(i.cast("string").alias("key"), F.concat(F.lit("T"), i).alias("title"), F.coalesce("html", F.lit("")).alias("body"), F.when(i % 3 == 0, F.array(F.concat(F.lit("docloom-own-"), i))).otherwise(F.array().cast("array<string>")).alias("labels"))
    wiki.publish_to(web, mark="people-", **at)
    theirs = wiki.read_wiki(spark, mark="people-", **at).select("page_id", "key")
    told = claims.claim(theirs, "<p>ours</p>", **at)
    after = wiki.read_wiki(spark, **at).select("page_id", F.md5(F.col("body").cast("binary")).alias("body"))
    return told.join(after, "page_id").select("key", "state", "message", "content_hash", "body")
