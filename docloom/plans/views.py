"""Inputs of the queries: views of the given tables that look like logs, pages, candidates, drafts and wikis.

Each view has a DataFrame and the same definition as SQL, of which the oracle is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FENCE_CLOSE, FENCE_OPEN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of operations on pages: seq orders them."""
    return audit_of(table(spark, sf_dir, "events"))


def audit_of(events: DataFrame) -> DataFrame:
    """The same of a table or a stream of events."""
    e, k, kind = events, F.col("k"), F.col("event_type")
    e = e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).try_cast("int"))
    operation = F.when(kind == "purchase", "publish").when((kind == "error") & (k >= 50), "retried").otherwise("generate")
    outcome = F.when(kind == "signup", "created").when(kind == "view", "unchanged").when(kind == "error", F.when(k < 50, "error").when(k < 80, "recovered").otherwise("no_help")).otherwise("updated")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("page-"), "user_id").alias("page"), operation.alias("operation"), outcome.alias("outcome"),
        F.concat(F.lit("c"), F.expr("event_id div 400")).alias("commit"), F.when(k % 26 != 25, F.concat(F.lit("v"), k % 26)).alias("prompt_version"),
        F.when(kind != "error", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("body-"), F.col("event_id") % 97).cast("binary"), 256))).alias("content_hash"),
        F.when(k < 60, "high").when(k < 85, "medium").when(k < 97, "low").otherwise("HIGH").alias("confidence"),
        (F.col("event_id") % 40).alias("log"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
    )


AUDIT = """audit AS (SELECT event_id AS seq, 'page-' || user_id AS page,
  CASE WHEN event_type = 'purchase' THEN 'publish' WHEN event_type = 'error' AND k >= 50 THEN 'retried' ELSE 'generate' END AS operation,
  CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'view' THEN 'unchanged'
    WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 'error' WHEN k < 80 THEN 'recovered' ELSE 'no_help' END ELSE 'updated' END AS outcome,
  'c' || (event_id // 400) AS "commit", CASE WHEN k % 26 <> 25 THEN 'v' || (k % 26) END AS prompt_version,
  CASE WHEN event_type <> 'error' THEN 'sha256:' || sha256('body-' || (event_id % 97)) END AS content_hash,
  CASE WHEN k < 60 THEN 'high' WHEN k < 85 THEN 'medium' WHEN k < 97 THEN 'low' ELSE 'HIGH' END AS confidence,
  event_id % 40 AS log, '2024-01-01T00:00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || 'Z' AS timestamp
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions found in source files."""
    i = F.col("doc_id")
    folder = F.get(F.array(*(F.lit(x) for x in ("src", "app/controllers", "test", "build", "shop/views", "lib", "node_modules"))), (i % 7).cast("int"))
    ext = F.get(F.array(*(F.lit(x) for x in (".java", ".CFC", ".cfm", "_controller.rb", "_views.py", ".cs"))), (i % 6).cast("int"))
    name = F.when(i % 3 == 0, F.concat(F.lit("ShopItem"), i % 50, F.lit("Controller.loadAll"))).when(i % 3 == 1, F.concat(F.lit("sync_items_"), i % 50)).otherwise(F.concat(F.lit("XMLOrders#show"), i % 50))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(folder, F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/item"), i % 90, ext).alias("relative_path"), name.alias("name"), (i % 200 + 1).alias("line_start"))


CANDIDATES = """candidates AS (SELECT doc_id,
  ['src', 'app/controllers', 'test', 'build', 'shop/views', 'lib', 'node_modules'][doc_id % 7 + 1] || '/' || coalesce(source, 'none') || '/item' || (doc_id % 90)
    || ['.java', '.CFC', '.cfm', '_controller.rb', '_views.py', '.cs'][doc_id % 6 + 1] AS relative_path,
  CASE doc_id % 3 WHEN 0 THEN 'ShopItem' || (doc_id % 50) || 'Controller.loadAll' WHEN 1 THEN 'sync_items_' || (doc_id % 50) ELSE 'XMLOrders#show' || (doc_id % 50) END AS name,
  doc_id % 200 + 1 AS line_start FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages: frontmatter, sections, fence, and a note of the team behind every fifth fence."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    flow = F.when(i % 4 != 0, F.concat(F.when(i % 3 == 0, "\n\n##  Main flow \n\n1. first step of ").otherwise("\n\n## Main flow\n\n1. first step of "), F.coalesce("source", F.lit("none")), F.lit("\n2. second step"))).otherwise("")
    fence = F.concat(F.lit(f"\n\n---\n\n{FENCE_OPEN} key="), i, F.lit(" -->\ncommit: c"), i % 9, F.lit(f"\n{FENCE_CLOSE}\n"))
    fence = F.when(i % 16 == 9, F.concat(fence, F.lit(f"{FENCE_OPEN} -->again{FENCE_CLOSE}\n"))).otherwise(fence)
    head = F.concat(F.when(i % 6 != 1, F.concat(F.lit("---\nkey: k-"), i, F.lit("\ntitle: T"))).otherwise("---\ntitle: T"), i, F.when(i % 10 != 3, F.concat(F.lit("\nslug: t-"), i)).otherwise(""), F.lit("\nconfidence: "), F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("HIGH"), F.lit("\n---\n\n## Summary\n\n"))
    note = F.when(i % 5 == 0, F.concat(F.lit("Team note "), i)).otherwise("")
    return docs.select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), flow, F.when(i % 8 == 7, "").otherwise(fence), note).alias("page"))


PAGES = f"""pages_md AS (SELECT doc_id, '---\n' || CASE WHEN doc_id % 6 <> 1 THEN 'key: k-' || doc_id || '\n' ELSE '' END || 'title: T' || doc_id || CASE WHEN doc_id % 10 <> 3 THEN '\nslug: t-' || doc_id ELSE '' END || '\nconfidence: '
  || CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'HIGH' END || '\n---\n\n## Summary\n\n' || coalesce(text, '')
  || CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN '\n\n##  Main flow \n\n1. first step of ' ELSE '\n\n## Main flow\n\n1. first step of ' END || coalesce(source, 'none') || '\n2. second step' ELSE '' END
  || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '\n\n---\n\n{FENCE_OPEN} key=' || doc_id || ' -->\ncommit: c' || (doc_id % 9) || '\n{FENCE_CLOSE}\n' || CASE WHEN doc_id % 16 = 9 THEN '{FENCE_OPEN} -->again{FENCE_CLOSE}\n' ELSE '' END END
  || CASE WHEN doc_id % 5 = 0 THEN 'Team note ' || doc_id ELSE '' END AS page FROM documents)"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of use cases: the assistant's turns; some fields are blank, null or empty."""
    c, i, text = table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.col("conv_id"), F.coalesce("text", F.lit(""))
    dash = F.when(i % 11 == 0, "\u2014").otherwise("")
    pair = lambda a, b, n, m: F.struct(F.lit(n).alias(a), F.concat(F.lit(m), i).alias(b))
    steps = F.transform(F.split(text, r"\. "), lambda s: F.struct(s.alias("step"), F.when(i % 6 == 1, F.concat(F.lit("note "), i)).alias("footnote")))
    return c.select(
        "conv_id", "turn", F.when(F.col("turn") % 5 == 0, " ").otherwise(F.concat(F.lit("Title "), i)).alias("title"), F.when(i % 7 == 0, "  ").otherwise(text).alias("summary"),
        F.when(F.col("turn") % 3 != 0, F.lit("Visitor")).alias("actor"), F.when(i % 4 != 0, F.lit("A form is sent")).alias("trigger"), F.array(F.lit("Signed in"), F.concat(F.lit("At "), i)).alias("preconditions"),
        F.when(i % 13 != 5, steps).alias("main_flow"), F.array(pair("label", "description", "Bad", "The file is missing")).alias("alternate_flows"), F.when(i % 6 != 0, F.array(F.lit("A row is stored"))).alias("postconditions"),
        F.array(F.struct(F.concat(F.lit("Cache is cleared"), dash).alias("rule"), F.when(i % 5 == 2, "see code").alias("footnote"))).alias("business_rules"), F.array(pair("label", "gwt", "Happy", "Given ")).alias("test_scenarios"),
        F.array(F.struct(F.concat(F.lit("t-"), i).alias("slug"), F.lit("Other page").alias("title"))).alias("related"), F.when(i % 5 == 0, F.array(F.lit("orders"), F.lit("JSON"))).when(i % 5 == 1, F.array(F.lit("sql"), F.lit("api"))).when(i % 5 == 2, F.array(F.lit("orders"))).alias("tags"),
        F.when(i % 9 == 0, "HIGH").when(i % 9 == 1, "").when(i % 9 != 2, "high").alias("confidence"), F.lit("clear code").alias("confidence_reason"),
    )


DRAFTS = """drafts AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN ' ' ELSE 'Title ' || conv_id END AS title,
  CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE coalesce(text, '') END AS summary,
  CASE WHEN turn % 3 <> 0 THEN 'Visitor' END AS actor, CASE WHEN conv_id % 4 <> 0 THEN 'A form is sent' END AS trigger_, ['Signed in', 'At ' || conv_id] AS preconditions,
  CASE WHEN conv_id % 13 <> 5 THEN list_transform(string_split(coalesce(text, ''), '. '), lambda s: {'step': s, 'footnote': CASE WHEN conv_id % 6 = 1 THEN 'note ' || conv_id END}) END AS main_flow,
  [{'label': 'Bad', 'description': 'The file is missing' || conv_id}] AS alternate_flows, CASE WHEN conv_id % 6 <> 0 THEN ['A row is stored'] END AS postconditions,
  [{'rule': 'Cache is cleared' || CASE WHEN conv_id % 11 = 0 THEN chr(8212) ELSE '' END, 'footnote': CASE WHEN conv_id % 5 = 2 THEN 'see code' END}] AS business_rules,
  [{'label': 'Happy', 'gwt': 'Given ' || conv_id}] AS test_scenarios, [{'slug': 't-' || conv_id, 'title': 'Other page'}] AS related,
  CASE conv_id % 5 WHEN 0 THEN ['orders', 'JSON'] WHEN 1 THEN ['sql', 'api'] WHEN 2 THEN ['orders'] END AS tags,
  CASE conv_id % 9 WHEN 0 THEN 'HIGH' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'high' END AS confidence, 'clear code' AS confidence_reason FROM conversations WHERE role = 'assistant')"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wiki's inventory: some pages carry the pipeline's key, the rest only a title."""
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.when(i % 3 == 0, i).alias("key"), F.when(i % 2 == 0, F.concat(F.lit("t"), i)).otherwise(F.concat(F.lit("Own "), i)).alias("title"))


WIKI = """wiki AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id END AS key, CASE WHEN page_id % 2 = 0 THEN 't' || page_id ELSE 'Own ' || page_id END AS title FROM pages)"""
