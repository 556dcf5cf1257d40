"""Publishing as joins of pages with a wiki's inventory: preflight, upsert, text that people wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE_CLOSE, FENCE_OPEN, after_fence


def effective_title(title: Column, prefix: Column) -> Column:
    """The title behind the trimmed prefix and a blank; the title if the prefix is blank or null."""
    p = F.trim(prefix)
    return F.when(F.coalesce(p, F.lit("")) == "", title).otherwise(F.concat(p, F.lit(" "), title))


def preflight(pages: DataFrame, wiki: DataFrame, prefix: str = "", any_case: bool = True, target: str = "wiki") -> DataFrame:
    """(doc_id, outcome, existing, match_reason, suggested_action) of pages (doc_id, title): managed, renamed, collision or clean.

    A wiki page of the same key is managed (renamed if its title differs in more than
    case); else the least page without a key and of the same title collides, in any case
    or only in the same one. Titles have the ``prefix``.
    """
    key = (lambda c: F.lower(c)) if any_case else (lambda c: F.col(c))
    pages = pages.withColumn("title", effective_title(F.col("title"), F.lit(prefix)))
    keyed = wiki.where("key is not null").groupBy(F.col("key").alias("k")).agg(F.min(F.struct("page_id", "title")).alias("own"))
    free = wiki.where("key is null").groupBy(key("title").alias("t")).agg(F.min("page_id").alias("other"))
    joined = pages.join(keyed, pages["doc_id"] == keyed["k"], "left").join(free.withColumnRenamed("t", "u"), key("title") == F.col("u"), "left")
    own, other = F.col("own").isNotNull(), F.col("own").isNull() & F.col("other").isNotNull()
    outcome = F.when(own, F.when(F.lower("own.title") == F.lower("title"), "managed").otherwise("renamed")).when(other, "collision").otherwise("clean")
    action = F.when(other, claim_command(F.lit(target), F.col("doc_id"), F.col("other")))
    return joined.select("doc_id", outcome.alias("outcome"), F.when(own, F.col("own.page_id")).when(other, F.col("other")).alias("existing"), F.when(own, "label").when(other, "title_exact_ci").alias("match_reason"), action.alias("suggested_action"))


def claim_command(target: Column, key: Column, page: Column) -> Column:
    """The command that takes over an existing page."""
    return F.concat(F.lit("docloom claim --target "), target, F.lit(" --page "), page, F.lit(" --map-to "), key)


def summary(found: DataFrame) -> DataFrame:
    """One row: the count of each outcome, zero where there is none."""
    return found.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("clean", "managed", "collision", "renamed")))


def upsert(pages: DataFrame, wiki: DataFrame) -> DataFrame:
    """The wiki after publishing: (key, page_id, title, version, action, message) of pages created and updated, and of those left alone.

    ``pages`` (doc_id, title, and perhaps ``failure``, a message): a page that fails is
    skipped with its message and the others go on. A page's version grows by one.
    """
    if "failure" not in pages.columns:
        pages = pages.withColumn("failure", F.lit(None).cast("string"))
    if "version" not in wiki.columns:
        wiki = wiki.withColumn("version", F.lit(1).cast("long"))
    own = wiki.where("key is not null").select("key", "page_id", F.col("title").alias("old"), "version")
    both = pages.join(own, pages["doc_id"] == own["key"], "full_outer")
    action = F.when(F.col("doc_id").isNull(), "kept").when(F.col("failure").isNotNull(), "skipped").when(F.col("page_id").isNull(), "created").otherwise("updated")
    title = F.when(F.col("failure").isNotNull(), F.col("old")).otherwise(F.coalesce("title", "old"))
    version = F.when(action.isin("kept", "skipped"), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    written = both.select(F.coalesce("doc_id", "key").alias("key"), "page_id", title.alias("title"), version.cast("long").alias("version"), action.alias("action"), F.col("failure").alias("message"))
    return written.unionByName(wiki.where("key is null").select("key", "page_id", "title", F.col("version").cast("long"), F.lit("kept").alias("action"), F.lit(None).cast("string").alias("message")))


def dry_run(pages: DataFrame, wiki: DataFrame) -> DataFrame:
    """(doc_id, action): what publishing would do, from keys alone."""
    own = wiki.where("key is not null").select("key").distinct()
    return pages.join(own, pages["doc_id"] == own["key"], "left").select("doc_id", F.when(F.col("key").isNull(), "created").otherwise("updated").alias("action"))


def totals(results: DataFrame) -> DataFrame:
    """One row: pages created, updated and skipped."""
    return results.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped")))


def file_changes(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, change): created, updated or unchanged, by the whole text of the file of the slug (slug, content)."""
    old = files.select(F.col("slug").alias("s"), F.col("content").alias("old"))
    both = pages.join(old, pages["slug"] == old["s"], "left")
    return both.select("slug", F.when(F.col("s").isNull(), "created").when(F.col("page").eqNullSafe(F.col("old")), "unchanged").otherwise("updated").alias("change"))


def merged(new: Column, old: Column) -> Column:
    """The new page, followed by what people wrote behind the old one's fence, as it is; a blank rest goes."""
    note = after_fence(old)
    return F.when(F.rlike(note, F.lit(r"(?U)\S")), F.concat(new, note)).otherwise(new)


def claimed(body: Column, banner: Column, key: Column, placement: str = "below") -> Column:
    """A page that people wrote, taken over: banner, empty fence and the old body below (or above) it."""
    if placement not in ("above", "below"):
        raise ValueError(f"placement is above or below: {placement}")
    fence = F.concat(F.lit(f"{FENCE_OPEN} id="), key, F.lit(f" -->\n{FENCE_CLOSE}"))
    rule = F.lit("<hr/>\n<h2>Original content (preserved)</h2>\n")
    parts = [banner, F.lit("\n"), body, F.lit("\n"), rule, fence] if placement == "above" else [banner, F.lit("\n"), fence, F.lit("\n"), rule, body]
    return F.concat(*parts)


def claims(pages: DataFrame, space: str) -> DataFrame:
    """``pages`` (key, labels, space, body) with ``error`` (null if it can be taken over) and the hash of the body before."""
    own = F.filter("labels", lambda x: F.startswith(x, F.lit("key-")))
    error = F.when(F.size(own) > 0, F.concat(F.lit("already managed: "), own[0])).when(F.col("space") != space, F.concat(F.lit("in another space: "), "space"))
    return pages.withColumn("error", error).withColumn("body_hash", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)))


def replaced_blocks(old: DataFrame, new: DataFrame, banner: str = "\U0001f4dd") -> DataFrame:
    """(page_id, part, pos, type, text): the blocks of each page after an update.

    A page that was taken over has a banner (a callout of that emoji) and a divider behind
    it: what lies between them is replaced, the rest stays. Of other pages all goes. The
    new banner is part 1, new blocks part 2; what stays before is part 0, behind part 3.
    """
    flag = (F.col("type") == "callout") & F.col("emoji").eqNullSafe(F.lit(banner))
    first = old.groupBy("page_id").agg(F.min(F.when(flag, F.col("pos"))).alias("at"))
    rule = old.join(first, "page_id").where((F.col("type") == "divider") & (F.col("pos") > F.col("at"))).groupBy("page_id").agg(F.min("pos").alias("until"))
    found = first.join(rule, "page_id")
    stay = old.join(found, "page_id").where((F.col("pos") < F.col("at")) | (F.col("pos") >= F.col("until")))
    stay = stay.select("page_id", F.when(F.col("pos") < F.col("at"), 0).otherwise(3).alias("part"), "pos", "type", "text")
    pages = new.select("page_id").union(old.select("page_id")).distinct()
    head = pages.select("page_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("callout").alias("type"), F.lit("banner").alias("text"))
    return stay.unionByName(head).unionByName(new.select("page_id", F.lit(2).alias("part"), "pos", "type", "text"))


# Block types that cannot be written back.
READONLY = ("unsupported", "child_database", "child_page")


def writable_block(kind: Column, text: Column) -> Column:
    """(type, text) of a block that is written back; one that cannot be becomes a paragraph that says so."""
    bad = kind.isin(*READONLY)
    return F.struct(F.when(bad, "paragraph").otherwise(kind).alias("type"), F.when(bad, F.concat(F.lit("(a block of type "), kind, F.lit(" was not kept)"))).otherwise(text).alias("text"))


def parallel_parent(pinned: Column, by_label: Column, by_title: Column) -> Column:
    """(id, made): the parent of pages in parallel mode: the pinned one, that of the label, of the title, or one to be made."""
    found = F.coalesce(F.nullif(pinned, F.lit("")), by_label, by_title)
    return F.struct(found.alias("id"), found.isNull().alias("made"))


def settings(cli_mode: Column, mode: Column, prefix: Column) -> Column:
    """(mode, slug_prefix): of the command line, else of the file, else greenfield; a prefix by default in parallel mode only."""
    chosen = F.coalesce(cli_mode, mode, F.lit("greenfield"))
    return F.struct(chosen.alias("mode"), F.coalesce(prefix, F.when(chosen == "parallel", "docloom/")).alias("slug_prefix"))


def labels(key: Column, tags: Column, label: str = "docloom") -> Column:
    """The labels of a page: its key, the label of all pages, and its tags that are made of letters, digits and dashes."""
    good = F.filter(tags, lambda t: F.rlike(t, F.lit("^[A-Za-z0-9-]+$")))
    return F.concat(F.array(F.concat(F.lit("key-"), key), F.lit(label)), F.transform(good, lambda t: F.concat(F.lit("tag-"), F.lower(t))))
