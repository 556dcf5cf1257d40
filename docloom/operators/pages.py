"""Pages of the documentation: rendering, footnotes, blocks, banners, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FENCE_CLOSE, FENCE_OPEN, escape_markup, frontmatter_fields, without_frontmatter

#: What the frontmatter of a page must name.
REQUIRED = ("key", "title", "slug")


def page_files(files: DataFrame, page: str = "page") -> DataFrame:
    """``files`` with the fields of their frontmatter and ``missing``, the required ones that are absent or empty."""
    fields = frontmatter_fields(F.col(page))
    missing = F.filter(F.array(*(F.when(F.coalesce(fields[k], F.lit("")) == "", k) for k in REQUIRED)), lambda k: k.isNotNull())
    return files.select("*", *(fields[k].alias(f"page_{k}") for k in REQUIRED), missing.alias("missing"))


def complete_pages(files: DataFrame, page: str = "page") -> DataFrame:
    """One row: pages whose frontmatter has all that it must, and all pages."""
    return page_files(files, page).agg(F.count_if(F.size("missing") == 0).alias("ok"), F.count("*").alias("total"))


def linked(related: Column, known: Column | None = None) -> Column:
    """Lines of related pages (slug, title): links, but plain titles for slugs that are not ``known`` (an array; null: all are)."""
    link = lambda r: F.concat(F.lit("- ["), r["title"], F.lit("]("), r["slug"], F.lit(")"))
    plain = lambda r: F.concat(F.lit("- "), r["title"])
    return F.transform(related, link if known is None else lambda r: F.when(known.isNull() | F.array_contains(known, r["slug"]), link(r)).otherwise(plain(r)))


def with_known(pages: DataFrame, slugs: DataFrame, key: str = "key", related: str = "related") -> DataFrame:
    """``pages`` with ``known``: the slugs of their related pages that are in ``slugs`` (slug). A join by slug: no list of all slugs is held."""
    asked = pages.select(key, F.explode(F.transform(related, lambda r: r["slug"])).alias("slug")).distinct()
    found = asked.join(slugs.select("slug").distinct(), "slug").groupBy(key).agg(F.collect_set("slug").alias("known"))
    return pages.join(found, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def body(pages: DataFrame, known: Column | None = None) -> Column:
    """The sections of a page of a use case, as Markdown; sections without content are left out."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda c: F.size(F.col(c)) > 0
    noted = lambda x: F.coalesce(x["footnote"], F.lit("")) != ""

    def items(column: str, field: str, word: str, lead) -> tuple[Column, Column]:
        lines = F.transform(column, lambda x, i: F.concat(lead(i), x[field], F.when(noted(x), F.concat(F.lit(f" [^{word}"), i + 1, F.lit("]"))).otherwise("")))
        notes = F.transform(column, lambda x, i: F.when(noted(x), F.concat(F.lit(f"[^{word}"), i + 1, F.lit("]: "), x["footnote"])))
        return F.array_join(lines, "\n"), F.array_join(F.array_compact(notes), "\n")

    flow, flow_notes = items("main_flow", "step", "step", lambda i: F.concat(i + 1, F.lit(". ")))
    rules, rule_notes = items("business_rules", "rule", "rule", lambda i: F.lit("- "))
    files = F.transform("source_files", lambda s: F.concat(F.lit("- `"), s["path"], F.lit("` lines "), s["lines"]))
    parts = [
        F.lit("## Summary"), F.col("summary"), F.lit("## Actor and triggers"), F.concat(F.lit("- **Actor:** "), "actor"), F.when(F.coalesce("trigger", F.lit("")) != "", F.concat(F.lit("- **Trigger:** "), "trigger")),
        F.when(some("preconditions"), F.concat(F.lit("## Preconditions\n\n"), bullets("preconditions"))),
        F.when(some("main_flow"), F.concat(F.lit("## Main flow\n\n"), flow)), F.when(some("main_flow"), F.nullif(flow_notes, F.lit(""))),
        F.when(some("alternate_flows"), F.concat(F.lit("## Alternate and exception flows\n\n"), F.array_join(F.transform("alternate_flows", lambda a: F.concat(F.lit("- **"), a["label"], F.lit(":** "), a["description"])), "\n"))),
        F.when(some("postconditions"), F.concat(F.lit("## Postconditions\n\n"), bullets("postconditions"))),
        F.when(some("business_rules"), F.concat(F.lit("## Business rules\n\n"), rules)), F.when(some("business_rules"), F.nullif(rule_notes, F.lit(""))),
        F.when(some("test_scenarios"), F.concat(F.lit("## Suggested test scenarios\n\n"), F.array_join(F.transform("test_scenarios", lambda t: F.concat(F.lit("- **"), t["label"], F.lit("**: "), t["gwt"])), "\n"))),
        F.when(some("related"), F.concat(F.lit("## Related use cases\n\n"), F.array_join(linked(F.col("related"), known), "\n"))),
        F.lit("## Source links"), F.lit("<details>"), F.lit("<summary>Implementation files (for developers and auditors)</summary>"), F.lit(""),
        F.when(some("source_files"), F.array_join(files, "\n")).otherwise("- (no source files recorded)"), F.lit(""), F.lit("</details>"),
    ]
    return F.concat_ws("\n\n", *parts)


def footer(pages: DataFrame) -> Column:
    """The fence at the end of a page: when, from what and how surely it was made."""
    why = F.when(F.coalesce("confidence_reason", F.lit("")) != "", F.concat(F.lit(", "), "confidence_reason")).otherwise("")
    return F.concat(
        F.lit(f"{FENCE_OPEN} id="), "key", F.lit(" -->\n*Generated from commit `"), "last_commit", F.lit("` on "), "last_generated", F.lit(".*\n*Confidence: **"), "confidence", F.lit("**"), why, F.lit(f"*\n{FENCE_CLOSE}\n"),
    )


def quoted_scalar(text: Column) -> Column:
    """A text as a scalar of YAML: plain where it reads back as the same text, else in single quotes."""
    odd = r"\A\s|\s\z|\A\z|\A[-?:,\[\]{}#&*!|>'\"%@`]|: |:\z| #|\n|\A(?:true|false|null|yes|no|on|off|~)\z|\A[-+.0-9][0-9_.eE+-]*\z|\A\d{4}-\d\d-\d\d"
    safe = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.rlike(text, F.lit(f"(?i){odd}")), F.when(F.contains(text, F.lit("\n")), F.to_json(F.array(text)).substr(F.lit(2), F.char_length(F.to_json(F.array(text))) - 2)).otherwise(safe)).otherwise(text)


def rendered(pages: DataFrame, known: Column | None = None) -> Column:
    """The whole page: frontmatter, sections, fence."""
    plain = ("key", "title", "slug", "actor", "status", "last_generated", "last_commit", "confidence")
    head = [F.concat(F.lit(f"{c}: "), quoted_scalar(F.col(c))) for c in plain]
    files = F.array_join(F.transform("source_files", lambda s: F.concat(F.lit("  - path: "), quoted_scalar(s["path"]), F.lit("\n    lines: "), quoted_scalar(s["lines"]))), "\n")
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), quoted_scalar(t))), "\n")
    lists = [F.when(F.size(c) > 0, F.concat(F.lit(f"{n}:\n"), text)).otherwise(f"{n}: []") for n, c, text in (("source_files", "source_files", files), ("tags", "tags", tags))]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *head, *lists), F.lit("\n---\n\n"), body(pages, known), F.lit("\n\n---\n\n"), footer(pages))


_DEFINITION, _REFERENCE = r"^\[\^([A-Za-z0-9_-]+)\]:\s*(.+)$", r"\[\^([A-Za-z0-9_-]+)\]"


def footnotes(page: Column) -> Column:
    """The notes of a page (id, text), numbered by their place in this array: by first mention, then those that nothing mentions; of two definitions the last counts."""
    lines = F.split(page, "\n")
    defined = F.filter(lines, lambda s: F.rlike(s, F.lit(_DEFINITION)))
    ids = F.transform(defined, lambda s: F.regexp_extract(s, _DEFINITION, 1))
    texts = F.transform(defined, lambda s: F.regexp_replace(F.regexp_extract(s, _DEFINITION, 2), r"\A\s+|\s+\z", ""))
    mentioned = F.flatten(F.transform(F.filter(lines, lambda s: ~F.rlike(s, F.lit(_DEFINITION))), lambda s: F.regexp_extract_all(s, F.lit(_REFERENCE), F.lit(1))))
    order = F.array_union(F.filter(F.array_distinct(mentioned), lambda i: F.array_contains(ids, i)), F.array_distinct(ids))
    # the last definition of an id: its place from the end
    text_of = lambda i: F.element_at(texts, -F.array_position(F.reverse(ids), i).cast("int"))
    return F.transform(order, lambda i: F.struct(i.alias("id"), text_of(i).alias("text")))


def with_footnotes(page: Column) -> Column:
    """A page with its footnotes as numbers and a section of their texts before the rule over the fence (at the end without a fence); as it is without definitions."""
    notes = footnotes(page)
    ids = F.transform(notes, lambda n: n["id"])
    lines = F.split(page, "\n")
    fence = F.array_position(F.transform(lines, lambda s: F.contains(s, F.lit(FENCE_OPEN))), True).cast("int")
    # the rule: the last line before the fence that is not blank, if it is one
    above = F.slice(lines, 1, F.greatest(fence - 1, F.lit(0)))
    blank = F.aggregate(F.reverse(above), F.struct(F.lit(0).alias("n"), F.lit(False).alias("end")), lambda a, s: F.struct(F.when(a["end"] | (F.trim(s) != ""), a["n"]).otherwise(a["n"] + 1).alias("n"), (a["end"] | (F.trim(s) != "")).alias("end")), lambda a: a["n"])
    rule = fence - 1 - blank
    is_rule = (rule > 0) & (F.trim(F.get(lines, rule - 1)) == "---")
    start = F.when(fence == 0, F.size(lines) + 1).when(is_rule, rule).otherwise(fence)

    def numbered(s: Column) -> Column:
        # cut at the references: text, and the reference that ends it
        pieces = F.split(s, r"(?<=\[\^[A-Za-z0-9_-]{1,200}\])")
        n = lambda p: F.array_position(ids, F.regexp_extract(p, _REFERENCE + r"\z", 1))
        return F.array_join(F.transform(pieces, lambda p: F.when(n(p) > 0, F.concat(F.regexp_replace(p, _REFERENCE + r"\z", ""), F.lit("["), n(p), F.lit("]"))).otherwise(p)), "")

    clean = lambda part: F.transform(F.filter(part, lambda s: ~F.rlike(s, F.lit(_DEFINITION))), numbered)
    top = F.regexp_replace(F.array_join(clean(F.slice(lines, 1, start - 1)), "\n"), r"(?:\n[ \t\r]*)+\z", "")
    rest = F.array_join(clean(F.slice(lines, start, F.size(lines))), "\n")
    listed = F.concat(F.lit("\n\n## Footnotes\n\n"), F.array_join(F.transform(notes, lambda n, i: F.concat(i + 1, F.lit(". "), n["text"])), "\n"))
    whole = F.when(fence == 0, F.concat(top, listed, F.lit("\n"))).otherwise(F.concat(top, listed, F.lit("\n\n"), rest, F.when(F.endswith(rest, F.lit("\n")), "").otherwise("\n")))
    return F.when(F.size(notes) > 0, whole).otherwise(page)


def blocks(pages: DataFrame, page: str = "page", key: str = "key", keep_markup: bool = False) -> DataFrame:
    """(key, pos, type, text, language): a page as a list of blocks, by lines: headings, items, code, quotes, rules, paragraphs.

    Footnotes are numbered first, comments go, and a folded part becomes a heading and
    its content, unless raw markup is kept. Lines of code between fences are one block. Windows hold one page.
    """
    text = with_footnotes(without_frontmatter(F.col(page)))
    if not keep_markup:
        text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<details>\s*<summary>\s*(.*?)\s*</summary>\s*(.*?)\s*</details>", "\n### $1\n$2\n")
    lines = pages.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    fence = F.startswith("line", F.lit("```"))
    within = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(within))
    code = (F.col("fences") % 2 == 1) | fence
    c = F.col("line")
    kind = (
        F.when(F.startswith(c, F.lit("# ")), "heading_1").when(F.startswith(c, F.lit("## ")), "heading_2").when(F.startswith(c, F.lit("### ")), "heading_3").when(F.startswith(c, F.lit("- ")), "bulleted_list_item")
        .when(F.rlike(c, F.lit(r"^\d+\. ")), "numbered_list_item").when(F.startswith(c, F.lit("> ")), "quote").when(F.rlike(c, F.lit(r"^(?:---+|\*\*\*+)\s*$")), "divider").otherwise("paragraph")
    )
    shown = F.when(kind == "paragraph", c).when(kind == "divider", "").otherwise(F.regexp_replace(c, r"^(?:#{1,3} |- |\d+\.\s+|> )", ""))
    plain = marked.where(~code & F.rlike("line", F.lit(r"\S"))).select("key", F.col("pos").cast("long").alias("pos"), kind.alias("type"), shown.alias("text"), F.lit(None).cast("string").alias("language"))
    # a fence's lines have an odd count of fences so far; the closing fence has an even one and goes
    inside = marked.where("fences % 2 = 1").groupBy("key", "fences").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    label = F.trim(F.substr(F.col("rows")[0]["line"], F.lit(4)))
    made = inside.select("key", F.col("pos").cast("long").alias("pos"), F.lit("code").alias("type"), F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: r["line"]), "\n").alias("text"), F.when(label == "", "plain text").otherwise(label).alias("language"))
    return plain.unionByName(made).withColumnRenamed("key", key)


def safe_markup(text: Column) -> Column:
    """Raw markup that is comments, details or summary and nothing else as it is; other raw markup escaped."""
    rest = F.regexp_replace(text, r"(?s)<!--.*?-->|</?(?:details|summary)(?:\s[^>]*)?>", "")
    return F.when(F.rlike(rest, F.lit("[<>]")), escape_markup(text, apostrophe=True)).otherwise(text)


# Tags that have no end.
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())


def closed_voids(markup: Column) -> Column:
    """Tags that have no end, closed in themselves."""
    return F.regexp_replace(markup, rf"(?i)<({'|'.join(VOID)})\b([^>]*?)\s*(?<!/)>", "<$1$2/>")


# Inline marks of Markdown and their elements.
_INLINE = ((r"`([^`\n]+)`", "<code>$1</code>"), (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "<em>$1</em>"), (r"\[([^\]\n]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>'))


def inline_markup(text: Column) -> Column:
    """A line of Markdown as markup: code, strong, emphasis, links; raw markup is kept only where it is safe."""
    out = safe_markup(text)
    for pattern, made in _INLINE:
        out = F.regexp_replace(out, pattern, made)
    return out


def storage(pages: DataFrame, page: str = "page", key: str = "key") -> DataFrame:
    """(key, storage): a page as the markup of a wiki, from a subset of Markdown: the blocks of ``blocks``; lines of raw markup as they are where they are safe."""
    listed, text = blocks(pages, page, key, keep_markup=True), F.col("text")
    raw = (F.col("type") == "paragraph") & F.startswith("text", F.lit("<"))
    line = inline_markup(text)
    tag = lambda t: F.concat(F.lit(f"<{t}>"), line, F.lit(f"</{t}>"))
    made = (
        F.when(raw, safe_markup(text)).when(F.col("type") == "heading_1", tag("h1")).when(F.col("type") == "heading_2", tag("h2")).when(F.col("type") == "heading_3", tag("h3")).when(F.col("type") == "quote", F.concat(F.lit("<blockquote>"), tag("p"), F.lit("</blockquote>")))
        .when(F.col("type") == "divider", "<hr/>").when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), escape_markup(text), F.lit("\n</code></pre>"))).when(F.col("type").endswith("list_item"), tag("li")).otherwise(tag("p"))
    )
    group = F.when(F.col("type") == "bulleted_list_item", "ul").when(F.col("type") == "numbered_list_item", "ol").otherwise("")
    rows = listed.select(F.col(key).alias("key"), "pos", made.alias("made"), group.alias("list"))
    order = Window.partitionBy("key").orderBy("pos")
    before, after = F.coalesce(F.lag("list").over(order), F.lit("")), F.coalesce(F.lead("list").over(order), F.lit(""))
    open_, close = F.when((F.col("list") != "") & (before != F.col("list")), F.concat(F.lit("<"), "list", F.lit(">"))).otherwise(""), F.when((F.col("list") != "") & (after != F.col("list")), F.concat(F.lit("</"), "list", F.lit(">"))).otherwise("")
    rows = rows.select("key", F.struct("pos", F.concat(open_, F.col("made"), close).alias("made")).alias("row"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["made"]), "\n").alias("storage")).withColumnRenamed("key", key)


def source_link(template: Column, commit: Column, repo_url: Column, repo: Column) -> Column:
    """Where a banner's link goes: the template with the commit in place of its first ``{commit}``, else the repository, else a place holder."""
    usable = (F.coalesce(template, F.lit("")) != "") & (F.coalesce(commit, F.lit("")) != "") & (commit != "unknown")
    at = F.instr(template, "{commit}")
    filled = F.when(at == 0, template).otherwise(F.concat(F.substr(template, F.lit(1), at - 1), commit, F.substr(template, at + len("{commit}"))))
    return F.when(usable, filled).when(F.coalesce(repo_url, F.lit("")) != "", repo_url).otherwise(F.concat(F.lit("https://example.invalid/"), repo))


_EDITS = "Edits inside the managed region will be overwritten on the next sync: make changes outside the marked region or in the source code."


def banner_text(repo: Column, link: Column, synced: Column) -> Column:
    return F.concat(F.lit("\U0001f4dd **This page is auto-generated** from "), repo, F.lit(f". {_EDITS} Last synced: "), synced, F.lit(". View source: "), link, F.lit("."))


def banner_markup(repo: Column, link: Column, synced: Column) -> Column:
    """The banner as a macro of the wiki's markup."""
    start, end = '<ac:structured-macro ac:name="info" ac:schema-version="1"><ac:rich-text-body>', "</ac:rich-text-body></ac:structured-macro>"
    said = F.concat(F.lit("<p>\U0001f4dd <strong>This page is auto-generated</strong> from "), escape_markup(repo), F.lit(f". {_EDITS} Last synced: "), escape_markup(synced), F.lit('. <a href="'), escape_markup(link), F.lit('">View source</a>.</p>'))
    return F.concat(F.lit(start), said, F.lit(end))


def banner_block(repo: Column, link: Column, synced: Column) -> Column:
    """The banner as JSON of a callout block."""
    piece = lambda text, url=None: F.struct(F.lit("text").alias("type"), F.struct(text.alias("content"), F.struct(url.alias("url")).alias("link")).alias("text") if url is not None else F.struct(text.alias("content")).alias("text"))
    said = F.concat(F.lit(" from "), repo, F.lit(f". {_EDITS} Last synced: "), synced, F.lit(". "))
    parts = [F.to_json(piece(x)) for x in (F.lit("This page is auto-generated"), said)] + [F.to_json(piece(F.lit("View source"), link)), F.to_json(piece(F.lit(".")))]
    return F.concat(F.lit('{"object":"block","type":"callout","callout":{"icon":{"type":"emoji","emoji":"\U0001f4dd"},"rich_text":['), F.array_join(F.array(*parts), ","), F.lit("]}}"))


def with_banner(pages: DataFrame, banner: str, key: str = "key", page: str = "page") -> DataFrame:
    """(key, body): the banner (a column of ``pages``) over the page's markup."""
    return storage(pages, page, key).join(pages.select(key, banner), key).select(key, F.concat(F.col(banner), F.lit("\n"), F.col("storage")).alias("body"))


def section_of(prefix: Column, whole: bool) -> Column:
    """The section of pages in parallel mode: the slug prefix without outer slashes, or its first part."""
    bare = F.regexp_replace(F.coalesce(prefix, F.lit("docloom/")), "^/+|/+$", "")
    part = bare if whole else F.split(bare, "/+")[0]
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("docloom"))


def wiki_page_id(ref: Column) -> Column:
    """The number of a wiki page from a number or an address; null for anything else."""
    for_path, for_query = F.regexp_extract(ref, r"/pages/(\d+)(?:/|$|\?)", 1), F.regexp_extract(ref, r"[?&]pageId=(\d+)", 1)
    return F.when(F.rlike(ref, F.lit(r"^\d+$")), ref).otherwise(F.coalesce(F.nullif(for_path, F.lit("")), F.nullif(for_query, F.lit(""))))


def block_page_id(ref: Column) -> Column:
    """An id of 32 hex digits, with or without dashes or in an address, in the form 8-4-4-4-12; null for anything else."""
    bare = F.replace(ref, F.lit("-"), F.lit(""))
    found = F.when(F.rlike(bare, F.lit("(?i)^[0-9a-f]{32}$")), bare).otherwise(F.nullif(F.regexp_extract(ref, "(?i)([0-9a-f]{32})", 1), F.lit("")))
    return F.when(found.isNotNull(), F.regexp_replace(found, "^(.{8})(.{4})(.{4})(.{4})(.*)$", "$1-$2-$3-$4-$5"))


def page_url(base: Column, own_base: Column, path: Column) -> Column:
    """The address of a wiki page; null without a path."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.coalesce(own_base, base), path))


def page_of_key(files: DataFrame, key: str) -> DataFrame:
    """The first page file (path, page) that has the key."""
    return page_files(files).where(F.col("page_key") == key).orderBy("path").limit(1)


def known_keys(files: DataFrame, most: int = 10) -> DataFrame:
    """The first keys of page files, in order: what is told when a key is not found."""
    return page_files(files).where("page_key is not null").select(F.col("page_key").alias("key")).orderBy("key").limit(most)
