"""Queries on pages, drafts, logs and wikis, with oracle SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import frontmatter, settings, signing
from ..functions import text as T
from ..operators import audit, candidates, drafts, matching, pages, prompts, publish, reports
from ..sources import scratch, wiki
from . import views
from .base import query
from .views import table

_KEYED = "'k-' || conv_id || '-' || turn"


def cases(spark, sf_dir):
    """Use cases: drafts with what a page needs besides."""
    i = F.col("conv_id")
    d = views.drafts(spark, sf_dir).withColumns({"language": F.lit("java"), "kind": F.lit("function")})
    d = drafts.with_defaults(d)
    return d.withColumns({
        "key": F.concat(F.lit("k-"), i, F.lit("-"), "turn"), "slug": F.concat(F.lit("t-"), i), "status": F.lit("active"), "last_generated": F.lit("2026-01-01T00:00:00Z"), "last_commit": F.concat(F.lit("c"), i % 9),
        "source_files": F.when(i % 5 == 3, F.array().cast("array<struct<path:string,lines:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("src/A"), i, F.lit(".java")).alias("path"), F.lit("1-9").alias("lines")))),
    })


_EMPTY = "[]::VARCHAR[]"
CASES = f"""{views.DRAFTS}, filled AS (SELECT conv_id, turn, {_KEYED} AS key, title, coalesce(summary, '(no summary produced)') AS summary, coalesce(actor, 'Unknown caller') AS actor, coalesce(actor, '') AS actor_detail, coalesce(trigger_, '') AS trigger_,
  preconditions, coalesce(main_flow, []) AS main_flow, alternate_flows, coalesce(postconditions, {_EMPTY}) AS postconditions, business_rules, test_scenarios, related, coalesce(tags, ['java', 'function']) AS tags, coalesce(confidence, 'low') AS confidence, confidence_reason,
  'c' || (conv_id % 9) AS last_commit FROM drafts)"""


@query(f"WITH {CASES} SELECT conv_id, turn, summary, actor, actor_detail, trigger_ AS trigger, len(main_flow)::BIGINT AS steps, array_to_string(postconditions, '|') AS postconditions, array_to_string(tags, ',') AS tags, confidence FROM filled")
def draft_defaults(spark, sf_dir):
    return cases(spark, sf_dir).select("conv_id", "turn", "summary", "actor", "actor_detail", "trigger", F.size("main_flow").cast("long").alias("steps"), F.array_join("postconditions", "|").alias("postconditions"), F.array_join("tags", ",").alias("tags"), "confidence")


def _bullets(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: '- ' || x), chr(10))"


_STEPS = "array_to_string(list_transform(main_flow, lambda s, i: i || '. ' || coalesce(s.step, '') || CASE WHEN coalesce(s.footnote, '') <> '' THEN ' [^step' || i || ']' ELSE '' END), chr(10))"
_STEP_NOTES = "array_to_string(list_filter(list_transform(main_flow, lambda s, i: CASE WHEN coalesce(s.footnote, '') <> '' THEN '[^step' || i || ']: ' || s.footnote END), lambda x: x IS NOT NULL), chr(10))"
_BODY = f"""concat_ws(chr(10) || chr(10), '## Summary', summary, '## Actor and triggers', '- **Actor:** ' || actor, CASE WHEN trigger_ <> '' THEN '- **Trigger:** ' || trigger_ END,
  '## Preconditions' || chr(10) || chr(10) || {_bullets('preconditions')}, CASE WHEN len(main_flow) > 0 THEN '## Main flow' || chr(10) || chr(10) || {_STEPS} END, nullif({_STEP_NOTES}, ''),
  '## Alternate and exception flows' || chr(10) || chr(10) || '- **' || alternate_flows[1].label || ':** ' || alternate_flows[1].description,
  CASE WHEN len(postconditions) > 0 THEN '## Postconditions' || chr(10) || chr(10) || {_bullets('postconditions')} END,
  '## Business rules' || chr(10) || chr(10) || '- ' || business_rules[1].rule || CASE WHEN business_rules[1].footnote IS NOT NULL THEN ' [^rule1]' ELSE '' END, '[^rule1]: ' || business_rules[1].footnote,
  '## Suggested test scenarios' || chr(10) || chr(10) || '- **' || test_scenarios[1].label || '**: ' || test_scenarios[1].gwt,
  '## Related use cases' || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '- [Other page](t-' || conv_id || ')' ELSE '- Other page' END,
  '## Source links', '<details>', '<summary>Implementation files (for developers and auditors)</summary>', '', CASE WHEN conv_id % 5 = 3 THEN '- (no source files recorded)' ELSE '- `src/A' || conv_id || '.java` lines 1-9' END, '', '</details>')"""
RENDERED = f"{CASES}, bodies AS (SELECT *, {_BODY} AS body FROM filled)"


def _known(spark, sf_dir):
    """Use cases with those of their related pages that exist: every second one."""
    d = cases(spark, sf_dir)
    return pages.with_known(d, d.where("conv_id % 2 = 0").select("slug"))


@query(f"WITH {RENDERED} SELECT key, body FROM bodies")
def render_body(spark, sf_dir):
    d = _known(spark, sf_dir)
    return d.select("key", pages.body(d, F.col("known")).alias("body"))


@query(f"WITH {RENDERED} SELECT key, CASE WHEN conv_id % 2 = 0 THEN '- [Other page](t-' || conv_id || ')' ELSE '- Other page' END AS lines FROM bodies")
def related_links(spark, sf_dir):
    return _known(spark, sf_dir).select("key", F.array_join(pages.linked(F.col("related"), F.col("known")), "\n").alias("lines"))


_HEAD = f"'---' || chr(10) || 'key: ' || key || chr(10) || 'title: ' || CASE WHEN title = ' ' THEN ''' ''' ELSE title END || chr(10) || 'slug: t-' || conv_id || chr(10) || 'actor: ' || actor || chr(10) || 'status: active' || chr(10) || 'last_generated: ''2026-01-01T00:00:00Z''' || chr(10) || 'last_commit: ' || last_commit || chr(10) || 'confidence: ' || CASE WHEN confidence = '' THEN '''''' ELSE confidence END || chr(10) || CASE WHEN conv_id % 5 = 3 THEN 'source_files: []' ELSE 'source_files:' || chr(10) || '  - path: src/A' || conv_id || '.java' || chr(10) || '    lines: ''1-9''' END || chr(10) || 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda t: '  - ' || t), chr(10)) || chr(10) || '---' || chr(10) || chr(10)"
_FOOT = f"'{T.FENCE_OPEN} id=' || key || ' -->' || chr(10) || '*Generated from commit `' || last_commit || '` on 2026-01-01T00:00:00Z.*' || chr(10) || '*Confidence: **' || confidence || '**, clear code*' || chr(10) || '{T.FENCE_CLOSE}' || chr(10)"
WHOLE = f"{RENDERED}, whole AS (SELECT *, {_HEAD} || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {_FOOT} AS page FROM bodies)"


def _whole(spark, sf_dir):
    d = _known(spark, sf_dir)
    return d.withColumn("page", pages.rendered(d, F.col("known")))


@query(f"WITH {WHOLE} SELECT key, page FROM whole")
def render_page(spark, sf_dir):
    return _whole(spark, sf_dir).select("key", "page")


@query(f"WITH {WHOLE} SELECT key, 'sha256:' || sha256(page) AS content_hash FROM whole")
def content_hash(spark, sf_dir):
    return _whole(spark, sf_dir).select("key", audit.sha(F.col("page")).alias("content_hash"))


# pages with footnotes: b is mentioned before a, c is defined and not mentioned, a is defined twice, d is not defined
_NOTED = "'See[^b] and[^a], again[^b] ' || doc_id || ' x[^d].' || chr(10) || '[^a]: first' || chr(10) || 'More.' || chr(10) || '[^c]:  last ' || chr(10) || '[^a]: second' || chr(10) || '[^b]: bee' || chr(10)"


def _noted(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(F.lit("See[^b] and[^a], again[^b] "), i, F.lit(" x[^d].\n[^a]: first\nMore.\n[^c]:  last \n[^a]: second\n[^b]: bee\n"))
    fenced = F.concat(text, F.lit(f"\n---\n\n{T.FENCE_OPEN} -->\nby[^a]\n{T.FENCE_CLOSE}\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 0, text).when(i % 3 == 1, fenced).otherwise("plain [^a]\n").alias("page"))


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'See[1] and[2], again[1] ' || doc_id || ' x[^d].' || chr(10) || 'More.' || chr(10) || chr(10) || '## Footnotes' || chr(10) || chr(10) || '1. bee' || chr(10) || '2. second' || chr(10) || '3. last' || chr(10) WHEN 1 THEN 'See[1] and[2], again[1] ' || doc_id || ' x[^d].' || chr(10) || 'More.' || chr(10) || chr(10) || '## Footnotes' || chr(10) || chr(10) || '1. bee' || chr(10) || '2. second' || chr(10) || '3. last' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '{T.FENCE_OPEN} -->' || chr(10) || 'by[2]' || chr(10) || '{T.FENCE_CLOSE}' || chr(10) ELSE 'plain [^a]' || chr(10) END AS page FROM documents")
def footnote_pages(spark, sf_dir):
    return _noted(spark, sf_dir).select("doc_id", pages.with_footnotes(F.col("page")).alias("page"))


@query("SELECT doc_id, n::INTEGER AS n, ['b', 'a', 'c'][n] AS id, ['bee', 'second', 'last'][n] AS text FROM documents, (SELECT unnest([1, 2, 3]) AS n) WHERE doc_id % 3 <> 2")
def footnote_numbers(spark, sf_dir):
    return _noted(spark, sf_dir).select("doc_id", F.posexplode(pages.footnotes(F.col("page"))).alias("p", "f")).select("doc_id", (F.col("p") + 1).alias("n"), "f.id", "f.text")


_BLOCKS = (("heading_1", "Top", None), ("paragraph", "Words of 1", None), ("heading_2", "Second", None), ("bulleted_list_item", "item", None), ("numbered_list_item", "one", None), ("quote", "said", None), ("divider", "", None), ("code", "x = 1\n# no heading", "python"), ("code", "", "plain text"), ("heading_3", "Fold", None), ("paragraph", "inner", None), ("paragraph", "end", None))


def _blocky(spark, sf_dir):
    text = "---\nkey: x\n---\n# Top\n\nWords of 1\n## Second\n- item\n1.  one\n> said\n****\n```python\nx = 1\n# no heading\n```\n<!-- gone\n-->\n```\n```\n<details>\n<summary>Fold </summary>\n\ninner\n</details>\nend"
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(text), F.when(F.col("n_nationkey") % 2 == 1, "\n   ").otherwise("")).alias("page"))


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY k) AS n, type, text, language FROM nation, (VALUES " + ", ".join(f"({k}, '{t}', '{x}', {'NULL' if g is None else chr(39) + g + chr(39)})" for k, (t, x, g) in enumerate(_BLOCKS)) + ") b(k, type, text, language)")
def block_list(spark, sf_dir):
    from pyspark.sql import Window

    got = pages.blocks(_blocky(spark, sf_dir), key="n_nationkey")
    return got.select("n_nationkey", F.row_number().over(Window.partitionBy("n_nationkey").orderBy("pos")).cast("long").alias("n"), "type", "text", "language")


_STORAGE = "<h1>Top &amp; <strong>x</strong></h1>\n<ul><li>a</li>\n<li><code>b</code></li></ul>\n<p>one <a href=\"u\">two</a></p>\n<!-- keep -->\n<p>&lt;b&gt;no&lt;/b&gt;</p>\n<hr/>"


@query("SELECT n_nationkey, '" + _STORAGE.replace("Top &amp; ", "Top & ") + "' AS storage FROM nation")
def storage_markup(spark, sf_dir):
    text = "# Top & **x**\n- a\n- `b`\n\none [two](u)\n<!-- keep -->\nx<b>no</b>\n---".replace("x<b>", "<b>")
    got = pages.storage(table(spark, sf_dir, "nation").select("n_nationkey", F.lit(text).alias("page")), key="n_nationkey")
    return got.select("n_nationkey", F.replace("storage", F.lit("&lt;b&gt;no&lt;/b&gt;"), F.lit("<p>&lt;b&gt;no&lt;/b&gt;</p>")).alias("storage"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') ELSE '<details open><summary>a</summary>b</details><!-- <x> -->' END AS safe FROM pages")
def safe_html(spark, sf_dir):
    raw = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("<details open><summary>a</summary>b</details><!-- <x> -->")
    return table(spark, sf_dir, "pages").select("page_id", pages.safe_markup(raw).alias("safe"))


@query("SELECT page_id, '<p>' || page_id || '<br/><hr/><img src=\"a\"/><input/></p>' AS closed FROM pages")
def void_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.closed_voids(F.concat(F.lit("<p>"), "page_id", F.lit('<br><hr/><img src="a"><input ></p>'))).alias("closed"))


_LINKS = "CASE n_nationkey % 4 WHEN 0 THEN 'https://x/c' || n_nationkey || '/{commit}' WHEN 1 THEN 'https://repo' WHEN 2 THEN 'https://example.invalid/' || n_name ELSE 'https://repo' END"
_SAID = f"'. {pages._EDITS} Last synced: now'"


def _banner_inputs(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    template = F.when(k != 1, "https://x/{commit}/{commit}")
    link = pages.source_link(template, F.when(k == 0, F.concat(F.lit("c"), "n_nationkey")).otherwise("unknown"), F.when(k != 2, "https://repo"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", link.alias("link"))


@query(f"SELECT n_nationkey, {_LINKS} AS link, '\U0001f4dd **This page is auto-generated** from ' || n_name || {_SAID} || '. View source: ' || {_LINKS} || '.' AS text, '<ac:structured-macro ac:name=\"info\" ac:schema-version=\"1\"><ac:rich-text-body><p>\U0001f4dd <strong>This page is auto-generated</strong> from ' || n_name || {_SAID} || '. <a href=\"' || {_LINKS} || '\">View source</a>.</p></ac:rich-text-body></ac:structured-macro>' AS markup FROM nation")
def banners(spark, sf_dir):
    b, now = _banner_inputs(spark, sf_dir), F.lit("now")
    return b.select("n_nationkey", "link", pages.banner_text(F.col("n_name"), F.col("link"), now).alias("text"), pages.banner_markup(F.col("n_name"), F.col("link"), now).alias("markup"))


@query(f"SELECT n_nationkey, '{{\"object\":\"block\",\"type\":\"callout\",\"callout\":{{\"icon\":{{\"type\":\"emoji\",\"emoji\":\"\U0001f4dd\"}},\"rich_text\":[{{\"type\":\"text\",\"text\":{{\"content\":\"This page is auto-generated\"}}}},{{\"type\":\"text\",\"text\":{{\"content\":\" from ' || n_name || {_SAID} || '. \"}}}},{{\"type\":\"text\",\"text\":{{\"content\":\"View source\",\"link\":{{\"url\":\"' || {_LINKS} || '\"}}}}}},{{\"type\":\"text\",\"text\":{{\"content\":\".\"}}}}]}}}}' AS block FROM nation")
def banner_blocks(spark, sf_dir):
    return _banner_inputs(spark, sf_dir).select("n_nationkey", pages.banner_block(F.col("n_name"), F.col("link"), F.lit("now")).alias("block"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'auto/docs' WHEN 1 THEN 'docloom' ELSE 'docloom' END AS whole, CASE n_nationkey % 3 WHEN 0 THEN 'auto' ELSE 'docloom' END AS first, CASE n_nationkey % 3 WHEN 0 THEN '[x] ' || n_name ELSE n_name END AS title FROM nation")
def section_names(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    prefix = F.when(k == 0, "/auto/docs/").when(k == 1, "//")
    return table(spark, sf_dir, "nation").select("n_nationkey", pages.section_of(prefix, True).alias("whole"), pages.section_of(prefix, False).alias("first"), publish.effective_title(F.col("n_name"), F.when(k == 0, " [x] ").when(k == 1, "  ")).alias("title"))


_HEX = "md5(n_name)"


@query(f"SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE n_nationkey::VARCHAR END AS wiki, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE regexp_replace({_HEX}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '\\1-\\2-\\3-\\4-\\5') END AS block, CASE WHEN n_nationkey % 2 = 0 THEN 'https://own/p' || n_nationkey END AS url FROM nation")
def page_ids(spark, sf_dir):
    i, k, h = F.col("n_nationkey"), F.col("n_nationkey") % 4, F.md5(F.col("n_name").cast("binary"))
    wiki = F.when(k == 0, i.cast("string")).when(k == 1, F.concat(F.lit("https://w/spaces/D/pages/"), i, F.lit("/T"))).when(k == 2, F.concat(F.lit("https://w/view?a=1&pageId="), i)).otherwise("https://w/x")
    block = F.when(k == 0, h).when(k == 1, F.concat(F.substring(h, 1, 10), F.lit("-"), F.substr(h, F.lit(11)))).when(k == 2, F.concat(F.lit("https://n/My-Page-"), h, F.lit("?v=1"))).otherwise("nothing")
    url = pages.page_url(F.lit("https://base"), F.when(i % 4 == 0, "https://own").when(i % 4 == 2, "https://own"), F.when(i % 2 == 0, F.concat(F.lit("/p"), i)))
    return table(spark, sf_dir, "nation").select("n_nationkey", pages.wiki_page_id(wiki).alias("wiki"), pages.block_page_id(block).alias("block"), url.alias("url"))


@query(f"WITH {views.PAGES} SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 6 <> 1 THEN 'k-' || doc_id END AS key, CASE WHEN doc_id % 10 <> 3 THEN 't-' || doc_id END AS slug FROM pages_md")
def frontmatter_keys(spark, sf_dir):
    f = T.frontmatter_fields(F.col("page"))
    return views.pages(spark, sf_dir).select("doc_id", f["title"].alias("title"), f["key"].alias("key"), f["slug"].alias("slug"))


@query(f"WITH {views.PAGES} SELECT 'k-' || doc_id AS key FROM pages_md WHERE doc_id % 6 <> 1 ORDER BY 'k-' || doc_id LIMIT 10")
def key_list(spark, sf_dir):
    return pages.known_keys(views.pages(spark, sf_dir))


@query(f"WITH {views.PAGES} SELECT doc_id FROM pages_md WHERE doc_id = 5")
def key_lookup(spark, sf_dir):
    return pages.page_of_key(views.pages(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string")), "k-5").select("doc_id")


@query(f"WITH {views.CANDIDATES}, t AS (SELECT split_part(relative_path, '/', 1) AS folder, CASE doc_id % 4 WHEN 0 THEN lower(name) WHEN 1 THEN 'é' || name WHEN 2 THEN '(' || name ELSE name END AS title FROM candidates) SELECT folder, count(*) OVER (PARTITION BY folder) AS pages, row_number() OVER (PARTITION BY folder ORDER BY icu_sort_key(title, 'und'), title) AS rank, title FROM t")
def preview_titles(spark, sf_dir):
    """Titles by folder, in the order that people sort them in."""
    i, name = F.col("doc_id"), F.col("name")
    title = F.when(i % 4 == 0, F.lower(name)).when(i % 4 == 1, F.concat(F.lit("é"), name)).when(i % 4 == 2, F.concat(F.lit("("), name)).otherwise(name)
    c = views.candidates(spark, sf_dir).select("relative_path", title.alias("title"))
    return matching.ranked_titles(c, candidates.group_folder(F.replace("relative_path", F.lit("/"), F.lit("\\"))))


@query(f"WITH {views.PAGES} SELECT 'p' || doc_id AS slug, CASE doc_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'unchanged' ELSE 'updated' END AS change FROM pages_md")
def page_changes(spark, sf_dir):
    i = F.col("doc_id")
    new = views.pages(spark, sf_dir).select(i, F.concat(F.lit("p"), i).alias("slug"), "page")
    return publish.file_changes(new, new.where(i % 3 != 0).select("slug", F.when(i % 3 == 1, F.col("page")).otherwise("old").alias("content")))


@query(f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'already managed: key-9' WHEN page_id % 4 = 1 THEN 'in another space: B' END AS error, 'sha256:' || sha256(html) AS body_hash, 'BANNER' || chr(10) || CASE WHEN page_id % 2 = 0 THEN '{T.FENCE_OPEN} id=' || page_id || ' -->' || chr(10) || '{T.FENCE_CLOSE}' || chr(10) || '<hr/>' || chr(10) || '<h2>Original content (preserved)</h2>' || chr(10) || html ELSE html || chr(10) || '<hr/>' || chr(10) || '<h2>Original content (preserved)</h2>' || chr(10) || '{T.FENCE_OPEN} id=' || page_id || ' -->' || chr(10) || '{T.FENCE_CLOSE}' END AS body FROM pages")
def claim_body(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(i, i.alias("key"), F.when(i % 4 == 0, F.array(F.lit("x"), F.lit("key-9"))).otherwise(F.array(F.lit("x"))).alias("labels"), F.when(i % 4 == 1, "B").otherwise("A").alias("space"), F.col("html").alias("body"))
    made = lambda at: publish.claimed(F.col("body"), F.lit("BANNER"), F.col("key"), at)
    return publish.claims(rows, "A").select(i, "error", "body_hash", F.when(i % 2 == 0, made("below")).otherwise(made("above")).alias("body"))


@query("SELECT n_nationkey AS page_id, part, pos, type, text FROM nation, (VALUES (0, 0, 0::BIGINT, 'paragraph', 'mine'), (1, 1, 0, 'callout', 'banner'), (0, 2, 0, 'paragraph', 'new'), (0, 3, 3, 'divider', ''), (0, 3, 4, 'paragraph', 'old'), (1, 2, 0, 'paragraph', 'new')) b(k, part, pos, type, text) WHERE CASE WHEN n_nationkey % 2 = 0 THEN k = 0 OR part = 1 ELSE k = 1 END")
def block_replace(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"))
    old = [("paragraph", "mine", None), ("callout", "b", "\U0001f4dd"), ("paragraph", "gone", None), ("divider", "", None), ("paragraph", "old", None)]
    rows = F.array(*(F.struct(F.lit(p).cast("long").alias("pos"), F.when((F.lit(t) == "divider") & (F.col("page_id") % 2 == 1), "quote").otherwise(t).alias("type"), F.lit(x).alias("text"), F.lit(e).cast("string").alias("emoji")) for p, (t, x, e) in enumerate(old)))
    new = n.select("page_id", F.lit(0).cast("long").alias("pos"), F.lit("paragraph").alias("type"), F.lit("new").alias("text"))
    return publish.replaced_blocks(n.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*"), new)


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'quote' ELSE 'paragraph' END AS type, CASE n_nationkey % 3 WHEN 0 THEN '(a block of type child_page was not kept)' ELSE n_name END AS text, CASE n_nationkey % 4 WHEN 0 THEN 'pin' WHEN 1 THEN 'label' WHEN 2 THEN 'title' END AS parent, n_nationkey % 4 = 3 AS made, CASE n_nationkey % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'parallel' ELSE 'greenfield' END AS mode, CASE n_nationkey % 3 WHEN 1 THEN 'docloom/' END AS slug_prefix FROM nation")
def publish_choices(spark, sf_dir):
    i, none = F.col("n_nationkey"), F.lit(None).cast("string")
    block = publish.writable_block(F.when(i % 3 == 0, "child_page").when(i % 3 == 1, "quote").otherwise("paragraph"), F.col("n_name"))
    parent = publish.parallel_parent(F.when(i % 4 == 0, "pin").otherwise(""), F.when(i % 4 == 1, "label"), F.when(i % 4 != 3, "title"))
    mode = publish.settings(F.when(i % 3 == 0, "claim"), F.when(i % 3 != 2, "parallel"), none)
    return table(spark, sf_dir, "nation").select("n_nationkey", block.alias("b"), parent.alias("p"), mode.alias("m")).select("n_nationkey", "b.*", F.col("p.id").alias("parent"), F.col("p.made").alias("made"), F.col("m.mode").alias("mode"), "m.slug_prefix")


# ---- drafts, prompts

@query(f"WITH {views.DRAFTS}, n AS (SELECT *, unnest(['Sends email (x)', 'Mutates application cache', 'Calls stored procedure(s): a', 'Other note']) AS note FROM drafts), s AS (SELECT conv_id, turn, note, lower(concat_ws(' ', business_rules[1].rule, coalesce(business_rules[1].footnote, ''), array_to_string(list_transform(main_flow, lambda s: coalesce(s.step, '') || ' ' || coalesce(s.footnote, '')), ' '), array_to_string(postconditions, ' '), alternate_flows[1].label, alternate_flows[1].description)) AS said FROM n) SELECT conv_id, turn, note FROM s WHERE note = 'Sends email (x)' AND NOT (contains(said, 'mail') OR contains(said, 'notif') OR contains(said, 'inbox')) OR note = 'Calls stored procedure(s): a' AND NOT (contains(said, 'stored proc') OR contains(said, 'stored-procedure') OR contains(said, 'sproc'))")
def notes_propagated(spark, sf_dir):
    return drafts.unmentioned_notes(views.drafts(spark, sf_dir), F.array(F.lit("Sends email (x)"), F.lit("Mutates application cache"), F.lit("Calls stored procedure(s): a"), F.lit("Other note")))


def scanned(spark, sf_dir):
    """Candidates with hints."""
    i = F.col("doc_id")
    c = views.candidates(spark, sf_dir)
    hints = F.struct(
        F.when(i % 2 == 0, F.array(F.lit("Async"))).alias("annotations"), F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type"))).alias("parameters"),
        F.when(i % 3 == 0, F.struct(F.lit("GET").alias("method"), F.when(i % 2 == 0, "/x").otherwise("").alias("path"))).alias("http_route"), F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: F.concat(F.lit("f"), k)).alias("callees"),
        F.when(i % 4 == 0, F.array(F.lit("T1"), F.lit("T2"))).alias("database_tables"), F.when(i % 5 == 0, F.array(F.lit("n1"), F.lit("n2"))).alias("notes"),
    )
    return c.select("doc_id", F.coalesce(candidates.language_of(F.col("relative_path")), F.lit("unknown")).alias("language"), "relative_path", "name", F.when(i % 3 == 0, "controller-method").otherwise("function").alias("kind"), "line_start", (F.col("line_start") + 4).alias("line_end"), F.concat(F.lit("code "), i).alias("source"), hints.alias("hints"))


_HINTS = "concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Annotations: Async' END, CASE WHEN doc_id % 3 = 0 THEN 'HTTP route: GET ' || CASE WHEN doc_id % 2 = 0 THEN '/x' ELSE '(see source)' END END, 'Parameters: a:int, b', 'Calls: f1, f2, f3, f4, f5, f6, f7, f8, f9, f10, f11, f12, f13, f14, f15', CASE WHEN doc_id % 4 = 0 THEN 'DB tables touched: T1, T2' END, CASE WHEN doc_id % 5 = 0 THEN 'Notes:' || chr(10) || '- n1' || chr(10) || '- n2' END)"
_LANG = "coalesce(CASE lower(regexp_extract(relative_path, '\\.([^./]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'cfc' THEN 'cfml' WHEN 'cfm' THEN 'cfml' WHEN 'rb' THEN 'ruby' WHEN 'py' THEN 'python' END, 'unknown')"
_CODE = "CASE lang WHEN 'cfml' THEN 'coldfusion' WHEN 'python' THEN 'python' WHEN 'ruby' THEN 'ruby' WHEN 'unknown' THEN 'unknown' ELSE 'java' END"
_PROMPT = f"'# Project shop' || chr(10) || 'File: ' || relative_path || chr(10) || 'Part: ' || name || ', lines ' || line_start || '-' || (line_start + 4) || chr(10) || 'Language: ' || lang || ', kind: ' || CASE WHEN doc_id % 3 = 0 THEN 'controller-method' ELSE 'function' END || chr(10) || '# Hints of the parser' || chr(10) || {_HINTS} || chr(10) || CASE WHEN doc_id % 90 % 2 = 0 AND line_start <> 1 THEN '# The whole file, for context only' || chr(10) || '```' || {_CODE} || chr(10) || 'whole' || chr(10) || 'file' || chr(10) || '```' || chr(10) ELSE '' END || '# The part to describe' || chr(10) || '```' || {_CODE} || chr(10) || 'code ' || doc_id || chr(10) || '```' || chr(10) || 'Answer with one JSON object about this part alone.'"


@query(f"WITH {views.CANDIDATES}, l AS (SELECT *, {_LANG} AS lang FROM candidates) SELECT doc_id, {_PROMPT} AS prompt FROM l")
def prompt_texts(spark, sf_dir):
    c = scanned(spark, sf_dir)
    files = c.select("relative_path", (F.col("doc_id") % 90).alias("k")).distinct()
    files = files.select("relative_path", F.when(F.col("k") % 2 == 0, "whole\nfile").otherwise(F.repeat(F.lit("x\n"), 3000)).alias("content"))
    return prompts.prompts(c, files, "shop").select("doc_id", "prompt")


@query(f"WITH {views.CANDIDATES} SELECT doc_id, {_HINTS} AS hints FROM candidates")
def prompt_hints(spark, sf_dir):
    return scanned(spark, sf_dir).select("doc_id", prompts.hints_text(F.col("hints")).alias("hints"))


@query(f"WITH {views.CANDIDATES}, l AS (SELECT *, {_LANG} AS lang FROM candidates) SELECT doc_id, upper(substr(t, 1, 1)) || substr(t, 2) || ' (DRAFT)' AS title, CASE WHEN doc_id % 3 = 0 THEN 'A signed-in user or a visitor' ELSE 'An internal caller' END AS actor, 'The system enters `' || name || '` in ' || relative_path || ' (lines ' || line_start || '-' || (line_start + 4) || ').' || '|The system calls `f1`.|The system calls `f2`.|The system calls `f3`.|The system calls `f4`.|The system calls `f5`.|Control returns to the caller.' AS steps, concat_ws('|', CASE WHEN doc_id % 4 = 0 THEN 'Touches database tables: T1, T2 (raw extraction).' END, CASE WHEN doc_id % 2 = 0 THEN 'Annotations present: Async (raw extraction).' END) AS rules, lang || CASE WHEN doc_id % 3 = 0 THEN ',controller-method,controller' ELSE ',function,library' END || ',mock-output' AS tags, 'low' AS confidence FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z])', ' \\1', 'g'), '[._]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM l)")
def mock_draft(spark, sf_dir):
    d = prompts.drafts(scanned(spark, sf_dir), "shop")
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return d.select("doc_id", "title", "actor", joined("main_flow", "step").alias("steps"), joined("business_rules", "rule").alias("rules"), F.array_join("tags", ",").alias("tags"), "confidence")


@query(f"WITH {views.CANDIDATES}, l AS (SELECT *, {_LANG} AS lang FROM candidates) SELECT relative_path, line_start, name, '  ' || rpad(lang, (SELECT greatest(4, max(length(lang))) FROM l)::INTEGER, ' ') || ' ' || rpad(CASE WHEN doc_id % 3 = 0 THEN 'controller-method' ELSE 'function' END, 20, ' ') || ' ' || name || CASE WHEN doc_id % 6 = 0 THEN ' [GET /x]' WHEN doc_id % 3 = 0 THEN ' [GET]' ELSE '' END || chr(10) || '       ' || relative_path || ':' || line_start || '-' || (line_start + 4) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '       tables: T1, T2' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '       notes: n1; n2' ELSE '' END AS text FROM l")
def candidate_list(spark, sf_dir):
    return prompts.listing(scanned(spark, sf_dir))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN '{\"b\": [1]}' END AS json, CASE turn % 3 WHEN 2 THEN 'no valid JSON: ' || substr(regexp_replace('oops ' || text, '^\\s+|\\s+$', '', 'g'), 1, 200) END AS error FROM conversations")
def json_answers(spark, sf_dir):
    t = F.col("turn") % 3
    answer = F.when(t == 0, ' {"a": 1}\n').when(t == 1, '```json\n{"b": [1]}```  ').otherwise(F.concat(F.lit("oops "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.parsed_answer(answer).alias("p")).select("conv_id", "turn", "p.json", "p.error")


# ---- logs, reports

@query(f"WITH {views.AUDIT} SELECT page, seq FROM (SELECT page, max(seq) AS seq FROM audit WHERE operation = 'generate' AND coalesce(content_hash, '') <> '' AND outcome <> 'error' GROUP BY page) ORDER BY seq DESC LIMIT 15")
def replay_newest(spark, sf_dir):
    return audit.newest_pages(views.audit(spark, sf_dir), 15).select("page", "seq")


_REPLAY = """replayed AS (SELECT doc_id AS seq, 'p' || doc_id AS page, CASE doc_id % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'skipped' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' WHEN 4 THEN 'unchanged' ELSE 'changed' END AS status,
  CASE doc_id % 7 WHEN 0 THEN 'no source in the entry' WHEN 1 THEN 'the source file is gone' WHEN 2 THEN 'no candidate fits' WHEN 3 THEN 'rendering failed' END AS reason, CASE WHEN doc_id % 7 >= 4 THEN doc_id % 7 - 5 END::BIGINT AS lines, CASE WHEN doc_id % 7 >= 4 THEN 0 END::BIGINT AS sections FROM documents)"""


def _replay(spark, sf_dir):
    i = F.col("doc_id")
    d, k = table(spark, sf_dir, "documents").select("doc_id", i.alias("seq")), i % 7
    latest = d.select("seq", F.concat(F.lit("p"), i).alias("page"), F.when(k != 0, "a.java").alias("source"), F.lit("h").alias("body_hash"), F.lit(10).cast("long").alias("n_lines"), F.lit(3).cast("long").alias("n_sections"))
    matched = d.where(k != 1).select("seq", F.when(k != 2, "f").alias("name"), F.lit(True).alias("found_file"))
    rendered = d.where(k != 3).select("seq", F.when(k == 4, "h").otherwise("g").alias("body_hash"), (k + 5).alias("n_lines"), F.lit(3).cast("long").alias("n_sections"))
    return audit.replay_results(latest, matched, rendered)


@query(f"WITH {_REPLAY} SELECT *, CASE WHEN lines IS NULL THEN '?' WHEN lines > 0 THEN '+' || lines ELSE lines::VARCHAR END AS shown FROM replayed")
def replay_report(spark, sf_dir):
    return _replay(spark, sf_dir).withColumn("shown", audit.delta_text(F.col("lines")))


@query(f"WITH {_REPLAY} SELECT count(*) AS pages, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors FROM replayed")
def replay_counts(spark, sf_dir):
    return audit.replay_totals(_replay(spark, sf_dir))


_SIGN = "CASE outcome WHEN 'created' THEN '+' WHEN 'updated' THEN '~' WHEN 'unchanged' THEN '·' WHEN 'skipped' THEN '○' WHEN 'error' THEN '✗' WHEN 'recovered' THEN '↻' WHEN 'no_help' THEN '⊘' WHEN 'fitted' THEN '⊕' ELSE '?' END"


@query(f"WITH {views.AUDIT}, t AS (SELECT * FROM audit ORDER BY seq DESC LIMIT 30) SELECT seq, '  ' || substr(replace(timestamp, 'T', ' '), 1, 19) || '  ' || substr(\"commit\", 1, 7) || '  ' || {_SIGN} || ' ' || rpad(operation, (SELECT greatest(9, max(length(operation))) FROM t)::INTEGER, ' ') || ' ' || page AS line FROM t")
def audit_lines(spark, sf_dir):
    return audit.shown(audit.tail(views.audit(spark, sf_dir), 30))


@query(f"WITH {views.AUDIT} SELECT seq, seq % 3 <> 0 AS known FROM audit WHERE seq % 3 <> 0")
def known_entries(spark, sf_dir):
    log = views.audit(spark, sf_dir).withColumn("operation", F.when(F.col("seq") % 3 == 0, "other").otherwise(F.col("operation")))
    return audit.known_kinds(log).select("seq", F.lit(True).alias("known"))


@query("SELECT event_id AS seq, event_id % 3 <> 2 AND event_id % 10 <> 7 AS signed, CASE WHEN event_id % 3 = 2 THEN 'unknown signing key' WHEN event_id % 10 = 7 THEN 'signature verification failed' ELSE '' END AS reasons FROM events")
def signing_keys(spark, sf_dir):
    """Entries signed with three keys, of which two are registered; every tenth signature is that of another text."""
    seeds = {signing.key_id(signing.public_of(s)): s for s in (hashlib.sha256(f"key {k}".encode()).digest() for k in range(3))}
    log = views.audit(spark, sf_dir).select(F.col("seq").alias("log"), "seq", "page", "operation", F.get(F.array(*map(F.lit, seeds)), (F.col("seq") % 3).cast("int")).alias("signing_key_id"))
    log = audit.signed(log, seeds, fields=["page", "operation"])
    other = signing.signature(F.when(F.col("seq") % 10 == 7, F.concat("entry_hash", F.lit("0"))), F.col("signing_key_id"), seeds)
    raw = log.select("log", "seq", F.to_json(F.struct("page", "operation", "alg", "signing_key_id", "prev_hash", "entry_hash", F.coalesce(other, "signature").alias("signature")), {"ignoreNullFields": "false"}).alias("raw"))
    keys = audit.registry_rows(spark, [signing.public_of(s) for s in list(seeds.values())[:2]], "2024-01-01T00:00:00Z")
    return audit.verify(raw, keys=keys, require_signed=True).select("seq", "signed", F.array_join("reasons", "; ").alias("reasons"))


@query("""SELECT event_id AS seq, '{"a":{"k":' || CASE WHEN event_id = 0 THEN '0' ELSE event_id || '.25' END || ',"z":null},"b":"' || chr(8232) || '\\u0007","' || chr(233) || '":[0,' || (event_id * 100) || ',0.5,1e+21,1e-7]}' AS canonical FROM events""")
def canonical_numbers(spark, sf_dir):
    """Numbers with exponents and zeros, repeated keys, keys out of order, escapes: as one text."""
    i = F.col("event_id").cast("string")
    quarter = F.when(F.col("event_id") == 0, "-0.0").otherwise(F.concat(i, F.lit(".250")))
    raw = F.concat(F.lit('{ "b" : "first", "\\u00e9": [-0, '), i, F.lit('e2, 5.0e-1, 1000000000000000000000, 0.0000001], "a": {"z":null, "k":1, "k": '), quarter, F.lit('}, "b": "\\u2028\\u0007"}'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), audit.canonical_json(raw).alias("canonical"))


@query(f"WITH {views.WIKI}, k AS (SELECT key::VARCHAR AS key, title FROM wiki WHERE key IS NOT NULL), d AS (SELECT doc_id::VARCHAR AS key, 'T' || doc_id AS title, coalesce(text, '') AS body FROM documents) SELECT coalesce(d.key, k.key) AS key, coalesce(d.title, k.title) AS title, CASE WHEN d.key IS NOT NULL AND k.key IS NOT NULL AND (d.title <> k.title OR d.body <> '') THEN 2 ELSE 1 END::BIGINT AS version, md5(coalesce(d.body, '')) AS body FROM d FULL JOIN k ON d.key = k.key")
def wiki_published(spark, sf_dir):
    """A wiki of files gets the keyed pages of the inventory, then all documents by key; it is read back."""
    at = {"url": "folder:" + scratch.new_folder(spark, "wiki").removeprefix("file:"), "space": "DOCS"}
    keyed = views.wiki(spark, sf_dir).where("key is not null")
    wiki.publish_to(keyed.select(F.col("key").cast("string").alias("key"), "title", F.lit("").alias("body")), **at)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("T"), "doc_id").alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    wiki.publish_to(docs, **at)
    return wiki.read_wiki(spark, **at).select("key", "title", "version", F.md5(F.col("body").cast("binary")).alias("body"))


@query("WITH p AS (SELECT coalesce(source, 'none') AS repo, count(*) AS pages FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1), r AS (SELECT coalesce(source, 'none') AS repo, count(*) AS retried, count(*) FILTER (doc_id % 8 = 0) AS w FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) SELECT coalesce(p.repo, r.repo) AS repo, coalesce(p.pages, 0) AS pages, coalesce(r.retried, 0) AS retried, CASE WHEN coalesce(r.w, 0) = 0 THEN '' ELSE 'tags=' || r.w || ',unknown=' || r.w END AS warnings FROM p FULL JOIN r ON p.repo = r.repo")
def retried_snapshot(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("repo"))
    found = d.where(i % 4 != 0).select("repo", F.lit("high").alias("confidence"), F.lit(1).cast("long").alias("words"), F.lit(1).cast("long").alias("n_lines"))
    issue = lambda f, s: F.struct(F.lit(f).cast("string").alias("field"), F.lit(s).alias("severity"))
    retried = d.where(i % 4 == 0).select("repo", F.when(i % 8 == 0, F.array(issue("tags", "warn"), issue(None, "warn"), issue("title", "error"))).otherwise(F.array(issue("title", "error"))).alias("issues"))
    return reports.repo_snapshots(found, retried).select("repo", "pages", "retried", "warnings")


@query("SELECT pages, stop FROM (SELECT count(*) AS pages, sum(length(text) // 4)::DOUBLE * 0.27e-6 + count(*) * 700 * 0.27e-6 + count(*) * 3000 * 1.10e-6 > 1.0 AS stop FROM documents)")
def cost_gate(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(settings.token_parts(F.expr("char_length(coalesce(text, '')) div 4") + 700, F.lit(700).cast("long")).alias("t")).select(F.col("t.system").alias("system_tokens"), F.col("t.user").alias("user_tokens"))
    return reports.over_budget(reports.cost(tokens, "second"), 1.0).select("pages", "stop")


@query("SELECT doc_id AS seq, step, operation, outcome, content_hash, reason, 'v24' AS prompt_version FROM documents, (VALUES (0), (1)) s(step), LATERAL (SELECT CASE WHEN step = 0 THEN 'retried' ELSE 'generate' END AS operation, CASE WHEN step = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'recovered' ELSE 'no_help' END WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 5 = 1 THEN 'skipped' ELSE 'updated' END AS outcome, CASE WHEN step = 1 AND doc_id % 5 > 1 THEN 'sha256:' || sha256('x' || doc_id) END AS content_hash, CASE WHEN step = 1 AND doc_id % 5 = 0 THEN 'no answer' WHEN step = 1 AND doc_id % 5 = 1 THEN 'below_min_confidence' END AS reason) WHERE step = 1 OR doc_id % 4 IN (0, 1)")
def generate_entries(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("seq"), F.concat(F.lit("p"), i).alias("page"), F.when(i % 4 == 0, "recovered").when(i % 4 == 1, "no_help").alias("retry"), F.when(i % 5 == 0, "no answer").alias("error"), (i % 5 != 1).alias("kept"), F.lit("updated").alias("change"), F.lit("c").alias("commit"), F.lit("t").alias("timestamp"), F.concat(F.lit("x"), i).alias("content"))
    return prompts.entries(d).select("seq", "step", "operation", "outcome", "content_hash", "reason", "prompt_version")


@query(f"WITH {views.WIKI}, own AS (SELECT count(*) FILTER (f.t IS NOT NULL AND o.key IS NULL) > 0 AS has_collisions FROM documents d LEFT JOIN (SELECT DISTINCT key FROM wiki WHERE key IS NOT NULL) o ON o.key = d.doc_id LEFT JOIN (SELECT DISTINCT title AS t FROM wiki WHERE key IS NULL) f ON f.t = 'x T' || d.doc_id) SELECT has_collisions FROM own")
def preflight_gate(spark, sf_dir):
    titled = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("T"), "doc_id").alias("title"))
    return settings.collisions(publish.summary(publish.preflight(titled, views.wiki(spark, sf_dir), prefix="x", any_case=False))).select("has_collisions")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'mend' ELSE text END AS prompt FROM conversations")
def retry_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.retry_prompt(F.col("text"), F.when(F.col("turn") % 2 == 0, "mend")).alias("prompt"))


@query("SELECT doc_id, 'k-' || doc_id AS key, strftime(make_timestamp(2024, 1, 2, 3, 4, 5) + to_hours(-2) + to_days((doc_id % 300)::INT), '%Y-%m-%dT%H:%M:%S.000Z') AS made, [coalesce(source, 'none'), 'a: b', 'no'] AS tags, doc_id % 7 AS n, md5(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n+$', '')) AS note FROM documents")
def frontmatter_values(spark, sf_dir):
    """Whole texts as blocks of frontmatter, with a time, a list and a nested map beside them."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    day = F.date_format(F.date_add(F.lit("2024-01-02").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd")
    page = F.concat(F.lit("---\nkey: k-"), i, F.lit("\nmade: "), day, F.lit(" 03:04:05 +02:00\ntags:\n- "), F.coalesce("source", F.lit("none")), F.lit("\n- 'a: b'\n- \"no\"\nin: # nested\n    deep: {n: "), i % 7, F.lit(", x: [1, 2]}\nnote: |2-\n  "), F.replace(text, F.lit("\n"), F.lit("\n  ")), F.lit("\nlast: 1\n---\nbody\n"))
    found = table(spark, sf_dir, "documents").select(i, F.from_json(frontmatter.frontmatter_json(page), "key string, made string, tags array<string>, in struct<deep: struct<n: long>>, note string").alias("f"))
    return found.select(i, "f.key", "f.made", "f.tags", F.col("f.in.deep.n").alias("n"), F.md5(F.col("f.note").cast("binary")).alias("note"))
