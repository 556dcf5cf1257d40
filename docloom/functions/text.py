"""Text functions of the documentation pipeline as column expressions: they run in generated code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fence around the part of a page that the pipeline owns.
FENCE_OPEN, FENCE_CLOSE = "<!-- managed:start", "<!-- managed:end -->"
FRONTMATTER = r"(?s)\A---\r?\n.*?\r?\n---\r?\n"


def slugify(text: Column) -> Column:
    """Lower case, quotes dropped, runs of other characters as one dash, 80 characters at most, no dash at the ends."""
    s = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "['\"]", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(s, 1, 80), "^-+|-+$", "")


def stable_id(language: Column, path: Column, name: Column) -> Column:
    """The key of a page: language, path without extension and name, with runs of dashes as one."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(path, r"\.[^.]+$", ""), "[^a-zA-Z0-9]+", "-"))
    stem = F.regexp_replace(stem, "^-+|-+$", "")
    return F.regexp_replace(F.concat_ws("-", language, stem, slugify(name), F.lit("v1")), "-{2,}", "-")


def humanize(name: Column) -> Column:
    """A name as words: a blank before capitals, dots and underscores as blanks, first letter in upper case."""
    s = F.regexp_replace(F.regexp_replace(name, "([A-Z])", " $1"), "[._]", " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def page_slug(title: Column, name: Column, key: Column) -> Column:
    """The slug of the title; of the humanized name if that is empty; else the key."""
    return F.coalesce(F.nullif(slugify(title), F.lit("")), F.nullif(slugify(humanize(name)), F.lit("")), key)


def snake_resource(name: Column) -> Column:
    """A controller's or view's resource: the suffix dropped, camel case to snake case."""
    s = F.regexp_replace(name, "(Controller|ViewSet|APIView|View)$", "")
    s = F.regexp_replace(F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(s)


def kebab_name(name: Column) -> Column:
    """The last dotted part of a name in kebab case."""
    s = F.regexp_replace(F.regexp_replace(name, r"^.*\.", ""), "([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    return F.regexp_replace(s, "^-|-$", "")


def slug_matches(name: Column, slug: Column) -> Column:
    """Whether a slug may be that of a function: it holds the kebab name, or the name holds its first part."""
    k = kebab_name(name)
    return (k != "") & (F.contains(slug, k) | F.contains(k, F.split(slug, "-")[0]))


def version_at_most(a: Column, b: Column) -> Column:
    """``v<number>`` compared as numbers, anything else as text."""
    form = r"^v[0-9]+$"
    number = lambda c: F.substr(c, F.lit(2)).try_cast("decimal(38,0)")
    return F.when(F.rlike(a, F.lit(form)) & F.rlike(b, F.lit(form)), number(a) <= number(b)).otherwise(a <= b)


def not_after(version: Column, last: str) -> Column:
    """Whether a version is ``last`` or before, or missing (as in entries from before versions were kept)."""
    return version.isNull() | version_at_most(version, F.lit(last))


def without_frontmatter(page: Column) -> Column:
    return F.regexp_replace(page, FRONTMATTER, "")


def _fence(page: Column) -> tuple[Column, Column, Column]:
    """(where the fence opens, where its opening comment ends, where it closes), 1-based, 0 if absent."""
    at = F.instr(page, FENCE_OPEN)
    end = F.when(at > 0, F.position(F.lit("-->"), page, at)).otherwise(0)
    return at, end, F.when(end > 0, F.position(F.lit(FENCE_CLOSE), page, end)).otherwise(0)


def managed_region(page: Column) -> Column:
    """The text inside the fence, trimmed; null without a whole fence."""
    _, end, close = _fence(page)
    return F.when(close > 0, F.regexp_replace(F.substr(page, end + 3, close - end - 3), r"^\s+|\s+$", ""))


def before_fence(page: Column) -> Column:
    """The text before the fence; the whole page without one or if its opening comment does not end."""
    at, end, _ = _fence(page)
    return F.when((at == 0) | (end == 0), page).otherwise(F.substr(page, F.lit(1), at - 1))


def after_fence(page: Column) -> Column:
    """The text after the fence; empty without a whole one."""
    _, _, close = _fence(page)
    return F.when(close > 0, F.substr(page, close + len(FENCE_CLOSE))).otherwise(F.lit(""))


def escape_markup(text: Column, apostrophe: bool = False) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#39;"),) if apostrophe else ())):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def round_half_up(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


FENCE = r"<!--\s*managed:start[^>]*-->(.*?)<!--\s*managed:end\s*-->"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def body_of(page: Column) -> Column:
    """A page without frontmatter and its first fence, trimmed."""
    bare, cut = without_frontmatter(page), r"(?s)\A(.*?)" + FENCE + r"(.*)\z"
    return trimmed(F.when(F.rlike(bare, F.lit(cut)), F.concat(F.regexp_extract(bare, cut, 1), F.regexp_extract(bare, cut, 3))).otherwise(bare))


def fence_body(page: Column) -> Column:
    """The trimmed text of a page's first fence; empty without one."""
    return trimmed(F.regexp_extract(without_frontmatter(page), "(?s)" + FENCE, 1))


def sections(body: Column) -> Column:
    """The second-level headings of a page, in order."""
    return F.regexp_extract_all(body, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))


def flow_words(page: Column) -> Column:
    """Words between the heading ``Main flow`` and the next second-level heading or the end."""
    flow = F.regexp_extract(page, r"(?m)^##\s+Main flow\s*$([\s\S]*?)(?=^##\s|\z)", 1)
    return F.size(F.filter(F.split(flow, r"\s+"), lambda w: w != "")).cast("long")


def frontmatter_fields(page: Column) -> Column:
    """A map of the flat keys of a page's frontmatter to their text, quotes taken off; empty without frontmatter."""
    head = F.regexp_extract(page, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    line = r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*?)[ \t\r]*$"
    keys, values = (F.regexp_extract_all(head, F.lit(line), F.lit(g)) for g in (1, 2))
    entries = F.arrays_zip(keys.alias("key"), F.transform(values, lambda v: F.regexp_replace(v, r"^(['\"])(.*)\1$", "$2")).alias("value"))
    # of a key that comes twice the last one counts
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(last)
