"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block
alone: its place (menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are bad by tag, role or class), link density, length and stop-word
density make it good or bad, or leave it undecided: near good, or short. In the
second pass undecided blocks inherit from the nearest decided neighbours.

Results for odd input: null and empty pages give an empty text; markup that is cut
off or badly nested is read as far as it goes (an open comment, script or style
runs to the end; closing tags without an open one are ignored); repeated rows give
repeated results; very long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in
into is it its more most my no not of on one only or other our out over she should so some such than that the their them then
there these they this to under up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für haben hat
ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie
wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en entre est et eux il ils je la le les leur lui mais même ne nous on ou où par
pas plus pour qu que qui sa sans se ses si son sont sur un une vous
al como con cuando de del desde donde el ella ellos en entre es esta este fue ha hay la las le lo los más me mi muy no nos o para
pero por que se ser si sin sobre son su sus también te tiene todo un una uno y ya
""".split()
)
# Tags that begin and end a block.
BLOCK_TAGS = frozenset(
    """
address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table
tbody td textarea tfoot th thead title tr ul
""".split()
)
# Tags, roles and words of class or id that hold no article text.
BAD_TAGS = frozenset("aside button dialog fieldset footer form head iframe menu nav optgroup option search select textarea title".split())
BAD_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
BAD_WORDS = frozenset(
    """
ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies
copyright disclaimer disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices
pagination pager popup promo promoted promotion recommended related reply replies reader respond share sharing sidebar sidenav signup
social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets
""".split()
)
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template")
# an svg's labels are no article text; its end may be missing, and then only its opening tag goes. Math, object and canvas hold readable text.

#: Characters below which a block says nothing by itself, and from which stop words make it good.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH, LINKS_HIGH = 0.10, 0.20, 0.33

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW_TAGS) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*[^>]*>|\Z)|<(svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:(?<!/>)(?:(?!<svg\b).)*?</svg\s*>)?|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
# a class or id that says what an element has or lacks, not what it is
_MODIFIER = re.compile(r"(?:no|not|non|has|have|with|without)[-_]")


@dataclass
class Block:
    text: str
    tag: str
    bad: bool  # by its place
    article: bool
    links: int  # characters in links
    holder: int = 0  # the element around the paragraph
    by: tuple[int, ...] = ()  # the elements around it that are bad by class or id
    within: tuple[int, ...] = ()  # the elements around it, without paragraphs, html and body
    label: str = ""


def _bad_place(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is bad by tag or role, and by class or id."""
    place, name = tag in BAD_TAGS or tag == "header" and not in_article, False
    for kind, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = "".join(values).lower()
        if kind.lower() == "role":
            place = place or bool(set(_NAME.findall(value)) & BAD_ROLES)
        elif tag not in ("html", "body"):
            name = name or any(set(_NAME.findall(v)) & BAD_WORDS for v in value.split() if not _MODIFIER.match(v))
    return place, name


def _wrappers(found: list[Block]) -> set[int]:
    """Elements that are bad by class or id, but hold over half of the page's text and its h1, or all of its long text if it has no h1."""
    held: dict[int, int] = {}
    for b in found:
        for e in b.by:
            held[e] = held.get(e, 0) + len(b.text)
    half = sum(len(b.text) for b in found) / 2
    title = any(b.tag == "h1" for b in found)
    return {e for e, n in held.items() if n > half and (any(b.tag == "h1" and e in b.by for b in found) if title else any(e in b.by and len(b.text) >= LONG for b in found) and all(e in b.by or b.bad or len(b.text) < LONG for b in found))}


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones."""
    page = _DROP.sub(lambda m: " " if m[0].startswith("<!--") is False and m[1] is None and m[2] is None else "", page)
    found = _blocks(page, set())
    spared = _wrappers(found)
    return _blocks(page, spared) if spared else found


def _blocks(page: str, spared: set[int]) -> list[Block]:
    """The blocks; elements in ``spared`` are not judged by class or id."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = []  # tag, in a bad place, in the article, number, around it bad by class or id
    parts: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links, parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, bad, article, _, by = stack[-1] if stack else ("", False, False, 0, ())
                within = tuple(e[3] for e in stack if e[0] not in PARAGRAPHS and e[0] not in ("html", "body"))
                out.append(Block(text, tag, bad, article, links, next((e[3] for e in reversed(stack) if e[0] not in PARAGRAPHS), 0), by, within))
        parts, links = [], 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                links += len("".join(html.unescape(piece).split()))
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "a":
            in_link = not m[1]
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if m[1]:
            in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID_TAGS or (m[3] or "").endswith("/"):
            continue
        # an open paragraph or item ends where the next block begins
        while stack and (stack[-1][0] in PARAGRAPHS or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            stack.pop()
        if tag == "body":
            stack.clear()
        bad, article, by = (*stack[-1][1:3], stack[-1][4]) if stack else (False, False, ())
        place, name = _bad_place(tag, m[3] or "", article)
        name = name and m.end() not in spared
        own = place or name
        if tag in ("article", "main") and not own:
            bad, article = bad and article, True  # a place that was left open before the article does not hold it
            by = by if bad else ()
        stack.append((tag, bad or own, article, m.end(), (*by, m.end()) if name else by))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def classify(found: list[Block]) -> list[bool]:
    """Whether each block is main text.

    Where the long blocks of a page hold hardly any known stop word, it is in another
    language: length and links decide alone. A block that is bad only by its links or
    stop words, in an element that holds good ones or within it, is undecided: an
    article's table, code or list of sources. A copyright sign counts in short blocks
    behind the last good one.
    """
    placed = [b for b in found if not b.bad]
    foreign = sum(len(b.text) for b in placed if len(b.text) >= SHORT and _stop_share(b.text) < STOPS_LOW) > 0.9 * sum(len(b.text) for b in placed if len(b.text) >= SHORT)
    weak: list[Block] = []
    for b in found:
        n, links = len(b.text), b.links / max(1, len(b.text.replace(" ", "")))
        stops = STOPS_HIGH if foreign else _stop_share(b.text)
        if b.bad:
            b.label = "bad"
        elif links > LINKS_HIGH:
            b.label = "bad"
            weak.append(b)
        elif n < SHORT:
            b.label = "short"
        elif stops >= STOPS_HIGH:
            b.label = "good" if n >= LONG else "near"
        elif stops >= STOPS_LOW:
            b.label = "near"
        elif b.tag == "p":
            b.label = "short"
        else:
            b.label = "bad"
            weak.append(b)
    good = {e for b in found if b.label == "good" for e in b.within[-1:]}
    for b in weak:
        # a line that is nothing but a link stays what it is: a menu in the article's element
        if good & set(b.within) and (len(b.text) >= SHORT or b.links < 0.9 * len(b.text.replace(" ", ""))):
            b.label = "near"
    last = max((i for i, b in enumerate(found) if b.label == "good"), default=len(found))
    for b in found[last + 1 :]:
        if "©" in b.text and len(b.text) < LONG:
            b.label = "bad"
    before, after, last = [], [], None
    for b in found:
        before.append(last)
        last = b if b.label in ("good", "bad") else last
    last = None
    for b in reversed(found):
        after.append(last)
        last = b if b.label in ("good", "bad") else last
    after.reverse()
    none = all(b.label != "good" for b in found)
    out = []
    for b, x, y in zip(found, before, after, strict=True):
        up, down = x is not None and x.label == "good", y is not None and y.label == "good"
        if b.label in ("good", "bad"):
            out.append(b.label == "good")
        elif none:
            out.append(True)  # the only text there is
        elif b.label == "near":
            out.append(up or down)
        else:  # short: between good ones, next to a good one in the same element or deeper in it, or the heading of one
            out.append(up and (down or x.holder == b.holder or x.holder in b.within) or down and (y.holder == b.holder or y.holder in b.within or b.tag[:1] == "h"))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``page`` and with its main text in ``out`` (empty if there is none), in place of a column of that name. No shuffle."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pc.fill_null(mapped(batch, pa.string(), main_text), "")

    text = df.withColumn(out, run(F.col(page)))
    return text if page == out else text.drop(page)


def op3_html(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
