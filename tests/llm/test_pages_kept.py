"""Pages that block rules could take text from, and charsets that a header may name."""

import pytest

from docloom.llm import html, warc

LONG = "This is the text that they wrote and that we will have to read in the end. " * 4
RUSSIAN = "Это первый абзац статьи на русском языке, который рассказывает о том, как устроена жизнь в большом городе и почему люди любят гулять по вечерам вдоль реки. Он достаточно длинный, чтобы считаться настоящим текстом, и в нём нет ни одной ссылки."
ITALIAN = "Questo testo racconta una storia molto bella della quale tutti quanti parlano ancora oggi nelle piazze italiane. " * 3
LINKS = 'See <a href="x">the report on the state of the union and on the other things that we all have to know about it in the end of the year</a> for more.'
CODE = "def frobnicate(x): return [y**2 for y in range(x) if y%2==0] + list(map(str, sorted(z)))"


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f"<body><div class=menu><a href=1>Дом</a> <a href=2>Связь</a></div><div><h1>Заголовок</h1><div>{RUSSIAN}</div><div>{RUSSIAN} Ещё.</div></div></body>", ["Заголовок", RUSSIAN, f"{RUSSIAN} Ещё."], ["Связь"]),
        (f"<div><p>{ITALIAN}</p><p>{ITALIAN}</p></div><div class=footer>fine</div>", [ITALIAN.strip()] * 2, ["fine"]),
        (f"<article><h1>T</h1><p>The sign © is for those {LONG}</p><p>Here is © in a short one.</p><p>{LONG}</p></article><div>© 2024 Company. All rights reserved.</div><div>We use cookies on this page.</div>", ["T", f"The sign © is for those {LONG}".strip(), "Here is © in a short one.", LONG.strip()], ["2024", "cookies"]),
        (f"<article><p>{LONG}</p><p>{LINKS}</p><p>{LONG}</p></article>", [LONG.strip(), "See the report on the state of the union and on the other things that we all have to know about it in the end of the year for more.", LONG.strip()], []),
        (f"<article><p>{LONG}</p><table><tr><td>Aluminium Beryllium Calcium Dysprosium Erbium Francium Gallium Hafnium Indium Krypton</td></tr></table><p>{LONG}</p></article>", [LONG.strip(), "Aluminium Beryllium Calcium Dysprosium Erbium Francium Gallium Hafnium Indium Krypton", LONG.strip()], []),
        (f"<article><p>{LONG}</p><pre>{CODE}</pre><ul><li>One</li><li>Two</li></ul></article><footer>foot</footer>", [LONG.strip(), CODE, "One", "Two"], ["foot"]),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div>All rights reserved.</div>", [LONG.strip()] * 2, ["rights"]),
    ],
)
def test_articles_stay_whole(page, kept, gone):
    got = html.main_text(page)
    assert got.split("\n") == kept and not any(x in got for x in gone)


@pytest.mark.parametrize("charset", "idna undefined utf-7 unicode_escape raw_unicode_escape rot13 base64 hex zlib mbcs punycode nonsense latin-1 utf-16 cp1252 gb18030 utf-8-sig big5 x.y-z".split())
def test_charsets(charset):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + charset.encode() + b"\r\nX-\xff: \xfe\r\n\r\n<p>x \\ud800 \xff\xfe +2AA- &#xd800; y</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: %d\r\n\r\n" % len(block) + block
    made = warc.derive(record)
    assert [r["type"] for r in made] == ["metadata", "conversion"] and all(r["reason"] is None and r["block"] is not None for r in made)
    if charset == "cp1252":
        assert made[1]["block"] == "x \\ud800 ÿþ +2AA- � y"


def test_empty_tables(spark):
    assert warc.op6_warc.__doc__ and warc.derivatives(spark.createDataFrame([], "page_id long, warc binary"), ["page_id"]).count() == 0
