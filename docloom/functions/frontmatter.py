"""A page's frontmatter as values, and values as frontmatter.

The YAML that pages begin with: nested maps and lists by indentation, plain and quoted
scalars over several lines, literal and folded blocks, lists and maps in brackets,
comments. Plain scalars are resolved to null, booleans, numbers and times (as UTC with
milliseconds). Anchors, tags and several documents are not read: the text counts as broken.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import canonical, parsed

_HEAD = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:](?=\S)[^#]*?)\s*:(?=\s|$)""")
_TIME = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d)(?:\.(\d*))?[ \t]*(Z|[-+]\d\d?(?::?\d\d)?)?)?")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class Broken(ValueError):
    """A text that is no frontmatter."""


def _time(m: re.Match) -> str:
    year, month, day, hour, minute, second, part, zone = m.groups()
    at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=UTC)
    if zone and zone != "Z":
        away = re.fullmatch(r"([-+])(\d\d?):?(\d\d)?", zone)
        at = at.replace(tzinfo=timezone((1 if away[1] == "+" else -1) * timedelta(hours=int(away[2]), minutes=int(away[3] or 0)))).astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + (part or "").ljust(3, "0")[:3] + "Z"


def resolved(text: str):
    """The value of a plain scalar."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false") and text in (text.lower(), text.upper(), text.capitalize()):
        return text.lower() == "true"
    if re.fullmatch(r"[-+]?(0b[01]+|0o[0-7]+|0x[0-9a-fA-F]+)", text):
        return int(text, 0)
    if re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text):
        return float(text) if re.search("[.eE]", text) else int(text)
    if m := _TIME.fullmatch(text):
        try:
            return _time(m)
        except ValueError:
            return text
    return text


def _unquoted(text: str) -> str:
    """The text of a quoted scalar, its lines folded."""
    inner = re.sub(r"[ \t]*\n[ \t]*(?:\n[ \t]*)*", lambda m: "\n" * (m[0].count("\n") - 1) or " ", text[1:-1])
    if text[0] == "'":
        return inner.replace("''", "'")

    def escape(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise Broken(f"escape {c}")
        return _ESCAPES[c]

    out = re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", escape, inner)
    # pairs of surrogates are one character
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass")


class Flow:
    """A value in one piece of text: quoted, in brackets, or plain."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _blank(self) -> None:
        self.at = re.compile(r"(?:\s|(?:(?<=\s)|\A)#[^\n]*)*").match(self.text, self.at).end()

    def value(self, inside: bool = False):
        self._blank()
        rest = self.text[self.at :]
        if rest[:1] in ("'", '"'):
            m = re.match(r"""'(?:[^']|'')*'|"(?:[^"\\]|\\.)*\"""", rest, re.S)
            if not m:
                raise Broken("a quote that does not end")
            self.at += m.end()
            return _unquoted(m[0])
        if rest[:1] == "[":
            return self._items("]", self.value)
        if rest[:1] == "{":
            pairs = self._items("}", self._pair)
            if len(dict(pairs)) < len(pairs):
                raise Broken("a key twice")
            return dict(pairs)
        if rest[:1] in tuple("&*!%@`|>") and rest:
            raise Broken(f"{rest[0]} is not read")
        m = re.match(r"(?:(?!\s#|:\s|:$|:[,\]}])[^,\[\]{}\n]|\n)*" if inside else r"(?:(?!\s#).)*", rest, re.S)
        self.at += m.end()
        return resolved(" ".join(m[0].split("\n")).strip() if inside else m[0].strip())

    def _items(self, end: str, item) -> list:
        self.at += 1
        out = []
        while True:
            self._blank()
            if self.text[self.at : self.at + 1] == end:
                self.at += 1
                return out
            out.append(item(True))
            self._blank()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != end:
                raise Broken("a bracket that does not end")

    def _pair(self, _) -> tuple:
        key = self.value(True)
        self._blank()
        if self.text[self.at : self.at + 1] != ":":
            return _name(key), None
        self.at += 1
        self._blank()
        return _name(key), None if self.text[self.at : self.at + 1] in (",", "}") else self.value(True)

    def whole(self):
        out = self.value()
        self._blank()
        if self.at < len(self.text):
            raise Broken(f"more text: {self.text[self.at :][:40]}")
        return out


def _name(key) -> str:
    return key if isinstance(key, str) else canonical(key).strip('"')


def _folded(lines: list[str]) -> str:
    """Lines of a folded block as one text: a line end is a blank, unless lines are empty or indented further."""
    out, last, empty = "", None, 0
    for line in lines:
        if not line:
            empty += 1
            continue
        if last is None:
            out = "\n" * empty
        elif last[0] in " \t" or line[0] in " \t":
            out += "\n" * (empty + 1)
        else:
            out += "\n" * empty or " "
        out, last, empty = out + line, line, 0
    return out


class Reader:
    """Lines by indentation; each method returns the value that begins at the line at hand."""

    def __init__(self, text: str):
        self.lines, self.at = text.replace("\r\n", "\n").split("\n"), 0

    def _indent(self) -> int:
        """The indentation of the next line that says something, which becomes the line at hand; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.lstrip("\t").startswith("#"):
                if bare[0] == "\t":
                    raise Broken("a tab before a value")
                return len(line) - len(bare)
            self.at += 1
        return -1

    def value(self, least: int):
        """What stands at an indentation of ``least`` or more; None if the next line has less."""
        indent = self._indent()
        if indent < least:
            return None
        text = self.lines[self.at][indent:]
        if re.match(r"-(\s|$)", text):
            return self._list(indent)
        if _KEY.match(text):
            return self._map(indent)
        return self._scalar(text, indent - 1)

    def _list(self, indent: int) -> list:
        out = []
        while self._indent() == indent and re.match(r"-(\s|$)", self.lines[self.at][indent:]):
            line = self.lines[self.at]
            rest = line[indent + 1 :]
            out.append(self._after(rest, indent, " " * (indent + 1) + rest))
        return out

    def _map(self, indent: int) -> dict:
        out: dict = {}
        while self._indent() == indent:
            line = self.lines[self.at]
            m = _KEY.match(line, indent)
            if not m:
                raise Broken(f"no key: {line}")
            key = _unquoted(m[1]) if m[1][0] in "'\"" else _name(resolved(m[1]) if not _TIME.fullmatch(m[1]) else m[1])
            if key in out:
                raise Broken(f"a key twice: {key}")
            out[key] = self._after(line[m.end() :], indent, None)
        if self._indent() > indent:
            raise Broken(f"an indentation that nothing has begun: {self.lines[self.at]}")
        return out

    def _after(self, rest: str, indent: int, inline: str | None):
        """What follows a dash or a key: in its line, or below it. ``inline``: the line as it would be if its dash were a blank."""
        bare = rest.strip()
        if not bare or bare.startswith("#"):
            self.at += 1
            below = self._indent()
            if inline is None and below == indent and re.match(r"-(\s|$)", self.lines[self.at][indent:]):
                return self._list(indent)  # a list may stand right below its key
            return self.value(indent + 1)
        if m := re.fullmatch(r"([|>])([-+]?)([1-9]?)([-+]?)(?:\s+#.*)?", bare):
            self.at += 1
            return self._block(m[1], m[2] or m[4], int(m[3]) if m[3] else None, indent)
        start = len(rest) - len(rest.lstrip())
        if inline is not None and (re.match(r"-(\s|$)", bare) or _KEY.match(bare)):
            self.lines[self.at] = inline
            return self.value(indent + 1 + start)
        return self._scalar(bare, indent)

    def _block(self, kind: str, chomp: str, given: int | None, indent: int) -> str:
        rows, own = [], None if given is None else max(indent, 0) + given
        while self.at < len(self.lines):
            line = self.lines[self.at]
            depth = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if own is None:
                    own = depth
                if depth < own or own <= indent:
                    break
            rows.append(line[own:] if own is not None else "")
            self.at += 1
        body = "\n".join(rows)
        kept = body.rstrip("\n")
        ends = "\n" * (len(body) - len(kept) + 1) if rows else ""
        if kind == ">":
            kept = _folded(kept.split("\n"))
        return kept + {"-": "", "+": ends if kept else ends[1:], "": "\n" if kept else ""}[chomp]

    def _scalar(self, text: str, indent: int):
        """A value that begins with ``text`` and may go on in lines of more than ``indent``."""
        self.at += 1
        quote = text[0] if text[0] in "'\"" else ""
        closed = {"'": r"'(?:[^']|'')*'", '"': r'"(?:[^"\\]|\\.)*"'}
        if quote or text[0] in "[{":
            while not self._ends(text, closed.get(quote)):
                if self.at >= len(self.lines):
                    raise Broken("a value that does not end")
                text += "\n" + self.lines[self.at].strip()
                self.at += 1
            return Flow(text).whole()
        parts = [re.sub(r"\s#.*", "", text).strip()]
        while self.at < len(self.lines) and "#" not in text:
            line = self.lines[self.at]
            if line.strip() and (len(line) - len(line.lstrip(" ")) <= indent or line.lstrip().startswith("#")):
                break
            if not line.strip() and not any(x.strip() for x in self.lines[self.at :]):
                break
            more = re.sub(r"\s#.*", "", line).strip()
            if re.search(r":(\s|$)", more):
                raise Broken(f"a key within a value: {line}")
            parts.append(more)
            self.at += 1
        if re.search(r":(\s|$)", parts[0]):
            raise Broken(f"a key within a value: {text}")
        while len(parts) > 1 and not parts[-1]:
            parts.pop()
            self.at -= 1
        joined = parts[0]
        for i, p in enumerate(parts[1:], 1):
            joined += p if not parts[i - 1] else (" " + p if p else "")
            joined += "\n" if not p else ""
        return Flow(joined).whole() if len(parts) == 1 else joined

    @staticmethod
    def _ends(text: str, quoted: str | None) -> bool:
        if quoted:
            return re.match(quoted, text, re.S) is not None
        depth = 0
        for m in re.finditer(r"""'(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|[\[\]{}]""", text, re.S):
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        return depth <= 0


def read(text: str):
    """The value of a text of YAML; raises ValueError if it is broken."""
    reader = Reader(text)
    out = reader.value(0)
    if reader._indent() >= 0:
        raise Broken(f"more text: {reader.lines[reader.at]}")
    return out


_PLAIN = re.compile(r"""(?!---)(?:[^\s\-?:,\[\]{}#&*!|>'"%@`=~]|[-?:](?=[^\s\-?:,\[\]{}]))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*""")
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x84\x86-\x9f\ud800-\udfff\ufeff\ufffe\uffff\u2028\u2029\x85]")


def scalar(x, indent: int = 0) -> str:
    """A scalar as it stands behind a key that is indented by ``indent``."""
    if not isinstance(x, str):
        return canonical(x)
    if _ODD.search(x) or "\r" in x or ("\n" in x and not x.strip("\n \t")):
        return json.dumps(x)
    if "\n" in x:
        ends = len(x) - len(x.rstrip("\n"))
        mark = "|" + ("2" if x.startswith((" ", "\n")) else "") + ("-" if ends == 0 else "" if ends == 1 else "+")
        rows = (x[:-1] if ends else x).split("\n")
        return mark + "".join("\n" + (" " * (indent + 2) + r if r else "") for r in rows)
    if x == x.strip() and "\t" not in x and _PLAIN.fullmatch(x) and isinstance(resolved(x), str) and resolved(x) == x and not _TIME.fullmatch(x) and x.lower() not in ("y", "n", "yes", "no", "on", "off"):
        return x
    return "'" + x.replace("'", "''") + "'" if "\t" not in x else json.dumps(x)


def written(value, indent: int = 0) -> str:
    """A map or list as lines."""
    pad, out = " " * indent, []
    if isinstance(value, dict):
        for k, v in value.items():
            name = k if re.fullmatch(r"[A-Za-z_][\w.-]*", k, re.A) and scalar(k) == k else json.dumps(k)
            if isinstance(v, (dict, list)) and v:
                out.append(f"{pad}{name}:\n{written(v, indent + 2)}")
            else:
                out.append(f"{pad}{name}: {'{}' if v == {} and isinstance(v, dict) else '[]' if isinstance(v, list) else scalar(v, indent)}")
    else:
        for v in value:
            if isinstance(v, (dict, list)) and v:
                out.append(f"{pad}- {written(v, indent + 2)[indent + 2 :]}")
            else:
                out.append(f"{pad}- {'{}' if isinstance(v, dict) else '[]' if isinstance(v, list) else scalar(v, indent)}")
    return "\n".join(out)


def frontmatter_json(page: Column) -> Column:
    """The frontmatter of a page as canonical JSON; ``{}`` without one or if it is empty, null if it is broken or no map."""

    @F.arrow_udf("string")
    def run(pages):
        import pyarrow as pa

        out = []
        for text in pages.to_pylist():
            found = _HEAD.match(text or "")
            try:
                value = (read(found[1]) if found else {}) or {}
                out.append(canonical(value) if isinstance(value, dict) else None)
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array([x.encode("utf-8", "replace").decode() if x is not None else None for x in out], pa.string())

    return run(page)


def frontmatter_text(fields: Column) -> Column:
    """Frontmatter, with its fences, of fields as a JSON object, in their order; null if they are none."""

    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        out = []
        for text in texts.to_pylist():
            try:
                value = parsed(text) if text is not None else None
            except ValueError:
                value = None
            out.append(f"---\n{written(value)}\n---\n" if isinstance(value, dict) and value else "---\n---\n" if value == {} else None)
        return pa.array(out, pa.string())

    return run(fields)
