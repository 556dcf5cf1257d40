"""JSON texts as JavaScript writes them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class NoJson(ValueError):
    """A text that a strict reader of JSON refuses."""


def _refuse(word: str):
    raise NoJson(word)


#: One reader for all texts: ``json.loads`` with settings makes one for each.
_READER = json.JSONDecoder(parse_int=float, parse_constant=_refuse)


def parsed(text: str):
    """The value of a JSON text; of repeated keys the last one counts, numbers are doubles. Raises ValueError if it is none."""
    try:
        return _READER.decode(text)
    except RecursionError as e:
        raise NoJson("nested too deeply") from e


def number_text(x: float) -> str:
    """The shortest digits that give the double; exponents from 1e21 on and below 1e-6; no double that isn't finite."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = f"{digits[0]}{'.' if n > 1 else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + out if x < 0 else out


_LONE = re.compile("[\ud800-\udfff]")


def string_text(x: str) -> str:
    """A string in quotes: short escapes, other control characters and lone surrogates as four lower-case digits."""
    text = json.encoder.encode_basestring(x)
    return text if text.isascii() else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def utf16(key: str) -> bytes:
    """What keys are ordered by."""
    return key.encode("utf-16-be", "surrogatepass")


def canonical(value) -> str:
    """A value without blanks, keys in the order of their UTF-16 units."""
    if isinstance(value, str):
        return string_text(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{string_text(k)}:{canonical(value[k])}" for k in (sorted(value) if all(map(str.isascii, value)) else sorted(value, key=utf16))) + "}"


def canonical_json(raw: Column, without: tuple[str, ...] = ()) -> Column:
    """The canonical text of a JSON object, its keys ``without`` left out; null if it is no JSON object."""

    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        out = []
        for text in texts.to_pylist():
            try:
                value = parsed(text) if text is not None else None
                out.append(canonical({k: v for k, v in value.items() if k not in without}) if isinstance(value, dict) else None)
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(raw)
