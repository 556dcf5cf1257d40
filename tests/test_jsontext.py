import json

import pytest

from docloom.functions import jsontext


def test_one_reader_for_all_texts(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a reader for each text")

    monkeypatch.setattr(json, "JSONDecoder", refuse)
    assert jsontext.parsed('{"a": 1, "b": [2, null], "a": "x"}') == {"a": "x", "b": [2.0, None]}
    for bad in ("﻿{}", '{"a": NaN}', "{", "", '{"a": 1} x', "[" * 100_000):
        with pytest.raises(ValueError):
            jsontext.parsed(bad)
