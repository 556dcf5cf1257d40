"""Frontmatter: read, written, and read again."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm

READ = {
    "a: 1\nb: two words # note\nc: 'it''s'\nd: \"x\\ty\\u00e9\"": {"a": 1, "b": "two words", "c": "it's", "d": "x\tyé"},
    "a:\n  b:\n    - 1\n    - x: y\n      z: [1, {k: v, 'q': \"r\"}, ~]\n  c: {}\nd: []": {"a": {"b": [1, {"x": "y", "z": [1, {"k": "v", "q": "r"}, None]}], "c": {}}, "d": []},
    "l:\n- a\n- - b\n  - c\n-\n  k: v\nm: x": {"l": ["a", ["b", "c"], {"k": "v"}], "m": "x"},
    "t: |\n  one\n   two\n\n  three\n\nf: >-\n  fold\n  ed\n\n  new\nk: |+\n  x\n\nz: 1": {"t": "one\n two\n\nthree\n", "f": "fold ed\nnew", "k": "x\n\n", "z": 1},
    "at: 2024-01-02T03:04:05Z\nday: 2024-01-02\noff: 2024-01-02 03:04:05.5 +02:00\nno: 2024-13-45": {"at": "2024-01-02T03:04:05.000Z", "day": "2024-01-02T00:00:00.000Z", "off": "2024-01-02T01:04:05.500Z", "no": "2024-13-45"},
    "a: null\nb: ~\nc:\nd: True\ne: false\nf: 0x1F\ng: -1.5e3\nh: 1_000\ni: yes\nj: 012": {"a": None, "b": None, "c": None, "d": True, "e": False, "f": 31, "g": -1500.0, "h": "1_000", "i": "yes", "j": 12},
    "a: one\n  two\n\n  three\nb: 'x\n  y\n\n  z'\nc: [1,\n  2]": {"a": "one two\nthree", "b": "x y\nz", "c": [1, 2]},
    "# all\n\nurl: http://a.b/c#d\n'quoted key': 1\n? : x": None, "a: 1\na: 2": None, "a: b: c": None, "a: 'x": None, "a: [1": None, "a: &x 1": None, "a: *x": None, "a: !t 1": None, "- 1\nb: 2": None, "a: 1\n   b: 2": None, "\ta: 1": None,
    "url: http://a.b/c#d\n'quoted key': 1\n-x: -y": {"url": "http://a.b/c#d", "quoted key": 1, "-x": "-y"},
}


@pytest.mark.parametrize("text", READ)
def test_reading(text):
    if READ[text] is None:
        with pytest.raises(ValueError):
            fm.read(text)
    else:
        assert fm.read(text) == READ[text]


odd = st.text(st.sampled_from(list("ab1-:#'\"\\ \n\t[]{},&*!|>%@`?~=.éT0Z\u2028\x07+")) | st.characters(exclude_categories=["Cs"]), max_size=14)
values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | odd | st.sampled_from(["true", "null", "1e3", "0x10", "2024-01-02", "no", "---", "- a", "a: b", " x", "x ", "x\n", "\nx", "x\n\n", " \n", "a\n  b\n", "'", "#", "a #b"]), lambda x: st.lists(x, max_size=4) | st.dictionaries(odd, x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(odd, values, max_size=4))
def test_written_is_read_back(value):
    assert fm.read(fm.written(value)) == (value or None)


def test_columns(spark):
    fields = [{"title": "A: b", "tags": ["x", "1", "no"], "source_files": [{"path": "src/A.java", "lines": "1-9"}], "note": "two\nlines"}, {}, {"n": 1.5}]
    rows = spark.createDataFrame([(json.dumps(f),) for f in fields] + [("[1]",), ("nonsense",), (None,)], "fields string")
    got = rows.select("fields", fm.frontmatter_text(F.col("fields")).alias("head")).select("fields", "head", fm.frontmatter_json(F.concat("head", F.lit("# Page\n---\n"))).alias("again")).collect()
    assert [json.loads(r.again) for r in got[:3]] == fields and [r.head for r in got[3:]] == [None] * 3
    assert got[0].head == "---\ntitle: 'A: b'\ntags:\n  - x\n  - '1'\n  - 'no'\nsource_files:\n  - path: src/A.java\n    lines: 1-9\nnote: |-\n  two\n  lines\n---\n"
    pages = spark.createDataFrame([("no frontmatter",), ("---\na: [1\n---\nx",), ("---\n- 1\n---\n",), ("---\r\na: 1\r\nb: x\r\n---\r\nbody",), ("---\n---\n",), (None,)], "page string")
    assert [r.j for r in pages.select(fm.frontmatter_json(F.col("page")).alias("j")).collect()] == ["{}", None, None, '{"a":1,"b":"x"}', "{}", "{}"]
