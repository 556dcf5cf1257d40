"""A database of pages made of blocks: reading by cursors, writing, and taking back."""

import pytest

from docloom.sources import block_wiki as bw

ROWS = "key string, title string, tags array<string>, blocks array<struct<type: string, text: string>>"


def options(root, **more):
    return {"url": f"folder:{root}", "database": "db", "pageSize": "4", "baseMs": "1"} | more


def fault(root, kind, *replies):
    (root / "faults").mkdir(parents=True, exist_ok=True)
    for i, r in enumerate(replies):
        (root / "faults" / f"{kind}-{i}").write_text(r)


def shown(spark, root):
    return {r.key: (r.title, r.tags, [(b.type, b.text) for b in r.blocks]) for r in bw.read_blocks(spark, **options(root)).collect()}


def test_written_and_read_back(spark, tmp_path):
    long = [("paragraph", f"p{i}") for i in range(250)] + [("code", "x" * 4500), ("divider", "")]
    rows = [(f"k{i}", f"T{i}", ["a", f"t{i}"], [("heading_1", f"H{i}"), ("paragraph", "text")]) for i in range(9)] + [("long", "L", [], long)]
    fault(tmp_path, "query", "429 0")
    bw.publish_blocks(spark.createDataFrame(rows, ROWS), **options(tmp_path))
    want = {k: (t, tags, b) for k, t, tags, b in rows}
    assert shown(spark, tmp_path) == want and bw.read_blocks(spark, **options(tmp_path)).rdd.getNumPartitions() == 3
    one = bw.read_blocks(spark, **options(tmp_path)).where("key in ('k3', 'none', 'k4') and title = 'T3'")
    assert [r.key for r in one.collect()] == ["k3"] and one.rdd.getNumPartitions() == 3
    ids = {r.key: r.page_id for r in bw.read_blocks(spark, **options(tmp_path)).collect()}
    new = [("k1", "T1", ["a", "t1"], [("paragraph", "new")]), ("k2", "New title", ["z"], [("heading_1", "H2"), ("paragraph", "text")]), ("n", "N", [], [])]
    bw.publish_blocks(spark.createDataFrame(new, ROWS), **options(tmp_path))
    assert shown(spark, tmp_path) == want | {k: (t, tags, b) for k, t, tags, b in new}
    assert ids.items() <= {r.key: r.page_id for r in bw.read_blocks(spark, **options(tmp_path)).collect()}.items()


def test_text_of_people_stays(spark, tmp_path):
    bw.publish_blocks(spark.createDataFrame([("k", "T", [], [("callout", "managed"), ("paragraph", "old 1"), ("paragraph", "old 2"), ("divider", ""), ("paragraph", "their own")])], ROWS), **options(tmp_path))
    bw.publish_blocks(spark.createDataFrame([("k", "T", [], [("paragraph", f"new {i}") for i in range(150)])], ROWS), **options(tmp_path))
    assert shown(spark, tmp_path)["k"][2] == [("callout", "managed"), *((("paragraph", f"new {i}")) for i in range(150)), ("divider", ""), ("paragraph", "their own")]


@pytest.mark.parametrize(("kind", "replies"), [("append", ["500"]), ("archive", ["429 0", "500"]), ("describe", ["503"])])
def test_what_a_failed_task_did_is_taken_back(spark, tmp_path, kind, replies):
    first = [(f"k{i}", f"T{i}", [], [("paragraph", "one"), ("paragraph", "two")]) for i in range(3)]
    bw.publish_blocks(spark.createDataFrame(first, ROWS), **options(tmp_path))
    before = shown(spark, tmp_path)
    change = spark.createDataFrame([("fresh", "F", [], []), ("k0", "Other", ["x"], [("paragraph", "new")])], ROWS).coalesce(1)
    fault(tmp_path, kind, *replies)
    with pytest.raises(Exception, match=f"{kind} failed: 50"):
        change.write.format("block_wiki").options(**options(tmp_path)).mode("append").save()
    assert shown(spark, tmp_path) == before
    writer = bw.Writer(options(tmp_path), change.schema)
    done = writer.write(iter(change.collect()))
    assert shown(spark, tmp_path) != before
    writer.abort([done, None])
    assert shown(spark, tmp_path) == before
