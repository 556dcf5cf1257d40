"""Sharding over virtual slots against plain Python."""

import collections
import random
import zlib

import pyarrow.parquet as pq

from docloom.llm import shards


def plain_map(sizes, n, now=None, slack=shards.SLACK):
    """The map that the rule gives: slots by size stay while their shard has room, the others go to the lightest shard."""
    weight = {v: max(b, 1) for v, b in sizes.items()}
    order, loads, out = sorted(weight, key=lambda v: (-weight[v], v)), [0] * n, {}
    room = -int(-sum(weight.values()) / n * (1 + slack) // 1)
    for v in order:
        if now and now[v] < n and loads[now[v]] + weight[v] <= room:
            out[v] = now[v]
            loads[now[v]] += weight[v]
    for v in order:
        if v not in out:
            out[v] = min(range(n), key=lambda s: (loads[s], s))
            loads[out[v]] += weight[v]
    return out


def check(got, rows, n=16):
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    assert set(held) <= set(range(n)) and all(sorted(x) == list(range(len(x))) for x in held.values())
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r["size"]
    even, most = sum(loads.values()) / n, max(r["size"] for r in got)
    return loads, even, most


def test_given_documents(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()]
    got = shards.op11_shards(spark, tiny).collect()
    loads, even, most = check(got, rows)
    assert all(abs(loads[s] - even) <= max(0.02 * even, most) for s in range(16))
    assert {(r.law, r.grown_shard, r.map_version) for r in got} == {("bytes", None, 1)}
    again = shards.op11_shards(spark, tiny).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_odd_and_hot_rows(spark):
    rng = random.Random(4)
    rows = [(i, "ü" * rng.randrange(90)) for i in range(1500)] + [(None, None), (None, "x"), (3, ""), (3, None), (4, "y" * 40000)]
    rows += [(77, "the same again")] * 9000  # more than are unfolded at once; one key with most of the rows
    df = spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in rows], "doc_id long, text string, shard string, slot int, size int, virtual_slot int")
    got = shards.sharded(df).collect()
    loads, even, most = check(got, rows)
    # the long text fills its shard; the others are even
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) >= 40001 and max(rest) - min(rest) <= 200
    assert shards.sharded(df.limit(0)).count() == 0


def test_map_is_the_rule_and_grows(spark, tmp_path):
    rng = random.Random(5)
    sizes = {v: rng.choice([0, 0, 1, 50, 300, 900, 20000 if v % 50 == 0 else 10]) for v in range(512)}
    frame = spark.createDataFrame([(v, b, b // 10) for v, b in sizes.items()], "virtual_slot int, bytes long, n long")
    maps = shards.SlotMaps(spark, str(tmp_path / "maps"))
    assert maps.latest() == 0 and maps.rebalance(frame, 7) == 1
    first = {r.virtual_slot: r.shard for r in maps.read(1).collect()}
    assert first == plain_map(sizes, 7)
    assert maps.rebalance(frame, 8) == 2
    second = {r.virtual_slot: r.shard for r in maps.read(2).collect()}
    assert second == plain_map(sizes, 8, first)
    moved = [v for v in sizes if first[v] != second[v]]
    total = sum(sizes.values())
    assert 0 < sum(sizes[v] for v in moved) < 1.3 * total / 8 and sum(sizes[v] for v in moved if second[v] != 7) < 0.02 * total
    # an edit holds what it changes only; earlier versions stay as they were; nothing to move is an edit of no rows
    assert spark.read.parquet(f"{maps.folder}/version=2").count() == len(moved)
    assert {r.virtual_slot: r.shard for r in maps.read(1).collect()} == first
    assert maps.rebalance(frame, 8) == 3 and {r.virtual_slot: r.shard for r in maps.read(3).collect()} == second
    # a shard that goes gives its slots to the others
    assert maps.rebalance(frame, 7) == 4 and max(r.shard for r in maps.read(4).collect()) == 6
