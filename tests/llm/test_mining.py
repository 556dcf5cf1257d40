"""Hard-negative mining against all products."""

import collections
import math
import random

import duckdb
import numpy as np
import pytest

from docloom.llm import mining


def plain(rows, anchors=100, positives=5, negatives=10):
    good = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for n, (i, lab, v) in enumerate(good):
        if i is None or i % anchors:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for k, (j, m, w) in enumerate(good) if k != n]
        for ps, pid, _ in sorted((s for s in scored if s[2] == lab), key=order)[:positives]:
            hard = sorted((s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:negatives]
            out += [(i, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(hard, 1)]
    return out


def test_odd_rows(spark):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [x + rng.gauss(0, 0.4) for x in rng.choice(base)]) for i in range(0, 700, 3)]
    rows += [(600, 1, [0.0] * 12), (100, 2, base[0]), (100, 2, base[0]), (None, 0, base[1]), (None, 1, base[1]), (200, None, base[2]), (400, 1, None), (500, 1, [float("nan")] * 12), (800, 0, [None] * 12), (900, 0, [float("inf")] * 12), (1000, 0, []), (1100, 1, base[3][:5]), (1200, 77, base[4])]
    rows += [(7000 + i, 0, base[0]) for i in range(60)]  # ties
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, label int, embedding array<double>, rank int, row int").repartition(3)
    want = collections.Counter(plain(rows))
    for options in ({}, {"block_anchors": 3, "chunk_rows": 40}):
        got = mining.hard_negatives(mining.integer_rows(df), **options).collect()
        assert collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert len(want) > 100
    assert mining.hard_negatives(mining.integer_rows(df.limit(0))).count() == 0


def test_huge_components(spark):
    rows = [(0, 1, [2.0**20, 2.0**10]), (1, 1, [2.0**19, 1.0]), (2, 2, [2.0**17, 3.0]), (3, 2, [2.0**18, -7.0]), (4, 2, [-(2.0**19), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, mining.hard_negatives(mining.integer_rows(df)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain(rows)
    df = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1e200]), (2, 2, [1e10])], "vec_id long, label int, embedding array<double>")
    assert mining.hard_negatives(mining.integer_rows(df)).count() <= 1


@pytest.mark.parametrize("seed", range(3))
def test_bounds_drop_nothing(seed):
    """The stages against all products, on spectra from flat to steep; and most pairs go early where the spectrum is steep."""
    rng = np.random.default_rng(seed)
    d, scale = 24, [1.0, 0.8, 0.5][seed] ** np.arange(24)
    vectors = np.floor(256 * rng.standard_normal((3000, d)) * scale).astype(np.int64)
    values, matrix = np.linalg.eigh(vectors.T.astype(float) @ vectors)
    seen = []

    class Counted(mining.Sweep):
        def _verify(self, i, *rest):
            seen.append(len(i))
            super()._verify(i, *rest)

    sweep = Counted(matrix[:, ::-1], mining.stages(values[::-1]), 10, True)
    n = 40
    low, high = np.full((n, 2), mining.LOW), np.full((n, 2), mining.HIGH)
    scores = vectors[:n] @ vectors.T
    high[:, 1] = np.sort(scores, 1)[:, -50] * 9 // 10
    sweep.start(np.arange(n), np.zeros(n, np.int64), vectors[:n], low, high)
    for a in range(0, len(vectors), 700):
        ids = np.arange(a, min(a + 700, len(vectors)))
        sweep.see(ids, ids, np.zeros(len(ids), np.int64), vectors[ids])
    i, no, score, ids, _ = sweep.result()
    for x in range(n):
        for k in range(2):
            own = np.lexsort([np.arange(len(vectors)), -scores[x]])
            own = [int(j) for j in own if j != x and scores[x, j] <= high[x, k]][:10]
            mine = (i == x) & (no == k)
            assert ids[mine].tolist() == own and score[mine].tolist() == scores[x, own].tolist()
    assert sum(seen) < n * len(vectors) * [1, 0.8, 0.7][seed]


def test_against_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    want = con.execute(mining.NEGATIVES_SQL).fetchall()
    got = mining.op13_negatives(spark, tiny).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
