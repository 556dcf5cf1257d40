"""Lexical search against scoring every document."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from docloom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return out


def test_terms():
    for x in (None, "", " .,;", "Ab1-cD_É ß x퟿\U0001f600z", "İIı K", "a\x7fb\x00c"):
        assert [t.decode() for t in lexical.terms_of(x)] == plain_terms(x)


@pytest.mark.parametrize("seed", range(4))
def test_treaps_against_all_scores(seed):
    rng = np.random.default_rng(seed)
    n, n_terms = 900, 30
    held = [np.flatnonzero(rng.random(n) < p) for p in rng.choice([0.002, 0.02, 0.3, 1.0], n_terms)]
    # many equal impacts, and some that rise with the document
    impacts = [rng.integers(1, [3, 1000, 10**6][t % 3], len(d)) if t % 4 else 1 + d for t, d in enumerate(held)]
    treaps = lexical.Treaps(np.concatenate([np.full(len(d), t) for t, d in enumerate(held)]), np.concatenate(held), np.concatenate(impacts))
    asked = [{int(t): int(rng.integers(0, 9000)) for t in rng.choice(n_terms + 5, rng.integers(0, 12), replace=False)} for _ in range(20)]
    for k in (1, 7, 20, 2000):
        items, docs, scores, _ = treaps.top(asked, k, seeds=8)
        for j, own in enumerate(asked):
            full = np.zeros(n, np.int64)
            for t, w in own.items():
                if t < n_terms:
                    full[held[t]] += w * impacts[t]
            want = np.lexsort([np.arange(n), -full])[:k]
            want = want[full[want] > 0]
            assert docs[items == j].tolist() == want.tolist() and scores[items == j].tolist() == full[want].tolist()


def test_few_documents_are_scored():
    rng = np.random.default_rng(9)
    n = 20000
    held = [np.flatnonzero(rng.random(n) < p) for p in (0.001, 0.002, 0.01, 0.2, 0.3, 0.5)]
    impacts = [rng.integers(1, 10**6, len(d)) for d in held]
    treaps = lexical.Treaps(np.concatenate([np.full(len(d), t) for t, d in enumerate(held)]), np.concatenate(held), np.concatenate(impacts))
    *_, tried = treaps.top([{0: 7000, 1: 6500, 2: 4600, 3: 1600, 4: 1200, 5: 690}], 20)
    assert tried < n / 20


def test_odd_rows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ﬁ", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200])))) for i in rng.sample(range(10**6), 400)]
    docs += [(None, "w1 w2 Ünï"), (5, None), (6, ""), (7, "!?"), (8, "w3 " * 30000), *docs[:30], *[(1000 + i, "W1 w2, w3!") for i in range(60)], (2**62, "w1"), (-4, "w1 w2")]
    items = [(1, "w1 W2 w3"), (2, None), (3, ""), (4, "nowhere here"), (5, " ".join(words) + " w1 w1"), (1, "w1 W2 w3"), (None, "x1 ünï Ünï ﬁ")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int").repartition(3)
    q = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, term string")
    want = collections.Counter(plain_search(docs, items, 20))
    for options in ({}, {"segment_docs": 50}, {"segment_postings": 300, "block_terms": 10}):
        got = lexical.search(d, q, **options).collect()
        assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d.where("text is null"), q).count() == 0


def test_against_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = con.execute(lexical.SEARCH_SQL).fetchall()
    got = lexical.op12_search(spark, tiny).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
