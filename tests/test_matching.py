"""Containment joins and collated ranks against plain Python."""

import random

from pyspark.sql import functions as F

from docloom.functions.text import slug_matches
from docloom.operators import matching


def test_holding_is_containment(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcü") for _ in range(n))
    needles = [word(rng.randrange(0, 7)) for _ in range(150)] + [None, "", "zz", "aaaaaaaaaaaaaaaaaaaa"]
    stacks = [word(rng.randrange(0, 12)) for _ in range(200)] + [None, "", "a", "a" * 5000]
    got = matching.holding(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(s,) for s in stacks], "stack string"))
    want = {(n, s) for n in needles for s in stacks if n and s is not None and n in s}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 1000
    assert matching.holding(spark.createDataFrame([], "needle string"), spark.createDataFrame([("a",)], "stack string")).count() == 0


def test_slug_pairs(spark):
    names = ["UserController.register", "XMLParser", "a.b.loadAll", "x.", "", None, "sync_items", "ÄÖ", "Z9"]
    slugs = ["registering-a-user", "xmlparser", "load-all-items", "", "-dash", "sync", "z9", "a", None, "items-sync_items"]
    n, s = spark.createDataFrame([(x,) for x in names * 2], "name string"), spark.createDataFrame([(x,) for x in slugs * 2], "slug string")
    pairs = matching.slug_pairs(n, s)
    want = n.distinct().crossJoin(s.distinct()).where(slug_matches(F.col("name"), F.col("slug")))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_slugs_are_made_once(spark):
    words = [f"Item {i % 50} and more" for i in range(300)]
    slugs = spark.createDataFrame([(w,) for w in words], "t string").select(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "-").alias("slug"))
    pairs = matching.slug_pairs(spark.createDataFrame([("x.item",), ("More",)], "name string"), slugs)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "RDDScan" not in plan and pairs.count() == 100


def test_ranks_follow_the_collation(spark):
    rows = [("f", t) for t in ("b", "B", "a", "Ä", "z", "A", "ä", "-a", "a b", "ab", "a")] + [("g", None), ("g", "x")] + [("hot", f"T{i % 700}") for i in range(3000)] + [(None, "n")]
    df = spark.createDataFrame(rows, "folder string, title string")
    got = matching.ranked_titles(df.repartition(5), F.col("folder")).collect()
    f = sorted((r["rank"], r.title) for r in got if r.folder == "f")
    assert f == list(enumerate(["-a", "a", "a", "A", "ä", "Ä", "a b", "ab", "b", "B", "z"], 1))
    hot = sorted((r["rank"], r.title) for r in got if r.folder == "hot")
    assert [r for r, _ in hot] == list(range(1, 3001)) and [t for _, t in hot] == sorted(t for _, t in hot) and {r.pages for r in got if r.folder == "hot"} == {3000}
    assert {(r["rank"], r.title, r.pages) for r in got if r.folder == "g"} == {(1, None, 2), (2, "x", 2)}
    assert matching.ranked_titles(df.limit(0), F.col("folder")).count() == 0
