"""Claims of pages: what is left of a page after each kind of failure."""

import hashlib

import pytest

from docloom.sources import claims, wiki
from docloom.sources.wiki_folder import FolderServer

BANNER = "<p>managed</p>"


def people(root, n, space="DOCS"):
    """Pages without a key, by title."""
    send, out = FolderServer(str(root)).send, {}
    import json

    for i in range(n):
        reply = send("POST", "/rest/api/content", {}, {"title": f"{space} {i}", "space": {"key": space}, "body": {"storage": {"value": f"own text {i}"}}})
        out[f"{space} {i}"] = json.loads(reply.body)["id"]
    return out


def options(root):
    return {"url": f"folder:{root}", "space": "DOCS", "baseMs": "1"}


def fault(root, kind, *replies):
    (root / "faults").mkdir(parents=True, exist_ok=True)
    for i, r in enumerate(replies):
        (root / "faults" / f"{kind}-{i}").write_text(r)


def pages(spark, root):
    return {r.page_id: r for r in wiki.read_wiki(spark, **options(root)).collect()}


def test_claims(spark, tmp_path):
    ids, far = people(tmp_path, 4), people(tmp_path, 1, "OTHER")
    wiki.publish_to(spark.createDataFrame([("k9", "Ours", "x")], "key string, title string, body string"), **options(tmp_path))
    ours = next(r.page_id for r in pages(spark, tmp_path).values() if r.key == "k9")
    rows = [(ids["DOCS 0"], "k0"), (ids["DOCS 1"], "k1"), (ids["DOCS 1"], "k1"), (ours, "k2"), (far["OTHER 0"], "k3"), ("nowhere", "k4"), (None, "k5"), (ids["DOCS 2"], None), (ids["DOCS 2"], "k1")]
    asked = spark.createDataFrame(rows, "page_id string, key string")
    got = {(r.page_id, r.key): r for r in claims.claim(asked, BANNER, **options(tmp_path)).collect()}
    states = {k: (r.state, r.operation, r.outcome) for k, r in got.items()}
    first, second = sorted([ids["DOCS 1"], ids["DOCS 2"]])
    assert states == {(ids["DOCS 0"], "k0"): ("claimed", "claim", "updated"), (first, "k1"): ("claimed", "claim", "updated"), (second, "k1"): ("rejected", "claim", "error"), (ours, "k2"): ("rejected", "claim", "error"), (far["OTHER 0"], "k3"): ("rejected", "claim", "error"), ("nowhere", "k4"): ("rejected", "claim", "error")}
    assert got[ours, "k2"].message == "already managed: k9" and got[far["OTHER 0"], "k3"].message == "in another space: OTHER" and "404" in got["nowhere", "k4"].message and got["nowhere", "k4"].content_hash is None
    now = pages(spark, tmp_path)[ids["DOCS 0"]]
    assert now.key == "k0" and now.labels == ["docloom"] and now.version == 2 and now.body.startswith(BANNER) and now.body.endswith("own text 0") and "id=k0 -->" in now.body
    assert got[ids["DOCS 0"], "k0"].content_hash == "sha256:" + hashlib.sha256(b"own text 0").hexdigest()
    assert claims.claim(asked.limit(0), BANNER, **options(tmp_path)).count() == 0


@pytest.mark.parametrize(
    ("faults", "state", "operation", "body", "version"),
    [
        ({"update": ["503"]}, "failed", "claim", "own text 0", 1),
        ({"label": ["500"]}, "rolled back", "claim", "own text 0", 3),
        ({"label": ["500"], "update": []}, "rolled back", "claim", "own text 0", 3),
        ({"label": ["429 0", "429"]}, "claimed", "claim", None, 2),
    ],
)
def test_failures(spark, tmp_path, faults, state, operation, body, version):
    ids = people(tmp_path, 1)
    for kind, replies in faults.items():
        fault(tmp_path, kind, *replies)
    asked = spark.createDataFrame([(ids["DOCS 0"], "k0")], "page_id string, key string")
    (got,) = claims.claim(asked, BANNER, placement="above", **options(tmp_path)).collect()
    now = pages(spark, tmp_path)[ids["DOCS 0"]]
    assert (got.state, got.operation) == (state, operation) and now.version == version and (body is None or now.body == body and now.key is None)


def test_failed_restore_is_told_and_mended(tmp_path):
    """The restore fails too: the page stays in between; a run that finds it so goes on."""
    ids = people(tmp_path, 1)
    link = wiki.connected(options(tmp_path))
    row = {"page_id": ids["DOCS 0"], "key": "k0", "body": "own text 0", "new_body": "new"}
    fault(tmp_path, "label", "500")
    plain, calls = link.update, []

    def update(*args):
        calls.append(args)
        if len(calls) == 2:
            fault(tmp_path, "update", "502")
        return plain(*args)

    link.update = update
    state, message = claims.take_over(link, row, "docloom")
    assert state == "aborted" and message == "label failed: 500 fault / update failed: 502 fault" and link.version(row["page_id"]).body == "new"
    assert claims.take_over(link, row, "docloom") == ("claimed", None) and link.version(row["page_id"]).key == "k0" and link.version(row["page_id"]).version == 2
    link.update(row["page_id"], 2, "t", "edited by hand")
    assert claims.take_over(link, row, "docloom") == ("failed", "the page was changed meanwhile")


def test_pages_are_read_once(spark, tmp_path, monkeypatch):
    ids, seen, read = people(tmp_path, 9), spark.sparkContext.accumulator(0), claims.read_pages

    def counted(asked, options):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return read(asked, options).mapInArrow(run, claims.PLAN)

    monkeypatch.setattr(claims, "read_pages", counted)
    got = claims.claim(spark.createDataFrame([(p, f"k{i}") for i, p in enumerate(ids.values())], "page_id string, key string"), BANNER, **options(tmp_path))
    assert {r.state for r in got.collect()} == {"claimed"} and seen.value == 9
