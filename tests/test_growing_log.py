"""A log that grows: micro-batches, repeats and restarts against the chain of the whole."""

import json
import os

from pyspark.sql import functions as F

from docloom.operators import audit
from docloom.streaming import logs

SCHEMA = "log long, seq long, page string, outcome string, score double"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    part = folder / f".{name}"
    part.write_text("".join(json.dumps(dict(zip(("log", "seq", "page", "outcome", "score"), r, strict=True))) + "\n" for r in rows))
    # files come by the time of their change: one a minute
    at = 1_700_000_000 + 60 * int(name[0])
    os.utime(part, (at, at))
    part.rename(folder / name)


def run(spark, folder, out, checkpoint, files=1):
    entries = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(str(folder))
    query = logs.append_to(logs.appended(entries, ["page", "outcome", "score"]), str(out), str(checkpoint))
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return query


def test_batches_and_restart(spark, tmp_path):
    rows = [(i % 3, i, f"page-{i}", "created" if i % 2 else None, i / 8) for i in range(60)]
    inbox, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    put(inbox, "0.json", rows[:25][::-1])
    put(inbox, "1.json", rows[25:40])
    run(spark, inbox, out, checkpoint)  # two micro-batches
    put(inbox, "2.json", rows[10:40])  # a repeat of what is there
    put(inbox, "3.json", [*rows[38:60], (None, 7, "lost", None, 0.0)])
    put(inbox, "4.json", [(9, 5, "page-x", "new log", 1e21), (9, 6, "line\nbreak   \u001f", None, None)])
    run(spark, inbox, out, checkpoint)  # another query, from the checkpoint
    got = spark.read.schema("log long, seq long, raw string").json(str(out))
    whole = spark.createDataFrame([*rows, (9, 5, "page-x", "new log", 1e21), (9, 6, "line\nbreak   \u001f", None, None)], SCHEMA)
    want = {(r.log, r.seq): (r.prev_hash, r.entry_hash) for r in audit.chain(whole, fields=["page", "outcome", "score"]).collect()}
    assert {(r.log, r.seq): (json.loads(r.raw)["prev_hash"], json.loads(r.raw)["entry_hash"]) for r in got.collect()} == want and got.count() == len(want)
    # what was written verifies, each log from its start on
    checked = audit.verify(got).collect()
    assert all(r.valid and r.reasons == [] for r in checked) and len(checked) == 62
    # the batch side goes on where a log ends
    ends = got.groupBy("log").agg(F.max_by(F.get_json_object("raw", "$.entry_hash"), "seq").alias("entry_hash"))
    more = spark.createDataFrame([(0, 100, "p", "o", 0.5), (77, 1, "q", None, None)], SCHEMA)
    on = {r.log: r.prev_hash for r in audit.chain(more, fields=["page", "outcome", "score"], after=ends).collect()}
    assert on == {0: want[0, 57][1], 77: None}
