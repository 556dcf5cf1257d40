"""Readers, writers, the log as a stream; odd input of the text and page functions."""

import datetime

from pyspark.sql import functions as F

from docloom.functions import code, settings, text
from docloom.operators import audit, drafts, pages, publish
from docloom.sources import files
from docloom.streaming import logs


def test_source_files(spark, tmp_path):
    for path, content in (("src/A.java", "class A {}"), ("src/test/B.java", "x"), ("app/x_controller.rb", "y"), ("app/x.rb", "z"), (".hidden/C.java", "h"), ("D.JAVA", "u")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    got = {r.relative_path: (r.language, r.content) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"src/A.java": ("java", "class A {}"), "app/x_controller.rb": ("ruby", "y")}
    assert {r.relative_path for r in files.source_files(spark, str(tmp_path), (".rb",)).collect()} == {"app/x_controller.rb", "app/x.rb"}


def test_pages_and_reports(spark, tmp_path):
    rows = [("a", "---\nkey: k\ntitle: T\nslug: a\n---\nold", 1), ("a", "---\nkey: k\ntitle: 'T two'\nslug: a\n---\nnew", 2), ("b", "no frontmatter", 1)]
    files.write_pages(spark.createDataFrame(rows, "slug string, page string, seq int"), str(tmp_path / "out"))
    got = files.read_pages(spark, str(tmp_path / "out")).collect()
    assert [(r.page_key, r.page_title, r.page.endswith("new")) for r in got] == [("k", "T two", True)]
    at = files.write_report(spark.range(3), str(tmp_path / "report"), "2026-01-01T10:00:00.5Z")
    assert at.endswith("2026-01-01T10-00-00-5Z") and files.read_report(spark, at).count() == 3


def test_log_lines_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text('{"operation":"generate","page":"p","outcome":"created","content_hash":"h","timestamp":"2026-01-01T00:00:00Z","commit":"1"}\n\nbroken\n{"operation":"generate","page":"p","outcome":"updated","content_hash":"i","timestamp":"2026-01-02T00:00:00Z","commit":"2"}\n')
    rows = files.read_log(spark, str(log)).orderBy("seq").collect()
    assert len(rows) == 3 and rows[1].raw == "broken"
    stream = logs.follow(spark, str(log))
    run = logs.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.page, r.commit) for r in spark.table("latest").collect()] == [("p", "2")]
    run = logs.counts(logs.follow(spark, str(log))).writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r.operation, r.outcome, r.n) for r in spark.table("counted").collect()} == {("generate", "created", 1), ("generate", "updated", 1)}


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_slugs_and_versions(spark):
    for raw, want in (("Register a New Pet Owner", "register-a-new-pet-owner"), ("It's a 'test' (really)!", "its-a-test-really"), ("---hello---", "hello"), ("", "")):
        assert one(spark, text.slugify(F.col("s")), s=raw) == want
    assert one(spark, text.slug_matches(F.col("a"), F.col("b")), a="UserController.register", b="registering-a-user") and one(spark, text.slug_matches(F.col("a"), F.col("b")), a="XMLParser", b="xmlparser")
    assert one(spark, text.version_at_most(F.col("a"), F.col("b")), a="v10", b="v9") is False
    assert one(spark, text.round_half_up(F.col("n") / 100), n=250) == 2.5 and one(spark, F.floor(F.lit(-2.5) + 0.5)) == -2


def test_draft_rules(spark):
    kind = "struct<step:string,footnote:string>"
    schema = f"conv_id long, turn int, title string, summary string, actor string, trigger string, preconditions array<string>, main_flow array<{kind}>, alternate_flows array<struct<label:string,description:string>>, postconditions array<string>, business_rules array<struct<rule:string,footnote:string>>, test_scenarios array<struct<label:string,gwt:string>>, related array<struct<slug:string,title:string>>, tags array<string>, confidence string, confidence_reason string"
    good = ("T", "S", "A", "G", ["p"], [("a", None), ("b", "n")], [("l", "d")], ["post"], [("r", None)], [("l", "g")], [("s", "t")], ["orders", "api"], "high", "why")
    bad = (None, " \n", "\u00a0", "", None, None, None, None, None, None, None, ["SQL", "x", "yaml"], "sure", "a \u2014 b")
    df = spark.createDataFrame([(1, 1, *good), (2, 1, *bad), (3, 1, *good[:5], [None, ("", None), ("x", None)], *good[6:])], schema)
    got = {}
    for r in drafts.issues(df).collect():
        got.setdefault(r.conv_id, []).append((r.field, r.severity, r.message))
    assert set(got) == {2, 3} and [g[0] for g in got[3]] == ["main_flow"]
    assert sorted(g[0] for g in got[2]) == sorted(["title", "summary", "actor", "trigger", "main_flow", "postconditions", "tags", "structure", "confidence"]) and ("tags", "warn", "jargon: SQL, yaml") in got[2] and ("main_flow", "error", "steps: 0") in got[2]
    assert not [r for r in drafts.issues(df, jargon=()).collect() if r.field == "tags"]
    hints = {r.conv_id: r.hint for r in drafts.retry_hints(df, drafts.issues(df)).collect()}
    assert hints[1] == "" and hints[3] == drafts.HINT + "\n\n- main_flow: a step is empty"


def test_chain_of_lines(spark):
    log = audit.chain(spark.createDataFrame([(0, i, f'p"\\{i}\n', None if i == 2 else "h") for i in range(4)], "log int, seq int, page string, content_hash string"))
    lines = [r.raw for r in log.select("seq", audit.lines(log, ["page", "content_hash"]).alias("raw")).orderBy("seq").collect()]

    def reasons(rows, **options):
        df = spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "log int, seq int, raw string")
        return [(r.valid, r.reasons) for r in audit.verify(df, width=2, **options).orderBy("seq").collect()]

    assert reasons(lines) == [(True, [])] * 4
    assert reasons([lines[0], lines[1][:20], *lines[2:]]) == [(True, []), (False, ["not valid JSON"]), (True, ["chain break"]), (True, [])]
    assert reasons([*lines[:3], lines[3].replace('p\\"', "q")])[3] == (False, ["tampered"]) and reasons(lines[1:])[0] == (True, ["chain break"])
    assert reasons(lines[:1], require_signed=True) == [(True, ["unsigned"])]
    df = spark.createDataFrame([('{"b":1,"a":{"d":null,"c":"x\\"y"}}',), ("[1]",), ("",)], "raw string")
    assert [r.c for r in df.select(audit.canonical_json(F.col("raw")).alias("c")).collect()] == ['{"a":{"c":"x\\"y","d":null},"b":1}', None, None]


def test_pages_of_odd_shapes(spark):
    assert one(spark, pages.with_footnotes(F.col("p")), p="no notes") == "no notes" and one(spark, pages.with_footnotes(F.col("p")), p="") == ""
    assert one(spark, pages.with_footnotes(F.col("p")), p="x[^bravo] y[^alpha] z[^bravo]\n[^alpha]: A\n[^bravo]: B") == "x[1] y[2] z[1]\n\n## Footnotes\n\n1. B\n2. A\n"
    assert one(spark, publish.merged(F.lit("new\n"), F.col("p")), p="<!-- managed:start -->a<!-- managed:end -->\n  mine \n") == "new\n\n  mine \n"
    assert one(spark, text.flow_words(F.col("p")), p="##  Main flow \r\n\r\na b\r\n## Next\r\nc") == 2 and one(spark, text.flow_words(F.col("p")), p="none") == 0
    assert one(spark, pages.quoted_scalar(F.col("p")), p="it's: x") == "'it''s: x'" and one(spark, pages.quoted_scalar(F.col("p")), p="plain text") == "plain text"
    assert one(spark, settings.without_dashes(F.col("p")), p="") == "" and one(spark, code.executable_lines(F.col("p")), p="") == 0


def test_retry_after(spark):
    now = F.lit(datetime.datetime(2026, 10, 21, 7, 28, 0))
    for header, want in (("120", 120_000), ("-5", None), ("", None), ("Wed, 21 Oct 2026 07:28:03 GMT", 3_000)):
        assert one(spark, settings.retry_after_ms(F.col("h"), now), h=header) == want
