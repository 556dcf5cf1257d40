"""Rules for drafts: issues in long form, retry hints, and which of two drafts is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 12
# Tags that name an implementation.
JARGON = tuple(
    """
    ssl tls http https tcp udp ftp smtp pop3 imap
    json jsonb xml yaml csv utf-8 base64 hex url-encoded query-string
    sha256 md5 uuid
    ses
    jwt oauth csrf cors
    sql nosql orm crud
    """.split()
)
LEVELS = ("high", "medium", "low")


def blank(c: Column) -> Column:
    return F.coalesce(~F.rlike(c, F.lit(r"(?U)\S")), F.lit(True))


def texts(draft: DataFrame) -> Column:
    """All 13 text fields of a draft in one text, nulls left out."""
    inner = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[f] for f in fields))), " ")
    return F.concat_ws(
        " ", "title", "summary", "actor", "trigger", F.array_join("preconditions", " "), inner("main_flow", "step", "footnote"), inner("alternate_flows", "label", "description"), F.array_join("postconditions", " "),
        inner("business_rules", "rule", "footnote"), inner("test_scenarios", "label", "gwt"), inner("related", "title"), F.array_join("tags", " "), "confidence_reason",
    )


def issues(drafts: DataFrame, max_steps: int = MAX_STEPS, jargon: tuple[str, ...] = JARGON) -> DataFrame:
    """(conv_id, turn, seq, field, severity, message): the rules that a draft breaks, in order. One pass, no shuffle.

    A null list counts as an empty one; without ``jargon`` that rule is off.
    """
    none = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    flow, n = F.col("main_flow"), F.greatest(none("main_flow"), F.lit(0))
    tags = F.coalesce(F.filter("tags", lambda t: F.lower(t).isin(*jargon) if jargon else F.lit(False)), F.array().cast("array<string>"))
    rules = [
        ("title", "error", blank(F.col("title")), F.lit("no title")),
        ("summary", "error", blank(F.col("summary")), F.lit("no summary")),
        ("actor", "error", blank(F.col("actor")), F.lit("no actor")),
        ("trigger", "warn", blank(F.col("trigger")), F.lit("no trigger")),
        ("main_flow", "error", n < 2, F.concat(F.lit("steps: "), n)),
        ("main_flow", "error", F.coalesce(F.exists(flow, lambda s: blank(s["step"])), F.lit(False)), F.lit("a step is empty")),
        ("main_flow", "warn", n > max_steps, F.concat(F.lit("too many steps: "), n)),
        ("postconditions", "warn", none("postconditions") <= 0, F.lit("no postcondition")),
        ("tags", "warn", F.size(tags) > 0, F.concat(F.lit("jargon: "), F.array_join(tags, ", "))),
        ("structure", "error", F.contains(texts(drafts), F.lit("\u2014")), F.lit("an em dash")),
        ("confidence", "error", (F.coalesce("confidence", F.lit("")) != "") & ~F.col("confidence").isin(*LEVELS), F.concat(F.lit("confidence: "), "confidence")),
    ]
    made = F.array(*(F.when(broken, F.struct(F.lit(i).cast("long").alias("seq"), F.lit(field).alias("field"), F.lit(level).alias("severity"), message.alias("message"))) for i, (field, level, broken, message) in enumerate(rules)))
    return drafts.select("conv_id", "turn", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("conv_id", "turn", "i.*")


#: The first line of a retry's prompt.
HINT = "These parts of the last answer were wrong; mend them and answer again:"


def has_errors(found: DataFrame) -> DataFrame:
    """(conv_id, turn, errors): the count of errors of each draft that has issues."""
    return found.groupBy("conv_id", "turn").agg(F.count_if(F.col("severity") == "error").alias("errors"))


def retry_hints(drafts: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, turn, hint): below a first line the errors of a draft as a list, or all issues if none is an error; empty without issues. A draft has 11 at most."""
    listed = found.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "field", "severity", "message"))).alias("all"))
    errors = F.filter("all", lambda i: i["severity"] == "error")
    told = F.when(F.size(errors) > 0, errors).otherwise(F.col("all"))
    hint = F.concat(F.lit(HINT + "\n\n"), F.array_join(F.transform(told, lambda i: F.concat(F.lit("- "), i["field"], F.lit(": "), i["message"])), "\n"))
    return drafts.select("conv_id", "turn").join(listed, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(hint, F.lit("")).alias("hint"))


# Beginnings of the notes that a page must mention, in order, and words of which one is enough.
_TRANSACTION = ("transaction", "atomic", "rollback", "all-or-nothing", "succeed or fail", "all or nothing")
NOTE_WORDS = (
    ("Sends email", ("email", "mail", "notification", "notify", "inbox")),
    ("Makes outbound HTTP request", ("http", "external service", "external api", "outbound", "api call", "third-party", "request to", "remote", "dependency", "upstream", "external", "calls an")),
    ("Enqueues background job", ("background", "asynchronous", "async", "queue", "later", "deferred", "scheduled", "out of band", "trigger")),
    ("Publishes Spring application event", ("event", "publish", "subscriber", "listener")),
    ("Sends message to broker", ("broker", "kafka", "rabbitmq", "rabbit", "jms", "amqp", "message queue", "topic", "service bus", "masstransit")),
    ("Executes database operations inside a transaction", _TRANSACTION),
    ("Executes within a database transaction", _TRANSACTION),
    ("Calls stored procedure", ("stored procedure", "stored-procedure", "sproc", "stored proc")),
    ("Writes to file system", ("file", "disk", "filesystem", "upload", "saves", "persisted to", "writes to", "export", "log", "report", "download")),
    ("Mutates application cache", ("cache", "invalidate", "stale", "evict", "clear", "flush", "removeall", "delete_matched", "delete_pattern")),
    ("Executes external process", ("process", "command", "shell", "external program", "binary", "spawns", "invoke")),
)


def unmentioned_notes(drafts: DataFrame, notes: Column, rules=NOTE_WORDS) -> DataFrame:
    """(conv_id, turn, note): the notes of a draft (array column) of a known kind of which its flow, rules and conditions have no word. No shuffle."""
    inner = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(F.coalesce(x[f], F.lit("")) for f in fields))), " ")
    said = F.lower(F.concat_ws(" ", inner("business_rules", "rule", "footnote"), inner("main_flow", "step", "footnote"), F.array_join("postconditions", " "), inner("alternate_flows", "label", "description")))
    rows = drafts.select("conv_id", "turn", said.alias("said"), F.explode(notes).alias("note"))
    words = F.lit(None).cast("array<string>")
    for start, some in reversed(rules):  # the first beginning that fits decides
        words = F.when(F.startswith("note", F.lit(start)), F.array(*(F.lit(w) for w in some))).otherwise(words)
    return rows.where(words.isNotNull() & ~F.exists(words, lambda w: F.contains(F.col("said"), w))).select("conv_id", "turn", "note")


def with_defaults(drafts: DataFrame) -> DataFrame:
    """``drafts`` (with language and kind of their candidate) with every missing field filled."""
    empty = {c: F.array().cast(drafts.schema[c].dataType) for c in ("preconditions", "main_flow", "alternate_flows", "postconditions", "business_rules", "test_scenarios", "related")}
    filled = {"actor": "Unknown caller", "summary": "(no summary produced)", "trigger": "", "confidence": "low", "confidence_reason": ""}
    return drafts.withColumns(
        {"actor_detail": F.coalesce("actor", F.lit(""))} | {c: F.coalesce(c, F.lit(v)) for c, v in filled.items()} | {c: F.coalesce(c, v) for c, v in empty.items()} | {"tags": F.coalesce("tags", F.array("language", "kind"))}
    )


def retry_decisions(drafts: DataFrame) -> DataFrame:
    """(conv_id, first_errors, second_errors, outcome, kept_turn) of conversations whose first draft has errors and has a second."""
    errors = issues(drafts).where("severity = 'error'").groupBy("conv_id", "turn").agg(F.count("*").alias("errors"))
    every = drafts.select("conv_id", "turn").join(errors, ["conv_id", "turn"], "left").select("conv_id", F.struct("turn", F.coalesce("errors", F.lit(0)).alias("errors")).alias("d"))
    first = every.groupBy("conv_id").agg(F.min("d").alias("first"))
    second = every.join(first, "conv_id").where("d.turn > first.turn").groupBy("conv_id").agg(F.min("d").alias("second"))
    both, better = first.join(second, "conv_id").where("first.errors > 0"), F.col("second.errors") < F.col("first.errors")
    return both.select("conv_id", F.col("first.errors").alias("first_errors"), F.col("second.errors").alias("second_errors"), F.when(better, "recovered").otherwise("no_help").alias("outcome"), F.when(better, F.col("second.turn")).otherwise(F.col("first.turn")).alias("kept_turn"))
