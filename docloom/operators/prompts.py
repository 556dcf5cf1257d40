"""What a writer is asked, and drafts without one: hints, prompts, deterministic drafts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import draft_title

#: The version of the prompt, stamped on every entry.
PROMPT_VERSION = "v24"
#: Lines of a file that goes into a prompt whole, at most.
WHOLE_FILE = 3_000
#: Calls that a prompt and a draft name at most.
PROMPT_CALLS, DRAFT_CALLS = 15, 5
# Labels of code fences.
FENCES = {"cfml": "coldfusion", "python": "python", "ruby": "ruby", "unknown": "unknown"}


def stamped(log: DataFrame) -> DataFrame:
    return log.withColumn("prompt_version", F.lit(PROMPT_VERSION))


def hints_text(hints: Column) -> Column:
    """A candidate's hints (annotations, http_route, parameters, callees, database_tables, notes) as lines; empty ones are left out."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    listed = lambda label, c: F.when(some(c), F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    route = hints["http_route"]
    path = F.coalesce(F.nullif(route["path"], F.lit("")), F.lit("(see source)"))
    parameters = F.transform(hints["parameters"], lambda p: F.concat(p["name"], F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(":"), p["type"])).otherwise("")))
    return F.concat_ws(
        "\n", listed("Annotations", hints["annotations"]), F.when(route.isNotNull(), F.concat(F.lit("HTTP route: "), route["method"], F.lit(" "), path)), listed("Parameters", parameters),
        listed("Calls", F.slice(hints["callees"], 1, PROMPT_CALLS)), listed("DB tables touched", hints["database_tables"]), F.when(some(hints["notes"]), F.concat(F.lit("Notes:\n- "), F.array_join(hints["notes"], "\n- "))),
    )


def fence_label(language: Column) -> Column:
    out = F.lit("java")
    for name, label in FENCES.items():
        out = F.when(language == name, label).otherwise(out)
    return out


def prompts(candidates: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """``candidates`` with ``prompt``; ``files`` (relative_path, content) gives the whole file where it is not too long and more than the candidate."""
    whole = files.select(F.col("relative_path").alias("p"), "content")
    both = candidates.join(whole, candidates["relative_path"] == F.col("p"), "left")
    lines = F.size(F.split("content", "\n"))
    spans = (F.col("line_start") == 1) & (F.col("line_end") >= lines - 1)
    fence = fence_label(F.col("language"))
    code = lambda c: F.concat(F.lit("```"), fence, F.lit("\n"), c, F.lit("\n```"))
    place = F.concat(F.lit("lines "), "line_start", F.lit("-"), "line_end")
    hints = F.nullif(hints_text(F.col("hints")), F.lit(""))
    text = F.concat_ws(
        "\n", F.lit(f"# Project {project}"), F.concat(F.lit("File: "), "relative_path"), F.concat(F.lit("Part: "), "name", F.lit(", "), place), F.concat(F.lit("Language: "), "language", F.lit(", kind: "), "kind"),
        F.concat(F.lit("# Hints of the parser\n"), hints), F.when(~spans & (lines <= WHOLE_FILE), F.concat(F.lit("# The whole file, for context only\n"), code(F.col("content")))), F.concat(F.lit("# The part to describe\n"), code(F.col("source"))), F.lit("Answer with one JSON object about this part alone."),
    )
    return both.select(*candidates.columns, text.alias("prompt"))


def retry_prompt(prompt: Column, hint: Column) -> Column:
    """A prompt with what was wrong with the first answer behind a rule."""
    return F.when(F.coalesce(hint, F.lit("")) == "", prompt).otherwise(F.concat(prompt, F.lit("\n\n---\n\n"), hint))


def parsed_answer(answer: Column) -> Column:
    """(json, error) of an answer: code fences around it dropped; the error shows its first 200 characters."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"\A\s+|\s+\z", ""), r"(?i)\A```(?:json)?\s*", ""), r"```\s*\z", "")
    good = F.try_parse_json(text).isNotNull()
    return F.struct(F.when(good, text).alias("json"), F.when(~good, F.concat(F.lit("no valid JSON: "), F.substring(text, 1, 200))).alias("error"))


def drafts(candidates: DataFrame, project: str) -> DataFrame:
    """``candidates`` with the fields of a deterministic draft, made without a writer: it says what was found and that it is a draft."""
    hints, code = F.col("hints"), lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    controller, tag = F.col("kind") == "controller-method", F.col("kind") == "cf-tag-function"
    step = lambda text: F.struct(text.alias("step"), F.lit(None).cast("string").alias("footnote"))
    rule = lambda label, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.struct(F.concat(F.lit(label), F.array_join(c, ", "), F.lit(" (raw extraction).")).alias("rule"), F.lit(None).cast("string").alias("footnote")))
    calls = F.coalesce(F.transform(F.slice(hints["callees"], 1, DRAFT_CALLS), lambda c: step(F.concat(F.lit("The system calls "), code(c), F.lit(".")))), F.array().cast("array<struct<step:string,footnote:string>>"))
    enter = step(F.concat(F.lit("The system enters "), code(F.col("name")), F.lit(" in "), "relative_path", F.lit(" (lines "), "line_start", F.lit("-"), "line_end", F.lit(").")))
    return candidates.select(
        *candidates.columns, draft_title(F.col("name")).alias("title"), F.when(controller, "A signed-in user or a visitor").otherwise("An internal caller").alias("actor"),
        F.lit("A draft made without a writer.").alias("summary"),
        F.when(controller, "A user sends a request to the endpoint.").when(tag, "A caller invokes this function from the application layer.").otherwise("A caller invokes this function.").alias("trigger"),
        F.array(F.concat(F.lit("The caller may invoke "), code(F.col("name")), F.lit(".")), F.lit("The application is running.")).alias("preconditions"),
        F.concat(F.array(enter), calls, F.array(step(F.lit("Control returns to the caller.")))).alias("main_flow"),
        F.array(F.struct(F.lit("Not described").alias("label"), F.lit("A draft knows no alternate flows.").alias("description"))).alias("alternate_flows"), F.array(F.lit("What the function did.")).alias("postconditions"),
        F.array_compact(F.array(rule("Touches database tables: ", hints["database_tables"]), rule("Annotations present: ", hints["annotations"]))).alias("business_rules"),
        F.array(F.struct(F.lit("Happy path").alias("label"), F.lit("Given its preconditions, when it is invoked, then it returns.").alias("gwt"))).alias("test_scenarios"), F.array().cast("array<struct<slug:string,title:string>>").alias("related"),
        F.array("language", "kind", F.when(controller, "controller").otherwise("library"), F.lit("mock-output")).alias("tags"), F.lit("low").alias("confidence"), F.lit(f"Made without a writer. Project: {project}.").alias("confidence_reason"),
    )


def drafted(candidates: DataFrame, write, project: str) -> DataFrame:
    """``candidates`` with ``answer``: what ``write`` (a function of a list of prompts) says to their prompts, a batch at a time where the rows are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("prompt")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(write(batch.column(at).to_pylist()), pa.string())], names=[*batch.schema.names, "answer"])

    return candidates.mapInArrow(run, T.StructType([*candidates.schema.fields, T.StructField("answer", T.StringType())]))


def listing(candidates: DataFrame) -> DataFrame:
    """(relative_path, line_start, name, text): candidates as lines; the column of languages is as wide as the longest one."""
    width = candidates.agg(F.greatest(F.lit(4), F.max(F.char_length("language"))).alias("width"))
    hints, route = F.col("hints"), F.col("hints.http_route")
    shown = F.when(F.coalesce(route["method"], F.lit("")) != "", F.concat(F.lit(" ["), route["method"], F.when(F.coalesce(route["path"], F.lit("")) != "", F.concat(F.lit(" "), route["path"])).otherwise(""), F.lit("]"))).otherwise("")
    more = lambda label, c, sign: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"       {label}: "), F.array_join(c, sign)))
    text = F.concat_ws(
        "\n", F.concat(F.lit("  "), F.rpad("language", F.col("width"), F.lit(" ")), F.lit(" "), F.rpad("kind", 20, " "), F.lit(" "), "name", shown), F.concat(F.lit("       "), "relative_path", F.lit(":"), "line_start", F.lit("-"), "line_end"),
        more("tables", hints["database_tables"], ", "), more("notes", hints["notes"], "; "),
    )
    return candidates.join(F.broadcast(width)).select("relative_path", "line_start", "name", text.alias("text"))  # one row


def entries(results: DataFrame) -> DataFrame:
    """Log entries of generated pages (seq, page, retry, error, kept, change, commit, timestamp, content): a retry's entry before the page's own.

    ``retry`` is recovered, no_help or null; ``error`` a message or null; ``kept`` whether
    its confidence is enough; ``change`` created, updated or unchanged.
    """
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256))
    first = F.when(F.col("retry").isNotNull(), F.struct(F.lit(0).alias("step"), F.lit("retried").alias("operation"), F.col("retry").alias("outcome"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("reason")))
    outcome = F.when(F.col("error").isNotNull(), "error").when(~F.col("kept"), "skipped").otherwise(F.col("change"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("kept"), "below_min_confidence")
    own = F.struct(F.lit(1).alias("step"), F.lit("generate").alias("operation"), outcome.alias("outcome"), F.when(reason.isNull(), hashed).alias("content_hash"), reason.alias("reason"))
    made = results.select("seq", "page", "commit", "timestamp", F.explode(F.array_compact(F.array(first, own))).alias("e"))
    return stamped(made.select("seq", "page", "commit", "timestamp", "e.*"))
