"""Settings and protocols as column expressions: environment files, backends, waiting, git's output, dashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def env_lines(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """(path, line, name, value, problem): the settings of environment files; ``problem`` tells of a line that is none, without its value.

    A byte order mark, ``export`` and comments go; quotes reach to the last one of their
    kind, and what is behind it goes.
    """
    rows = files.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("n", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", "^﻿", ""), r"^\s+|\s+$", "")
    rows = rows.select(key, (F.col("n") + 1).alias("line"), text.alias("text")).where("text != '' and not startswith(text, '#')")
    form = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    good, value = F.rlike("text", F.lit(form)), F.regexp_extract("text", form, 2)
    quoted = F.regexp_extract(value, r"^([\"'])(.*)\1", 2)
    plain = F.trim(F.when(F.instr(value, " #") > 0, F.substring_index(value, " #", 1)).otherwise(value))
    at = F.instr("text", "=")
    problem = F.concat(F.lit("length="), F.char_length("text"), F.lit(", has '='="), F.when(at > 0, F.concat(F.lit("yes@"), at - 1)).otherwise("no"), F.lit(", first-char-code="), F.ascii("text"))
    return rows.select(key, "line", F.when(good, F.regexp_extract("text", form, 1)).alias("name"), F.when(good, F.when(F.rlike(value, F.lit(r"^([\"']).*\1")), quoted).otherwise(plain)).alias("value"), F.when(~good, problem).alias("problem"))


def loaded(settings: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """(path, loaded, skipped): settings that fill a name that is unset or empty in ``present`` (name, value), by its first line, and those that do not."""
    held = present.where("coalesce(value, '') != ''").select(F.col("name").alias("n")).distinct()
    rows = settings.where("name is not null").join(held, F.col("name") == F.col("n"), "left")
    # a name that an earlier line filled is filled
    before = Window.partitionBy(key, "name").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("n").isNotNull() | F.coalesce(F.bool_or(F.col("value") != "").over(before), F.lit(False))
    return rows.withColumn("filled", filled).groupBy(key).agg(F.count_if(~F.col("filled")).alias("loaded"), F.count_if("filled").alias("skipped"))


def retry_after_ms(header: Column, now: Column) -> Column:
    """The wait that a response asks for: seconds, or the time until a date; null if it is neither or past."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    delta = F.unix_millis(date) - F.unix_millis(now)
    return F.when(F.rlike(text, F.lit(r"^\d+$")), text.try_cast("long") * 1000).when(delta >= 0, delta)


def delay_ms(attempt: Column, jitter: Column, asked_ms: Column | None = None, base: int = 500, cap: int = 60_000) -> Column:
    """How long to wait before the next attempt: what was asked for, else a share ``jitter`` of the doubled base; never above the cap."""
    own = F.floor(jitter * F.least(base * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))).cast("long")
    return own if asked_ms is None else F.when(asked_ms.isNotNull(), F.least(asked_ms, F.lit(cap))).otherwise(own)


def backend(mock: Column, override: Column, chosen: Column, deepseek: Column, anthropic: Column, azure: Column) -> Column:
    """(backend, error): which writer is used. ``mock`` first, then the override, the file's choice, and the first one with a key; an unknown override or a chosen one without its key is an error."""
    names = ("deepseek", "anthropic", "azure-openai")
    wish = F.coalesce(F.nullif(override, F.lit("")), F.lit("auto"))
    picked = F.when(wish != "auto", wish).otherwise(F.coalesce(F.nullif(chosen, F.lit("")), F.lit("auto")))
    error = F.when(mock, None).when(~wish.isin("auto", *names), F.concat(F.lit("unknown backend: "), wish)).when((picked == "deepseek") & ~deepseek, "deepseek: no key").when((picked == "azure-openai") & ~azure, "azure-openai: no key or endpoint")
    auto = F.when(deepseek, "deepseek").when(anthropic, "anthropic").when(azure, "azure-openai").otherwise("mock")
    name = F.when(mock, "mock").when(error.isNotNull(), None).when(picked.isin(*names), picked).otherwise(auto)
    return F.struct(name.alias("backend"), error.alias("error"))


def token_parts(total: Column, user: Column) -> Column:
    """(system, user): the tokens of the fixed part of a prompt are the whole less the user's part."""
    return F.struct((total - user).alias("system"), user.alias("user"))


DASH = "—"


def _dashless(text: Column, header: Column) -> Column:
    head, prose = text, text
    for raw, for_head, for_prose in ((f" {DASH} ", ": ", ", "), (f"{DASH} ", ": ", ", "), (f" {DASH}", ":", ","), (DASH, ":", ", ")):
        head, prose = F.replace(head, F.lit(raw), F.lit(for_head)), F.replace(prose, F.lit(raw), F.lit(for_prose))
    return F.when(header, head).otherwise(prose)


def without_dashes(text: Column, markdown: bool = True) -> Column:
    """A text without em dashes: colons in headings, commas in prose; code between back ticks in Markdown is kept."""
    def line(s: Column) -> Column:
        if not markdown:
            return _dashless(s, F.lit(False))
        header = F.rlike(s, F.lit(r"^\s*#"))
        # odd pieces are code; a lone back tick is none
        pieces = F.split(s, r"(?=`[^`]+`)|(?<=`)(?<=`[^`]{1,500}`)")
        return F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit("^`[^`]+`$")), p).otherwise(_dashless(p, header))), "")

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def dash_totals(files: DataFrame, content: str = "content", markdown: bool = True) -> DataFrame:
    """One row: files that change and dashes that go."""
    count = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(DASH), F.lit("")))
    gone = count(F.col(content)) - count(without_dashes(F.col(content), markdown))
    return files.agg(F.count_if(gone > 0).alias("files"), F.coalesce(F.sum(gone), F.lit(0)).cast("long").alias("removed"))


def has_fragment(path: Column, fragments: tuple[str, ...]) -> Column:
    """Whether a path, from its root and with slashes, holds one of the fragments."""
    p = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(p, F.lit(f))
    return out


def git_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(path, staged, unstaged, untracked) of lines of git's short status."""
    code, path = F.substring(line, 1, 2), F.substr(F.col(line), F.lit(4))
    new = code == "??"
    return lines.where(F.char_length(line) > 3).select(path.alias("path"), (~new & (F.substring(code, 1, 1) != " ")).alias("staged"), (~new & (F.substring(code, 2, 1) != " ")).alias("unstaged"), new.alias("untracked"))


def git_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """(sha, date, subject) of lines of a log whose fields a unit separator parts; lines without all three are dropped."""
    parts = F.split(line, "\x1f")
    return lines.where(F.size(parts) >= 3).select(parts[0].alias("sha"), parts[1].alias("date"), parts[2].alias("subject"))


def git_worktrees(lines: DataFrame, line: str = "line", n: str = "n") -> DataFrame:
    """(path, branch, detached) of git's list of work trees: a line ``worktree`` begins one, those below tell of it."""
    at = F.last(F.when(F.startswith(line, F.lit("worktree ")), F.substr(F.col(line), F.lit(10))), ignorenulls=True).over(Window.orderBy(n).rowsBetween(Window.unboundedPreceding, 0))  # one repository's list is short
    rows = lines.withColumn("at", at).where("at is not null")
    branch = F.max(F.when(F.startswith(line, F.lit("branch ")), F.regexp_replace(F.substr(F.col(line), F.lit(8)), "^refs/heads/", "")))
    return rows.groupBy(F.col("at").alias("path")).agg(branch.alias("branch"), F.coalesce(F.bool_or(F.col(line) == "detached"), F.lit(False)).alias("detached"))


def collisions(summary: DataFrame) -> DataFrame:
    """The summary of a preflight with ``has_collisions``."""
    return summary.withColumn("has_collisions", F.col("collision") > 0)
