"""Selecting candidates: path rules, filters by name and change, even sampling, matching names to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_matches

# Files that are read (case counts), and folders that are not.
INCLUDED = r"(\.(java|cfc|cfm|cs|asax|ascx)|_controller\.rb|(^|/)views\.py|_views\.py|(^|/)views/.*\.py)$"
EXCLUDED = r"(^|/)(node_modules|target|build|dist|\.git|test|tests|test-harness|spec|specs|__tests__|__mocks__|[^/]*benchmarks?[^/]*|references)/"
HIDDEN = r"(^|/)\."
LANGUAGES = (("java", "java"), ("cfc", "cfml"), ("cfm", "cfml"), ("rb", "ruby"), ("py", "python"))


def scanned(path: Column) -> Column:
    """Whether a path is included and not excluded, nor a dot file or in a dot folder. Built-in expressions, so it filters before any parser runs."""
    return F.rlike(path, F.lit(INCLUDED)) & ~F.rlike(path, F.lit(EXCLUDED)) & ~F.rlike(path, F.lit(HIDDEN))


def with_extension(path: Column, *extensions: str) -> Column:
    """Whether a path has one of the extensions and is not excluded."""
    some = F.rlike(path, F.lit(r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"))
    return some & ~F.rlike(path, F.lit(EXCLUDED)) & ~F.rlike(path, F.lit(HIDDEN))


def language_of(path: Column) -> Column:
    """The language that a file's extension (any case) is parsed as; null if it is not parsed."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES:
        out = F.when(ext == e, language).otherwise(out)
    return out


def named(name: Column, wanted: str) -> Column:
    return (name == wanted) | F.endswith(name, F.lit("." + wanted))


def changed_only(candidates: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Candidates of the changed files (path); all if it is not known what changed."""
    return candidates if changed is None else candidates.join(changed.distinct(), candidates["relative_path"] == changed["path"], "left_semi")


def sample_even(df: DataFrame, key: str, n: int, width: int = 8192) -> DataFrame:
    """``n`` rows of ``df`` evenly over the order of the long ``key`` (unique), all if there are no more.

    Positions are two-level: within ranges of the key, and the counts of the ranges before;
    no window holds more than a range, or one row for each range.
    """
    if n <= 0:
        return df.limit(0)
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    ahead = sizes.select("__range", F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__rows").over(Window.partitionBy()).alias("__total"))
    at = ranged.join(ahead, "__range").withColumn("__at", F.col("__ahead") + F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1)
    # row p is taken if it is floor(i * total / n) for some i: only the two i next to p * n / total can be
    step = F.col("__total").cast("double") / n
    i = F.floor(F.col("__at") / step)
    hit = F.exists(F.array(i, i + 1), lambda j: (j < n) & (F.floor(j * step) == F.col("__at")))
    return at.where((F.col("__total") <= n) | hit).select(*df.columns)


def match_pages(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(seq, name): for each entry (seq, page, source) the first candidate of its file, by line, whose name fits the page.

    Names are few where rows are many: pairs are formed of the distinct pages of a file
    and its distinct names with their first line, and joined back to the entries.
    """
    names = candidates.groupBy("relative_path", "name").agg(F.min("line_start").alias("line_start"))
    pages = entries.select("page", "source").distinct()
    both = pages.join(names, pages["source"] == names["relative_path"]).where(slug_matches(F.col("name"), F.col("page")))
    first = both.groupBy("page", "source").agg(F.min(F.struct("line_start", "name")).alias("first"))
    return entries.join(first, ["page", "source"]).select("seq", F.col("first.name").alias("name"))


def confident(confidence: Column, least: str) -> Column:
    """Whether a page's confidence is ``least`` or more; what is no level counts as low."""
    levels = {"high": 3, "medium": 2, "low": 1}
    if least not in levels:
        raise ValueError(f"confidence must be one of {', '.join(levels)}: {least}")
    rank = F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)
    return rank >= levels[least]


def group_folder(path: Column) -> Column:
    """The first folder of a path with slashes of either kind; ``(root)`` without one."""
    return F.when(F.rlike(path, F.lit(r"[/\\]")), F.coalesce(F.nullif(F.split(path, r"[/\\]")[0], F.lit("")), F.lit("(root)"))).otherwise("(root)")
