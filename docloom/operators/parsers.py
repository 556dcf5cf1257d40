"""Parsers: source files (relative_path, content) to candidates, one for each function that a reader may want to know of.

All give the same columns: language, relative_path, name, kind, line_start, line_end,
source, hints. Ruby and Python are read line by line with windows over a file's lines;
tags by their shape. Only brackets, which no pattern can match, are matched in Arrow
batches (``scopes`` for Java, ``script_scopes`` for script); what is found there is
classified and described with the same expressions as the rest.

Results for odd input: null and empty files, and files of other kinds, give no rows; a
file that cannot be read as its language gives what was found; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code, notes
from ..functions.text import snake_resource
from .candidates import language_of

PARAMETERS = "array<struct<name:string,type:string>>"
COLUMNS = ("language", "relative_path", "name", "kind", "line_start", "line_end", "source", "hints")


def _strip(c: Column) -> Column:
    return F.trim(c)


def _filled(c: Column) -> Column:
    """An array, or null if it is empty."""
    return F.when(F.size(c) > 0, c)


def hints(annotations=None, parameters=None, route=None, callees=None, tables=None, found=None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    names = "array<string>"
    return F.struct(
        (none(names) if annotations is None else annotations).alias("annotations"), (none(PARAMETERS) if parameters is None else _filled(parameters)).alias("parameters"), (none("struct<method:string,path:string>") if route is None else route).alias("http_route"),
        (none(names) if callees is None else _filled(callees)).alias("callees"), (none(names) if tables is None else _filled(tables)).alias("database_tables"), (none(names) if found is None else _filled(found)).alias("notes"),
    )


def _joined(*parts: Column) -> Column:
    """Texts and arrays of texts as one array without nulls."""
    return F.array_compact(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))


def _one(c: Column) -> Column:
    return F.array_compact(F.array(c))


# ---- Ruby

_OPENS, _DO, _END = r"^(?:class|module|if|unless|while|until|for|case|begin)\b", r"\bdo\s*(?:\|[^|]*\|)?\s*(?:#.*)?$", r"^end\b"
_CALLBACK = r"^(skip_)?before_(?:action|filter)\s+:(\w+[?!]?)(.*)"


def ruby(files: DataFrame) -> DataFrame:
    """Public methods of controllers. Depth is a running sum over a file's lines; blank lines and comments do not count."""
    own = files.where(F.endswith(F.lower("relative_path"), F.lit("_controller.rb"))).select("relative_path", F.split("content", "\n").alias("lines"), F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^class\s+(\w+(?:::\w+)*)", 1), F.lit("")), code.class_of_file(F.col("relative_path"))).alias("class"))
    own = own.withColumn("file", F.monotonically_increasing_id())
    rows = own.select("file", F.posexplode("lines").alias("n", "raw")).select("file", "n", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("t")).where("t != '' and not startswith(t, '#')")
    is_ = lambda p: F.rlike("t", F.lit(p))
    delta = F.when(is_(_OPENS) | is_(r"^def\s+") | is_(_DO), 1).when(is_(_END), -1).otherwise(0)
    order = Window.partitionBy("file").orderBy("n")
    past, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("delta", delta).withColumn("after", F.sum("delta").over(until)).withColumn("before", F.col("after") - F.col("delta"))
    # the level of classes is that of the first one; a class begins at it and ends where an end goes back to it
    level = F.first(F.when(is_(r"^class\s+\w"), F.col("before")), ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    begins = F.max(F.when(is_(r"^class\s+\w") & (F.col("before") == F.col("level")), F.col("n"))).over(past)
    ends = F.max(F.when((F.col("delta") == -1) & (F.col("after") == F.col("level")), F.col("n"))).over(past)
    hidden = F.max(F.when(is_(r"^(?:private|protected)$"), F.col("n"))).over(past)
    call = lambda g: F.regexp_extract("t", _CALLBACK, g)
    listed = lambda word: F.regexp_extract(call(3), rf"\b{word}:\s*(%[iI]\[[^\]]*\]|\[[^\]]*\])", 1)
    callback = F.struct((call(1) != "").alias("skip"), call(2).alias("name"), F.when(listed("only") != "", code.symbol_list(listed("only"))).alias("only"), F.when(listed("except") != "", code.symbol_list(listed("except"))).alias("but"))
    inside = (F.col("begins").isNotNull() & (F.coalesce("ends", F.lit(-1)) < F.col("begins"))) & (F.col("before") == F.col("level") + 1)
    rows = rows.withColumns({"begins": begins, "ends": ends, "hidden": hidden}).withColumn("inside", F.coalesce(inside, F.lit(False)))
    rows = rows.withColumn("callbacks", F.collect_list(F.when(F.col("inside") & is_(_CALLBACK), callback)).over(past))
    # where the body ends: the next end that goes back to the depth before the method
    rows = rows.withColumn("depth", F.when(F.col("delta") == -1, F.col("after")).otherwise(F.col("before")))
    stop = F.first(F.when(F.col("delta") == -1, F.col("n")), ignorenulls=True).over(Window.partitionBy("file", "depth").orderBy("n").rowsBetween(1, Window.unboundedFollowing))
    methods = rows.withColumn("stop", stop).where(F.col("inside") & is_(r"^def\s+\w") & ~is_(r"^def\s+self\.") & ~F.coalesce(F.col("hidden") > F.col("begins"), F.lit(False)))
    found = methods.select("file", "n", "t", "stop", "callbacks").join(own, "file")
    last = F.coalesce("stop", F.size("lines"))
    part = F.slice("lines", F.col("n") + 1, F.greatest(last - F.col("n") + 1, F.lit(1)))
    count = lambda c: F.char_length("t") - F.char_length(F.replace("t", F.lit(c), F.lit("")))
    head = F.when(count("(") > count(")"), F.array_join(F.transform(part, _strip), " ")).otherwise(F.col("t"))
    found = found.withColumns({"source": F.array_join(part, "\n"), "head": head, "last": last})
    shape = r"^def\s+(\w+[?!]?)\s*(?:\(([^)]*)\))?"
    found = found.withColumn("method", F.regexp_extract("head", shape, 1)).where("method != ''")
    applies = lambda c: F.when(c["only"].isNotNull(), F.array_contains(c["only"], F.col("method"))).when(c["but"].isNotNull(), ~F.array_contains(c["but"], F.col("method"))).otherwise(True)
    skipped = F.transform(F.filter("callbacks", lambda c: c["skip"] & applies(c)), lambda c: c["name"])
    kept = F.filter("callbacks", lambda c: ~c["skip"] & applies(c) & ~F.array_contains(skipped, c["name"]))
    guard = F.when(F.size(kept) > 0, F.concat(F.lit("before_action: "), F.array_join(F.transform(kept, lambda c: F.concat(F.lit(":"), c["name"])), ", ")))
    route = code.rest_route(F.col("method"), snake_resource(F.element_at(F.split("class", "::"), -1)))
    source = F.col("source")
    return found.select(
        F.lit("ruby").alias("language"), "relative_path", F.concat("class", F.lit("#"), "method").alias("name"), F.when(F.col("method").isin(*code.REST), "rails-action").otherwise("function").alias("kind"),
        (F.col("n") + 1).alias("line_start"), (F.col("last") + 1).alias("line_end"), "source",
        hints(parameters=code.ruby_parameters(F.regexp_extract("head", shape, 2)), route=route, callees=code.called(source, "ruby"), tables=code.record_models(source), found=_joined(_one(guard), notes.side_effects(F.lit("ruby"), source))).alias("hints"),
    )


# ---- Python

# Views by name, decorators and bases that guard them.
VIEW_BASES = tuple(
    """
    View TemplateView RedirectView DetailView ListView FormView CreateView UpdateView DeleteView ArchiveIndexView YearArchiveView MonthArchiveView WeekArchiveView
    DayArchiveView TodayArchiveView DateDetailView BaseDetailView BaseListView BaseCreateView BaseUpdateView BaseDeleteView BaseFormView APIView GenericAPIView ViewSet
    GenericViewSet ReadOnlyModelViewSet ModelViewSet
    """.split()
)
PYTHON_GUARDS = tuple("login_required permission_required staff_member_required user_passes_test permission_classes authentication_classes".split())
MIXINS = {"LoginRequiredMixin": "auth: login_required", "PermissionRequiredMixin": "auth: permission_required", "UserPassesTestMixin": "auth: user_passes_test"}


def _last_part(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, r"^\s+|\s+$", ""), ".", -1)


def _header(lines: Column, n: Column) -> Column:
    """(text, size): the header that begins in line ``n`` (from 0), its lines trimmed and joined until its parentheses close."""
    def balance(s: Column) -> Column:
        return F.char_length(F.replace(s, F.lit(")"), F.lit("))"))) - F.char_length(F.replace(s, F.lit("("), F.lit("((")))

    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        left = a["open"] - balance(s)
        return F.struct(F.when(a["done"], a["open"]).otherwise(left).alias("open"), F.when(a["done"], a["size"]).otherwise(a["size"] + 1).alias("size"), (a["done"] | (left <= 0)).alias("done"))

    size = F.aggregate(F.slice(lines, n + 1, F.size(lines)), start, step, lambda a: F.when(a["done"], a["size"]).otherwise(1))
    return F.struct(F.array_join(F.transform(F.slice(lines, n + 1, size), _strip), " ").alias("text"), size.alias("size"))


def _decorators(lines: Column, n: Column) -> Column:
    """The line (from 0) where the decorators above line ``n`` begin: back over blank lines, comments, decorators and what their brackets hold."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("open"), F.lit(0).alias("top"), F.lit(False).alias("done"))
    many = lambda s, some: sum((F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit(""))) for c in some), F.lit(0))

    def step(a: Column, raw: Column) -> Column:
        t = F.trim(raw)
        blank = (t == "") | F.startswith(t, F.lit("#"))
        depth = a["open"] + F.when(blank, 0).otherwise(many(t, ")]}") - many(t, "([{"))
        mark = F.startswith(t, F.lit("@")) & ~blank
        takes = mark & (depth <= 0)
        stops = ~blank & ((depth < 0) | (~takes & ~((a["open"] > 0) | (depth > 0))))
        at = a["k"] + 1
        return F.struct(at.alias("k"), F.when(a["done"], a["open"]).otherwise(depth).alias("open"), F.when(~a["done"] & takes, at).otherwise(a["top"]).alias("top"), (a["done"] | stops).alias("done"))

    return n - F.aggregate(F.reverse(F.slice(lines, 1, n)), start, step, lambda a: a["top"])


def _guard_notes(block: Column) -> Column:
    """Notes of guarding decorators in a block of lines, plain ones first."""
    plain = F.filter(F.transform(F.split(block, "\n"), _strip), lambda s: F.regexp_extract(s, r"^@(\w+)", 1).isin(*PYTHON_GUARDS))
    arg = lambda s: F.regexp_extract(s, r"^@\w+\(([^)]*)\)", 1)
    first = F.transform(plain, lambda s: F.concat(F.lit("auth: "), F.regexp_extract(s, r"^@(\w+)", 1), F.when(F.rlike(s, F.lit(r"^@\w+\([^)]*\)")), F.concat(F.lit("("), F.trim(arg(s)), F.lit(")"))).otherwise("")))
    wrapped = F.transform(F.slice(F.split(block, r"@method_decorator(?=\()"), 2, F.char_length(block) + 1), lambda s: F.trim(code.first_argument(code.balanced(s, F.lit(1)))))
    shape = r"^(\w+)\s*(?:\(([\s\S]*)\))?\s*$"
    good = F.filter(wrapped, lambda s: F.regexp_extract(s, shape, 1).isin(*PYTHON_GUARDS))
    second = F.transform(good, lambda s: F.concat(F.lit("auth: "), F.regexp_extract(s, shape, 1), F.when(F.contains(s, F.lit("(")), F.concat(F.lit("("), F.trim(F.regexp_extract(s, shape, 2)), F.lit(")"))).otherwise("")))
    return F.concat(first, second)


def python(files: DataFrame) -> DataFrame:
    """Views: functions whose first parameter is the request, and methods of view classes that answer a verb or an action."""
    own = files.where(F.rlike(F.lower("relative_path"), F.lit(r"(?:(?:^|[/\\])views\.py|_views\.py|[/\\]views[/\\].+\.py)$"))).select("relative_path", F.split("content", "\n").alias("lines")).withColumn("file", F.monotonically_increasing_id())
    rows = own.select("file", F.posexplode("lines").alias("n", "raw")).select("file", "n", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("t"), code.indent_of(F.col("raw")).alias("indent")).where("t != '' and not startswith(t, '#')")
    order = Window.partitionBy("file").orderBy("n")
    # the class that a line is in begins with the last line at the margin
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("owner", F.last(F.when(F.col("indent") == 0, F.struct("n", "t")), ignorenulls=True).over(past))
    heads = rows.where(F.rlike("t", F.lit(r"^(?:def|class)\s"))).select("file", "n", "t", "indent", "owner")
    shape = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "indent"))).alias("shape"))
    found = heads.join(own, "file").join(shape, "file").withColumn("head", _header(F.col("lines"), F.col("n")))
    # the body: lines that count behind the header, up to one that is not deeper
    body = F.filter("shape", lambda s: s["n"] >= F.col("n") + F.col("head.size"))
    stop = F.filter(body, lambda s: s["indent"] <= F.col("indent"))
    deep = F.filter(body, lambda s: F.when(F.size(stop) > 0, s["n"] < stop[0]["n"]).otherwise(True))
    found = found.withColumn("last", F.when(F.size(deep) > 0, F.element_at(deep, -1)["n"]).otherwise(F.col("n") + F.col("head.size") - 1)).withColumn("first", _decorators(F.col("lines"), F.col("n")))
    found = found.withColumn("block", F.array_join(F.slice("lines", F.col("first") + 1, F.col("n") - F.col("first")), "\n"))
    classes = found.where(F.rlike("t", F.lit(r"^class\s")) & (F.col("indent") == 0))
    form = r"^class\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*:"
    bases = F.transform(F.split(F.regexp_extract("head.text", form, 2), ","), _last_part)
    view = F.exists(bases, lambda b: b.isin(*VIEW_BASES) | (F.endswith(b, F.lit("View")) & (F.char_length(b) > 4)) | F.endswith(b, F.lit("ViewSet")))
    mixed = F.array_compact(F.transform(bases, lambda b: reduce(lambda out, m: F.when(b == m[0], m[1]).otherwise(out), MIXINS.items(), F.lit(None).cast("string"))))
    inside = F.array_join(F.slice("lines", F.col("n") + F.col("head.size") + 1, F.greatest(F.col("last") - F.col("n") - F.col("head.size") + 1, F.lit(0))), "\n")
    allowed = F.regexp_extract(inside, r"(?m)^[ \t]+permission_classes\s*=\s*\[([^\]]*)\]", 1)
    allowed = F.filter(F.transform(F.split(allowed, ","), lambda p: F.regexp_replace(_last_part(p), r"[()\[\]]", "")), lambda p: p != "")
    models = F.concat(F.regexp_extract_all(inside, F.lit(r"(?m)^[ \t]+queryset\s*=\s*([A-Z][A-Za-z0-9_]*)\.objects\."), F.lit(1)), F.regexp_extract_all(inside, F.lit(r"(?m)^[ \t]+model\s*=\s*([A-Z][A-Za-z0-9_]*)\s*$"), F.lit(1)))
    classes = classes.where((F.regexp_extract("head.text", form, 1) != "") & view).select(F.col("file").alias("f"), F.col("n").alias("at"), F.regexp_extract("head.text", form, 1).alias("class"), F.array_distinct(F.concat(mixed, _guard_notes(F.col("block")))).alias("guards"), allowed.alias("allowed"), F.array_distinct(models).alias("models"))
    define = r"^def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"
    methods = found.where(F.rlike("t", F.lit(r"^def\s"))).withColumns({"method": F.regexp_extract("head.text", define, 1), "parameters": F.regexp_extract("head.text", define, 2)}).where("method != ''")
    # a function inside another one is no view
    nested = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    methods = methods.withColumn("nested", nested >= F.col("n")).where("not nested and not startswith(method, '_')").withColumn("source", F.array_join(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n"))
    source, effects = F.col("source"), notes.side_effects(F.lit("python"), F.col("source"))
    calls = code.called(source, "python")
    place = [(F.col("first") + 1).alias("line_start"), (F.col("last") + 1).alias("line_end"), "source"]
    lead = F.trim(F.split(F.regexp_replace(F.trim(F.split("parameters", ",")[0]), r"^\*+", ""), r"\s*[=:]\s*")[0])
    views = methods.where((F.col("indent") == 0) & (lead == "request")).select(
        F.lit("python").alias("language"), "relative_path", F.col("method").alias("name"), F.lit("django-view").alias("kind"), *place,
        hints(parameters=code.python_parameters(F.col("parameters")), callees=calls, tables=code.manager_models(source), found=_joined(_guard_notes(F.col("block")), effects)).alias("hints"),
    )
    args = F.regexp_extract("block", r"@action\s*\(([\s\S]*?)\)", 1)
    custom = F.rlike("block", F.lit(r"@action\s*\([\s\S]*?\)"))
    verb = F.upper(F.regexp_replace(F.trim(F.split(F.regexp_extract(args, r"\bmethods\s*=\s*\[([^\]]*)\]", 1), ",")[0]), "['\"]", ""))
    deep_path = F.when(F.regexp_extract(args, r"\bdetail\s*=\s*(True|False)", 1) == "True", "/:id").otherwise("")
    resource = snake_resource(F.col("class"))
    acts = F.when(custom, F.struct(F.when(verb == "", "GET").otherwise(verb).alias("method"), F.concat(F.lit("/"), resource, deep_path, F.lit("/"), "method").alias("path")))
    route = F.coalesce(code.view_route(F.col("method"), resource), acts)
    inner = methods.where("indent > 0").join(classes, (F.col("file") == F.col("f")) & (F.col("owner.n") == F.col("at"))).withColumn("route", route).where("route is not null")
    own_parameters = F.filter(code.python_parameters(F.col("parameters")), lambda p: ~p["name"].isin("self", "request"))
    permits = F.when(F.size("allowed") > 0, F.concat(F.lit("permission_classes: "), F.array_join("allowed", ", ")))
    inner = inner.select(
        F.lit("python").alias("language"), "relative_path", F.concat("class", F.lit("#"), "method").alias("name"), F.lit("django-view").alias("kind"), *place,
        hints(parameters=own_parameters, route=F.col("route"), callees=calls, tables=F.array_union("models", code.manager_models(source)), found=_joined(F.col("guards"), _guard_notes(F.col("block")), _one(permits), effects)).alias("hints"),
    )
    return views.unionByName(inner)


# ---- CFML

_TAG = r"(?is)(<cffunction\b[^>]*>.*?</cffunction\s*>)"
_SCRIPT = re.compile(r"(?:^|\s|;|\{|\}|\*/)(?:public|private|package|remote|any|void|string|numeric|boolean|array|struct|query)?\s*(?:public|private|package|remote)?\s*function\s+([A-Za-z_]\w*)\s*\(")
_REMOTE = "access: remote (HTTP-callable via CFC remoting)"


def _match(text: str, at: int, opens: str, closes: str, strings: bool) -> int:
    """The index of the bracket that closes the one at ``at``; -1 if none does."""
    depth, quote = 0, ""
    for m in re.compile(r"[\"'" + re.escape(opens + closes) + "]").finditer(text, at):
        c = m[0]
        if strings and quote:
            quote = "" if c == quote and text[m.start() - 1] != "\\" else quote
        elif c in "\"'":
            quote = c if strings else ""
        else:
            depth += 1 if c == opens else -1
            if not depth:
                return m.start()
    return -1


def script_functions(text: str) -> list[dict]:
    """The functions in script: name, what stands before them in their line, parameters, what stands before the body, lines, source."""
    out, at = [], 0
    while (m := _SCRIPT.search(text, at)) is not None:
        opened = m.end() - 1
        closed = _match(text, opened, "(", ")", False)
        brace = text.find("{", closed) if closed >= 0 else -1
        end = _match(text, brace, "{", "}", True) if brace >= 0 else -1
        if end < 0:
            at = m.end()
            continue
        start = text.rfind("function", 0, opened)
        line = text.rfind("\n", 0, start) + 1
        out.append({"name": m[1], "lead": text[line:start], "parameters": text[opened + 1 : closed], "between": text[closed + 1 : brace], "line_start": 1 + text.count("\n", 0, start), "line_end": 1 + text.count("\n", 0, end + 1), "source": text[start : end + 1]})
        at = end + 1
    return out


def script_scopes(text: Column) -> Column:
    """``script_functions`` of each text, as an array of structs."""
    kind = "array<struct<name:string,lead:string,parameters:string,between:string,line_start:int,line_end:int,source:string>>"

    @F.arrow_udf(kind)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = pa.list_(pa.struct([(n, pa.int32() if n.startswith("line") else pa.string()) for n in ("name", "lead", "parameters", "between", "line_start", "line_end", "source")]))
        for batch in texts:
            yield pa.array([_safely(script_functions, x)[0] for x in batch.to_pylist()], made)

    return run(text)


def cfml(files: DataFrame) -> DataFrame:
    """Functions of components, in tags and in script, and pages that do something."""
    lower = F.lower("relative_path")
    own = files.select("relative_path", F.col("content").alias("content"), code.without_comments(F.col("content")).alias("clean"))
    parts = own.where(F.endswith(lower, F.lit(".cfc")))
    # what stands between the functions gives the place of each
    blocks, gaps = F.regexp_extract_all("clean", F.lit(_TAG), F.lit(1)), F.split("clean", _TAG)
    tags = parts.select("*", blocks.alias("blocks"), gaps.alias("gaps")).select("*", F.posexplode("blocks").alias("k", "source"))
    lead = F.array_join(F.concat(F.slice("gaps", 1, F.col("k") + 1), F.slice("blocks", 1, F.col("k"))), "")
    fields = code.tag_attributes(F.regexp_extract("source", r"(?i)^<cffunction\b([^>]*)>", 1))
    tags = tags.select("relative_path", "content", F.coalesce(fields["name"], F.lit("anonymous")).alias("name"), F.lit("cf-tag-function").alias("kind"), (code.n_lines(lead) + 1).alias("line_start"), (code.n_lines(lead) + code.n_lines(F.col("source")) + 1).alias("line_end"), "source", F.lower(F.coalesce(fields["access"], F.lit(""))).alias("access"), F.trim(F.coalesce(fields["roles"], F.lit(""))).alias("roles"), F.lit("").alias("inline"))
    script = parts.where(F.rlike("clean", F.lit(r"(?i)\bcomponent\b\s*[a-zA-Z\s\{]"))).select("relative_path", "content", F.explode(script_scopes(F.col("clean"))).alias("s"))
    access = F.when(F.rlike("s.lead", F.lit(r"(?i)\bprivate\b")), "private").when(F.rlike("s.lead", F.lit(r"(?i)\bremote\b")), "remote").otherwise("")
    script = script.select("relative_path", "content", "s.name", F.lit("cf-script-function").alias("kind"), "s.line_start", "s.line_end", "s.source", access.alias("access"), F.trim(F.regexp_extract("s.between", r"(?i)\broles\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("roles"), F.col("s.parameters").alias("inline"))
    page = own.where(F.endswith(lower, F.lit(".cfm")) & (code.executable_lines(F.col("content")) >= 3))
    page = page.select("relative_path", F.lit("").alias("content"), F.regexp_replace(F.regexp_extract("relative_path", r"([^/\\]*)$", 1), r"\.cfm$", "").alias("name"), F.lit("cf-tag-function").alias("kind"), F.lit(1).alias("line_start"), (code.n_lines(F.col("content")) + 1).alias("line_end"), F.col("content").alias("source"), F.lit("").alias("access"), F.lit("").alias("roles"), F.lit("").alias("inline"))
    every = tags.unionByName(script).unionByName(page).where("access != 'private'")
    source = F.col("source")
    arguments = F.transform(F.regexp_extract_all(source, F.lit(r"(?i)<cfargument\b([^>]*)>"), F.lit(1)), code.tag_attributes)
    named = F.transform(F.filter(arguments, lambda a: F.coalesce(a["name"], F.lit("")) != ""), lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type")))
    parameters = F.when(F.size(named) > 0, named).otherwise(code.script_parameters(F.col("inline")))
    hook = F.when(F.lower(F.regexp_extract("relative_path", r"([^/\\]*)$", 1)) == "application.cfc", notes.hook_note(F.col("name")))
    lists = notes.markup_notes(source)
    found = _joined(_one(F.when(notes.is_entity(F.col("content")), notes.ENTITY_NOTE)), _one(hook), _one(F.when(F.col("access") == "remote", _REMOTE)), lists, notes.side_effects(F.lit("cfml"), source), _one(notes.procedure_note(source)), _one(F.when(F.col("roles") != "", F.concat(F.lit("roles: "), "roles"))))
    return every.select(F.lit("cfml").alias("language"), "relative_path", "name", "kind", "line_start", "line_end", "source", hints(parameters=parameters, callees=code.called(source, "cfml"), tables=code.sql_tables(source), found=found).alias("hints"))


# ---- Java

_HIDDEN = re.compile(r'"""(?s:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*(?s:.*?)\*/')
_CLASS, _CALL = re.compile(r"\bclass\s+(\w+)[^{;]*\{"), re.compile(r"\b(\w+)\s*\(")
_BEHIND = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>@]+?)?\s*([{;])")
_DECLARED = re.compile(r"\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|default)\s+)*(?:<[^(){};]*?>\s*)?(?!(?:return|new|else|throw|case|assert|yield)\b)[\w.]+\s*(?:<[^(){};=]*>)?\s*(?:\[\s*\]\s*)*")
_LOCAL = re.compile(r"\s*(?:(?:final|@\w+)\s+)*[\w.]+(?:<[^;{}]*>)?(?:\[\s*\])*\s+\w+(?:\[\s*\])*\s*(?:=.*)?", re.S)


def java_methods(text: str) -> list[dict]:
    """Each method of each class, those of inner classes for each class around them too: names, what stands before them, parameters, lines, source, statements."""
    plain = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    pairs, stack, flat, depth = {}, [], list(plain), 0
    for m in re.finditer(r"[(){}]", plain):
        c, i = m[0], m.start()
        if c in "({":
            if c == "{" and depth:
                flat[i] = " "  # inside parentheses: no place where a declaration ends
            stack.append(i)
            depth += c == "("
        elif stack and plain[stack[-1]] + c in ("()", "{}"):
            pairs[stack.pop()] = i
            depth -= c == ")"
            if c == "}" and depth:
                flat[i] = " "
    # what is in parentheses does not end a declaration either
    for a, b in pairs.items():
        if plain[a] == "(":
            for i in range(a + 1, b):
                if flat[i] == ";":
                    flat[i] = " "
    edges = [m.start() for m in re.finditer(r"[;{}]", "".join(flat))]

    def before(i: int) -> int:
        import bisect

        k = bisect.bisect_left(edges, i)
        return edges[k - 1] + 1 if k else 0

    def bare(a: int, b: int) -> str:
        """The declaration without annotations."""
        out, i = [], a
        for m in re.finditer(r"@(?!interface\b)[\w.]+\s*(\(?)", plain[a:b]):
            if a + m.start() < i:
                continue
            out.append(plain[i : a + m.start()])
            end = a + m.end()
            i = pairs.get(end - 1, end - 1) + 1 if m[1] else end
        return "".join([*out, plain[i:b]])

    package = re.search(r"^\s*package\s+([\w.]+)\s*;", plain, re.M)
    methods = []
    for m in _CALL.finditer(plain):
        close = pairs.get(m.end() - 1)
        behind = _BEHIND.match(plain, close + 1) if close is not None else None
        start = before(m.start())
        declared = bare(start, m.start())
        if behind is None or not re.search(r"\w\s+\Z|[>\]]\s*\Z", declared) or not _DECLARED.fullmatch(declared):
            continue
        words = declared.split()
        if all(w in ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default") for w in words):
            continue  # a constructor
        first = start + len(plain[start : m.start()]) - len(plain[start : m.start()].lstrip())
        opened = behind.end() - 1
        end = pairs.get(opened, len(text) - 1) if behind[1] == "{" else opened
        inside = "".join(flat[opened + 1 : end]) if behind[1] == "{" else ""
        count = sum(1 for s in re.split(r"[{}]", inside) for x in s.split(";")[:-1] if x.strip() and not re.match(r"\s*(?:throw|break|continue|assert)\b", x) and (re.match(r"\s*return\b", x) or not _LOCAL.fullmatch(x)))
        methods.append((m.start(), {"method": m[1], "lead": text[start : m.start()], "modifiers": " ".join(w for w in words), "parameters": text[m.end() : close], "has_body": behind[1] == "{", "statements": count, "line_start": 1 + text.count("\n", 0, first), "line_end": 1 + text.count("\n", 0, end), "source": text[first : end + 1]}))
    out = []
    for m in _CLASS.finditer(plain):
        end, start = pairs.get(m.end() - 1, len(text)), before(m.start())
        note = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*\Z", text[: start + len(plain[start : m.start()]) - len(plain[start : m.start()].lstrip())], re.S)
        said = bool(note) and bool(re.sub(r"(?m)^\s*\*+\s?", "", note[1]).strip())
        own = {"class": m[1], "class_lead": text[start : m.start()], "class_modifiers": bare(start, m.start()), "package": package[1] if package else None, "documented": said}
        out += [own | x for i, x in methods if m.end() <= i < end]
    return out


_JAVA_FIELDS = {"class": "string", "class_lead": "string", "class_modifiers": "string", "package": "string", "documented": "boolean", "method": "string", "lead": "string", "modifiers": "string", "parameters": "string", "has_body": "boolean", "statements": "int", "line_start": "int", "line_end": "int", "source": "string"}


def scopes(text: Column) -> Column:
    """``java_methods`` of each text, as an array of structs."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}

    @F.arrow_udf("array<struct<" + ",".join(f"{k}:{v}" for k, v in _JAVA_FIELDS.items()) + ">>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = pa.list_(pa.struct([(k, kinds[v]) for k, v in _JAVA_FIELDS.items()]))
        for batch in texts:
            yield pa.array([_safely(java_methods, x)[0] for x in batch.to_pylist()], made)

    return run(text)


def _safely(scan, text: str | None) -> tuple[list, str | None]:
    """(what ``scan`` finds in a text, None), or nothing and what went wrong: one file does not end the job."""
    try:
        return scan(text or ""), None
    except Exception as e:
        return [], f"{type(e).__name__}: {e}"[:500]


def unread(files: DataFrame) -> DataFrame:
    """(relative_path, error) of the files that the scans of Java and of component scripts could not read; ``parse`` leaves these out."""
    scans = {"java": java_methods, "cfml": script_functions}

    @F.arrow_udf("string")
    def run(kinds, texts):
        return pa.array([_safely(scans[k], x)[1] for k, x in zip(kinds.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    own = files.withColumn("__kind", language_of(F.col("relative_path"))).where(F.col("__kind").isin(*scans))
    return own.select("relative_path", run(F.col("__kind"), F.col("content")).alias("error")).where("error is not null")


# Annotations by what they make of a class or method, methods of servlets with their verb, packages that hold business code.
SPRING, CONTROLLERS, JAXRS = tuple("GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping".split()), ("Controller", "RestController", "Path"), tuple("GET POST PUT DELETE PATCH HEAD OPTIONS".split())
SERVICES = tuple("Service Component Repository Stateless Stateful Singleton MessageDriven Named ApplicationScoped RequestScoped SessionScoped Dependent".split())
SERVLETS, BENCHMARKS, PACKAGES = ("WebServlet", "WebFilter"), ("BenchmarkMode", "State", "Benchmark"), ("service", "business", "manager", "dao", "api")
SERVLET_METHODS = {"doGet": "GET", "doPost": "POST", "doPut": "PUT", "doDelete": "DELETE", "doPatch": "PATCH", "doHead": "HEAD", "doOptions": "OPTIONS", "service": "ANY", "doFilter": "ANY"}
SURFACES = ("annotated", "all-public-classes", "package-allowlist")


def _annotations(lead: Column) -> Column:
    bare = F.regexp_replace(lead, r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"", '""')
    return F.transform(F.regexp_extract_all(bare, F.lit(r"@(?!interface\b)([A-Za-z_][\w.]*)"), F.lit(1)), lambda a: F.substring_index(a, ".", -1))


def _path(lead: Column, names: tuple[str, ...]) -> Column:
    """The first string that an annotation of these names has as its value or path; empty without one."""
    return F.regexp_extract(lead, r"@(?:[\w.]*\.)?(?:" + "|".join(names) + r")\s*\(\s*(?:(?:[^()\"]|\"[^\"]*\")*?\b(?:value|path)\s*=\s*)?\"([^\"]*)\"", 1)


def _any(marks: Column, names) -> Column:
    return F.arrays_overlap(marks, F.array(*(F.lit(n) for n in names)))


def java(files: DataFrame, surface: str = "annotated", benchmarks: bool = False) -> DataFrame:
    """Methods of classes that the surface includes: of framework classes, of all documented public classes, or of packages by name."""
    if surface not in SURFACES:
        raise ValueError(f"surface is one of {', '.join(SURFACES)}: {surface}")
    own = files.where(F.endswith(F.lower("relative_path"), F.lit(".java"))).select("relative_path", F.posexplode(scopes(F.col("content"))).alias("k", "m")).select("relative_path", "m.*")
    own = own.withColumns({"class_marks": _annotations(F.col("class_lead")), "marks": _annotations(F.col("lead"))})
    word = lambda c, w: F.rlike(c, F.lit(rf"\b{w}\b"))
    trivial = F.rlike("method", F.lit("^(?:get|set|is|has)[A-Z]")) & (~F.col("has_body") | (F.col("statements") <= 1))
    own = own.withColumns({"trivial": trivial, "public": word("modifiers", "public")})
    bench, servlet = _any(F.col("class_marks"), BENCHMARKS), _any(F.col("class_marks"), SERVLETS)
    spring = F.get(F.filter("marks", lambda a: a.isin(*SPRING)), F.lit(0))
    verb = F.get(F.filter("marks", lambda a: a.isin(*JAXRS)), F.lit(0))
    by_name = reduce(lambda out, m: F.when(F.col("method") == m[0], m[1]).otherwise(out), SERVLET_METHODS.items(), F.lit(None).cast("string"))
    named = F.upper(F.replace(spring, F.lit("Mapping"), F.lit("")))
    method = F.when(spring.isNotNull(), F.when(named == "REQUEST", "ANY").otherwise(named)).when(verb.isNotNull(), verb).when(servlet, by_name)
    path = F.when(spring.isNotNull(), _path(F.col("lead"), SPRING)).when(verb.isNotNull(), _path(F.col("lead"), ("Path",))).otherwise("")
    route = F.when(method.isNotNull(), F.struct(method.alias("method"), code.join_paths(_path(F.col("class_lead"), ("RequestMapping", "Path")), path).alias("path")))
    own = own.withColumns({"route": route, "bench": bench, "servlet": servlet, "framework": _any(F.col("class_marks"), CONTROLLERS + SERVICES + SERVLETS)})
    gate = F.when(F.col("servlet"), F.col("route").isNotNull()).otherwise(F.col("route").isNotNull() | (F.col("framework") & ~F.col("trivial")))
    gate = F.when(F.col("servlet") | F.col("framework") | F.col("route").isNotNull(), gate).otherwise(False)
    plain = F.col("public") & ~F.col("trivial")
    if surface == "annotated":
        keep = F.when(F.col("bench"), plain).otherwise(gate)
    elif surface == "package-allowlist":
        keep = plain & F.coalesce(_any(F.split("package", r"\."), PACKAGES), F.lit(False))
    else:
        many = F.count_if(plain).over(Window.partitionBy("relative_path", "class_lead", "class"))
        named_test = F.rlike("class", F.lit("(?:Test|Tests|IT)$|^Test"))
        keep = plain & ~word("class_modifiers", "abstract") & ~named_test & F.col("documented") & (F.col("many") >= 3)
        own = own.withColumn("many", many)
    found = own.where(F.coalesce(keep, F.lit(False)) & ~word("modifiers", "static"))
    if not benchmarks:
        found = found.where(~F.col("bench"))
    source, marks = F.col("source"), F.concat("class_marks", "marks")
    bare = F.regexp_replace("parameters", r"@[\w.]+(?:\([^)]*\))?\s*|\bfinal\s+", "")
    typed = lambda p: F.struct(F.regexp_extract(p, r"(\w+)\s*(?:\[\s*\])*\s*$", 1).alias("name"), F.trim(F.regexp_extract(p, r"(?s)^(.*?)\.{0,3}\s*\w+\s*(?:\[\s*\])*\s*$", 1)).alias("type"))
    angles = F.regexp_replace(F.regexp_replace(bare, "<", "[<"), ">", ">]")  # generics are brackets for the cut at commas
    parameters = F.transform(F.filter(code.split_top(angles), lambda p: F.trim(p) != ""), lambda p: typed(F.regexp_replace(F.regexp_replace(F.trim(p), r"\[<", "<"), r">\]", ">")))
    calls = code.first_distinct(F.filter(F.regexp_extract_all(F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"", '""'), r"\bnew\s+[\w.]+(?:<[^>]*>)?\s*\(", "("), F.lit(r"(?<!@)\b([a-zA-Z_]\w*)\s*\("), F.lit(1)), lambda n: ~n.isin(*code.NO_CALLS["java"], "if", "for", "while", "switch", "catch", "synchronized", "return", "try", "super", "this", "assert") & (n != F.col("method"))), 30)
    found_notes = _joined(_one(notes.guards(marks)), notes.side_effects(F.lit("java"), source, marks))
    return found.select(
        F.lit("java").alias("language"), "relative_path", F.concat("class", F.lit("."), "method").alias("name"), F.when(F.col("route").isNotNull(), "controller-method").otherwise("function").alias("kind"), "line_start", "line_end", "source",
        hints(annotations=marks, parameters=parameters, route=F.col("route"), callees=calls, tables=code.jpa_models(source), found=found_notes).alias("hints"),
    )


# ---- all

def parse(files: DataFrame, surface: str = "annotated", benchmarks: bool = False, constants: bool = False) -> DataFrame:
    """The candidates of all files, each by the parser of its extension; functions that only return a literal are left out unless ``constants``."""
    ext = language_of(F.col("relative_path"))
    of = lambda name: files.where(ext == name)
    found = java(of("java"), surface, benchmarks).select(*COLUMNS)
    for other in (cfml(of("cfml")), ruby(of("ruby")), python(of("python"))):
        found = found.unionByName(other.select(*COLUMNS))
    return found if constants else found.where(~code.only_returns_literal(F.col("source")))


def in_order(candidates: DataFrame) -> DataFrame:
    """Candidates by path (code points), then line."""
    return candidates.orderBy("relative_path", "line_start")
