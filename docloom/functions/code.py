"""Functions on source text as column expressions: names, comments, lines, attributes, parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands before a character at the top level of brackets.
MARK = "\x01"


def draft_title(name: Column) -> Column:
    """A name as a title of a draft: words in lower case, the first letter in upper case."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([A-Z])", " $1"), "[._]", " "), r"\s+", " ")
    s = F.lower(F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)), F.lit(" (DRAFT)"))


def class_of_file(path: Column) -> Column:
    """The class of a controller's file: snake case to camel case."""
    base = F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), r"_controller\.rb$", "Controller")
    return F.array_join(F.transform(F.split(base, "_"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))), "")


def join_paths(prefix: Column, suffix: Column) -> Column:
    """A route's path behind its prefix, with one slash between them."""
    p, s = F.regexp_replace(prefix, "/$", ""), F.regexp_replace(suffix, "^/", "")
    return F.when(F.coalesce(prefix, F.lit("")) == "", suffix).when(F.coalesce(suffix, F.lit("")) == "", prefix).when(s == "", p).otherwise(F.concat(p, F.lit("/"), s))


def n_lines(text: Column) -> Column:
    """Line ends in a text."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that an offset from 0 is in."""
    return n_lines(F.substr(text, F.lit(1), F.greatest(offset, F.lit(0)))) + 1


def _blanked(text: Column, start: str, end: str) -> Column:
    """``text`` with comments from ``start`` to ``end`` (patterns) as their line ends alone; the lines keep their numbers."""
    def piece(s: Column) -> Column:
        shape = rf"(?s)\A(.*?)({start}.*{end})\z"
        note = F.regexp_extract(s, shape, 2)
        return F.when(note != "", F.concat(F.regexp_extract(s, shape, 1), F.repeat(F.lit("\n"), n_lines(note)))).otherwise(s)

    return F.array_join(F.transform(F.split(text, f"(?<={end})"), piece), "")


def without_comments(text: Column) -> Column:
    """Markup and block comments taken out, their line ends kept."""
    return _blanked(_blanked(text, "<!---", "--->"), r"/\*", r"\*/")


def executable_lines(text: Column) -> Column:
    """Lines that do something: without comments and tags that only wrap or set up a page."""
    for pattern in (r"(?s)<!---.*?--->", r"(?s)/\*.*?\*/", r"//[^\n]*", r"(?i)</?cfscript\b[^>]*>", r"(?i)</?cfsilent\b[^>]*>", r"(?i)<cfsetting\b[^>]*>", r"(?i)<cfinclude\b[^>]*>"):
        text = F.regexp_replace(text, pattern, "")
    return F.size(F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"\S")))).cast("long")


# Fixed value: what a function may return to be a mere placeholder.
LITERAL = r"(?:true|false|null|yes|no|-?\d+(?:\.\d+)?|\"[^\"\\]*\"|'[^'\\]*'|\{\s*\}|\[\s*\])"


def function_body(source: Column) -> Column:
    """What is inside a function: of its tag, else from the first brace behind the first parenthesis to the last brace; null if it has neither."""
    tag = r"(?is)<cffunction\b[^>]*>(.*?)</cffunction\s*>"
    close = F.instr(source, ")")
    opened = F.when(close > 0, F.position(F.lit("{"), source, close)).otherwise(0)
    last = F.char_length(source) - F.instr(F.reverse(source), "}") + 1
    braces = F.when((opened > 0) & (F.instr(source, "}") > 0) & (last > opened), F.substr(source, opened + 1, last - opened - 1))
    return F.when(F.rlike(source, F.lit(tag)), F.regexp_extract(source, tag, 1)).otherwise(braces)


def only_returns_literal(source: Column) -> Column:
    """Whether a function does nothing but return a literal or nothing; false for an unknown shape."""
    body = function_body(source)
    for pattern in (r"(?s)<!---.*?--->", r"(?s)/\*.*?\*/", r"//[^\n]*"):
        body = F.regexp_replace(body, pattern, "")
    body = F.regexp_replace(body, r"\A\s+|\s+\z", "")
    tag = rf"(?i)\A(?:<cfargument\b[^>]*>\s*)*<cfreturn\b(?:\s+{LITERAL}\s*)?/?\s*>\s*\z"
    script = rf"(?i)\Areturn(?:\s+{LITERAL})?\s*;?\s*\z"
    return F.coalesce(F.rlike(body, F.lit(tag)) | F.rlike(body, F.lit(script)), F.lit(False))


def tag_attributes(tag: Column) -> Column:
    """A map of a tag's quoted attributes, keys in lower case; of a key that comes twice the last one counts."""
    pattern = r"([a-zA-Z_][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    keys = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), F.lower)
    double, single = (F.regexp_extract_all(tag, F.lit(pattern), F.lit(g)) for g in (2, 3))
    entries = F.transform(F.arrays_zip(keys.alias("k"), double.alias("d"), single.alias("s")), lambda e: F.struct(e["k"].alias("k"), F.concat(F.coalesce(e["d"], F.lit("")), F.coalesce(e["s"], F.lit(""))).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["k"])))


def indent_of(line: Column) -> Column:
    """The width of a line's leading blanks; a tab counts as four."""
    lead = F.regexp_extract(line, "^[ \t]*", 0)
    return F.char_length(F.replace(lead, F.lit("\t"), F.lit("    "))).cast("long")


def symbol_list(text: Column) -> Column:
    """The names in ``%i[a b]`` or ``[:a, :b]``."""
    words = F.regexp_extract(text, r"%[iI]\[([^\]]*)\]", 1)
    names = F.split(F.regexp_extract(text, r"\[([^\]]*)\]", 1), ",")
    plain = F.filter(F.split(words, r"\s+"), lambda w: w != "")
    named = F.filter(F.transform(names, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), "^:", "")), lambda s: s != "")
    return F.when(F.rlike(text, F.lit(r"%[iI]\[[^\]]*\]")), plain).otherwise(named)


def marked(text: Column, signs: str = ",=:") -> Column:
    """``text`` with a mark before each of ``signs`` that stands in no bracket."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        after = acc["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        top = (after == 0) & F.contains(F.lit(signs), c) & (c != "")
        return F.struct(after.alias("depth"), F.concat(acc["out"], F.when(top, MARK).otherwise(""), c).alias("out"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), start, step, lambda a: a["out"])


def split_top(text: Column) -> Column:
    """A list cut at the commas that stand in no bracket; nothing is trimmed."""
    return F.split(marked(text, ","), MARK + ",")


def first_argument(text: Column) -> Column:
    return split_top(text)[0]


def closing(text: Column, at: Column, opens: str = "(", closes: str = ")", strings: bool = False) -> Column:
    """The position, from 1, of the bracket that closes the one at ``at``; 0 if none does. With ``strings`` quoted brackets do not count."""
    rest = F.split(F.substr(text, at), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("hit"), F.lit("").alias("quote"), F.lit("").alias("before"))

    def step(a: Column, c: Column) -> Column:
        quote = F.lit("")
        if strings:
            inside = a["quote"] != ""
            quote = F.when(inside, F.when((c == a["quote"]) & (a["before"] != "\\"), "").otherwise(a["quote"])).when(c.isin('"', "'"), c).otherwise("")
            free = ~inside & ~c.isin('"', "'")
        else:
            free = F.lit(True)
        depth = a["depth"] + F.when(free & (c == opens), 1).when(free & (c == closes), -1).otherwise(0)
        hit = F.when((a["hit"] == 0) & free & (c == closes) & (depth == 0), a["pos"] + 1).otherwise(a["hit"])
        return F.struct(depth.alias("depth"), (a["pos"] + 1).alias("pos"), hit.alias("hit"), quote.alias("quote"), c.alias("before"))

    hit = F.aggregate(rest, start, step, lambda a: a["hit"])
    return F.when(hit > 0, hit + at - 1).otherwise(0)


def balanced(text: Column, at: Column) -> Column:
    """What is inside the parenthesis that opens at ``at``; null if it does not close."""
    end = closing(text, at)
    return F.when(end > 0, F.substr(text, at + 1, end - at - 1))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _bare(c: Column) -> Column:
    return _trim(F.replace(c, F.lit(MARK), F.lit("")))


def _parameter(name: Column, kind: Column) -> Column:
    return F.struct(name.alias("name"), F.nullif(kind, F.lit("")).alias("type"))


def _pieces(text: Column, signs: str) -> Column:
    pieces = F.transform(F.split(marked(text, "," + signs), MARK + ","), _trim)
    return F.filter(pieces, lambda p: p != "")


def python_parameters(text: Column) -> Column:
    """(name, type) of the parameters of a Python function; bare stars and slashes are dropped."""
    def one(p: Column) -> Column:
        p = F.regexp_replace(p, r"^\*+", "")
        colon, equal = F.instr(p, MARK + ":"), F.instr(p, MARK + "=")
        typed = (colon > 0) & ((equal == 0) | (colon < equal))
        name = F.when(typed, F.substring_index(p, MARK + ":", 1)).otherwise(F.substring_index(p, MARK + "=", 1))
        kind = F.when(typed, F.substring_index(F.substr(p, colon + 2), MARK + "=", 1)).otherwise("")
        return _parameter(_bare(name), _bare(kind))

    return F.transform(F.filter(_pieces(text, "=:"), lambda p: ~p.isin("*", "/")), one)


def ruby_parameters(text: Column) -> Column:
    """(name, type) of the parameters of a Ruby method: the name behind stars and ampersands."""
    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^[*&]*\s*(\w+)", 1)
        return _parameter(F.when(name == "", p).otherwise(name), F.lit(""))

    return F.transform(_pieces(text, ""), one)


# Types of parameters that are built in.
SCRIPT_TYPES = tuple("any array binary boolean date guid numeric query string struct uuid void xml integer float".split())


def script_parameters(text: Column) -> Column:
    """(name, type) of the parameters of a script function: default and ``required`` dropped; a first word is a type if it is built in or begins with a capital."""
    def one(p: Column) -> Column:
        words = F.filter(F.split(_trim(F.regexp_replace(_trim(F.substring_index(p, MARK + "=", 1)), r"(?i)^required\s+", "")), r"\s+"), lambda w: w != "")
        typed = (F.size(words) > 1) & (F.lower(words[0]).isin(*SCRIPT_TYPES) | F.rlike(words[0], F.lit("^[A-Z]")))
        name = F.when(typed, F.get(words, F.lit(1))).otherwise(F.element_at(words, -1))
        return _parameter(name, F.when(typed, words[0]).otherwise(""))

    declared = F.filter(_pieces(text, "="), lambda p: _trim(F.regexp_replace(F.substring_index(p, MARK + "=", 1), r"(?i)^\s*required\s+", "")) != "")
    return F.transform(declared, one)


def first_distinct(values: Column, most: int) -> Column:
    """The first ``most`` different values, in order."""
    return F.slice(F.array_distinct(values), 1, most)


def jpa_models(source: Column) -> Column:
    """Models of repositories that are called: ``userRepository.`` gives ``User``."""
    found = F.regexp_extract_all(source, F.lit(r"\b([a-zA-Z]\w*)Repository\."), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.upper(F.substring(m, 1, 1)), F.substr(m, F.lit(2)))))


# Methods of models, and classes that are none.
RECORD_METHODS = tuple(
    """
    all find find_by find_by! find_or_create_by find_or_initialize_by where first last count sum average minimum maximum ids pluck exists?
    any? many? create create! update_all destroy_all delete_all insert upsert insert_all upsert_all new build
    """.split()
)
RUBY_CLASSES = tuple("Array Hash String Integer Float Symbol Numeric Range Regexp Proc IO File Dir Time Thread Struct Set Pathname".split())


def record_models(source: Column) -> Column:
    """Capitalised names on which a method of models is called, but for classes of the language."""
    pattern = F.lit(r"\b([A-Z][A-Za-z0-9_]*)\.([a-z_!?]+)")
    pairs = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("m"), F.regexp_extract_all(source, pattern, F.lit(2)).alias("f"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["f"].isin(*RECORD_METHODS) & ~p["m"].isin(*RUBY_CLASSES)), lambda p: p["m"]))


def manager_models(source: Column) -> Column:
    """Names before ``.objects.``."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\.objects\."), F.lit(1)))


def sql_tables(source: Column, most: int = 20) -> Column:
    """The tables that queries in tags and calls name behind from, update, into or join: the last dotted part without quotes."""
    tags = F.regexp_extract_all(source, F.lit(r"(?is)(<cfquery.*?</cfquery>)"), F.lit(1))
    call = F.lit(r"(?i)\bqueryExecute\s*\(\s*(?:\"([^\"]*)\"|'([^']*)')")
    calls = F.transform(F.arrays_zip(F.regexp_extract_all(source, call, F.lit(1)).alias("a"), F.regexp_extract_all(source, call, F.lit(2)).alias("b")), lambda z: F.concat(F.coalesce(z["a"], F.lit("")), F.coalesce(z["b"], F.lit(""))))
    names = F.flatten(F.transform(F.concat(tags, calls), lambda q: F.regexp_extract_all(q, F.lit("(?i)\\b(?:from|update|into|join)\\s+([\\w.\\[\\]\"`]+)"), F.lit(1))))
    last = F.transform(names, lambda t: F.regexp_replace(F.substring_index(t, ".", -1), "[\\[\\]\"`]", ""))
    return first_distinct(F.filter(last, lambda t: F.rlike(t, F.lit(r"^[a-zA-Z_]\w*$"))), most)


# Words before a parenthesis that are no calls worth naming.
NO_CALLS = {
    "ruby": tuple(
        """
        if unless while until for do begin rescue ensure raise require require_relative include extend prepend def class module end puts print
        pp return yield super and or not when case then break next redo retry attr_reader attr_writer attr_accessor
        new to_a to_h to_sym to_str to_f to_r to_c to_proc each_with_index each_with_object inject flat_map group_by partition tally min_by
        max_by sort_by take_while drop_while chunk_while slice_when printf sprintf debug info warn error fatal
        """.split()
    ),
    "python": tuple(
        """
        if elif else for while with try except finally raise return yield import from class def lambda pass break continue not and or in is
        print isinstance issubclass type len range enumerate zip map filter sorted reversed list dict set tuple str int float bool bytes object
        super vars dir hasattr getattr setattr delattr next iter open repr format abs min max sum any all input property staticmethod classmethod
        """.split()
    ),
    "java": tuple(
        """
        equals hashCode toString getClass stream parallelStream flatMap reduce collect sorted distinct peek limit skip findFirst findAny anyMatch
        allMatch noneMatch toList toArray toSet toMap ofNullable isPresent orElse orElseGet orElseThrow ifPresent ifPresentOrElse debug info warn
        error trace isDebugEnabled isInfoEnabled isWarnEnabled isErrorEnabled isTraceEnabled
        """.split()
    ),
    "cfml": tuple(
        """
        if else for while switch case do function return var local and or not true false len isdate isnull isvalid structkeyexists arraylen
        arraynew structnew querynew createobject createodbcdatetime createdate trim lcase ucase left right mid find listfindnocase listfind
        listappend listgetat listlen fileexists directoryexists now dateformat dateadd datediff datepart datecompare parsedatetime lsparsedate
        lsdateformat lstimeformat timeformat numberformat rereplace rereplacenocase serializejson deserializejson urlencodedformat urldecode
        htmleditformat xmlformat paramexists getmetadata gettickcount valueof iif evaluate writelog
        """.split()
    ),
}
DEFINITION = {"ruby": r"^\s*def\s", "python": r"^\s*(async\s+)?def\s"}


def called(source: Column, language: str, most: int = 30) -> Column:
    """Names before an opening parenthesis, of three characters or more, but for words of the language; lines that define a function do not count."""
    if language in DEFINITION:
        source = F.array_join(F.filter(F.split(source, "\n"), lambda s: ~F.rlike(s, F.lit(DEFINITION[language]))), "\n")
    names = F.regexp_extract_all(source, F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1))
    same = F.lower if language == "cfml" else (lambda x: x)
    kept = F.filter(names, lambda n: (F.char_length(n) >= 3) & ~same(n).isin(*NO_CALLS[language]))
    if language == "cfml":
        invoked = F.regexp_extract_all(source, F.lit(r"(?i)<cfinvoke\b[^>]*\bmethod\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
        kept = F.concat(kept, F.filter(invoked, lambda n: ~F.lower(n).isin(*NO_CALLS["cfml"])))
    return first_distinct(kept, most)


# Actions of a resource, with their verb and the end of their path.
REST = {"index": ("GET", ""), "show": ("GET", "/:id"), "new": ("GET", "/new"), "create": ("POST", ""), "edit": ("GET", "/:id/edit"), "update": ("PATCH", "/:id"), "destroy": ("DELETE", "/:id")}
VIEW_ACTIONS = {"list": ("GET", ""), "retrieve": ("GET", "/:id"), "create": ("POST", ""), "update": ("PUT", "/:id"), "partial_update": ("PATCH", "/:id"), "destroy": ("DELETE", "/:id")}
VERBS = tuple("get post put patch delete head options".split())


def _route(table: dict[str, tuple[str, str]], action: Column, resource: Column) -> Column:
    out = F.lit(None).cast("struct<method:string,path:string>")
    for name, (verb, end) in table.items():
        out = F.when(action == name, F.struct(F.lit(verb).alias("method"), F.concat(F.lit("/"), resource, F.lit(end)).alias("path"))).otherwise(out)
    return out


def rest_route(action: Column, resource: Column) -> Column:
    """(method, path) of an action of a resource; null for other names."""
    return _route(REST, action, resource)


def view_route(action: Column, resource: Column) -> Column:
    """(method, path) of a method of a view: verbs have the path of any resource, actions that of theirs; null for other names."""
    verb = F.when(action.isin(*VERBS), F.struct(F.upper(action).alias("method"), F.lit("/:resource").alias("path")))
    return F.coalesce(verb, _route(VIEW_ACTIONS, action, resource))
