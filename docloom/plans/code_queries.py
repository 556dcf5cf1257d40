"""Queries on source text: functions that look at code, with oracle SQL.

Raw tables hold no code, so ``functions`` picks one of the sources below for each document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code, notes, settings
from .base import query
from .views import table

#: (language, source, annotations); ``@@`` stands for a number of the document.
SOURCES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("java", '@PostMapping("/a")\npublic String save@@(Owner o) {\n  ownerRepository.save(o); /* twice */\n  this.petRepository.findAll().stream();\n  mailSender.send(m);\n  return "ok";\n}', ("PostMapping", "Transactional")),
    ("java", "public int zero() {\n  // nothing\n  return -1.5;\n}", ("Async", "CacheEvict")),
    ("java", "void run@@() {\n  Runtime.getRuntime().exec(cmd);\n  Files.delete(path);\n  restTemplate.getForObject(url);\n  publisher.publishEvent(e);\n}", ()),
    ("java", "void call(Connection c) {\n  c.prepareCall(sql);\n  transactionTemplate.execute(s -> kafkaTemplate.send(x));\n}", ("TransactionAttribute",)),
    ("ruby", "def create@@\n  @user = User.find_by(id: 1)\n  Order.create!(params)\n  String.new\n  UserMailer.hello.deliver_later\n  SyncJob.perform_async(1)\n  render_page(x, y)\nend", ()),
    ("ruby", "def wipe\n  system('ls')\n  Rails.cache.clear\n  Account.transaction do\n    File.open(p, 'w')\n  end\n  db.execute(\"CALL tidy()\")\n  HTTParty.get(u)\nend", ()),
    ("python", "def index@@(request):\n    items = Item.objects.filter(a=1)\n    Tag.objects.all()\n    send_mail(s, b, f, t)\n    sync.delay(1)\n    requests.post(url)\n    return render(request, t)", ()),
    ("python", "def wipe(request, path):\n    with transaction.atomic():\n        cache.delete(k)\n    cursor.callproc('p')\n    subprocess.run(cmd)\n    open(path, 'w').write(x)\n    producer.publish(m)", ()),
    ("cfml", '<cffunction name="get@@" access="remote" ACCESS=\'public\' roles="admin">\n<!--- a\nb --->\n<cfquery name="q">SELECT * FROM dbo.[Users] JOIN orders o</cfquery>\n<cfmail to="x"></cfmail>\n<cfstoredproc procedure="sp_x">\n</cffunction>', ()),
    ("cfml", '<cffunction name="flag"><cfargument name="a"><cfreturn true/></cffunction>', ()),
    ("cfml", "function save(required string name, numeric n = max(1, 2)) {\n  queryExecute(\"update items set a = 1\");\n  fileWrite(p, x);\n  transaction { doWork(); entitySave(x); }\n  announceEvent('onSave');\n  createObject(\"component\", \"lib.Mail@@\");\n}", ()),
    ("cfml", "<cfsetting showdebugoutput=\"no\">\n<cfinclude template=\"h.cfm\">\n<cfscript>\n// note\nx = 1;\n</cfscript>\n<cf_header>\n<cfmodule template=\"f.cfm\">", ()),
)


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def functions(spark, sf_dir):
    i = F.col("doc_id")
    rows = F.array(*(F.struct(F.lit(lang).alias("language"), F.lit(source).alias("source"), F.array(*(F.lit(a) for a in marks)).cast("array<string>").alias("annotations")) for lang, source, marks in SOURCES))
    picked = table(spark, sf_dir, "documents").select("doc_id", F.get(rows, (i % len(SOURCES)).cast("int")).alias("s"))
    return picked.select("doc_id", "s.language", F.replace("s.source", F.lit("@@"), (i % 50).cast("string")).alias("source"), "s.annotations")


def _list(values) -> str:
    return "[" + ", ".join(values) + "]"


FUNCTIONS = f"""functions AS (SELECT doc_id, {_list(sql_text(s[0]) for s in SOURCES)}[doc_id % {len(SOURCES)} + 1] AS language,
  replace({_list(sql_text(s[1]) for s in SOURCES)}[doc_id % {len(SOURCES)} + 1], '@@', (doc_id % 50)::VARCHAR) AS source,
  {_list(_list(map(sql_text, s[2])) + '::VARCHAR[]' for s in SOURCES)}[doc_id % {len(SOURCES)} + 1] AS annotations FROM documents)"""


def _rule_sql(lang: str, note: str, patterns, marks) -> str:
    tests = [f"regexp_matches(source, {sql_text(p)})" for p in patterns] + [f"list_contains(annotations, {sql_text(m)})" for m in marks]
    return f"CASE WHEN language = '{lang}' AND ({' OR '.join(tests)}) THEN {sql_text(note)} END"


@query(f"WITH {FUNCTIONS} SELECT doc_id, array_to_string(list_filter({_list(_rule_sql(*r) for r in notes.RULES)}, lambda x: x IS NOT NULL), '; ') AS notes FROM functions")
def note_rules(spark, sf_dir):
    return functions(spark, sf_dir).select("doc_id", F.array_join(notes.side_effects(F.col("language"), F.col("source"), F.col("annotations")), "; ").alias("notes"))


@query(f"WITH {FUNCTIONS}, m AS (SELECT doc_id, regexp_extract(source, '(?is)<cffunction\\b[^>]*>(.*?)</cffunction\\s*>', 1) AS tag, regexp_matches(source, '(?is)<cffunction\\b[^>]*>(.*?)</cffunction\\s*>') AS tagged, regexp_extract(source, '(?s)\\A[^)]*\\)[^{{]*\\{{(.*)\\}}', 1) AS script FROM functions), b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN tagged THEN tag ELSE script END, '(?s)<!---.*?--->', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), ' ' || chr(10)) AS body FROM m) SELECT doc_id, regexp_matches(body, '(?i)\\Areturn(\\s+{code.LITERAL.replace(chr(39), chr(39) * 2)})?\\s*;?\\s*\\z') OR regexp_matches(body, '(?i)\\A(<cfargument\\b[^>]*>\\s*)*<cfreturn\\b(\\s+{code.LITERAL.replace(chr(39), chr(39) * 2)}\\s*)?/?\\s*>\\s*\\z') AS constant FROM b")
def constant_return(spark, sf_dir):
    return functions(spark, sf_dir).select("doc_id", code.only_returns_literal(F.col("source")).alias("constant"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '(?s)<!---.*?--->|/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '(?i)</?cf(script|silent)\\b[^>]*>', '', 'g'), '(?i)<cf(setting|include)\\b[^>]*>', '', 'g'), chr(10)), lambda l: regexp_matches(l, '\\S')))::BIGINT AS n FROM functions")
def exec_lines(spark, sf_dir):
    return functions(spark, sf_dir).select("doc_id", code.executable_lines(F.col("source")).alias("n"))


@query(f"WITH {FUNCTIONS} SELECT doc_id FROM functions WHERE language = 'cfml' AND doc_id % {len(SOURCES)} <> 9")
def stub_pages(spark, sf_dir):
    """CFML sources that do something in three lines or more."""
    return functions(spark, sf_dir).where((F.col("language") == "cfml") & (code.executable_lines(F.col("source")) >= 3)).select("doc_id")


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'Users,orders' WHEN 10 THEN 'items' ELSE '' END AS tables FROM functions")
def table_refs(spark, sf_dir):
    return functions(spark, sf_dir).select("doc_id", F.array_join(code.sql_tables(F.col("source")), ",").alias("tables"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 0 THEN 'Owner,Pet' WHEN 4 THEN 'User,Order' WHEN 5 THEN '' WHEN 6 THEN 'Item,Tag' ELSE '' END AS models FROM functions")
def orm_models(spark, sf_dir):
    lang, source = F.col("language"), F.col("source")
    models = F.when(lang == "java", code.jpa_models(source)).when(lang == "ruby", code.record_models(source)).when(lang == "python", code.manager_models(source))
    return functions(spark, sf_dir).select("doc_id", F.coalesce(F.array_join(models, ","), F.lit("")).alias("models"))


_CALLS = {4: "find_by,render_page", 5: "system,clear,open,execute,tidy,get", 6: "filter,all,send_mail,delay,post,render", 7: "atomic,delete,callproc,run,write,publish", 8: "", 9: "", 10: "save,max,queryExecute,fileWrite,doWork,entitySave,announceEvent", 11: ""}


@query(f"WITH {FUNCTIONS} SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(array_to_string(list_filter(string_split(source, chr(10)), lambda l: language = 'cfml' OR NOT regexp_matches(l, '^\\s*(async\\s+)?def\\s')), chr(10)), '\\b([a-zA-Z_]\\w*)\\s*\\(', 1), lambda n: length(n) >= 3 AND NOT list_contains(CASE language WHEN 'ruby' THEN {_list(map(sql_text, code.NO_CALLS['ruby']))} WHEN 'python' THEN {_list(map(sql_text, code.NO_CALLS['python']))} ELSE {_list(map(sql_text, code.NO_CALLS['cfml']))} END, CASE WHEN language = 'cfml' THEN lower(n) ELSE n END)))) AS calls FROM (SELECT doc_id, language, CASE WHEN language = 'java' THEN '' ELSE source END AS source FROM functions)")
def call_names(spark, sf_dir):
    lang, source = F.col("language"), F.col("source")
    calls = F.when(lang == "ruby", code.called(source, "ruby")).when(lang == "python", code.called(source, "python")).otherwise(code.called(source, "cfml"))
    # names in Java sources are the grammar's to tell
    return functions(spark, sf_dir).select("doc_id", F.when(lang == "java", F.array().cast("array<string>")).otherwise(F.array_sort(calls)).alias("calls"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 8 THEN replace(source, '<!--- a' || chr(10) || 'b --->', chr(10)) WHEN 0 THEN replace(source, '/* twice */', '') ELSE source END AS source FROM functions")
def strip_comments(spark, sf_dir):
    return functions(spark, sf_dir).select("doc_id", code.without_comments(F.col("source")).alias("source"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'get' || (doc_id % 50) WHEN 9 THEN 'flag' END AS name, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'public' END AS access, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'admin' END AS roles FROM functions")
def tag_values(spark, sf_dir):
    tag = code.tag_attributes(F.regexp_extract("source", "(?i)<cffunction([^>]*)>", 1))
    return functions(spark, sf_dir).select("doc_id", tag["name"].alias("name"), tag["access"].alias("access"), tag["roles"].alias("roles"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE WHEN instr(source, 'return') > 0 THEN 1 + length(substr(source, 1, instr(source, 'return') - 1)) - length(replace(substr(source, 1, instr(source, 'return') - 1), chr(10), '')) END::BIGINT AS line FROM functions")
def line_numbers(spark, sf_dir):
    at = F.instr("source", "return")
    return functions(spark, sf_dir).select("doc_id", F.when(at > 0, code.line_of(F.col("source"), at - 1)).cast("long").alias("line"))


@query(f"WITH {FUNCTIONS}, l AS (SELECT doc_id, unnest(string_split(replace(source, '    ', '  ' || chr(9)), chr(10))) AS line FROM functions WHERE language = 'python') SELECT doc_id, line, (length(regexp_extract(line, '^[ \\t]*')) + 3 * (length(regexp_extract(line, '^[ \\t]*')) - length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), ''))))::BIGINT AS indent FROM l")
def line_indents(spark, sf_dir):
    lines = functions(spark, sf_dir).where("language = 'python'").select("doc_id", F.explode(F.split(F.replace("source", F.lit("    "), F.lit("  \t")), "\n")).alias("line"))
    return lines.select("doc_id", "line", code.indent_of(F.col("line")).alias("indent"))


@query("SELECT c_custkey, regexp_replace(c_name, '#0*', ' #') || '' AS name, upper(substr(t, 1, 1)) || substr(t, 2) || ' (DRAFT)' AS title FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '#0*', ' #'), '([A-Z])', ' \\1', 'g'), '[._]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM customer)")
def draft_titles(spark, sf_dir):
    name = F.regexp_replace("c_name", "#0*", " #")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), code.draft_title(name).alias("title"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), '') || 'Controller' AS class, CASE WHEN p_partkey % 5 = 0 THEN '/' || p_size WHEN p_partkey % 5 = 4 THEN '/api/' ELSE '/api/' || p_size END AS path FROM part")
def class_and_path(spark, sf_dir):
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    prefix = F.when(i % 5 == 0, "").when(i % 5 == 1, "/api").otherwise("/api/")
    suffix = F.when(i % 5 == 4, "").when(i % 5 == 2, size).otherwise(F.concat(F.lit("/"), size))
    file = F.concat(F.lit("app/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_Controller.RB"))
    return table(spark, sf_dir, "part").select("p_partkey", code.class_of_file(file).alias("class"), code.join_paths(prefix, suffix).alias("path"))


#: Parameter lists and what they hold, by language.
_PARAMETERS = (
    ("python", "self, request, pk: int = 5, *args, q: Dict[str, int] = {'a': 1}, *, **kw", "self: request: pk:int args: q:Dict[str, int] kw:"),
    ("python", " ", ""),
    ("ruby", "name, age: 18, items = [1, 2, 3], *rest, **opts, &block", "name: age: items: rest: opts: block:"),
    ("script", "required string name, numeric n = max(1, 2), Foo bar, x, required y", "name:string n:numeric bar:Foo x: y:"),
    ("script", "odd word", "word:"),
)


@query("SELECT n_nationkey, " + _list(sql_text(p[2]) for p in _PARAMETERS) + f"[n_nationkey % {len(_PARAMETERS)} + 1] AS parameters FROM nation")
def parameter_lists(spark, sf_dir):
    k = (F.col("n_nationkey") % len(_PARAMETERS)).cast("int")
    text = F.get(F.array(*(F.lit(p[1]) for p in _PARAMETERS)), k)
    lang = F.get(F.array(*(F.lit(p[0]) for p in _PARAMETERS)), k)
    found = F.when(lang == "python", code.python_parameters(text)).when(lang == "ruby", code.ruby_parameters(text)).otherwise(code.script_parameters(text))
    shown = F.array_join(F.transform(found, lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type"], F.lit("")))), " ")
    return table(spark, sf_dir, "nation").select("n_nationkey", shown.alias("parameters"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'f(a, [1, 2])' WHEN 1 THEN 'login_required' ELSE '(1, (2, 3))' END AS first, CASE n_nationkey % 3 WHEN 0 THEN 'a, [1, 2]' WHEN 1 THEN NULL ELSE '1, (2, 3)' END AS inner_, CASE n_nationkey % 3 WHEN 0 THEN 'show,edit' WHEN 1 THEN 'a,b' ELSE '' END AS symbols FROM nation")
def bracket_parts(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "f(a, [1, 2]), x").when(k == 1, "login_required, name='d('").otherwise("(1, (2, 3)), (4")
    symbols = F.when(k == 0, "[:show, :edit]").when(k == 1, "%i[a b]").otherwise("none")
    return table(spark, sf_dir, "nation").select("n_nationkey", code.first_argument(text).alias("first"), F.when(k == 1, None).otherwise(code.balanced(text, F.instr(text, "("))).alias("inner_"), F.array_join(code.symbol_list(symbols), ",").alias("symbols"))


@query("SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 20 ELSE 0 END::BIGINT AS at FROM nation")
def brace_ends(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 2 == 0, 'x { a = "}"; { b } } }').otherwise('{ "}" ')
    return table(spark, sf_dir, "nation").select("n_nationkey", code.closing(text, F.instr(text, "{"), "{", "}", strings=True).cast("long").alias("at"))


_RESOURCE = "lower(regexp_replace(regexp_replace(replace(p_brand, '#', 'Line'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
_ACTIONS = "['index', 'show', 'new', 'create', 'edit', 'update', 'destroy', 'search']"


@query(f"SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'GET /' || r WHEN 1 THEN 'GET /' || r || '/:id' WHEN 2 THEN 'GET /' || r || '/new' WHEN 3 THEN 'POST /' || r WHEN 4 THEN 'GET /' || r || '/:id/edit' WHEN 5 THEN 'PATCH /' || r || '/:id' WHEN 6 THEN 'DELETE /' || r || '/:id' END AS rest, CASE p_partkey % 8 WHEN 3 THEN 'POST /' || r WHEN 5 THEN 'PUT /' || r || '/:id' WHEN 6 THEN 'DELETE /' || r || '/:id' END AS view FROM (SELECT *, {_RESOURCE} AS r FROM part)")
def rest_routes(spark, sf_dir):
    from ..functions.text import snake_resource

    action = F.get(F.array(*(F.lit(a) for a in ("index", "show", "new", "create", "edit", "update", "destroy", "search"))), (F.col("p_partkey") % 8).cast("int"))
    resource = snake_resource(F.replace("p_brand", F.lit("#"), F.lit("Line")))
    shown = lambda r: F.when(r.isNotNull(), F.concat(r["method"], F.lit(" "), r["path"]))
    return table(spark, sf_dir, "part").select("p_partkey", shown(code.rest_route(action, resource)).alias("rest"), shown(code.view_route(action, resource)).alias("view"))


@query(f"WITH {FUNCTIONS} SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'Calls stored procedure(s): sp_x' END AS procedures, CASE doc_id % {len(SOURCES)} WHEN 10 THEN 'Fires plugin events: onSave; Calls ORM functions: entitysave; Dynamically instantiates components: lib.Mail' || (doc_id % 50) WHEN 11 THEN 'Invokes custom tags: cf_header, cfmodule:f.cfm' ELSE '' END AS found, doc_id % 4 = 1 AS entity, CASE doc_id % 3 WHEN 0 THEN 'ColdFusion lifecycle hook: {notes.HOOKS['onerror']}' END AS hook FROM functions")
def markup_notes(spark, sf_dir):
    i, source = F.col("doc_id"), F.col("source")
    part = F.when(i % 4 == 1, 'component entityname="A" persistent="true" {').when(i % 4 == 2, '<cfcomponent persistent="false">').otherwise("component { x = persistent }")
    return functions(spark, sf_dir).select("doc_id", notes.procedure_note(source).alias("procedures"), F.array_join(notes.markup_notes(source), "; ").alias("found"), notes.is_entity(part).alias("entity"), notes.hook_note(F.when(i % 3 == 0, "onError").otherwise("save")).alias("hook"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90) * 1000 WHEN 1 THEN NULL WHEN 2 THEN 28000 WHEN 3 THEN NULL END::BIGINT AS asked, CASE event_id % 5 WHEN 0 THEN least((event_id % 90) * 1000, 60000) WHEN 2 THEN 28000 ELSE floor((event_id % 10) / 10.0::DOUBLE * least(500 * pow(2, event_id % 9), 60000)) END::BIGINT AS delay_ms FROM events")
def retry_after(spark, sf_dir):
    i = F.col("event_id")
    header = F.when(i % 5 == 0, F.concat(F.lit(" "), i % 90)).when(i % 5 == 1, "soon").when(i % 5 == 2, "Wed, 21 Oct 2026 07:28:28 GMT").when(i % 5 == 3, "Tue, 20 Oct 2026 07:28:28 GMT")
    asked = settings.retry_after_ms(header, F.to_timestamp(F.lit("2026-10-21 07:28:00")))
    return table(spark, sf_dir, "events").select("event_id", asked.alias("asked"), settings.delay_ms(i % 9, (i % 10).cast("double") / 10, asked).alias("delay_ms"))


@query("WITH l AS (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS line FROM documents) SELECT doc_id, line::INTEGER AS line, CASE line WHEN 1 THEN 'A' WHEN 3 THEN 'B_2' WHEN 4 THEN 'C' WHEN 5 THEN 'D' WHEN 8 THEN 'A' END AS name, CASE line WHEN 1 THEN 'v' || doc_id WHEN 3 THEN 'x # y' WHEN 4 THEN 'plain' WHEN 5 THEN '\"open' WHEN 8 THEN 'again' END AS value, CASE line WHEN 6 THEN 'length=11, has ''=''=no, first-char-code=110' WHEN 7 THEN 'length=3, has ''=''=yes@1, first-char-code=49' END AS problem FROM l WHERE line <> 2")
def env_settings(spark, sf_dir):
    return settings.env_lines(_env(spark, sf_dir), key="doc_id")


def _env(spark, sf_dir):
    text = F.concat(F.lit("﻿A=v"), "doc_id", F.lit("\r\n# note\nexport B_2 = \"x # y\" # more\nC=plain # note\nD=\"open\nnot setting\n1=x\nA='again'"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("content"))


@query("SELECT doc_id, 2::BIGINT AS loaded, 3::BIGINT AS skipped FROM documents")
def env_loaded(spark, sf_dir):
    present = spark.createDataFrame([("B_2", "set"), ("C", ""), ("D", "x"), ("A", None)], "name string, value string")
    return settings.loaded(settings.env_lines(_env(spark, sf_dir), key="doc_id"), present, key="doc_id")


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'mock' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'anthropic' WHEN 4 THEN 'azure-openai' ELSE 'deepseek' END AS backend, CASE n_nationkey % 6 WHEN 1 THEN 'unknown backend: azure' WHEN 2 THEN 'deepseek: no key' END AS error FROM nation")
def backend_choice(spark, sf_dir):
    k = F.col("n_nationkey") % 6
    none = F.lit(None).cast("string")
    override = F.when(k == 1, "azure").when(k == 2, "deepseek").when(k == 3, "auto").otherwise(none)
    chosen = F.when(k == 3, "anthropic").when(k == 4, "azure-openai").otherwise(none)
    return table(spark, sf_dir, "nation").select("n_nationkey", settings.backend(k == 0, override, chosen, k == 5, F.lit(True), k == 4).alias("b")).select("n_nationkey", "b.*")


_DASHED = "'# Head — ' || doc_id || chr(10) || 'a — b—c— d `x — y` e' || chr(10) || '`open — ' || coalesce(text, '')"


@query("SELECT doc_id, '# Head: ' || doc_id || chr(10) || 'a, b, c, d `x — y` e' || chr(10) || '`open, ' || replace(coalesce(text, ''), '`', '') AS text FROM documents")
def dash_scrub(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# Head — "), "doc_id", F.lit("\na — b—c— d `x — y` e\n`open — "), F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit("")))
    return d.select("doc_id", settings.without_dashes(text).alias("text"))


@query("SELECT count(*) FILTER (doc_id % 3 <> 0) AS files, sum(CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END)::BIGINT AS removed FROM documents")
def dash_counts(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, "`a — b`").otherwise("a — b — c `—`")
    return settings.dash_totals(table(spark, sf_dir, "documents").select(text.alias("content")))


@query("SELECT n_nationkey, n_nationkey % 2 = 1 AS skipped FROM nation")
def skipped_paths(spark, sf_dir):
    path = F.when(F.col("n_nationkey") % 2 == 1, "a\\node_modules\\x.js").otherwise("a/modules/x.js")
    return table(spark, sf_dir, "nation").select("n_nationkey", settings.has_fragment(path, ("/node_modules/", "/.git/")).alias("skipped"))


@query("SELECT n_name || '.py' AS path, n_nationkey % 4 IN (0, 2) AS staged, n_nationkey % 4 IN (1, 2) AS unstaged, n_nationkey % 4 = 3 AS untracked FROM nation")
def git_changes(spark, sf_dir):
    code_of = F.get(F.array(F.lit("M "), F.lit(" M"), F.lit("AM"), F.lit("??")), (F.col("n_nationkey") % 4).cast("int"))
    return settings.git_status(table(spark, sf_dir, "nation").select(F.concat(code_of, F.lit(" "), "n_name", F.lit(".py")).alias("line")))


@query("SELECT 'sha' || n_nationkey AS sha, '2026-01-01' AS date, n_name AS subject FROM nation WHERE n_nationkey % 5 <> 0")
def git_history(spark, sf_dir):
    line = F.when(F.col("n_nationkey") % 5 == 0, "broken").otherwise(F.concat(F.lit("sha"), "n_nationkey", F.lit("\x1f2026-01-01\x1f"), "n_name"))
    return settings.git_log(table(spark, sf_dir, "nation").select(line.alias("line")))


@query("SELECT '/w/' || g AS path, CASE WHEN g % 2 = 0 AND n = 3 THEN 'b' || g END AS branch, g % 2 = 1 AND n = 3 AS detached FROM (SELECT n_nationkey // 3 AS g, count(*) AS n FROM nation GROUP BY 1)")
def git_trees(spark, sf_dir):
    i, g = F.col("n_nationkey"), F.expr("n_nationkey div 3")
    line = F.when(i % 3 == 0, F.concat(F.lit("worktree /w/"), g)).when(i % 3 == 1, "HEAD 0").when(g % 2 == 0, F.concat(F.lit("branch refs/heads/b"), g)).otherwise("detached")
    return settings.git_worktrees(table(spark, sf_dir, "nation").select(i.alias("n"), line.alias("line")))
