"""Queries that parse source files, with oracle SQL: what a reader finds in each of a few files.

``source_files`` gives each document one of the files below; ``@@`` stands for a number of the document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsers
from .base import query
from .code_queries import sql_text
from .views import table

#: (path, content, (name, kind, first line, last line, route, notes) of each candidate).
FILES: tuple[tuple[str, str, tuple[tuple[str, str, int, int, str, str], ...]], ...] = (
    (
        "src/@@/HelloController.java",
        'package a;\n\n@RestController\n@RequestMapping("/api")\npublic class HelloController@@ {\n  // } not an end\n  @GetMapping("/hello")\n  public String hello(String who) {\n    mailSender.send(who);\n    return "}";\n  }\n\n  public String getName() { return name; }\n\n  @PostMapping(value = "save", produces = "x")\n  void save(int a, Map<String, Integer> b) {\n    jdbc.prepareCall(a);\n    go();\n  }\n\n  static void main(String[] a) { run(); go(); }\n}\n',
        (("HelloController@@.hello", "controller-method", 7, 11, "GET /api/hello", "Sends email"), ("HelloController@@.save", "controller-method", 15, 19, "POST /api/save", "Calls stored procedure")),
    ),
    (
        "app/u@@_items_controller.rb",
        "class U@@ItemsController < Base\n  before_action :login, except: [:index]\n\n  def index\n    @items = Item.all\n    @items.each do |i|\n      show_it(i)\n    end\n  end\n\n  def tidy(a, b: 1)\n    if a\n      Rails.cache.clear\n    end\n  end\n\n  private\n\n  def hidden\n  end\nend\n",
        (("U@@ItemsController#index", "rails-action", 4, 9, "GET /u@@_items", ""), ("U@@ItemsController#tidy", "function", 11, 15, "", "before_action: :login; Mutates application cache")),
    ),
    (
        "shop@@/views.py",
        "@login_required\ndef index(request, page: int = 1):\n    send_mail(a)\n\n    return 1\n\n\ndef helper(x):\n    return x\n\n\nclass PetView@@(LoginRequiredMixin, View):\n    model = Pet\n\n    def get(self, request):\n        return 1\n\n    def other(self):\n        return 2\n",
        (("index", "django-view", 1, 5, "", "auth: login_required; Sends email (Django mail)"), ("PetView@@#get", "django-view", 15, 16, "GET /:resource", "auth: login_required")),
    ),
    (
        "cf/c@@.cfc",
        '<cfcomponent>\n<!--- a\ncomment --->\n<cffunction name="hello@@" access="remote">\n  <cfargument name="who" type="string">\n  <cfhttp url="x">\n</cffunction>\n<cffunction name="own" access="private"></cffunction>\n</cfcomponent>',
        (("hello@@", "cf-tag-function", 4, 7, "", "access: remote (HTTP-callable via CFC remoting); Makes outbound HTTP request (cfhttp)"),),
    ),
    ("app/models/user@@.rb", "class User\n  def x\n  end\nend\n", ()),
)


def source_files(spark, sf_dir):
    i = F.col("doc_id")
    number = (i % 50).cast("string")
    rows = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c, _ in FILES))
    f = table(spark, sf_dir, "documents").select("doc_id", F.get(rows, (i % len(FILES)).cast("int")).alias("f"))
    filled = lambda c: F.replace(c, F.lit("@@"), number)
    return f.select(F.concat("doc_id", F.lit("/"), filled("f.path")).alias("relative_path"), filled("f.content").alias("content"))


_ROWS = ", ".join(f"({k}, {sql_text(f[0])}, {sql_text(n)}, '{kind}', {a}, {b}, {sql_text(route)}, {sql_text(found)})" for k, f in enumerate(FILES) for n, kind, a, b, route, found in f[2])
_FILLED = "replace({}, '@@', (doc_id % 50)::VARCHAR)"


@query(f"SELECT doc_id || '/' || {_FILLED.format('path')} AS relative_path, {_FILLED.format('name')} AS name, kind, line_start, line_end, {_FILLED.format('route')} AS route, notes FROM documents JOIN (VALUES {_ROWS}) f(k, path, name, kind, line_start, line_end, route, notes) ON doc_id % {len(FILES)} = k")
def parse_files(spark, sf_dir):
    h = F.col("hints")
    route = F.when(h["http_route"].isNotNull(), F.concat(h["http_route"]["method"], F.lit(" "), h["http_route"]["path"])).otherwise("")
    return parsers.parse(source_files(spark, sf_dir)).select("relative_path", "name", "kind", "line_start", "line_end", route.alias("route"), F.coalesce(F.array_join(h["notes"], "; "), F.lit("")).alias("notes"))
