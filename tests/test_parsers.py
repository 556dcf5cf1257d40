"""Parsers on small sources, by what a reader of these sources expects."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import parsers

JAVA = '''package com.shop.service.x;

import a.b.C;

/** Serves owners. */
@RestController
@RequestMapping("/owners")
public class OwnerController {
    private final OwnerRepository ownerRepository;

    public OwnerController(OwnerRepository r) { this.ownerRepository = r; }

    // a brace in a comment {
    @GetMapping("/{id}")
    @PreAuthorize("hasRole('A}')")
    public String show(@PathVariable("id") int id, final Map<String, List<Integer>> q) {
        String s = "}";
        log.info("x");
        return render(ownerRepository.findById(id).orElseThrow());
    }

    @RequestMapping(method = RequestMethod.POST, value = "save")
    @Transactional
    String save(Owner... owners) throws IOException {
        mailSender.send(owners);
        Files.write(path, bytes);
        return "ok";
    }

    public String getName() { return name; }
    public static void main(String[] args) { run(); }
    public int total() { int a = 1; add(a); return a; }
}

@WebServlet("/old")
class Old extends HttpServlet {
    protected void doGet(HttpServletRequest req, HttpServletResponse res) { res.setStatus(200); go(); }
    void helper() { go(); }
}

class Plain { public void work() { a(); b(); } }

@State
class Bench { public void measure() { a(); b(); } }
'''

RUBY = """module Admin
  class UsersController < ApplicationController
    before_action :authenticate
    before_action :load_user, only: [:show, :edit]
    skip_before_action :authenticate, only: %i[index]

    def index
      @users = User.where(active: true)
      if params[:q]
        @users.each do |u|
          log_it(u)
        end
      end
    end

    # def hidden
    def show(id, format: :json, *rest)
      UserMailer.hello(id).deliver_later
    end

    def self.build
    end

    def search(
      text,
      url:
    )
      system('ls')
    end

    private

    def secret
    end
  end
end
"""

DJANGO = '''from django.views import View

@login_required
@permission_required(
    "a.b",
)
def index(request, page: int = 1):
    items = Item.objects.all()
    def inner(request):
        return 1

    return render(request, items)


def helper(x):
    return x


def _private_view(request):
    return 1


@method_decorator(login_required, name="dispatch")
class OrderViewSet(LoginRequiredMixin, viewsets.ModelViewSet):
    queryset = Order.objects.all()
    permission_classes = [
        IsAuthenticated,
        perms.IsAdmin,
    ]

    def list(self, request):
        return Response(self.queryset)

    @action(detail=True, methods=["post"])
    def pay(self, request, pk=None):
        charge.delay(pk)

    def helper(self):
        pass


class Plain:
    def get(self, request):
        pass
'''

CFC = """<cfcomponent persistent="true">
<!--- <cffunction name="gone"></cffunction>
--->
<cffunction name="hello" access="remote" roles="admin">
  <cfargument name="who" type="string">
  <cfquery name="q">select a from dbo.users</cfquery>
  <cfreturn greet(who)>
</cffunction>
<cffunction name="own" access="private"></cffunction>
<cffunction name="flag"><cfreturn true></cffunction>
</cfcomponent>
"""

SCRIPT = """component accessors=true {
  public string function save(required string name, numeric n = max(1, 2)) roles="boss" {
    var a = "}";
    queryExecute("update items set a = 1");
    return a;
  }
  private void function inner() { x(); }
  remote function onError() { cfmail(to="a"); }
}
"""

FILES = [
    ("src/OwnerController.java", JAVA), ("app/Admin/Users_Controller.RB", RUBY), ("app/models/user.rb", RUBY), ("shop/views.py", DJANGO), ("shop/models.py", DJANGO), ("a/Hello.cfc", CFC), ("a/Application.cfc", SCRIPT),
    ("a/page.cfm", "<cfset a = 1>\n<!--- x --->\n<cfset b = 2>\n<cf_head>\n"), ("a/stub.cfm", "<cfinclude template=\"x\">\n<cfset a = 1>"), ("a/x.java", None), ("a/views.py", ""), ("a/broken.java", "class { void ("), ("a/broken_views.py", "def f(request\nclass"), ("a/broken_controller.rb", "def x\nclass"), ("a/x.cs", "class A {}"),
]


@pytest.fixture(scope="module")
def got(spark):
    return found(spark)


def found(spark, **options):
    df = spark.createDataFrame([(*f, 1) for f in FILES], "relative_path string, content string, name int")
    return {(r.relative_path, r.name): r for r in parsers.parse(df, **options).collect()}


def test_candidates(spark, got):
    names = {path: sorted(n for p, n in got if p == path) for path, _ in FILES}
    assert names["src/OwnerController.java"] == ["Old.doGet", "OwnerController.save", "OwnerController.show", "OwnerController.total"]
    assert names["app/Admin/Users_Controller.RB"] == ["UsersController#index", "UsersController#search", "UsersController#show"]
    assert names["shop/views.py"] == ["OrderViewSet#list", "OrderViewSet#pay", "index"]
    assert names["a/Hello.cfc"] == ["hello"] and names["a/Application.cfc"] == ["onError", "save"] and names["a/page.cfm"] == ["page"]
    assert not any(names[p] for p in ("app/models/user.rb", "shop/models.py", "a/stub.cfm", "a/x.java", "a/views.py", "a/broken.java", "a/broken_controller.rb", "a/x.cs"))
    cfc = spark.createDataFrame([f for f in FILES if f[0] == "a/Hello.cfc"], "relative_path string, content string")
    assert sorted(r.name for r in parsers.cfml(cfc).collect()) == ["flag", "hello"]


def test_java(got):
    show = got["src/OwnerController.java", "OwnerController.show"]
    assert (show.kind, show.line_start, show.line_end) == ("controller-method", 14, 20) and show.source.startswith("@GetMapping") and show.source.endswith("}")
    h = show.hints
    assert h.http_route == ("GET", "/owners/{id}") and h.annotations == ["RestController", "RequestMapping", "GetMapping", "PreAuthorize"] and h.notes == ["auth: PreAuthorize"] and h.database_tables == ["Owner"]
    assert [tuple(p) for p in h.parameters] == [("id", "int"), ("q", "Map<String, List<Integer>>")] and h.callees == ["render", "findById"]
    save = got["src/OwnerController.java", "OwnerController.save"].hints
    assert save.http_route == ("ANY", "/owners/save") and save.notes == ["Sends email", "Executes within a database transaction (@Transactional)", "Writes to file system"] and save.parameters[0].name == "owners"
    assert got["src/OwnerController.java", "Old.doGet"].hints.http_route == ("GET", "")
    assert got["src/OwnerController.java", "OwnerController.total"].kind == "function"


def test_java_surfaces(spark):
    java = spark.createDataFrame([FILES[0]], "relative_path string, content string")
    packages = {r.name for r in parsers.java(java, "package-allowlist", benchmarks=True).collect()}
    assert {r.name for r in parsers.java(java, "all-public-classes").collect()} == {"OwnerController.show", "OwnerController.total"}  # with the static one three count
    assert packages == {"OwnerController.show", "OwnerController.total", "Plain.work", "Bench.measure"}
    assert "Bench.measure" in {r.name for r in parsers.java(java, benchmarks=True).collect()}


def test_ruby(got):
    path = "app/Admin/Users_Controller.RB"
    index, show, search = (got[path, f"UsersController#{n}"] for n in ("index", "show", "search"))
    assert (index.kind, index.line_start, index.line_end) == ("rails-action", 7, 14) and index.hints.http_route == ("GET", "/users") and index.hints.notes is None and index.hints.database_tables == ["User"] and index.hints.callees == ["where", "log_it"]
    assert show.hints.notes == ["before_action: :authenticate, :load_user", "Sends email (ActionMailer)"] and [p.name for p in show.hints.parameters] == ["id", "format", "rest"] and show.hints.http_route == ("GET", "/users/:id")
    assert search.kind == "function" and [p.name for p in search.hints.parameters] == ["text", "url"] and (search.line_start, search.line_end) == (24, 29)


def test_django(got):
    index, listed, pay = got["shop/views.py", "index"], got["shop/views.py", "OrderViewSet#list"], got["shop/views.py", "OrderViewSet#pay"]
    assert (index.line_start, index.line_end) == (3, 12) and index.hints.notes == ["auth: login_required", "auth: permission_required"] and index.hints.database_tables == ["Item"]
    assert [tuple(p) for p in index.hints.parameters] == [("request", None), ("page", "int")] and index.hints.callees == ["permission_required", "render"]
    class_notes = ["auth: login_required", "permission_classes: IsAuthenticated, IsAdmin"]
    assert listed.hints.http_route == ("GET", "/order") and listed.hints.notes == class_notes and listed.hints.database_tables == ["Order"] and listed.hints.parameters is None
    assert pay.hints.http_route == ("POST", "/order/:id/pay") and pay.hints.notes == [*class_notes, "Enqueues background job"] and [p.name for p in pay.hints.parameters] == ["pk"]


def test_cfml(got):
    hello = got["a/Hello.cfc", "hello"]
    assert (hello.kind, hello.line_start, hello.line_end) == ("cf-tag-function", 4, 8) and [tuple(p) for p in hello.hints.parameters] == [("who", "string")] and hello.hints.database_tables == ["users"] and hello.hints.callees == ["greet"]
    assert hello.hints.notes[1:] == ["access: remote (HTTP-callable via CFC remoting)", "roles: admin"] and hello.hints.notes[0].startswith("ColdFusion ORM")
    save, error = got["a/Application.cfc", "save"], got["a/Application.cfc", "onError"]
    assert (save.kind, save.line_start, save.line_end) == ("cf-script-function", 2, 6) and [tuple(p) for p in save.hints.parameters] == [("name", "string"), ("n", "numeric")] and save.hints.notes == ["roles: boss"] and save.hints.database_tables == ["items"]
    assert error.hints.notes[0].startswith("ColdFusion lifecycle hook") and error.hints.notes[1:] == ["access: remote (HTTP-callable via CFC remoting)", "Sends email (cfmail)"]
    page = got["a/page.cfm", "page"]
    assert (page.line_start, page.line_end) == (1, 5) and page.hints.notes == ["Invokes custom tags: cf_head"]


def test_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 9), ("B", 3), ("a", 2)], "relative_path string, line_start int")
    assert [tuple(r) for r in parsers.in_order(df).collect()] == [("B", 3), ("a", 2), ("a", 9), ("b", 1)]
    assert parsers.parse(spark.createDataFrame([], "relative_path string, content string")).where(F.lit(True)).count() == 0


def test_a_file_that_raises_is_left_out_and_told(spark, monkeypatch):
    files = spark.createDataFrame([("a/Good.java", "@RestController class Good {\n  @GetMapping(\"/x\") String go() { int a = 1; return \"\" + a; }\n}"), ("a/Bad.java", "boom"), ("b/x.rb", "x")], "relative_path string, content string")
    plain = parsers.java_methods

    def scan(text):
        if text == "boom":
            raise RecursionError("too deep")
        return plain(text)

    monkeypatch.setattr(parsers, "java_methods", scan)
    assert parsers._safely(scan, "boom") == ([], "RecursionError: too deep") and parsers._safely(scan, None) == ([], None)
    monkeypatch.undo()
    assert parsers.unread(files).count() == 0 and [r["name"] for r in parsers.parse(files).select("name").collect()] == ["Good.go"]
