"""Every query that is not part of the optional subpackage, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, candidates, drafts, matching, pages, publish, reports
from ..sources import scratch
from ..streaming import logs
from . import views
from .base import ORACLE_SQL, QUERIES, query
from .views import table

def slug_sql(x: str) -> str:
    cut = f"substr(regexp_replace(regexp_replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), '[''\"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), 1, 80)"
    return f"regexp_replace({cut}, '^-+|-+$', '', 'g')"


def human_sql(x: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z])', ' \\1', 'g'), '[._]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"upper(substr({s}, 1, 1)) || substr({s}, 2)"


def bare_sql(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\A---\\r?\\n.*?\\r?\\n---\\r?\\n', '')"


_FENCE = r"(?s)<!--\s*managed:start[^>]*-->(.*?)<!--\s*managed:end\s*-->"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def body_sql(x: str) -> str:
    return trim_sql(f"regexp_replace({bare_sql(x)}, '{_FENCE}', '')")


def flow_sql(x: str) -> str:
    rest = f"regexp_extract({x}, '(?m)^##\\s+Main flow\\s*$((?s:.*))', 1)"
    flow = f"regexp_replace({rest}, '(?ms)^##\\s.*', '')"
    return f"len(list_filter(regexp_split_to_array({flow}, '\\s+'), lambda w: w <> ''))::BIGINT"


ROUND = "floor(({}) * 100 + 0.5) / 100"


@query(f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents")
def slugify_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


_STEM = "regexp_replace(lower(regexp_replace(regexp_replace(relative_path, '\\.[^.]+$', ''), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')"
_LANG = "CASE lower(regexp_extract(relative_path, '\\.([^./]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'cfc' THEN 'cfml' WHEN 'cfm' THEN 'cfml' WHEN 'rb' THEN 'ruby' WHEN 'py' THEN 'python' END"


@query(f"WITH {views.CANDIDATES} SELECT doc_id, regexp_replace(concat_ws('-', lang, {_STEM}, {slug_sql('name')}, 'v1'), '-{{2,}}', '-', 'g') AS id FROM (SELECT *, {_LANG} AS lang FROM candidates)")
def stable_ids(spark, sf_dir):
    c = views.candidates(spark, sf_dir)
    return c.select("doc_id", T.stable_id(candidates.language_of(F.col("relative_path")), F.col("relative_path"), F.col("name")).alias("id"))


@query(f"SELECT c_custkey, {human_sql('c_name')} AS human FROM customer")
def humanize_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.humanize(F.col("c_name")).alias("human"))


@query(f"WITH {views.CANDIDATES} SELECT doc_id, coalesce(nullif({slug_sql('title')}, ''), nullif({slug_sql(human_sql('name'))}, ''), 'id-' || doc_id) AS slug FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '!!' ELSE name END AS title FROM candidates)")
def slug_fallback(spark, sf_dir):
    i, c = F.col("doc_id"), views.candidates(spark, sf_dir)
    return c.select("doc_id", T.page_slug(F.when(i % 4 == 0, "!!").otherwise(F.col("name")), F.col("name"), F.concat(F.lit("id-"), i)).alias("slug"))


@query(
    f"WITH {views.CANDIDATES} SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(n, '(Controller|ViewSet|APIView|View)$', ''), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS resource FROM (SELECT doc_id, split_part(split_part(name, '.', 1), '#', 1) AS n FROM candidates)"
)
def snake_resource(spark, sf_dir):
    c = views.candidates(spark, sf_dir)
    return c.select("doc_id", T.snake_resource(F.substring_index(F.substring_index("name", ".", 1), "#", 1)).alias("resource"))


@query(f"WITH {views.CANDIDATES} SELECT doc_id, relative_path, regexp_matches(relative_path, '{candidates.INCLUDED}') AND NOT regexp_matches(relative_path, '{candidates.EXCLUDED}') AND NOT regexp_matches(relative_path, '{candidates.HIDDEN}') AS scanned, {_LANG} AS language FROM candidates")
def glob_prune(spark, sf_dir):
    p = F.col("relative_path")
    return views.candidates(spark, sf_dir).select("doc_id", p, candidates.scanned(p).alias("scanned"), candidates.language_of(p).alias("language"))


@query(f"WITH {views.CANDIDATES} SELECT doc_id, name FROM candidates WHERE contains(relative_path, 'app/contr') AND (name = 'loadAll' OR ends_with(name, '.loadAll'))")
def only_and_name(spark, sf_dir):
    c = views.candidates(spark, sf_dir)
    return c.where(F.contains("relative_path", F.lit("app/contr")) & candidates.named(F.col("name"), "loadAll")).select("doc_id", "name")


@query(f"WITH {views.CANDIDATES}, changed AS (SELECT DISTINCT relative_path AS path FROM candidates WHERE doc_id % 13 = 2) SELECT doc_id, relative_path FROM candidates WHERE relative_path IN (SELECT path FROM changed)")
def since_semi(spark, sf_dir):
    c = views.candidates(spark, sf_dir)
    return candidates.changed_only(c, c.where("doc_id % 13 = 2").select(F.col("relative_path").alias("path"))).select("doc_id", "relative_path")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE n <= 37 OR p IN (SELECT floor(i * ((SELECT count(*) FROM documents)::DOUBLE / 37))::BIGINT FROM range(37) t(i))")
def sample_even(spark, sf_dir):
    return candidates.sample_even(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 37)


@query(f"WITH {views.AUDIT} SELECT seq, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END >= 2 AS kept FROM audit")
def min_confidence(spark, sf_dir):
    return views.audit(spark, sf_dir).select("seq", candidates.confident(F.col("confidence"), "medium").alias("kept"))


@query(f"WITH {views.AUDIT} SELECT seq, prompt_version, prompt_version IS NULL OR CASE WHEN regexp_matches(prompt_version, '^v[0-9]+$') THEN substr(prompt_version, 2)::INT <= 9 ELSE prompt_version <= 'v9' END AS kept FROM audit")
def version_at_most(spark, sf_dir):
    v = F.col("prompt_version")
    return views.audit(spark, sf_dir).select("seq", v, T.not_after(v, "v9").alias("kept"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def escape_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_markup(F.col("html")).alias("escaped"))


@query(f"WITH {views.PAGES} SELECT doc_id, {bare_sql('page')} AS bare FROM pages_md")
def frontmatter_strip(spark, sf_dir):
    return views.pages(spark, sf_dir).select("doc_id", T.without_frontmatter(F.col("page")).alias("bare"))


@query(
    f"WITH {views.PAGES}, f AS (SELECT doc_id, page, instr(page, '{T.FENCE_OPEN}') AS a, instr(page, '{T.FENCE_CLOSE}') AS c FROM pages_md) SELECT doc_id, CASE WHEN a > 0 THEN regexp_replace(split_part(split_part(substr(page, a), '-->', 2), '<!--', 1), '^\\s+|\\s+$', '', 'g') END AS region, CASE WHEN a > 0 THEN substr(page, 1, a - 1) ELSE page END AS before, CASE WHEN a > 0 THEN substr(page, c + {len(T.FENCE_CLOSE)}) ELSE '' END AS after FROM f"
)
def managed_region(spark, sf_dir):
    p = F.col("page")
    return views.pages(spark, sf_dir).select("doc_id", T.managed_region(p).alias("region"), T.before_fence(p).alias("before"), T.after_fence(p).alias("after"))


@query("SELECT event_id, floor((event_id % 10) / 10.0::DOUBLE * least(500 * pow(2, event_id % 9), 60000))::BIGINT AS delay_ms FROM events")
def retry_delay(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.floor((i % 10).cast("double") / 10 * F.least(500 * F.pow(F.lit(2), i % 9), F.lit(60000.0))).cast("long").alias("delay_ms"))


@query("SELECT count(*) AS pages, coalesce(sum(length(text) // 4), 0)::BIGINT AS system, count(*)::BIGINT * 700 AS \"user\", " + ROUND.format("sum(length(text) // 4)::BIGINT * 3e-6 * 0.5") + " AS cached_usd, " + ROUND.format("count(*) * 700 * 3e-6") + " AS uncached_usd, " + ROUND.format("count(*) * 3000 * 15e-6") + " AS output_usd FROM documents")
def cost_estimate(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.expr("char_length(coalesce(text, '')) div 4").alias("system_tokens"), F.lit(700).cast("long").alias("user_tokens"))
    usd = {c: T.round_half_up(F.col(c)) for c in ("cached_usd", "uncached_usd", "output_usd")}
    return reports.cost(tokens).withColumns(usd).drop("total_usd")


_KEYS = "array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_extract(page, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---\\r?\\n', 1), '(?m)^([A-Za-z_][A-Za-z0-9_-]*):', 1))), ',')"
_SNAP = f"snaps AS (SELECT doc_id, sha256(body) AS body_hash, sha256({trim_sql('regexp_extract(bare, ' + chr(39) + _FENCE + chr(39) + ', 1)')}) AS fence_hash, {_KEYS} AS keys, array_to_string(regexp_extract_all(body, '(?m)^##\\s+(.+?)\\s*$', 1), '|') AS headings, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END::BIGINT AS n_lines, {flow_sql('bare')} AS words FROM (SELECT doc_id, page, {body_sql('page')} AS body, {bare_sql('page')} AS bare FROM pages_md))"


@query(f"WITH {views.PAGES}, {_SNAP} SELECT * FROM snaps")
def md_snapshot(spark, sf_dir):
    return reports.page_snapshots(views.pages(spark, sf_dir))


def _rated(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("repo"))
    i = F.col("doc_id")
    return md_snapshot(spark, sf_dir).join(meta, "doc_id").select("repo", F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("HIGH").alias("confidence"), "words", "n_lines", "doc_id")


_RATED = f"{views.PAGES}, {_SNAP}, rated AS (SELECT coalesce(source, 'none') AS repo, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'HIGH' END AS confidence, words, n_lines, doc_id FROM snaps JOIN documents USING (doc_id))"
_REPOS = "SELECT repo, count(*) AS pages, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, " + ROUND.format("sum(words)::DOUBLE / count(*)") + " AS avg_words, " + ROUND.format("sum(n_lines)::DOUBLE / count(*)") + " AS avg_lines, CASE WHEN count(*) FILTER (confidence IN ('high', 'medium', 'low')) = 0 THEN 0.0 ELSE " + ROUND.format("count(*) FILTER (confidence = 'high')::DOUBLE / count(*) FILTER (confidence IN ('high', 'medium', 'low')) * 100") + " END::DOUBLE AS high_pct FROM rated {} GROUP BY repo"


@query(f"WITH {_RATED} {_REPOS.format('')}")
def snapshot_aggregate(spark, sf_dir):
    return reports.repo_snapshots(_rated(spark, sf_dir))


@query(f"WITH {_RATED}, p AS ({_REPOS.format('WHERE doc_id % 7 <> 0')}), c AS ({_REPOS.format('WHERE doc_id % 5 <> 0')}) SELECT coalesce(p.repo, c.repo) AS repo, CASE WHEN c.repo IS NULL THEN 'prior' WHEN p.repo IS NULL THEN 'current' END AS only_in, {ROUND.format('c.high_pct - p.high_pct')} AS delta_pp, coalesce(-({ROUND.format('c.high_pct - p.high_pct')}) >= 1.0, false) AS regressed, coalesce(bool_or(coalesce(-({ROUND.format('c.high_pct - p.high_pct')}) >= 1.0, false)) OVER (), false) AS any_regressed FROM p FULL JOIN c ON p.repo = c.repo")
def snapshot_diff(spark, sf_dir):
    rated = _rated(spark, sf_dir)
    return reports.diff(reports.repo_snapshots(rated.where("doc_id % 7 <> 0")), reports.repo_snapshots(rated.where("doc_id % 5 <> 0")), 1.0)


_GOOD = "operation = 'generate' AND coalesce(content_hash, '') <> '' AND outcome <> 'error'"


@query(f'WITH {views.AUDIT} SELECT page, seq, "commit", outcome, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq DESC) AS r FROM audit WHERE {_GOOD} AND seq >= (SELECT min(seq) FROM audit WHERE "commit" = \'c1\')) WHERE r = 1')
def audit_latest_by_page(spark, sf_dir):
    return audit.latest_by_page(audit.since_commit(views.audit(spark, sf_dir), "c1"))


@query(f"WITH {views.AUDIT} SELECT seq, page, operation, outcome FROM audit ORDER BY seq DESC LIMIT 20")
def audit_tail(spark, sf_dir):
    return audit.tail(views.audit(spark, sf_dir), 20).select("seq", "page", "operation", "outcome")


@query(f"WITH {views.AUDIT} SELECT operation, outcome, count(*) AS n FROM audit GROUP BY ALL")
def audit_totals(spark, sf_dir):
    return views.audit(spark, sf_dir).groupBy("operation", "outcome").agg(F.count("*").alias("n"))


_FIELDS = ["commit", "confidence", "content_hash", "operation", "outcome", "page", "prev_hash", "prompt_version", "timestamp"]


def entry_sql(alias: str, prev: str, fields: list[str]) -> str:
    """An entry as JSON with sorted keys."""
    return "json_object(" + ", ".join(f"'{f}', " + (prev if f == "prev_hash" else f'{alias}."{f}"') for f in fields) + ")"


_CHAIN = f"""{views.AUDIT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY seq) AS n FROM audit),
  chain AS (SELECT *, NULL::VARCHAR AS prev_hash, 'sha256:' || sha256({entry_sql('numbered', 'NULL', _FIELDS)}::VARCHAR) AS entry_hash FROM numbered WHERE n = 1
    UNION ALL SELECT b.*, a.entry_hash, 'sha256:' || sha256({entry_sql('b', 'a.entry_hash', _FIELDS)}::VARCHAR) FROM chain a JOIN numbered b ON a.log = b.log AND b.n = a.n + 1)"""
_OWN = [f for f in _FIELDS if f != "prev_hash"]


@query(f"WITH {views.AUDIT} SELECT seq, 'sha256:' || sha256({entry_sql('audit', chr(39) + 'x' + chr(34) + chr(39), _FIELDS)}::VARCHAR) AS hash FROM audit")
def canonical_hash(spark, sf_dir):
    log = views.audit(spark, sf_dir).withColumn("prev_hash", F.lit('x"')).withColumn("entry_hash", F.lit("claimed"))
    shuffled = F.to_json(F.struct("timestamp", "prev_hash", "entry_hash", *reversed(_OWN[:-1])), {"ignoreNullFields": "false"})
    return log.select("seq", audit.sha(audit.canonical_json(shuffled, audit.UNHASHED)).alias("hash"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT seq, page, prev_hash, entry_hash FROM chain")
def chain_append(spark, sf_dir):
    return audit.chain(views.audit(spark, sf_dir), fields=_OWN).select("seq", "page", "prev_hash", "entry_hash")


@query(f"WITH RECURSIVE {_CHAIN} SELECT seq, log, prev_hash, entry_hash FROM chain")
def chain_stream(spark, sf_dir):
    """The events as a stream, appended to logs of JSON lines; what was written is read."""
    # a pattern, as a stream's path that is none must be a folder
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    chained = logs.appended(views.audit_of(events), _OWN)
    out = scratch.new_folder(spark, "log")
    logs.append_to(chained, out, scratch.new_folder(spark, "log-checkpoint")).awaitTermination()
    hashes = F.from_json("raw", "prev_hash string, entry_hash string")
    return spark.read.schema("log long, seq long, raw string").json(out).select("seq", "log", hashes.alias("h")).select("seq", "log", "h.*")


def _kept_log(spark, sf_dir):
    """The log as lines after someone took entries away, changed some, and cut some lines short; some claim a signature."""
    i = F.col("seq")
    log = audit.chain(views.audit(spark, sf_dir), fields=_OWN).where("seq % 89 <> 7").withColumn("outcome", F.when(i % 97 == 5, "forged").otherwise(F.col("outcome")))
    log = log.withColumns({"signature": F.when(i % 10 == 3, "c2ln"), "signing_key_id": F.concat(F.lit("k"), i % 4)})
    line = F.to_json(F.struct(*_OWN, "prev_hash", "entry_hash", "signature"), {"ignoreNullFields": "false"})
    return log.select("log", "seq", F.when(i % 61 == 4, F.substring(line, 1, 40)).otherwise(line).alias("raw"))


_VERIFIED = f"""{_CHAIN}, kept AS (SELECT log, seq, seq % 61 <> 4 AS is_json, seq % 97 = 5 AS tampered, prev_hash, entry_hash, seq % 10 = 3 AS signed FROM chain WHERE seq % 89 <> 7),
  seen AS (SELECT *, last_value(CASE WHEN is_json THEN entry_hash END IGNORE NULLS) OVER (PARTITION BY log ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept),
  verified AS (SELECT log, seq, is_json AND NOT tampered AS valid, false AS signed, is_json AND NOT tampered AND NOT signed AS unsigned,
    list_filter([CASE WHEN NOT is_json THEN 'not valid JSON' END, CASE WHEN is_json AND tampered THEN 'tampered' END, CASE WHEN is_json AND NOT tampered AND prev_hash IS DISTINCT FROM before THEN 'chain break' END,
      CASE WHEN is_json AND NOT tampered AND signed THEN 'unknown signing key' END, CASE WHEN is_json AND NOT tampered AND NOT signed THEN 'unsigned' END], lambda x: x IS NOT NULL) AS reasons FROM seen)"""


def _verified(spark, sf_dir):
    return audit.verify(_kept_log(spark, sf_dir), require_signed=True)


@query(f"WITH RECURSIVE {_VERIFIED} SELECT log, seq, valid, signed, unsigned, array_to_string(reasons, '; ') AS reasons FROM verified")
def chain_verify(spark, sf_dir):
    return _verified(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH RECURSIVE {_VERIFIED} SELECT log, count(*) AS total, count(*) FILTER (valid) AS valid, 0::BIGINT AS signed, count(*) FILTER (unsigned) AS unsigned, sum(len(reasons))::BIGINT AS errors, sum(len(reasons)) = 0 AS ok FROM verified GROUP BY log")
def chain_tallies(spark, sf_dir):
    return audit.tallies(_verified(spark, sf_dir))


def _rule(seq: int, field: str, level: str, where: str, message: str) -> str:
    return f"SELECT conv_id, turn, {seq}::BIGINT AS seq, '{field}' AS field, '{level}' AS severity, {message} AS message FROM drafts WHERE {where}"


_BLANK = "NOT regexp_matches(coalesce({}, ''), '\\S')"
_JARGON = "list_filter(tags, lambda t: lower(t) IN (" + ", ".join(f"'{t}'" for t in drafts.JARGON) + "))"
_PARTS = "concat_ws(' ', title, summary, actor, trigger_, array_to_string(preconditions, ' '), array_to_string(list_transform(main_flow, lambda s: concat_ws(' ', s.step, s.footnote)), ' '), array_to_string(postconditions, ' '), business_rules[1].rule, array_to_string(tags, ' '))"
_ISSUES = f"{views.DRAFTS}, issues AS (" + " UNION ALL ".join([
    _rule(0, "title", "error", _BLANK.format("title"), "'no title'"), _rule(1, "summary", "error", _BLANK.format("summary"), "'no summary'"), _rule(2, "actor", "error", _BLANK.format("actor"), "'no actor'"), _rule(3, "trigger", "warn", _BLANK.format("trigger_"), "'no trigger'"),
    _rule(4, "main_flow", "error", "coalesce(len(main_flow), 0) < 2", "'steps: ' || coalesce(len(main_flow), 0)"), _rule(5, "main_flow", "error", f"len(list_filter(main_flow, lambda s: {_BLANK.format('s.step')})) > 0", "'a step is empty'"), _rule(6, "main_flow", "warn", "len(main_flow) > 12", "'too many steps: ' || len(main_flow)"),
    _rule(7, "postconditions", "warn", "coalesce(len(postconditions), 0) = 0", "'no postcondition'"), _rule(8, "tags", "warn", f"len({_JARGON}) > 0", f"'jargon: ' || array_to_string({_JARGON}, ', ')"),
    _rule(9, "structure", "error", f"contains({_PARTS}, chr(8212))", "'an em dash'"), _rule(10, "confidence", "error", "confidence NOT IN ('', 'high', 'medium', 'low')", "'confidence: ' || confidence"),
]) + ")"


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def draft_issues(spark, sf_dir):
    return drafts.issues(views.drafts(spark, sf_dir))


@query(f"WITH {_ISSUES} SELECT field, severity, count(*) AS n FROM issues GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return drafts.issues(views.drafts(spark, sf_dir)).groupBy("field", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {_ISSUES}, m AS (SELECT *, bool_or(severity = 'error') OVER (PARTITION BY conv_id, turn) AS any_error FROM issues), h AS (SELECT conv_id, turn, '{drafts.HINT}' || chr(10) || chr(10) || string_agg('- ' || field || ': ' || message, chr(10) ORDER BY seq) AS hint FROM m WHERE severity = 'error' OR NOT any_error GROUP BY conv_id, turn) SELECT conv_id, turn, coalesce(hint, '') AS hint FROM drafts LEFT JOIN h USING (conv_id, turn)")
def retry_hint(spark, sf_dir):
    d = views.drafts(spark, sf_dir)
    return drafts.retry_hints(d, drafts.issues(d))


@query(f"WITH {_ISSUES}, e AS (SELECT d.conv_id, d.turn, (SELECT count(*) FROM issues i WHERE i.conv_id = d.conv_id AND i.turn = d.turn AND severity = 'error') AS errors, row_number() OVER (PARTITION BY d.conv_id ORDER BY d.turn) AS r FROM drafts d) SELECT a.conv_id, a.errors AS first_errors, b.errors AS second_errors, CASE WHEN b.errors < a.errors THEN 'recovered' ELSE 'no_help' END AS outcome, CASE WHEN b.errors < a.errors THEN b.turn ELSE a.turn END AS kept_turn FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.r = 1 AND b.r = 2 WHERE a.errors > 0")
def retry_decision(spark, sf_dir):
    return drafts.retry_decisions(views.drafts(spark, sf_dir))


_FLIGHT = f"{views.WIKI}, titled AS (SELECT doc_id, 'T' || doc_id AS title FROM documents WHERE doc_id IS NOT NULL), own AS (SELECT key, arg_min(title, page_id) AS title, min(page_id) AS page_id FROM wiki WHERE key IS NOT NULL GROUP BY key), free AS (SELECT lower(title) AS t, min(page_id) AS page_id FROM wiki WHERE key IS NULL GROUP BY 1), flight AS (SELECT d.doc_id, CASE WHEN o.key IS NOT NULL THEN CASE WHEN lower(o.title) = lower(d.title) THEN 'managed' ELSE 'renamed' END WHEN f.t IS NOT NULL THEN 'collision' ELSE 'clean' END AS outcome, coalesce(o.page_id, f.page_id) AS existing, CASE WHEN o.key IS NOT NULL THEN 'label' WHEN f.t IS NOT NULL THEN 'title_exact_ci' END AS match_reason, CASE WHEN o.key IS NULL AND f.t IS NOT NULL THEN 'docloom claim --target wiki --page ' || f.page_id || ' --map-to ' || d.doc_id END AS suggested_action FROM titled d LEFT JOIN own o ON o.key = d.doc_id LEFT JOIN free f ON f.t = lower(d.title))"


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("T"), "doc_id").alias("title"))


@query(f"WITH {_FLIGHT} SELECT * FROM flight")
def preflight_classify(spark, sf_dir):
    return publish.preflight(_titled(spark, sf_dir), views.wiki(spark, sf_dir))


@query(f"WITH {_FLIGHT} SELECT count(*) FILTER (outcome = 'clean') AS clean, count(*) FILTER (outcome = 'managed') AS managed, count(*) FILTER (outcome = 'collision') AS collision, count(*) FILTER (outcome = 'renamed') AS renamed FROM flight")
def preflight_summary(spark, sf_dir):
    return publish.summary(preflight_classify(spark, sf_dir))


_UPSERT = f"""{views.WIKI}, t AS (SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 7 = 4 THEN 'no answer' END AS failure FROM documents), upserted AS (
  SELECT coalesce(t.doc_id, w.key) AS key, w.page_id, CASE WHEN t.failure IS NOT NULL THEN w.title ELSE coalesce(t.title, w.title) END AS title,
    CASE WHEN t.doc_id IS NULL THEN 1 WHEN t.failure IS NOT NULL THEN CASE WHEN w.page_id IS NOT NULL THEN 1 END ELSE CASE WHEN w.page_id IS NULL THEN 1 ELSE 2 END END::BIGINT AS version,
    CASE WHEN t.doc_id IS NULL THEN 'kept' WHEN t.failure IS NOT NULL THEN 'skipped' WHEN w.page_id IS NULL THEN 'created' ELSE 'updated' END AS action, t.failure AS message
  FROM t FULL JOIN (SELECT * FROM wiki WHERE key IS NOT NULL) w ON w.key = t.doc_id UNION ALL SELECT key, page_id, title, 1::BIGINT, 'kept', NULL FROM wiki WHERE key IS NULL)"""


def _failing(spark, sf_dir):
    return _titled(spark, sf_dir).withColumn("failure", F.when(F.col("doc_id") % 7 == 4, "no answer"))


@query(f"WITH {_UPSERT} SELECT * FROM upserted")
def upsert_state(spark, sf_dir):
    return publish.upsert(_failing(spark, sf_dir), views.wiki(spark, sf_dir))


@query(f"WITH {_UPSERT} SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped FROM upserted")
def publish_totals(spark, sf_dir):
    return publish.totals(upsert_state(spark, sf_dir))


@query(f"WITH {views.WIKI} SELECT doc_id, CASE WHEN doc_id IN (SELECT key FROM wiki WHERE key IS NOT NULL) THEN 'updated' ELSE 'created' END AS action FROM documents")
def publish_dry_run(spark, sf_dir):
    return publish.dry_run(_titled(spark, sf_dir), views.wiki(spark, sf_dir))


@query(f"WITH {views.PAGES}, n AS (SELECT doc_id, 'New ' || doc_id || chr(10) AS fresh, CASE WHEN instr(page, '{T.FENCE_CLOSE}') > 0 THEN substr(page, instr(page, '{T.FENCE_CLOSE}') + {len(T.FENCE_CLOSE)}) ELSE '' END AS note FROM pages_md) SELECT doc_id, CASE WHEN regexp_matches(note, '\\S') THEN fresh || note ELSE fresh END AS page FROM n")
def merge_preserved(spark, sf_dir):
    return views.pages(spark, sf_dir).select("doc_id", publish.merged(F.concat(F.lit("New "), "doc_id", F.lit("\n")), F.col("page")).alias("page"))


@query("SELECT p_partkey, array_to_string(list_concat(['key-' || p_partkey, 'docloom'], list_transform(list_filter(string_split(p_type, ' '), lambda t: regexp_matches(t, '^[A-Za-z0-9-]+$')), lambda t: 'tag-' || lower(t))), ',') AS labels FROM part")
def label_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(publish.labels(F.col("p_partkey").cast("string"), F.split("p_type", " ")), ",").alias("labels"))


_KEBAB = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(name, '^.*\\.', ''), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g')"
_ENTRY = "entries AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'load-all-items' ELSE 'sync-items-' || (doc_id % 50) END AS page, relative_path AS source FROM candidates)"


@query(f"WITH {views.CANDIDATES}, {_ENTRY}, k AS (SELECT *, {_KEBAB} AS kebab FROM candidates) SELECT seq, name FROM (SELECT e.seq, k.name, row_number() OVER (PARTITION BY e.seq ORDER BY k.line_start, k.name) AS r FROM entries e JOIN k ON e.source = k.relative_path WHERE kebab <> '' AND (contains(e.page, kebab) OR contains(kebab, split_part(e.page, '-', 1)))) WHERE r = 1")
def replay_match(spark, sf_dir):
    c, i = views.candidates(spark, sf_dir), F.col("doc_id")
    entries = c.select(i.alias("seq"), F.when(i % 2 == 0, "load-all-items").otherwise(F.concat(F.lit("sync-items-"), i % 50)).alias("page"), F.col("relative_path").alias("source"))
    return candidates.match_pages(entries, c.select("relative_path", "line_start", "name"))


@query(f"WITH {views.CANDIDATES}, k AS (SELECT DISTINCT name, {_KEBAB} AS kebab FROM candidates), s AS (SELECT DISTINCT {slug_sql('text')} || '-' || (doc_id % 60) || '-show' AS slug FROM documents WHERE text IS NOT NULL) SELECT name, slug FROM k JOIN s ON kebab <> '' AND (contains(slug, kebab) OR contains(kebab, split_part(slug, '-', 1)))")
def slug_pairs(spark, sf_dir):
    """Every name against the slug of every text: those that may belong together."""
    slugs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(T.slugify(F.col("text")), F.lit("-"), F.col("doc_id") % 60, F.lit("-show")).alias("slug"))
    return matching.slug_pairs(views.candidates(spark, sf_dir).select("name"), slugs)


@query(f"WITH {views.CANDIDATES} SELECT CASE WHEN contains(relative_path, '/') THEN split_part(relative_path, '/', 1) ELSE '(root)' END AS folder, count(*) AS pages FROM candidates GROUP BY 1")
def preview_index(spark, sf_dir):
    return views.candidates(spark, sf_dir).groupBy(candidates.group_folder(F.col("relative_path")).alias("folder")).agg(F.count("*").alias("pages"))


@query(f"WITH {views.PAGES} SELECT count(*) FILTER (doc_id % 10 <> 3 AND doc_id % 6 <> 1) AS ok, count(*) AS total FROM pages_md")
def frontmatter_validate(spark, sf_dir):
    return pages.complete_pages(views.pages(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each page of the audit log."""
    return audit_latest_by_page(spark, sf_dir)


from . import code_queries, page_queries, parser_queries, source_queries  # noqa: E402, F401  these register their queries
