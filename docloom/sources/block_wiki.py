"""A wiki whose pages are rows of a database and whose text is a list of blocks: ``format("block_wiki")``.

Options: ``url`` (http or https, or ``folder:`` and a path for a database of files), ``database``,
``token``, ``property`` (the name of the property that holds keys), ``pageSize``, ``attempts``,
``baseMs``, ``capMs``.

Reading: results come by cursors, each of which names the next. The driver follows these alone;
a task asks for one cursor's pages again and for their blocks, some at a time. An equality (or
list) of keys is asked of the database. Writing: rows (key, title, blocks, perhaps tags) make
the page of their key or replace its blocks: new ones are added before old ones go, and what a
failed task or job did is taken back. Of a page that was taken over, only what stands between
its banner (a callout) and the divider behind it is replaced.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .wiki_client import Reply, WikiError, over_http, retried

SCHEMA = "page_id string, key string, title string, tags array<string>, blocks array<struct<id: string, type: string, text: string>>"
#: Blocks in one request, and letters in one piece of text: bounds of the interface.
MOST_BLOCKS, MOST_TEXT = 100, 2_000


def payload(kind: str, text: str | None) -> dict:
    """A block as the interface takes it; a text is cut into pieces."""
    text = text or ""
    pieces = [{"type": "text", "text": {"content": text[i : i + MOST_TEXT]}} for i in range(0, len(text), MOST_TEXT)]
    return {"object": "block", "type": kind, kind: {} if kind == "divider" else {"rich_text": pieces}}


def plain(pieces: list[dict]) -> str:
    return "".join(p.get("plain_text", p.get("text", {}).get("content", "")) for p in pieces)


class Database:
    def __init__(self, send: Callable[..., Reply], database: str, prop: str = "docloom_id", size: int = 100):
        self.send, self.database, self.prop, self.size = send, database, prop, size

    def _call(self, what: str, method: str, path: str, query: dict | None = None, body: dict | None = None) -> dict:
        reply = self.send(method, path, query or {}, body)
        if not 200 <= reply.status < 300:
            raise WikiError(what, reply)
        return json.loads(reply.body) if reply.body else {}

    def query(self, cursor: str | None = None, key: str | None = None) -> tuple[list[tuple], str | None]:
        """((page_id, key, title, tags) ..., the cursor of the next ones)."""
        body: dict = {"page_size": self.size} | ({"start_cursor": cursor} if cursor else {}) | ({"filter": {"property": self.prop, "rich_text": {"equals": key}}} if key is not None else {})
        found = self._call("query", "POST", f"/v1/databases/{self.database}/query", body=body)
        rows = []
        for r in found["results"]:
            p = r["properties"]
            rows.append((r["id"], plain(p.get(self.prop, {}).get("rich_text", [])) or None, plain(p.get("Name", {}).get("title", [])), [t["name"] for t in p.get("Tags", {}).get("multi_select", [])]))
        return rows, found.get("next_cursor") if found.get("has_more") else None

    def cursors(self) -> Iterator[str | None]:
        cursor = None
        while True:
            yield cursor
            _, cursor = self.query(cursor)
            if cursor is None:
                return

    def blocks(self, page_id: str) -> list[tuple[str, str, str]]:
        """(id, type, text) of a page's blocks, in order."""
        out, cursor = [], None
        while True:
            found = self._call("blocks", "GET", f"/v1/blocks/{page_id}/children", {"page_size": 100} | ({"start_cursor": cursor} if cursor else {}))
            out += [(b["id"], b["type"], plain(b.get(b["type"], {}).get("rich_text", []))) for b in found["results"]]
            if not found.get("has_more"):
                return out
            cursor = found["next_cursor"]

    def _properties(self, key: str, title: str, tags: list[str]) -> dict:
        text = lambda x: [{"type": "text", "text": {"content": x}}]
        return {"Name": {"title": text(title)}, self.prop: {"rich_text": text(key)}, "Tags": {"multi_select": [{"name": t} for t in tags]}}

    def create(self, key: str, title: str, tags: list[str]) -> str:
        return self._call("create", "POST", "/v1/pages", body={"parent": {"database_id": self.database}, "properties": self._properties(key, title, tags)})["id"]

    def describe(self, page_id: str, key: str, title: str, tags: list[str]) -> None:
        self._call("describe", "PATCH", f"/v1/pages/{page_id}", body={"properties": self._properties(key, title, tags)})

    def append(self, page_id: str, blocks: list[tuple[str, str]], made: list[str], after: str | None = None) -> None:
        """Add blocks (behind ``after``, else at the end); their ids go to ``made`` as they come."""
        for i in range(0, len(blocks), MOST_BLOCKS):
            body = {"children": [payload(*b) for b in blocks[i : i + MOST_BLOCKS]]} | ({"after": after} if after else {})
            new = [b["id"] for b in self._call("append", "PATCH", f"/v1/blocks/{page_id}/children", body=body)["results"]]
            made += new
            after = new[-1] if after else None

    def archive(self, block_id: str) -> None:
        self._call("archive", "DELETE", f"/v1/blocks/{block_id}")

    def restore(self, block_id: str) -> None:
        self._call("restore", "PATCH", f"/v1/blocks/{block_id}", body={"archived": False})

    def remove(self, page_id: str) -> None:
        self._call("remove", "PATCH", f"/v1/pages/{page_id}", body={"archived": True})


def connected(options) -> Database:
    url = options["url"]
    send = BlockServer(url.removeprefix("folder:")).send if url.startswith("folder:") else over_http(url, token=options.get("token", ""))
    send = retried(send, int(options.get("attempts", 5)), int(options.get("baseMs", 500)), int(options.get("capMs", 60_000)))
    return Database(send, options.get("database", "main"), options.get("property", "docloom_id"), int(options.get("pageSize", 100)))


@dataclass
class Part(InputPartition):
    cursor: str | None = None
    key: str | None = None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.keys = options, None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if f.attribute == ("key",) and values and self.keys is None and all(isinstance(v, str) for v in values):
                self.keys = list(dict.fromkeys(values))
            else:
                yield f

    def partitions(self):
        return [Part(key=k) for k in self.keys] if self.keys is not None else [Part(cursor=c) for c in connected(self.options).cursors()]

    def read(self, partition: Part):
        base = connected(self.options)
        for row in base.query(partition.cursor, partition.key)[0]:
            yield (*row, base.blocks(row[0]))


@dataclass
class Written(WriterCommitMessage):
    """What a task did: pages made, (page, key, title, tags) as they were, blocks added and blocks put away."""

    created: list[str] = field(default_factory=list)
    described: list[tuple] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    archived: list[str] = field(default_factory=list)


def take_back(base: Database, done: Written) -> None:
    for page_id in done.created:
        base.remove(page_id)
    for block in done.archived:
        base.restore(block)
    for block in done.added:
        base.archive(block)
    for row in done.described:
        base.describe(*row)


class Writer(DataSourceWriter):
    def __init__(self, options, schema):
        missing = {"key", "title", "blocks"} - set(schema.names)
        if missing:
            raise ValueError(f"pages have the columns key, title and blocks; missing: {', '.join(sorted(missing))}")
        self.options, self.has_tags = options, "tags" in schema.names

    def write(self, rows) -> Written:
        base, done = connected(self.options), Written()
        try:
            for r in rows:
                self._put(base, done, r["key"], r["title"], list(r["tags"] or []) if self.has_tags else [], [(b["type"], b["text"] or "") for b in r["blocks"] or []])
        except Exception:
            take_back(base, done)
            raise
        return done

    @staticmethod
    def _put(base: Database, done: Written, key: str, title: str, tags: list[str], blocks: list[tuple[str, str]]) -> None:
        found, _ = base.query(key=key)
        if not found:
            page_id = base.create(key, title, tags)
            done.created.append(page_id)
            base.append(page_id, blocks, [])
            return
        page_id, _, old_title, old_tags = found[0]
        there = base.blocks(page_id)
        # of a page that was taken over, what is between its banner and the divider is ours
        banner = next((i for i, b in enumerate(there) if b[1] == "callout"), None)
        line = next((i for i, b in enumerate(there) if b[1] == "divider" and banner is not None and i > banner), None)
        own = there if line is None else there[banner + 1 : line]
        if [b[1:] for b in own] != blocks:
            base.append(page_id, blocks, done.added, None if line is None else there[banner][0])
            for block_id, *_ in own:
                base.archive(block_id)
                done.archived.append(block_id)
        if (old_title, old_tags) != (title, tags):
            base.describe(page_id, key, title, tags)
            done.described.append((page_id, key, old_title, old_tags))

    def commit(self, messages) -> None:
        """All tasks have ended: pages show as they are written."""

    def abort(self, messages) -> None:
        base = connected(self.options)
        for m in messages:
            if m is not None:
                take_back(base, m)


class BlockWikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_wiki"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a wiki's pages are updated by key (mode append); other people's pages are not overwritten")
        return Writer(self.options, schema)


def read_blocks(spark: SparkSession, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockWikiSource)
    return spark.read.format("block_wiki").options(**options).load()


def publish_blocks(pages: DataFrame, **options) -> None:
    """Write ``pages`` (key, title, blocks, perhaps tags; one row for each key) to a database."""
    pages.sparkSession.dataSource.register(BlockWikiSource)
    pages.where("key is not null").write.format("block_wiki").options(**options).mode("append").save()


class BlockServer:
    """A database of files: a JSON file for each page with its blocks. Faults as in a folder wiki."""

    def __init__(self, root: str):
        self.root = Path(root)

    def send(self, method: str, path: str, query: dict, body: dict | None) -> Reply:
        parts = path.strip("/").split("/")[1:]
        kind = "query" if parts[-1] == "query" else {("GET", "blocks"): "blocks", ("POST", "pages"): "create", ("PATCH", "pages"): "describe", ("DELETE", "blocks"): "archive"}.get((method, parts[0])) or ("append" if parts[-1] == "children" else "restore")
        for f in sorted((self.root / "faults").glob(f"{kind}-*")):
            status, _, wait = f.read_text().partition(" ")
            f.unlink()
            return Reply(int(status), {"Retry-After": wait} if wait else {}, "fault")
        return getattr(self, f"_{kind}")(parts[1] if len(parts) > 1 else "", query, body or {})

    def _load(self, page_id: str) -> dict:
        return json.loads((self.root / "pages" / f"{page_id}.json").read_text())

    def _save(self, page: dict) -> None:
        at = self.root / "pages" / f"{page['id']}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        part = self.root / f"{uuid.uuid4().hex}.part"
        part.write_text(json.dumps(page))
        os.replace(part, at)

    @staticmethod
    def _some(rows: list, start: str | None, size: int) -> Reply:
        a = int(start or 0)
        more = a + size < len(rows)
        return Reply(200, {}, json.dumps({"results": rows[a : a + size], "has_more": more, "next_cursor": str(a + size) if more else None}))

    def _query(self, database: str, _, body: dict) -> Reply:
        pages = [json.loads(f.read_text()) for f in sorted((self.root / "pages").glob("*.json"))]
        rows = [p for p in pages if p["database"] == database and not p["archived"]]
        if f := body.get("filter"):
            rows = [p for p in rows if plain(p["properties"].get(f["property"], {}).get("rich_text", [])) == f["rich_text"]["equals"]]
        return self._some([{"id": p["id"], "properties": p["properties"]} for p in rows], body.get("start_cursor"), body["page_size"])

    def _create(self, _, __, body: dict) -> Reply:
        page = {"id": uuid.uuid4().hex, "database": body["parent"]["database_id"], "properties": body["properties"], "archived": False, "blocks": []}
        self._save(page)
        return Reply(200, {}, json.dumps({"id": page["id"]}))

    def _describe(self, page_id: str, _, body: dict) -> Reply:
        page = self._load(page_id)
        page["properties"] |= body.get("properties", {})
        page["archived"] = body.get("archived", page["archived"])
        self._save(page)
        return Reply(200, {}, json.dumps({"id": page_id}))

    def _blocks(self, page_id: str, query: dict, _) -> Reply:
        return self._some([b for b in self._load(page_id)["blocks"] if not b["archived"]], query.get("start_cursor"), int(query["page_size"]))

    def _append(self, page_id: str, _, body: dict) -> Reply:
        page = self._load(page_id)
        if len(body["children"]) > MOST_BLOCKS or any(len(t["text"]["content"]) > MOST_TEXT for b in body["children"] for t in b[b["type"]].get("rich_text", [])):
            return Reply(400, {}, "too long")
        new = [b | {"id": f"{page_id}.{uuid.uuid4().hex}", "archived": False} for b in body["children"]]
        at = next((i + 1 for i, b in enumerate(page["blocks"]) if b["id"] == body.get("after")), len(page["blocks"]))
        page["blocks"][at:at] = new
        self._save(page)
        return Reply(200, {}, json.dumps({"results": new}))

    def _mark(self, block_id: str, archived: bool) -> Reply:
        page = self._load(block_id.split(".")[0])
        for b in page["blocks"]:
            if b["id"] == block_id:
                b["archived"] = archived
        self._save(page)
        return Reply(200, {}, "{}")

    def _archive(self, block_id: str, _, __) -> Reply:
        return self._mark(block_id, True)

    def _restore(self, block_id: str, _, body: dict) -> Reply:
        return self._mark(block_id, bool(body.get("archived")))
