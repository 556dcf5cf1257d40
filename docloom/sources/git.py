"""Git repositories as tables: objects, commits, tree entries, refs, and what differs between two commits.

``spark.read.format("git_objects")`` reads the object stores of one or more repositories
(option ``path``, comma separated; folders that all executors see): loose objects by
their 256 folders, packs by ranges of their index. Objects stored as differences are put
together from their chain of bases. Commits and refs are rows; two trees are compared
a depth at a time, by joins of what is still unlike, so equal subtrees are never read.

A commit graph is walked in one task for each repository, with a number for each
commit in hand; repositories are dealt over tasks.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .scratch import shared_folder

OBJECTS = "repo string, sha string, type string, size long, content binary"
# How a pack numbers the types of objects; 6 and 7 are differences to a base by offset and by name.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7

#: Objects in a range of a pack; bytes of content in a batch; entries of trees in a batch.
RANGE, BATCH_BYTES, ENTRIES = 20_000, 8 << 20, 10_000


def git_folder(root: str) -> Path:
    """The folder of a repository's data: ``root`` itself, its ``.git``, or what a file of that name points to."""
    at = Path(root)
    if (at / "objects").is_dir():
        return at
    dot = at / ".git"
    if dot.is_file() and (m := re.match(r"gitdir: (.*)", dot.read_text())):
        dot = (at / m[1].strip()).resolve()
        if (dot / "commondir").exists():
            dot = (dot / (dot / "commondir").read_text().strip()).resolve()
    return dot


class Pack:
    """A pack and its index."""

    def __init__(self, path: Path):
        index = path.with_suffix(".idx").read_bytes()
        if index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: an index of another version than 2")
        self.count = struct.unpack(">I", index[8 + 255 * 4 : 8 + 256 * 4])[0]
        names = 8 + 256 * 4
        self.names = index[names : names + 20 * self.count]
        at = names + 24 * self.count
        near = struct.unpack(f">{self.count}I", index[at : at + 4 * self.count])
        far = at + 4 * self.count
        self.offsets = [o if o < 1 << 31 else struct.unpack(">Q", index[far + 8 * (o - (1 << 31)) : far + 8 * (o - (1 << 31)) + 8])[0] for o in near]
        with path.open("rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def name(self, i: int) -> str:
        return self.names[20 * i : 20 * i + 20].hex()

    def offset(self, name: bytes) -> int | None:
        low, high = 0, self.count
        while low < high:
            mid = (low + high) // 2
            if self.names[20 * mid : 20 * mid + 20] < name:
                low = mid + 1
            else:
                high = mid
        return self.offsets[low] if low < self.count and self.names[20 * low : 20 * low + 20] == name else None

    def _entry(self, at: int) -> tuple[int, int, bytes]:
        """(kind, offset of the base or -1, inflated bytes) of what stands at an offset."""
        start, byte = at, self.data[at]
        kind = byte >> 4 & 7
        while byte & 128:
            at += 1
            byte = self.data[at]
        at, base = at + 1, -1
        if kind == BY_OFFSET:
            byte = self.data[at]
            back = byte & 127
            while byte & 128:
                at += 1
                byte = self.data[at]
                back = (back + 1) << 7 | byte & 127
            at, base = at + 1, start - back
        elif kind == BY_NAME:
            base = self.offset(self.data[at : at + 20])
            if base is None:
                raise ValueError(f"a base outside its pack: {self.data[at : at + 20].hex()}")
            at += 20
        inflate, parts = zlib.decompressobj(), []
        while not inflate.eof and at < len(self.data):
            parts.append(inflate.decompress(self.data[at : at + 65536]))
            at += 65536
        return kind, base, b"".join(parts)

    def read(self, at: int) -> tuple[str, bytes]:
        """(type, content) of the object at an offset."""
        chain: list[bytes] = []
        while True:
            kind, base, content = self._entry(at)
            if base < 0:
                break
            chain.append(content)
            at = base
        for change in reversed(chain):
            content = patched(content, change)
        return TYPES[kind], content


def patched(base: bytes, change: bytes) -> bytes:
    """The bytes that a difference makes of its base."""
    at = 0

    def size() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = change[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if not byte & 128:
                return n

    size()
    length, out = size(), []
    while at < len(change):
        op = change[at]
        at += 1
        if op & 128:
            numbers = []
            for bits in (range(4), range(4, 7)):
                n = 0
                for i, bit in enumerate(bits):
                    if op >> bit & 1:
                        n |= change[at] << 8 * i
                        at += 1
                numbers.append(n)
            start, n = numbers[0], numbers[1] or 65536
            out.append(base[start : start + n])
        else:
            out.append(change[at : at + op])
            at += op
    made = b"".join(out)
    if len(made) != length:
        raise ValueError("a difference that does not fit its base")
    return made


def loose(path: Path) -> tuple[str, bytes]:
    head, _, content = zlib.decompress(path.read_bytes()).partition(b"\0")
    return head.split(b" ")[0].decode(), content


@dataclass
class Part(InputPartition):
    """A loose folder (``folder``) or a range of a pack of a repository."""

    repo: str
    folder: str = ""
    pack: str = ""
    first: int = 0
    last: int = 0


class ObjectReader(DataSourceReader):
    def __init__(self, options):
        self.repos = [x.strip() for x in options["path"].split(",")]
        self.range, self.names, self.kinds = int(options.get("range", RANGE)), None, None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if f.attribute == ("sha",) and values and self.names is None:
                self.names = set(values)
            elif f.attribute == ("type",) and values and self.kinds is None:
                self.kinds = set(values)
            else:
                yield f

    def partitions(self):
        out = []
        for repo in self.repos:
            store = git_folder(repo) / "objects"
            out += [Part(repo, folder=f.name) for f in sorted(store.glob("[0-9a-f][0-9a-f]")) if self.names is None or any(n.startswith(f.name) for n in self.names)]
            for pack in sorted((store / "pack").glob("*.pack")):
                with pack.with_suffix(".idx").open("rb") as f:
                    f.seek(8 + 255 * 4)
                    count = struct.unpack(">I", f.read(4))[0]
                step = count if self.names is not None else self.range
                out += [Part(repo, pack=pack.name, first=a, last=min(a + step, count)) for a in range(0, count, step or 1)]
        return out

    def _objects(self, part: Part) -> Iterator[tuple[str, str, bytes]]:
        store = git_folder(part.repo) / "objects"
        if part.folder:
            for f in sorted((store / part.folder).iterdir()):
                if len(f.name) == 38 and (self.names is None or part.folder + f.name in self.names):
                    yield part.folder + f.name, *loose(f)
            return
        pack = Pack(store / "pack" / part.pack)
        if self.names is not None:
            places = ((n, pack.offset(bytes.fromhex(n))) for n in sorted(self.names) if re.fullmatch("[0-9a-f]{40}", n))
        else:
            places = ((pack.name(i), pack.offsets[i]) for i in range(part.first, part.last))
        for name, at in places:
            if at is not None:
                yield name, *pack.read(at)

    def read(self, partition: Part):
        import pyarrow as pa

        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["repo", "sha", "type", "size", "content"])

        for name, kind, content in self._objects(partition):
            if self.kinds is None or kind in self.kinds:
                rows.append((partition.repo, name, kind, len(content), content))
                held += len(content)
            if held > BATCH_BYTES or len(rows) >= 4096:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class GitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


def objects(spark: SparkSession, *repos: str, **options) -> DataFrame:
    """(repo, sha, type, size, content); an object that is stored twice comes twice."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").options(path=",".join(repos), **options).load()


def commits(found: DataFrame) -> DataFrame:
    """(repo, sha, tree, parents, author, authored, committed, subject) of the commits among objects; times in seconds."""
    text = found.where("type = 'commit'").select("repo", "sha", F.decode("content", "utf-8").alias("t"))
    text = text.select("repo", "sha", F.regexp_extract("t", r"(?s)\A(.*?)(?:\n\n|\n*\z)", 1).alias("head"), F.regexp_extract("t", r"(?s)\n\n\n*(.*)\z", 1).alias("message"))
    line = lambda name, group: F.regexp_extract("head", rf"(?m)^{name} (.*?) ?<[^>\n]*> (\d+) [-+]\d+$", group)
    return text.select(
        "repo", "sha", F.regexp_extract("head", r"(?m)^tree ([0-9a-f]{40})$", 1).alias("tree"), F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        line("author", 1).alias("author"), line("author", 2).try_cast("long").alias("authored"), line("committer", 2).try_cast("long").alias("committed"),
        F.regexp_replace(F.regexp_extract("message", r"(?s)\A(.*?)(?:\n[ \t]*\n|\n*\z)", 1), "\n", " ").alias("subject"),
    ).dropDuplicates(["repo", "sha"])


def entry_batches(batches):
    """The entries of trees (repo, tree, content): one tree is in hand, and a bounded number of entries."""
    import pyarrow as pa

    def whole(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(5)], names=["repo", "tree", "mode", "name", "sha"])

    for batch in batches:
        rows = []
        for row in zip(*batch.columns, strict=True):
            repo, tree, content = (x.as_py() for x in row)
            at = 0
            while at < len(content):
                blank, end = content.index(b" ", at), content.index(b"\0", at)
                rows.append((repo, tree, content[at:blank].decode().zfill(6), content[blank + 1 : end].decode("utf-8", "replace"), content[end + 1 : end + 21].hex()))
                at = end + 21
                if len(rows) == ENTRIES:
                    yield whole(rows)
                    rows = []
        yield whole(rows)


def tree_entries(found: DataFrame) -> DataFrame:
    """(repo, tree, mode, name, sha): a row for each entry of the trees among objects."""
    return found.where("type = 'tree'").select("repo", "sha", "content").dropDuplicates(["repo", "sha"]).mapInArrow(entry_batches, "repo string, tree string, mode string, name string, sha string")


def refs(spark: SparkSession, *repos: str) -> DataFrame:
    """(repo, name, sha, upstream) of branches, remote branches and tags, and HEAD (``symbolic``: the branch that it is on); few rows, read where the driver is."""
    rows = []
    for repo in repos:
        at, own = git_folder(repo), {}
        if (at / "packed-refs").exists():
            own |= {name: sha for sha, name in re.findall(r"(?m)^([0-9a-f]{40}) (\S+)$", (at / "packed-refs").read_text())}
        own |= {str(f.relative_to(at)): f.read_text().strip() for f in sorted((at / "refs").rglob("*")) if f.is_file()}
        upstreams = {}
        if (at / "config").exists():
            for name, lines in re.findall(r'(?m)^\[branch "(.+)"\]\n((?:[ \t]+.*\n?)*)', (at / "config").read_text()):
                values = dict(re.findall(r"(?m)^\s*(\w+)\s*=\s*(.*?)\s*$", lines))
                if {"remote", "merge"} <= set(values):
                    remote = "refs/heads/" if values["remote"] == "." else f"refs/remotes/{values['remote']}/"
                    upstreams[f"refs/heads/{name}"] = remote + values["merge"].removeprefix("refs/heads/")
        head = (at / "HEAD").read_text().strip() if (at / "HEAD").exists() else ""
        branch = head.removeprefix("ref: ") if head.startswith("ref: ") else None
        own = {n: own.get(s.removeprefix("ref: "), "") if s.startswith("ref: ") else s for n, s in own.items()}
        if sha := own.get(branch, "") if branch else head:
            rows.append((repo, "HEAD", sha, upstreams.get(branch), branch))
        rows += [(repo, n, s, upstreams.get(n), None) for n, s in sorted(own.items()) if re.fullmatch("[0-9a-f]{40}", s)]
    return spark.createDataFrame(rows, "repo string, name string, sha string, upstream string, symbolic string")


def resolved(spark: SparkSession, repo: str, name: str) -> str | None:
    """The name of the commit that a ref, a branch, a remote branch, a tag or (the beginning of, 7 digits at least) a name means; None if there is none."""
    known = {r["name"]: r["sha"] for r in refs(spark, repo).collect()}
    for full in (name, f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}"):
        if full in known:
            name = known[full]
            break
    if not re.fullmatch("[0-9a-f]{7,40}", name):
        return None
    found = objects(spark, repo)
    found = found.where(F.col("sha") == name) if len(name) == 40 else found.where(F.startswith("sha", F.lit(name)))
    rows = found.where(F.col("type").isin("commit", "tag")).select("sha", "type", F.regexp_extract(F.decode("content", "utf-8"), r"\Aobject ([0-9a-f]{40})", 1).alias("of")).distinct().take(2)
    if len(rows) != 1:
        return None
    return rows[0]["sha"] if rows[0]["type"] == "commit" else resolved(spark, repo, rows[0]["of"])


def head(spark: SparkSession, repo: str, digits: int = 7) -> str:
    """The first digits of HEAD's commit, ``unknown`` if there is none."""
    found = refs(spark, repo).where("name = 'HEAD'").first() if git_folder(repo).is_dir() else None
    return found["sha"][:digits] if found else "unknown"


def tree_changes(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, path, old_sha, new_sha, old_mode, new_mode) of files that differ between trees ``pairs`` (repo, old, new; null: no tree).

    A depth at a time: entries of two trees meet by name, and only trees that differ go on
    to the next one. Each depth is written to the checkpoint folder.
    """
    spark = entries.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    entries = entries.checkpoint()
    side = lambda which: entries.select(F.col("repo").alias("r"), F.col("tree").alias("t"), F.struct("mode", "sha").alias(which), "name")
    now = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("repo", F.lit("").alias("path"), "old", "new").checkpoint()
    out = None
    while not now.isEmpty():
        key = [F.col("repo"), F.col("path"), F.col("name")]
        old = now.join(side("o"), (F.col("repo") == F.col("r")) & (F.col("old") == F.col("t"))).select(*key, "o")
        new = now.join(side("n"), (F.col("repo") == F.col("r")) & (F.col("new") == F.col("t"))).select(*key, "n")
        both = old.join(new, ["repo", "path", "name"], "full").where(~F.col("o").eqNullSafe(F.col("n"))).withColumn("path", F.concat("path", "name")).drop("name").checkpoint()
        is_tree = lambda x: F.col(f"{x}.mode") == "040000"
        file = lambda x: F.when(~is_tree(x), F.col(x))
        files = both.select("repo", "path", file("o").alias("o"), file("n").alias("n")).where("o is not null or n is not null")
        files = files.select("repo", "path", F.col("o.sha").alias("old_sha"), F.col("n.sha").alias("new_sha"), F.col("o.mode").alias("old_mode"), F.col("n.mode").alias("new_mode"))
        out = files if out is None else out.union(files)
        tree = lambda x: F.when(is_tree(x), F.col(f"{x}.sha"))
        now = both.select("repo", F.concat("path", F.lit("/")).alias("path"), tree("o").alias("old"), tree("n").alias("new")).where("not (old <=> new)").checkpoint()
    return out if out is not None else spark.createDataFrame([], "repo string, path string, old_sha string, new_sha string, old_mode string, new_mode string")


def changed_paths(changes: DataFrame) -> DataFrame:
    """(repo, path) of changes as a list of names shows them: a file that only moved is named by where it is now.

    A path that is gone is left out if a new path has its content; as many such paths as there
    are new ones, those of the same file name first. Files that moved and changed have both paths.
    """
    name = F.substring_index("path", "/", -1)
    gone = changes.where("new_sha is null").select("repo", "path", F.col("old_sha").alias("sha"), name.alias("name"))
    come = changes.where("old_sha is null").select("repo", F.col("new_sha").alias("sha"), name.alias("name"))
    room = come.groupBy("repo", "sha").agg(F.count("*").alias("n"))
    same = come.select("repo", "sha", "name", F.lit(1).alias("same")).distinct()
    order = Window.partitionBy("repo", "sha").orderBy(F.desc_nulls_last("same"), "path")
    moved = gone.join(room, ["repo", "sha"]).join(same, ["repo", "sha", "name"], "left").withColumn("r", F.row_number().over(order)).where("r <= n").select("repo", "path")
    return changes.select("repo", "path").distinct().join(moved, ["repo", "path"], "left_anti")


def changed_since(spark: SparkSession, repo: str, ref: str) -> DataFrame | None:
    """(repo, path) of what differs between a ref and HEAD; None (not an empty list) if there is no such ref."""
    ends = [resolved(spark, repo, x) if git_folder(repo).is_dir() else None for x in (ref, "HEAD")]
    if None in ends:
        return None
    trees = {r["sha"]: r["tree"] for r in commits(objects(spark, repo).where(F.col("sha").isin(*ends))).collect()}
    pairs = spark.createDataFrame([(repo, trees[ends[0]], trees[ends[1]])], "repo string, old string, new string")
    return changed_paths(tree_changes(tree_entries(objects(spark, repo)), pairs))


def ahead_behind(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (repo, name, left, right) with ``ahead`` and ``behind``: commits that only ``left``, and only ``right``, comes from; null if one isn't there.

    ``graph`` has the commits (repo, sha, parents).
    """

    def run(key, commits, asked):
        import pyarrow as pa

        number: dict[str, int] = {s: i for i, s in enumerate(commits.column("sha").to_pylist())}
        parents = [[number[p] for p in ps if p in number] for ps in commits.column("parents").to_pylist()]

        def reached(sha: str) -> set[int]:
            seen, todo = {number[sha]}, [number[sha]]
            while todo:
                for p in parents[todo.pop()]:
                    if p not in seen:
                        seen.add(p)
                        todo.append(p)
            return seen

        cache: dict[str, set[int]] = {}
        out = []
        for left, right in zip(asked.column("left").to_pylist(), asked.column("right").to_pylist(), strict=True):
            if left not in number or right not in number:
                out.append((None, None))
                continue
            a = reached(left)
            if right not in cache:  # branches are mostly compared with one trunk
                cache = {right: reached(right)}
            out.append((len(a - cache[right]), len(cache[right] - a)))
        return pa.Table.from_arrays([asked.column("repo"), asked.column("name"), asked.column("left"), asked.column("right"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["repo", "name", "left", "right", "ahead", "behind"])

    few = pairs.select("repo", "name", "left", "right")
    return graph.select("repo", "sha", "parents").groupBy("repo").cogroup(few.groupBy("repo")).applyInArrow(run, "repo string, name string, left string, right string, ahead long, behind long")


def branch_states(spark: SparkSession, *repos: str) -> DataFrame:
    """(repo, name, left, right, ahead, behind) of the branches, and HEAD, that have an upstream which is there."""
    known = refs(spark, *repos)
    ups = known.select("repo", F.col("name").alias("upstream"), F.col("sha").alias("right"))
    pairs = known.withColumnRenamed("sha", "left").join(ups, ["repo", "upstream"]).select("repo", "name", "left", "right")
    return ahead_behind(commits(objects(spark, *repos).where("type = 'commit'")), pairs)


def pending_branches(spark: SparkSession, trunk: str, *repos: str) -> DataFrame:
    """(repo, name, ahead, committed, subject) of remote branches with commits that ``trunk`` (a full ref's name) lacks, but for pointers and the trunks themselves."""
    known = refs(spark, *repos)
    graph = commits(objects(spark, *repos).where("type = 'commit'"))
    mains = ("HEAD", "trunk", "master", "main", "staging")
    remote = known.where("name like 'refs/remotes/%'").where(~F.regexp_extract("name", "^refs/remotes/[^/]+/(.*)$", 1).isin(*mains))
    pairs = remote.select("repo", "name", F.col("sha").alias("left")).join(known.where(F.col("name") == trunk).select("repo", F.col("sha").alias("right")), "repo")
    found = ahead_behind(graph, pairs).where("ahead > 0")
    return found.join(graph.select("repo", F.col("sha").alias("left"), "committed", "subject"), ["repo", "left"]).select("repo", F.regexp_replace("name", "^refs/remotes/", "").alias("name"), "ahead", "committed", "subject")


def index_entries(spark: SparkSession, repo: str) -> DataFrame:
    """(path, mode, sha) of what is staged, read by one task from the index (versions 2 and 3)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                raw = Path(path).read_bytes() if Path(path).exists() else b"DIRC\0\0\0\2\0\0\0\0"
                version, count = struct.unpack(">II", raw[4:12])
                if raw[:4] != b"DIRC" or version not in (2, 3):
                    raise ValueError(f"{path}: an index of a version that isn't read: {version}")
                at, rows = 12, []
                for _ in range(count):
                    mode, name, flags = struct.unpack(">I", raw[at + 24 : at + 28])[0], raw[at + 40 : at + 60], struct.unpack(">H", raw[at + 60 : at + 62])[0]
                    start = at + (64 if flags & 0x4000 else 62)
                    end = raw.index(b"\0", start)
                    rows.append((raw[start:end].decode("utf-8", "replace"), f"{mode:06o}", name.hex()))
                    at += (end - at) // 8 * 8 + 8
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(("path", "mode", "sha"), r, strict=True)) for r in rows], pa.schema([(c, pa.string()) for c in ("path", "mode", "sha")]))
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "mode", "sha"), r, strict=True)) for r in rows], pa.schema([(c, pa.string()) for c in ("path", "mode", "sha")]))

    return spark.createDataFrame([(str(git_folder(repo) / "index"),)], "file string").mapInArrow(run, "path string, mode string, sha string")


def blob_name(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def uncommitted(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of files that are tracked and differ from HEAD, staged or not; None if there is no HEAD. Files are hashed in tasks."""
    commit = resolved(spark, root, "HEAD") if git_folder(root).is_dir() else None
    if commit is None:
        return None
    tree = commits(objects(spark, root).where(F.col("sha") == commit)).first()["tree"]
    none = spark.createDataFrame([(root, None, tree)], "repo string, old string, new string")
    at_head = tree_changes(tree_entries(objects(spark, root)), none).select("path", F.col("new_sha").alias("head"), F.col("new_mode").alias("head_mode"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = []
            for path in batch.column(0).to_pylist():
                at = Path(root) / path
                names.append(blob_name(os.readlink(at).encode()) if at.is_symlink() else blob_name(at.read_bytes()) if at.is_file() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], names=["path", "work"])

    staged = index_entries(spark, root)
    work = staged.where("mode <> '160000'").select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, work string")
    found = at_head.join(staged, "path", "full").join(work, "path", "left")
    differs = ~F.col("head").eqNullSafe(F.col("sha")) | ~F.col("head_mode").eqNullSafe(F.col("mode")) | ((F.col("mode") != "160000") & ~F.col("work").eqNullSafe(F.col("sha")))
    return found.where(differs).select("path")


def write_loose(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with ``sha`` in place of ``type`` and ``content``: these are written as loose objects of a repository, each task its own; an object that is there stays."""
    from pyspark.sql import types as T

    rest = [c for c in rows.columns if c not in ("type", "content")]
    store = str(git_folder(root) / "objects")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = []
            for kind, content in ((k.as_py(), c.as_py()) for k, c in zip(batch.column(0), batch.column(1), strict=True)):
                whole = b"%s %d\0" % (kind.encode(), len(content)) + content
                name = hashlib.sha1(whole).hexdigest()
                at = Path(store) / name[:2] / name[2:]
                if not at.exists():
                    at.parent.mkdir(parents=True, exist_ok=True)
                    part = at.with_name(f"{at.name}.{os.getpid()}.part")
                    part.write_bytes(zlib.compress(whole, 1))
                    part.replace(at)
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string())], names=[*rest, "sha"])

    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField("sha", T.StringType())])
    return rows.select("type", F.col("content").cast("binary").alias("content"), *rest).mapInArrow(run, schema)


def tree_rows(entries: DataFrame, by: str) -> DataFrame:
    """(by, type, content): the tree of each group of entries (mode, name, sha), as git orders them. A tree is one object, so one row."""
    raw = F.concat(F.regexp_replace("mode", "^0+", "").cast("binary"), F.lit(b" "), F.col("name").cast("binary"), F.lit(b"\0"), F.unhex("sha"))
    order = F.concat("name", F.when(F.col("mode") == "040000", "/").otherwise("")).cast("binary")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("order"), raw.alias("raw")))), lambda x: F.hex(x["raw"]))
    return entries.groupBy(by).agg(F.lit("tree").alias("type"), F.unhex(F.array_join(parts, "")).alias("content"))
