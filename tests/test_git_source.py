"""Repositories made by git, read as tables, against what git says."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from docloom.sources import git


def run(root, *args, when=None):
    env = os.environ | {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    if when is not None:
        env |= {"GIT_AUTHOR_DATE": f"{when} +0200", "GIT_COMMITTER_DATE": f"{when} +0000"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True, env=env).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Branches with a merge, a clone with remote branches, packed and loose objects."""
    base = tmp_path_factory.mktemp("git")
    up, root = base / "up", base / "work"
    up.mkdir()
    run(up, "init", "-q", "-b", "main")
    rng = random.Random(3)
    text = [f"line {i} {rng.random()}\n" for i in range(900)]
    for i in range(12):
        for name in ("a.txt", "src/deep/er/b.java", "src/c.py", f"only/{i}.md", "ünï/ö.txt"):
            (up / name).parent.mkdir(parents=True, exist_ok=True)
            text[rng.randrange(900)] = f"changed {i} {name}\n"
            (up / name).write_text("".join(text))
        run(up, "add", "-A")
        run(up, "commit", "-qm", f"Step {i}\nsecond line\n\nbody {i}", when=1700000000 + i * 100)
    run(up, "tag", "-a", "v1", "-m", "tag", when=1700002000)
    run(up, "branch", "feature", "HEAD~4")
    run(up, "branch", "merged", "HEAD~2")
    run(up, "checkout", "-q", "feature")
    for i in range(3):
        (up / f"feature{i}.txt").write_text("f" * i)
        run(up, "add", "-A")
        run(up, "commit", "-qm", f"Feature {i}", when=1700003000 + i)
    run(up, "checkout", "-q", "main")
    run(up, "gc", "-q")  # a pack with differences
    run(base, "clone", "-q", str(up), str(root))
    (root / "src/c.py").unlink()
    (root / "moved").mkdir()
    (root / "only/0.md").rename(root / "moved/0.md")
    (root / "a.txt").write_text("all new")
    (root / "src/deep/x").write_text("x")
    os.chmod(root / "only/1.md", 0o755)
    run(root, "add", "-A")
    run(root, "commit", "-qm", "Local", when=1700005000)
    run(root, "merge", "-q", "--no-edit", "origin/feature", when=1700006000)
    return root


def test_objects(spark, repo):
    want = dict(x.split()[:2] for x in run(repo, "cat-file", "--batch-check", "--batch-all-objects").splitlines())
    for options in ({}, {"range": 7}):
        found = git.objects(spark, str(repo), **options)
        got = found.select("sha", "type", "size", F.sha1(F.concat(F.concat_ws(" ", "type", "size").cast("binary"), F.lit(b"\0"), "content")).alias("own")).collect()
        assert {r.sha: r.type for r in got} == want and all(r.sha == r.own for r in got)
    some = sorted(want)[::9]
    few = git.objects(spark, str(repo)).where(F.col("sha").isin(*some, "nonsense"))
    assert {r.sha for r in few.collect()} == set(some) and few.where("type = 'tree'").count() == sum(want[s] == "tree" for s in some)


def test_commits_and_refs(spark, repo):
    got = {r.sha: r for r in git.commits(git.objects(spark, str(repo))).collect()}
    want = [x.split("\x1f") for x in run(repo, "log", "--all", "--format=%H%x1f%T%x1f%P%x1f%an%x1f%at%x1f%ct%x1f%s").splitlines()]
    assert {(r.sha, r.tree, " ".join(r.parents), r.author, str(r.authored), str(r.committed), r.subject) for r in got.values()} == set(map(tuple, want)) and len(want) > 15
    found = {r["name"]: r for r in git.refs(spark, str(repo)).collect()}
    assert {n: r.sha for n, r in found.items() if n != "HEAD"} == {x.split()[1]: x.split()[0] for x in run(repo, "for-each-ref", "--format=%(objectname) %(refname)").splitlines()}
    assert found["HEAD"].sha == run(repo, "rev-parse", "HEAD").strip() and found["HEAD"].symbolic == "refs/heads/main" and found["HEAD"].upstream == "refs/remotes/origin/main"
    assert git.head(spark, str(repo)) == run(repo, "rev-parse", "--short=7", "HEAD").strip() and git.head(spark, "/tmp/no-such-repo") == "unknown"
    for ref in ("HEAD", "v1", "origin/feature", "main", run(repo, "rev-parse", "HEAD~3").strip(), run(repo, "rev-parse", "--short=9", "HEAD~3").strip()):
        assert git.resolved(spark, str(repo), ref) == run(repo, "rev-parse", f"{ref}^{{commit}}").strip()
    assert git.resolved(spark, str(repo), "no-such") is None and git.resolved(spark, str(repo), "0" * 40) is None


@pytest.mark.parametrize("ref", ["HEAD", "HEAD~1", "origin/main", "v1", "origin/feature", "ROOT"])
def test_changed_paths(spark, repo, ref):
    sha = run(repo, "rev-parse", f"{ref}^{{commit}}").strip() if ref != "ROOT" else run(repo, "rev-list", "--max-parents=0", "HEAD").strip()
    # names as they are; moves only where the content is the same
    want = set(filter(None, run(repo, "-c", "core.quotepath=off", "diff", "--name-only", "-M100%", sha, "HEAD").split("\n")))
    got = git.changed_since(spark, str(repo), ref if ref not in ("HEAD~1", "ROOT") else sha)
    assert {r.path for r in got.collect()} == want


def test_no_such_ref_is_no_list(spark, repo, tmp_path):
    assert git.changed_since(spark, str(repo), "none") is None and git.changed_since(spark, str(tmp_path), "HEAD") is None and git.uncommitted(spark, str(tmp_path)) is None


def test_ahead_and_behind(spark, repo):
    got = {r["name"]: (r.ahead, r.behind) for r in git.branch_states(spark, str(repo)).collect()}
    behind, ahead = map(int, run(repo, "rev-list", "--left-right", "--count", "@{u}...HEAD").split())
    assert got == {"HEAD": (ahead, behind), "refs/heads/main": (ahead, behind)} and ahead > 3
    graph = git.commits(git.objects(spark, str(repo)))
    names = ["origin/feature", "origin/main", "origin/merged", "HEAD", "v1"]
    sha = {n: run(repo, "rev-parse", f"{n}^{{commit}}").strip() for n in names}
    pairs = [(str(repo), f"{a} {b}", sha[a], sha[b]) for a in names for b in names] + [(str(repo), "lost", sha["HEAD"], "0" * 40)]
    got = {r["name"]: (r.ahead, r.behind) for r in git.ahead_behind(graph, spark.createDataFrame(pairs, "repo string, name string, left string, right string")).collect()}
    for a in names:
        for b in names:
            left, right = map(int, run(repo, "rev-list", "--left-right", "--count", f"{sha[a]}...{sha[b]}").split())
            assert got[f"{a} {b}"] == (left, right)
    assert got["lost"] == (None, None)
    pending = git.pending_branches(spark, "refs/remotes/origin/main", str(repo)).collect()
    assert [(r["name"], r.ahead, r.subject) for r in pending] == [("origin/feature", 3, "Feature 2")]
    assert {x.strip() for x in run(repo, "branch", "-r", "--no-merged", "origin/main").splitlines()} == {"origin/feature"}


def test_uncommitted(spark, repo):
    assert git.uncommitted(spark, str(repo)).count() == 0
    (repo / "a.txt").write_text("not staged")
    (repo / "new staged").write_text("1")
    (repo / "untracked").write_text("1")
    (repo / "src/deep/x").unlink()
    run(repo, "add", "new staged")
    try:
        want = set(filter(None, run(repo, "diff", "--name-only", "HEAD").split("\n")))
        assert {r.path for r in git.uncommitted(spark, str(repo)).collect()} == want == {"a.txt", "new staged", "src/deep/x"}
    finally:
        run(repo, "reset", "-q", "--hard")


def test_entries_of_large_trees_come_in_bounded_batches():
    import pyarrow as pa

    names = [f"f{i:06}" for i in range(25_000)]
    tree = b"".join(b"100644 " + n.encode() + b"\0" + bytes(20) for n in names)
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 3), pa.array(["a", "b", "c"]), pa.array([tree, b"", tree])], names=["repo", "sha", "content"])
    got = list(git.entry_batches([batch]))
    assert max(b.num_rows for b in got) <= git.ENTRIES and [(t, n) for b in got for t, n in zip(b["tree"].to_pylist(), b["name"].to_pylist(), strict=True)] == [(t, n) for t in "ac" for n in names]
