"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors become one row with a weight first. Each distinct vector then gets a
signature of ``bits`` signs in each of ``tables`` tables; vectors that share a
signature in any table are compared by their exact cosine in double precision. The
number of bits follows the logarithm of the row count, so buckets keep their size
as the table grows, and the number of tables follows from the bits, the threshold
and the recall asked for.

A bucket's task hands on how many links each vector has and a spanning forest of
them, never the pairs. A pair that meets in several tables counts in the first
only: signatures of all tables travel with a vector. Buckets beyond ``TILE_ROWS``
rows are cut into tiles whose pairs go to different tasks, so no bucket has a cap.

Results for odd input: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null id, link with nothing; vectors of
different lengths do not link; repeated rows count as other vectors with the same
values; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint
from .components import connected_components
from .simhash import union_labels

TILE_ROWS = 4_096
BLOCK = 1_024


def plan_tables(rows: int, threshold: float, recall: float, bucket: int = 32) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` unrelated vectors; a pair at the threshold meets with chance ``recall``."""
    bits = max(4, min(48, math.ceil(math.log2(max(rows, 2) / bucket)) if rows > bucket else 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, vec): the vector's components as bytes of doubles, null if it links with nothing."""
    v = F.col(vector)
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), "<f8") + 0.0  # one zero
            raw, at, out = flat.tobytes(), 0, []
            for n in lists.value_lengths().to_pylist():
                out.append(None if n is None else raw[at : at + 8 * n])
                at += 8 * (n or 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return df.select(F.col(key).cast("long").alias("id"), F.when(good, v.cast("array<double>")).alias("v")).mapInArrow(run, "id long, vec binary")


def _signatures(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``classes`` (rep, weight, vec) with ``sig``: an array of one long for each table."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            out = np.zeros((len(vecs), tables), np.int64)
            sizes = np.array([len(x) // 8 for x in vecs])
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                own = np.flatnonzero(sizes == d)
                x = np.frombuffer(b"".join(vecs[i] for i in own), "<f8").reshape(len(own), d)
                out[own] = ((x @ planes[d]).reshape(len(own), tables, bits) > 0) @ powers
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sig], names=["rep", "weight", "vec", "sig"])

    return classes.mapInArrow(run, "rep long, weight long, vec binary, sig array<long>")


def compare_bucket(x, y, table: int, sx, sy, wx, wy, label, shift: int, nx, ny, threshold: float, same: bool) -> None:
    """Adds to ``nx`` and ``ny`` the weights of links between rows of ``x`` and ``y`` that no earlier table has, and unites labels."""
    import numpy as np

    lx, ly = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    for r in range(0, len(x), BLOCK):
        for c in range(r if same else 0, len(y), BLOCK):
            cosine = (x[r : r + BLOCK] @ y[c : c + BLOCK].T) / (lx[r : r + BLOCK, None] * ly[None, c : c + BLOCK])
            hit = cosine >= threshold
            if same and r == c:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            i, j = i + r, j + c
            if table:
                new = ~(sx[i, :table] == sy[j, :table]).any(1)
                i, j = i[new], j[new]
            nx += np.bincount(i, wy[j], len(nx)).astype(np.int64)
            ny += np.bincount(j, wx[i], len(ny)).astype(np.int64)
            union_labels(label, i, j + shift)


def _compare(threshold: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        n = table.num_rows
        rep, weight, side, no, bucket = (table.column(c).to_numpy() for c in ("rep", "weight", "side", "no", "bucket"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(n, -1)
        vec, t = table.column("vec").to_pylist(), int(no[0])
        size = np.array([len(v) for v in vec])
        order = np.lexsort([side, size, bucket])
        starts = np.flatnonzero(np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(size[order]) != 0)])
        links, label = np.zeros(n, np.int64), np.arange(n)
        for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
            own = order[a:b]
            m = int((side[own] == 0).sum())
            if len(own) < 2:
                continue
            x = np.frombuffer(b"".join(vec[i] for i in own), "<f8").reshape(len(own), -1)
            part, lab = np.zeros(len(own), np.int64), np.arange(len(own))
            w, s = weight[own], sig[own]
            if m == len(own):
                compare_bucket(x, x, t, s, s, w, w, lab, 0, part, part, threshold, True)
            else:
                compare_bucket(x[:m], x[m:], t, s[:m], s[m:], w[:m], w[m:], lab, m, part[:m], part[m:], threshold, False)
            links[own] = part
            label[own] = own[lab]
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, label, rep)
        low = low[label]
        far, some = low != rep, links > 0
        return pa.table({"src": pa.array(np.r_[rep[some], low[far]]), "dst": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(rep[far])]), "n": pa.concat_arrays([pa.array(links[some]), pa.nulls(int(far.sum()), pa.int64())])})

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = 0.997, seed: int = 7) -> DataFrame:
    """One row for each of ``df``: (id, n_links, component_id, kept)."""
    rows = checkpoint(_packed(df, key, vector))
    classes = checkpoint(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "vec"))
    count = classes.count()
    bits, tables = plan_tables(count, threshold, recall)
    signed = _signatures(classes, bits, tables, seed)
    met = signed.select("rep", "weight", "vec", "sig", F.posexplode("sig").alias("no", "bucket"))
    # buckets beyond a tile's rows, with the number of tiles that each is cut into; at most tables x rows / TILE_ROWS of them
    large = signed.select(F.posexplode("sig").alias("no", "bucket")).groupBy("no", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > TILE_ROWS)
    large = large.select("no", "bucket", F.ceil(F.col("size") / TILE_ROWS).cast("int").alias("tiles"))
    # small buckets share groups of about a tile's rows: a group's cost is then not that of starting it
    shares = max(1, -(-count // TILE_ROWS))
    met = met.join(large, ["no", "bucket"], "left").withColumn("tile", F.pmod(F.xxhash64("rep"), F.coalesce("tiles", F.lit(1))).cast("int"))
    t, i = F.coalesce("tiles", F.lit(1)), F.col("tile")
    # tile i meets every other tile: as the left side of (i, j), i <= j, and as the right side of (j, i), j < i
    to = F.transform(F.sequence(F.lit(0), t - 1), lambda j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), F.when(j < i, 1).otherwise(0).alias("side")))
    sent = met.select("rep", "weight", "vec", "sig", "no", "bucket", F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("bucket"), F.lit(shares))).otherwise(-1).alias("share"), F.when(F.col("tiles").isNull(), 0).otherwise(F.col("bucket")).alias("alone"), F.explode(to).alias("m"))
    sent = sent.select("rep", "weight", "vec", "sig", "no", "bucket", "share", "alone", "m.a", "m.b", F.col("m.side").alias("side"))
    found = checkpoint(sent.groupBy("no", "share", "alone", "a", "b").applyInArrow(_compare(threshold), "src long, dst long, n long"))
    links = found.where("n is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("dst is not null").select("src", "dst"))
    result = classes.join(links, "rep", "left").join(groups, F.col("rep") == F.col("id"), "left").select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(result, "vec", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
