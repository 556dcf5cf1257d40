"""Hard-negative mining: an orthogonal rotation to principal components, partial products with bounds, exact verification.

Vectors become integers (the floor of 256 times a component). Their second moments are
summed in tasks; the eigenvectors of that small matrix rotate every vector so that the
leading components hold most of the length. A pair's product is then accumulated over
the leading components, some at a time; what the others can add is at most the product
of the two residual lengths, plus slack for rounding. A pair that can't come among the
first, or can't lie within the bounds asked for, is dropped as soon as that shows; the
rest is verified with integer products.

Anchors in blocks meet rows in chunks: a cell of that grid is one stream through a
task that holds the anchors of its block and a batch of rows, never a whole chunk, and
hands on no more than the first few of each anchor. The positives are one sweep of the
grid (same label, the first five), the negatives another (other labels, within the
bounds that a positive's score sets); a label that most rows have is cut into chunks as
any other.

Results for odd input: rows with a null label, a null vector or a null or non-finite
component take no part; a null vec_id is no anchor and comes last of equal scores;
repeated rows are rows of their own (a repeated anchor gives its rows again); shorter
vectors count as if filled up with zeros; integers beyond 64 bits are the largest that
64 bits hold; an empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Anchors in a block; rows in a chunk, of which there are CHUNKS at most; rows of a matrix.
ANCHORS, CHUNK_ROWS, CHUNKS, STEP = 4_096, 8_192, 64, 512
#: Pairs are looked at again where the components left hold this share of the squared length.
LEFT = (0.5, 0.25, 0.1, 0.03)
#: Relative error of a rotated product, for each component.
ROUNDING = 1e-13
LOW, HIGH = -(2**63), 2**63 - 1


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(row, id, label, v) of the rows that take part; ``row`` tells repeated rows apart."""
    v = F.col(vector).cast("array<double>")
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x * scale))
    return df.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), ints.alias("v"))


def rotation(rows: DataFrame, width: int):
    """(matrix, eigenvalues): the orthogonal rotation to principal components of ``rows`` (v of ``width``), largest first."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total))], names=["i", "sums"])

    parts = rows.select("v").mapInArrow(run, "i long, sums array<double>").select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    moments = np.zeros((width, width))
    for r in parts.toLocalIterator():  # width * width numbers
        moments[r["i"], r["j"]] = r["x"]
    # scaled, so that huge components don't overflow
    values, vectors = np.linalg.eigh(moments / max(1.0, np.abs(moments).max()))
    return np.ascontiguousarray(vectors[:, ::-1]), np.maximum(values[::-1], 0)


def stages(values, left: tuple[float, ...] = LEFT) -> list[int]:
    """Numbers of leading components after which pairs are looked at: where the others hold the shares ``left``, and all."""
    import numpy as np

    total = values.sum()
    rest = 1 - np.cumsum(values) / total if total else np.zeros(len(values))
    return sorted({int(np.argmax(rest <= share)) + 1 for share in left if (rest <= share).any()} | {len(values)})


class Sweep:
    """The anchors of a block with what is asked of each, and the first ``k`` rows found for every demand."""

    def __init__(self, rotate, ends: list[int], k: int, same_label: bool):
        self.rotate, self.ends, self.k, self.same_label = rotate, ends, k, same_label

    def prepared(self, ints):
        """Rotated vectors, the lengths of what is left after each stage, and whole lengths."""
        import numpy as np

        x = ints.astype(float) @ self.rotate
        squares = x * x
        left = [np.sqrt(squares[:, e:].sum(1)) for e in self.ends]
        return x, left, np.sqrt(squares.sum(1))

    def start(self, row, label, ints, low, high) -> None:
        """Anchors, with the bounds ``low`` and ``high`` (anchors x demands) that a score must lie in; a demand with low > high asks for nothing."""
        import numpy as np

        self.row, self.label, self.ints, self.low, self.high = row, label, ints, low, high
        self.x, self.left, self.length = self.prepared(ints)
        self.demands = low.shape[1]
        self.least = low.copy()  # rises to the k-th score
        self.found = [np.zeros(0, np.int64) for _ in range(4)]  # demand, score, id, row
        self.pending, self.size = [], 0
        self._bounds()

    def _bounds(self) -> None:
        """The least and the greatest score that any demand of an anchor can use."""
        import numpy as np

        none = self.low > self.high
        self.floor = np.where(none, np.inf, self.least.astype(float)).min(1, initial=np.inf)
        self.ceiling = np.where(none, -np.inf, self.high.astype(float)).max(1, initial=-np.inf)

    def see(self, row, ids, label, ints) -> None:
        for a in range(0, len(row), STEP):
            self._see(row[a : a + STEP], ids[a : a + STEP], label[a : a + STEP], ints[a : a + STEP])

    def _see(self, row, ids, label, ints) -> None:
        import numpy as np

        y, left, length = self.prepared(ints)
        slack = ROUNDING * len(self.rotate) * self.length[:, None] * length[None, :]
        keep = self.label[:, None] == label[None, :]
        if not self.same_label:
            keep = ~keep
        keep &= self.row[:, None] != row[None, :]
        total, at, i = np.zeros(keep.shape), 0, None
        for s, end in enumerate(self.ends):
            if i is None and keep.mean() < 0.2:
                i, j = np.nonzero(keep)
                total, slack = total[i, j], slack[i, j]
            if i is None:
                total += self.x[:, at:end] @ y[:, at:end].T
                room = self.left[s][:, None] * left[s][None, :] + slack
                keep &= (total + room >= self.floor[:, None]) & (total - room <= self.ceiling[:, None])
            else:
                for a in range(0, len(i), 65536):
                    b = slice(a, a + 65536)
                    total[b] += np.einsum("pd,pd->p", self.x[i[b], at:end], y[j[b], at:end])
                room = self.left[s][i] * left[s][j] + slack
                some = (total + room >= self.floor[i]) & (total - room <= self.ceiling[i])
                i, j, total, slack = i[some], j[some], total[some], slack[some]
            at = end
        if i is None:
            i, j = np.nonzero(keep)
        for a in range(0, len(i), 65536):
            self._verify(i[a : a + 65536], j[a : a + 65536], row, ids, ints)

    def _verify(self, i, j, row, ids, ints) -> None:
        import numpy as np

        score = products(self.ints[i], ints[j])
        for d in range(self.demands):
            some = np.flatnonzero((score >= self.least[i, d]) & (score <= self.high[i, d]) & (self.low[i, d] <= self.high[i, d]))
            if len(some):
                self.pending.append((i[some] * self.demands + d, score[some], ids[j[some]], row[j[some]]))
                self.size += len(some)
        if self.size >= max(4096, len(self.found[0])):
            self._merge()

    def _merge(self) -> None:
        import numpy as np

        if not self.pending:
            return
        demand, score, ids, row = (np.concatenate([self.found[c], *(p[c] for p in self.pending)]) for c in range(4))
        order = np.lexsort([row, ids, ~score, demand])
        own = demand[order]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
        last = order[place == self.k - 1]
        self.least[demand[last] // self.demands, demand[last] % self.demands] = score[last]
        order = order[place < self.k]
        self.found, self.pending, self.size = [x[order] for x in (demand, score, ids, row)], [], 0
        self._bounds()

    def result(self):
        """(anchor index, demand, score, id, row) of the rows found."""
        self._merge()
        demand, score, ids, row = self.found
        return demand // self.demands, demand % self.demands, score, ids, row


def products(x, y):
    """Inner products of the rows of two integer matrices; beyond 64 bits the largest number that these hold."""
    import numpy as np

    if not len(x) or np.abs(x.astype(float)).max(initial=0) * np.abs(y.astype(float)).max(initial=0) * max(1, x.shape[1]) < 2.0**62:
        return (x * y).sum(1)
    return np.array([min(max(sum(a * b for a, b in zip(p, q, strict=True)), LOW), HIGH) for p, q in zip(x.tolist(), y.tolist(), strict=True)], np.int64)


def swept(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, width: int, rotate, ends: list[int], k: int, same_label: bool) -> DataFrame:
    """(row, no, score, id, other): for demand ``no`` of each anchor its first ``k`` rows of every chunk.

    ``anchors`` (row, label, v, low, high) have arrays of as many bounds each. A cell's
    anchors come before its rows in the sorted partition.
    """
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    bounds = F.array().cast("array<long>")
    right = rows.select("row", "id", "label", "v", bounds.alias("low"), bounds.alias("high"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("side"), every(blocks, "block"))
    left = anchors.select("row", F.lit(None).cast("long").alias("id"), "label", "v", "low", "high", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), every(chunks, "chunk"))
    sent = right.unionByName(left).repartition(blocks * chunks, "block", "chunk").sortWithinPartitions("block", "chunk", "side")
    shared = rows.sparkSession.sparkContext.broadcast((rotate, ends))  # width * width numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cell, held, sweep = None, [], None

        def out():
            if sweep is None:
                return
            i, no, score, ids, other = sweep.result()
            # the order of null ids is that of the greatest number
            yield pa.RecordBatch.from_arrays([pa.array(sweep.row[i]), pa.array(no.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(other)], names=["row", "no", "score", "id", "other"])

        def matrix(column, wide):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)

        for batch in batches:
            row, block, chunk, side, label = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row", "block", "chunk", "side", "label"))
            ids = batch.column(batch.schema.get_field_index("id")).fill_null(HIGH).to_numpy(zero_copy_only=False)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("v", "low", "high")]
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1]), True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (block[a], chunk[a]) != cell:
                    yield from out()
                    cell, held, sweep = (block[a], chunk[a]), [], None
                ints = matrix(own[0].slice(a, b - a), width)
                if side[a] == 0:
                    held.append((row[a:b], label[a:b], ints, own[1].slice(a, b - a), own[2].slice(a, b - a)))
                    continue
                if sweep is None and held:
                    demands = len(held[0][3][0])
                    sweep = Sweep(*shared.value, k, same_label)
                    sweep.start(*(np.concatenate([h[c] for h in held]) for c in range(3)), *(np.concatenate([matrix(h[c], demands) for h in held]) for c in (3, 4)))
                if sweep is not None:
                    sweep.see(row[a:b], ids[a:b], label[a:b], ints)
        yield from out()

    return sent.mapInArrow(run, "row long, no int, score long, id long, other long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """Of all chunks' rows the first ``k`` of each demand, with ``rank``; a demand has ``k`` rows of each chunk at most."""
    order = Window.partitionBy("row", "no").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_anchors: int = ANCHORS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (row, id, label, v).

    Anchors are the rows whose id ``anchors`` divides; a negative's score is ``least``
    to ``most`` percent of the positive's.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.table(rows)
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    rotate, values = rotation(rows, width)
    asking = rows.where(F.col("id") % anchors == 0)
    blocks = max(1, -(-asking.count() // block_anchors))
    chunks = min(CHUNKS, max(1, -(-count // chunk_rows)))
    grid = (blocks, chunks, width, rotate, stages(values))
    first = asking.select("row", "label", "v", F.array(F.lit(LOW)).alias("low"), F.array(F.lit(HIGH)).alias("high"))
    found = scratch.table(firsts(swept(rows, first, *grid, positives, True), positives).select("row", F.col("id").alias("positive_id"), (F.col("rank") - 1).alias("no"), F.col("score").alias("positive_score")))
    # 30 p <= 100 n <= 90 p, for integers n; computed in decimals, as 90 p may exceed 64 bits
    p = F.col("positive_score").cast("decimal(38,0)")
    bounded = found.select("row", "no", F.ceil(p * least / 100).cast("long").alias("low"), F.floor(p * most / 100).cast("long").alias("high"))
    asked = bounded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "low", "high"))).alias("d"))  # as many as positives
    # those with fewer positives ask for nothing in their place: low > high
    fill = lambda c, x: F.concat(F.transform("d", lambda y: y[c]), F.array_repeat(F.lit(x).cast("long"), F.lit(positives) - F.size("d"))).alias(c)
    second = asking.join(asked, "row").select("row", "label", "v", fill("low", 1), fill("high", 0))
    picked = firsts(swept(rows, second, *grid, negatives, False), negatives)
    named = picked.select("row", "no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["row", "no"]).join(asking.select("row", F.col("id").alias("anchor_id")), "row")
    known = lambda c: F.when(F.col(c) != HIGH, F.col(c)).alias(c)  # noqa: E731  null ids went as the greatest number
    return named.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_rows(table(spark, sf_dir, "embeddings").withColumn("label", label)))


#: The same by all products of anchors and rows.
NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
