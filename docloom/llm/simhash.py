"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints of 64 bits are computed where documents are read. Rows of one
fingerprint become one class; only distinct fingerprints are compared, and every
pair of them is decided exactly: tiles of fingerprints are compared with numpy
exclusive-or and bit counts. A tile holds fingerprints of one population count in
the high and one in the low half. Two fingerprints that differ in at most ``radius``
bits have population counts that differ by no more than that in sum over the
halves, so all other tile pairs are skipped before any row is sent. Inside a tile
pair the counts of the four 16-bit words prune once more.

A tile pair hands on a spanning forest of the links it found, never the links of
all pairs, so a group of thousands of near copies costs a row for each member. The
forests are joined by distributed connected components.

Results for odd input: a null or wordless text has fingerprint zero and is linked
like any other; a null key is kept as a row (its component is the group's least
key, null if the group has no other); repeated rows are repeated in the result; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Scratch, checkpoint, slices, texts_of
from .components import connected_components

#: Fingerprints in a tile at most (a tile pair of two such tiles takes a few MB in its task).
TILE_ROWS = 65_536
#: Fingerprints of each side that are compared at once: 8 MB of exclusive-ors.
BLOCK = 1_024


def fingerprint_words(text: str, shingle: int) -> int:
    """The SimHash of a text's lower-cased (A-Z) word shingles, by XXH64 with seed 42."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [hashed(b" ".join(words), 42)]
    else:
        hashes = [hashed(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]  # noqa: B905
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):  # very long texts in bounded memory
        part = np.array(hashes[start : start + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (key, fp): ``fp`` is the fingerprint's 64 bits as a long. No shuffle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            got = np.array([fingerprint_words(x or "", shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["key", "fp"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def word_counts(x):
    """Population counts of the four 16-bit words of each fingerprint."""
    import numpy as np

    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def union_labels(label, i, j) -> None:
    """Unite, in place, the groups of rows ``i`` and ``j`` (arrays); a label is its group's least row."""
    import numpy as np

    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def linked_groups(a, b, radius: int):
    """Labels over the rows of ``a`` then ``b`` (``b`` None: ``a`` with itself): equal where links within ``radius`` connect."""
    import numpy as np

    every = a if b is None else np.concatenate([a, b])
    label = np.arange(len(every))
    shift = 0 if b is None else len(a)
    right = a if b is None else b

    # the rows of one tuple of word counts stand together on the right; only near tuples are compared
    def runs(x):
        counts = word_counts(x)
        order = np.lexsort(counts.T)
        counts = counts[order]
        starts = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(1)])
        return order, counts[starts], starts, np.r_[starts[1:], len(x)]

    if not len(a) or not len(right):
        return label
    la, ca, sa, ea = runs(a)
    lb, cb, sb, eb = (la, ca, sa, ea) if b is None else runs(right)
    for k in range(len(sa)):
        near = np.flatnonzero(np.abs(cb - ca[k]).sum(1) <= radius)
        if b is None:
            near = near[near >= k]
        if not len(near):
            continue
        rows, cols = la[sa[k] : ea[k]], np.concatenate([lb[sb[t] : eb[t]] for t in near])
        for r in range(0, len(rows), BLOCK):
            mine = rows[r : r + BLOCK]
            for c in range(0, len(cols), BLOCK):
                other = cols[c : c + BLOCK]
                hit = np.bitwise_count(a[mine][:, None] ^ right[other][None, :]) <= radius
                if hit.any():
                    i, j = np.nonzero(hit)
                    union_labels(label, mine[i], other[j] + shift)
    return label


def _compare(radius: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        fp = table.column("fp").to_numpy().view(np.uint64)
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        left, right = side == 0, side == 1
        label = linked_groups(fp[left], fp[right] if right.any() else None, radius)
        reps = np.concatenate([rep[left], rep[right]])
        low = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(low, label, reps)
        low = low[label]
        far = low != reps
        return pa.table({"src": pa.array(low[far]), "dst": pa.array(reps[far])})

    return run


def paired_tiles(rows: DataFrame, cell: tuple[str, ...], near: list[tuple[int, ...]], tile_rows: int, by: tuple[str, ...]) -> DataFrame:
    """``rows`` once for each tile pair that they are in: columns ``pair`` and ``side`` (0 or 1).

    ``cell`` names integer columns; a cell is cut into tiles of about ``tile_rows`` rows by
    the hash of ``by`` and meets the cells at the offsets ``near`` (itself among them). The
    cells are few by construction (population counts, bands of sizes), so their table of
    counts and neighbours is broadcast; the tile pairs are never listed.
    """
    counts = rows.groupBy(*cell).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    counts = checkpoint(counts)
    offsets = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(o, cell, strict=True))) for o in near))
    met = counts.select(*cell, F.col("tiles").alias("own"), F.explode(offsets).alias("o")).select(*cell, "own", *((F.col(c) + F.col("o")[c]).alias(f"to_{c}") for c in cell))
    there = counts.select(*(F.col(c).alias(f"to_{c}") for c in cell), "tiles")
    met = met.join(there, [f"to_{c}" for c in cell]).groupBy(*cell, "own").agg(F.collect_list(F.struct(F.struct(*(F.col(f"to_{c}").alias(c) for c in cell)).alias("cell"), "tiles")).alias("others"))
    at = rows.join(F.broadcast(met), list(cell)).withColumn("tile", F.pmod(F.xxhash64(*by), F.col("own")).cast("int"))
    at = at.select(*rows.columns, F.struct(F.struct(*cell).alias("cell"), "tile").alias("here"), F.explode("others").alias("other"))
    at = at.select(*rows.columns, "here", F.explode(F.transform(F.sequence(F.lit(0), F.col("other.tiles") - 1), lambda j: F.struct(F.col("other.cell").alias("cell"), j.alias("tile")))).alias("there"))
    return at.select(*rows.columns, F.struct(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b")).alias("pair"), F.when(F.col("here") <= F.col("there"), 0).otherwise(1).alias("side"))


def tile_links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (src, dst) between ``rep`` of distinct fingerprints (fp, rep): a spanning forest for each compared tile pair."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    near = [(h, w) for h in range(-radius, radius + 1) for w in range(-radius, radius + 1) if abs(h) + abs(w) <= radius]
    sent = paired_tiles(distinct.select("fp", "rep", high.alias("high"), low.alias("low")), ("high", "low"), near, tile_rows, ("fp",))
    return sent.select("pair", "side", "fp", "rep").groupBy("pair").applyInArrow(_compare(radius), "src long, dst long")


def near_duplicates(prints: DataFrame, radius: int = 3, key: str = "key") -> DataFrame:
    """``prints`` (key, fp) with ``component_id``: the least key (of any type that has an order) of all rows reachable by links of at most ``radius`` bits.

    ``prints`` is read more than once; pass a checkpoint.
    """
    distinct = checkpoint(prints.groupBy("fp").agg(F.min(key).alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    groups = checkpoint(connected_components(tile_links(distinct.select("fp", "rep"), radius)))
    joined = distinct.join(groups, distinct["rep"] == groups["id"])
    named = joined.groupBy("component").agg(F.min("least").alias("whole"))
    found = joined.join(named, "component").select("fp", F.col("whole").alias("component_id"))
    alone = distinct.join(groups, distinct["rep"] == groups["id"], "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(found.union(alone), "fp")


#: Longs in a sketch, the similarity that links, and standard deviations above the mean at it within which sketches are candidates.
SKETCH, SIMILARITY, DEVIATIONS = 8, 0.8, 4


def sketch_words(text: str, shingle: int = 5, longs: int = SKETCH) -> tuple[int, bytes]:
    """(distinct word shingles, SimHash of 64 x ``longs`` bits over them): for similarity of sets."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0, bytes(8 * longs)
    n = max(1, len(words) - shingle + 1)
    every = {b" ".join(words)} if n == 1 else {b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))}  # noqa: B905
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in every], np.uint64)
    out = np.zeros(longs, "<u8")
    for k in range(longs):  # further hashes are mixed from the first
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones = sum((np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for part in np.array_split(z, 1 + len(z) // 65536)), np.zeros(64, np.int64))
        out[k : k + 1] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")
    return len(h), out.tobytes()


def sketched(text):
    """A struct column of a column of texts: the number of distinct five-word shingles, the sketch and its population count. Only texts go to Python."""

    @F.arrow_udf("struct<size:long,sketch:binary,ones:int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [sketch_words(x) for part in texts_of(batch) for x in part]
            ones = [int.from_bytes(g[1], "little").bit_count() for g in got]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array(ones, pa.int32())], names=["size", "sketch", "ones"])

    return run(text)


def sketch_radius(similarity: float = SIMILARITY, longs: int = SKETCH) -> int:
    """Bits that two sketches differ in at the similarity (equal sizes), and ``DEVIATIONS`` standard deviations more."""
    import math

    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * longs * p + DEVIATIONS * math.sqrt(64 * longs * p * (1 - p)))


def similar_pairs(a, sa, ca, b, sb, cb, radius: int, similarity: float, forest: bool):
    """Pairs (i, j) of rows of sketches, with sizes and groups, of different groups and within the bounds; ``b`` None: ``a`` with itself.

    Rows of ``b`` are numbered after those of ``a``. With ``forest``, pairs of a spanning forest only.
    """
    import numpy as np

    same = b is None
    label = np.arange(len(a) + (0 if same else len(b)))
    shift, b, sb, cb = (0, a, sa, ca) if same else (len(a), b, sb, cb)
    first, out = sketch_radius(similarity, 1), []
    for r in range(0, len(a), BLOCK):
        for c in range(r if same else 0, len(b), BLOCK):
            x, y, m, n = a[r : r + BLOCK], b[c : c + BLOCK], sa[r : r + BLOCK], sb[c : c + BLOCK]
            i, j = np.nonzero(np.bitwise_count(x[:, 0][:, None] ^ y[:, 0][None, :]) <= first)
            apart = ca[i + r] != cb[j + c]
            if same and r == c:
                apart &= i < j
            if forest:
                apart &= label[i + r] != label[j + c + shift]  # links within a group are no news
            i, j = i[apart], j[apart]
            sized = np.minimum(m[i], n[j]) >= similarity * np.maximum(m[i], n[j])
            i, j = i[sized], j[sized]
            for k in range(0, len(i), 1 << 17):
                p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
                near = np.bitwise_count(x[p] ^ y[q]).sum(1, dtype=np.int64) <= radius
                p, q = p[near] + r, q[near] + c + shift
                if not forest:
                    out.append((p, q))
                    continue
                old = label.copy()
                union_labels(label, p, q)
                moved = np.flatnonzero(old != label)  # each joins its group's new least row
                out.append((label[moved], moved))
    return [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]


def _compare_sketches(radius: int, similarity: float, forest: bool):
    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(table.num_rows, -1)
        size, rep, comp, side = (table.column(c).to_numpy() for c in ("size", "rep", "comp", "side"))
        left, right = side == 0, side == 1
        other = (rows[right], size[right], comp[right]) if right.any() else (None, None, None)
        i, j = similar_pairs(rows[left], size[left], comp[left], *other, radius, similarity, forest)
        reps = np.concatenate([rep[left], rep[right]])
        return pa.table({"src": pa.array(np.minimum(reps[i], reps[j])), "dst": pa.array(np.maximum(reps[i], reps[j]))})

    return run


def shingle_set(text: str, shingle: int = 5):
    """The distinct hashes of a text's word shingles, as longs."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    every = {b" ".join(words)} if n == 1 else {b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))}  # noqa: B905
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in every], np.uint64)).view(np.int64)


def with_shingles(df: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """(id, set) of rows (id, text). No shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x or "", shingle) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "set"])

    return df.select("id", F.col(text).alias("text")).mapInArrow(run, "id long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (src, dst) whose sets of shingles have the Jaccard similarity, exactly. Two empty sets are alike."""
    both = pairs.join(sets.select(F.col("id").alias("dst"), F.col("set").alias("y")), "dst").join(sets.select(F.col("id").alias("src"), F.col("set").alias("x")), "src")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - F.lit(1e-9)).select("src", "dst")


def _sketch_tiles(rows: DataFrame, radius: int, similarity: float, tile_rows: int, forest: bool) -> DataFrame:
    """Pairs (src, dst) of ``rep`` that are candidates, of rows (size, sketch, ones, rep, comp) of different comp.

    The same tiled comparison: a cell holds sketches of like size and like population
    count. Sizes within the similarity are in the same or neighbouring bands, counts
    within the radius too, so all other tile pairs are skipped.
    """
    import math

    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(1 / similarity)).cast("int")
    cells = rows.withColumn("band", band).withColumn("ones", F.floor(F.col("ones") / (radius + 1)).cast("int"))
    sent = paired_tiles(cells, ("band", "ones"), [(b, o) for b in (-1, 0, 1) for o in (-1, 0, 1)], tile_rows, ("sketch", "rep"))
    return sent.select("pair", "side", "size", "sketch", "rep", "comp").groupBy("pair").applyInArrow(_compare_sketches(radius, similarity, forest), "src long, dst long")


def similar_documents(rows: DataFrame, texts, similarity: float = SIMILARITY, tile_rows: int = 8_192) -> DataFrame:
    """(id, component) for all rows (id, size, sketch, ones; written) that links of the Jaccard similarity join.

    ``texts`` makes (id, text) of a table of ids, with a row for each at least.
    Sketches only find candidates; a link counts if the sets of shingles have the
    similarity. Candidate groups are formed from forests; forest edges and pairs with a
    group's least row are verified first, which joins what is dense, and then all
    candidate pairs of rows that are still apart.
    """
    radius, scratch = sketch_radius(similarity), Scratch(rows.sparkSession)
    lone = rows.select("size", "sketch", "ones", F.col("id").alias("rep"), F.col("id").alias("comp"))
    forest = scratch.table(_sketch_tiles(lone, radius, similarity, tile_rows, True).distinct())
    groups = scratch.table(connected_components(forest))
    sets = scratch.table(with_shingles(texts(groups.select("id")).dropDuplicates(["id"])))
    stars = forest.union(groups.where("id > component").select(F.col("component").alias("src"), F.col("id").alias("dst"))).distinct()
    sure = scratch.table(verified(stars, sets, similarity))
    joined = connected_components(sure).withColumnRenamed("id", "rep")
    apart = lone.join(groups, lone["rep"] == groups["id"], "left_semi").drop("comp").join(joined, "rep", "left")
    apart = scratch.table(apart.select("size", "sketch", "ones", "rep", F.coalesce("component", "rep").alias("comp")))
    rest = scratch.table(verified(_sketch_tiles(apart, radius, similarity, tile_rows, False).distinct(), sets, similarity))
    out = checkpoint(connected_components(sure.union(rest)))
    scratch.drop(forest, groups, sets, sure, apart, rest)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least key (null if a group has no other).

    Texts never travel with the links: rows are known by their key and two hashes of the
    text, and what is dropped is taken away from ``docs`` at the end.
    """
    scratch, own = Scratch(docs.sparkSession), [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2")]
    known = scratch.table(docs.select(F.col(key).alias("key"), *own, sketched(F.col(text)).alias("s")).select("key", "t1", "t2", "s.*"))
    # rows of one text are one; the sets of rows that differ decide
    texts = known.groupBy("t1", "t2").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("ones").alias("ones"))
    texts = scratch.table(texts.withColumn("id", F.monotonically_increasing_id()))
    ids = texts.select("t1", "t2", "id")

    def text_of(wanted: DataFrame) -> DataFrame:
        few = scratch.table(ids.join(wanted, "id"))
        return docs.select(F.col(text).alias("text"), *own).join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, ["t1", "t2"]).select("id", "text")

    found = similar_documents(texts.select("id", "size", "sketch", "ones"), text_of)
    group = ids.join(found, "id", "left").select("t1", "t2", F.coalesce("component", "id").alias("component"))
    rows = known.groupBy("key", "t1", "t2").agg(F.count("*").alias("times")).join(group, ["t1", "t2"])
    place = F.struct(F.col("key").isNull().alias("none"), "key", "t1", "t2")
    first = rows.groupBy("component").agg(F.min(place).alias("first"))
    rows = rows.join(first, "component").withColumn("kept", place == F.col("first"))
    rows = scratch.table(rows.where("not kept or times > 1").select("key", "t1", "t2", "kept"))
    scratch.drop(known, texts)
    row = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), *own)
    small = rows.count() <= BROADCAST_ROWS

    def these(kept: bool) -> DataFrame:
        out = rows.where(F.col("kept") == kept).select(F.col("key").alias("k"), F.col("t1").alias("h1"), F.col("t2").alias("h2"))
        return F.broadcast(out) if small else out

    same = (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("key").eqNullSafe(F.col("k"))
    # a kept row that is repeated stays once
    again = row.join(these(True), same, "left_semi").dropDuplicates(["key", "t1", "t2"]).select("row.*")
    every = rows.select(F.col("key").alias("k"), F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    return row.join(F.broadcast(every) if small else every, same, "left_anti").select("row.*").union(again)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    prints = checkpoint(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = near_duplicates(prints)
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
