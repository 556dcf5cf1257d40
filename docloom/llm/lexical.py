"""Ranked lexical search over inverted treaps.

Documents are cut into terms once, into a forward index (document, length, counts of
the terms that any item asks for). Its partitions are segments: a task makes one
treap for each term of its segment, a search tree by document with the impact as heap
order, so that a subtree's root has the subtree's greatest impact. The treaps of an
item's terms are walked together: a range of documents has, for each term, the
highest node in it; the sum of their weighted impacts bounds every score in the
range. A range below the k-th score goes, another is split at the document of its
largest part, which is scored. Ranges of one depth are one set of numpy arrays.

A segment hands on its best k of each item; these are merged in two steps, so no task
sees what all segments found. Items are taken in blocks whose terms are counted, so
what is sent to the tasks has a bound; scores are 64-bit integers throughout, and
equal impacts are ordered by a hash of the document, which keeps treaps shallow.

Results for odd input: null, empty and wordless texts have no terms, count for nothing
and get no rank; an item without terms has no rows; a null doc_id ranks after the
others of its score; repeated documents are ranked as rows of their own, repeated items
give their rows again; no documents or no items give no rows. Columns of other names
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Terms of items, repeats within an item not counted, that a block of items has (an item is never cut).
BLOCK_TERMS = 500_000
#: Documents, and counts of terms, at which a segment is closed.
SEGMENT_DOCS, SEGMENT_POSTINGS = 65_536, 2_000_000
#: Documents with rare terms that are scored first for a bound on the k-th score.
SEEDS = 256
#: Items that are walked at once.
TOGETHER = 32
#: Groups into which segments' results are merged first.
MERGES = 64

# A byte of a term as it is compared; other bytes, all of them in ASCII, part terms. Bytes from 128 on are parts of letters.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(no, item_id, term, times): a row for each term of each item; ``no`` tells repeated items apart."""
    from pyspark.sql import types as T

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in slices(batches, "text"):
            rows = [(no, i, t, n) for no, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in Counter(terms_of(x)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), batch.schema.field(1).type, pa.binary(), pa.int64()))], names=["no", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("no"), F.col(key).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("term", T.BinaryType()), T.StructField("times", T.LongType())]))


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that have terms: all ``n`` of them, and the numbers and counts of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a block's terms at most

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known = shared.value
        for batch in slices(batches, "text"):
            ids, sizes, terms, counts = [], [], [], []
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms_of(x)
                if found:
                    own = {known[t]: n for t, n in Counter(found).items() if t in known}
                    ids.append(i), sizes.append(len(found)), terms.append(list(own)), counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def document_frequencies(forward: DataFrame, size: int) -> list[int]:
    """How many documents hold each of the ``size`` terms of a vocabulary; tasks count their own first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["term", "n"])

    out = [0] * size
    for r in forward.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def weight(n_docs: int, df: int) -> int:
    """What a term counts."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(sizes: list[int], n_docs: int, all_terms: int) -> list[int]:
    """A document's ``m`` by its number of terms."""
    return [100 - 25 + (25 * n * n_docs) // all_terms for n in sizes]


class Treaps:
    """One treap for each term of a segment, as arrays: node -> document position, impact, left and right node (-1: none)."""

    def __init__(self, terms, docs, impacts):
        """Postings in any order: term numbers, positions of documents in the order of their ids, impacts."""
        import numpy as np

        order = np.lexsort([docs, terms])
        self.term, self.doc, self.impact = terms[order].astype(np.int64), docs[order].astype(np.int64), impacts[order].astype(np.int64)
        n = len(order)
        self.left, self.right, self.root = np.full(n, -1, np.int64), np.full(n, -1, np.int64), {}
        # equal impacts: by a hash of the document, so that the depth is that of a random tree
        mixed = (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
        priority = (self.impact << 22) | mixed.astype(np.int64)
        starts = np.flatnonzero(np.r_[True, np.diff(self.term) != 0]) if n else []
        self.spans = {int(self.term[a]): (int(a), int(b)) for a, b in zip(starts, np.r_[starts[1:], n].astype(int), strict=True)} if n else {}
        for t, (a, b) in self.spans.items():
            left, right, path = [-1] * (b - a), [-1] * (b - a), []
            own = priority[a:b].tolist()
            for i, p in enumerate(own):
                below = -1
                while path and own[path[-1]] < p:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            for to, x in ((self.left, left), (self.right, right)):
                x = np.array(x, np.int64)
                to[a:b] = np.where(x < 0, -1, x + a)
            self.root[t] = a + path[0]

    def seeds(self, weights: dict[int, int], most: int):
        """Scores of up to ``most`` documents that hold an item's rarest terms."""
        import numpy as np

        rare, held = sorted((b - a, t) for t in weights if (span := self.spans.get(t)) for a, b in [span]), []
        for size, t in rare:
            a, b = self.spans[t]
            held.append(self.doc[a : min(b, a + most)])
            if sum(map(len, held)) >= most:
                break
        if not held:
            return np.zeros(0, np.int64)
        docs = np.unique(np.concatenate(held))
        scores = np.zeros(len(docs), np.int64)
        for _, t in rare:
            a, b = self.spans[t]
            at = np.minimum(np.searchsorted(self.doc[a:b], docs), b - a - 1) + a
            scores += np.where(self.doc[at] == docs, weights[t] * self.impact[at], 0)
        return scores

    def _highest(self, node, lo, hi):
        """The highest node in [lo, hi] of the subtree of each ``node``, -1 if there is none."""
        import numpy as np

        node, open_ = node.copy(), np.flatnonzero(node >= 0)
        while len(open_):
            doc = self.doc[node[open_]]
            low, high = doc < lo[open_], doc > hi[open_]
            off = low | high
            open_, low = open_[off], low[off]
            at = node[open_]
            node[open_] = np.where(low, self.right[at], self.left[at])
            open_ = open_[node[open_] >= 0]
        return node

    def _split(self, node, pivot, lo, hi):
        """Below each ``node``: the highest node of [lo, pivot), that of (pivot, hi], and the impact at the pivot (0: not there)."""
        import numpy as np

        n = len(node)
        before, after, hit, met = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        cells, at = np.arange(n), node
        while len(cells):
            doc, p = self.doc[at], pivot[cells]
            less, more = doc < p, doc > p
            for side, there in ((before, less & (doc >= lo[cells])), (after, more & (doc <= hi[cells]))):
                there &= side[cells] < 0
                side[cells[there]] = at[there]
            same = ~(less | more)
            met[cells[same]] = at[same]
            at = np.where(less, self.right[at], self.left[at])
            going = ~same & (at >= 0)
            cells, at = cells[going], at[going]
        # the walk ends at the pivot: what it has not passed yet is below it
        for side, child, a, b in ((before, self.left, lo, pivot - 1), (after, self.right, pivot + 1, hi)):
            free = np.flatnonzero((met >= 0) & (side < 0))
            side[free] = self._highest(child[met[free]], a[free], b[free])
        hit[met >= 0] = self.impact[met[met >= 0]]
        return before, after, hit

    def top(self, asked: list[dict[int, int]], k: int, seeds: int = SEEDS):
        """(item, positions, scores) of the ``k`` best documents by each item's weights of terms, equal scores by position; and how many documents were scored.

        All items are walked at once, a depth at a time.
        """
        import numpy as np

        asked = [{t: w for t, w in own.items() if w > 0 and t in self.root} for own in asked]
        # a score that at least k documents reach: nothing below it counts
        first = [np.sort(self.seeds(own, max(seeds, k))) for own in asked]
        least = np.array([max(1, int(x[-k])) if len(x) >= k > 0 else 1 for x in first], np.int64)
        # of the k-th document found so far
        last_score, last_doc = np.full(len(asked), -1, np.int64), np.full(len(asked), -1, np.int64)
        items, docs, scores, tried = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # ranges, and cells (range, weight, node) in the order of their ranges
        item = np.flatnonzero([bool(own) and k > 0 for own in asked])
        lo, hi = np.zeros(len(item), np.int64), np.full(len(item), np.iinfo(np.int64).max - 1)
        rng = np.repeat(np.arange(len(item)), [len(asked[i]) for i in item])
        wgt = np.array([w for i in item for w in asked[i].values()], np.int64)
        node = np.array([self.root[t] for i in item for t in asked[i]], np.int64)
        while len(rng):
            part = wgt * self.impact[node]
            starts = np.flatnonzero(np.r_[True, rng[1:] != rng[:-1]])
            bound = np.add.reduceat(part, starts)
            keep = (bound >= least[item]) & ((bound > last_score[item]) | ((bound == last_score[item]) & (lo < last_doc[item])))
            cells = keep[rng]
            wgt, node, part, rng = wgt[cells], node[cells], part[cells], (np.cumsum(keep) - 1)[rng[cells]]
            item, lo, hi = item[keep], lo[keep], hi[keep]
            if not len(rng):
                break
            starts = np.flatnonzero(np.r_[True, rng[1:] != rng[:-1]])
            largest = np.flatnonzero(part == np.maximum.reduceat(part, starts)[rng])
            largest = largest[np.r_[True, rng[largest[1:]] != rng[largest[:-1]]]]
            pivot = self.doc[node[largest]]
            before, after, hit = self._split(node, pivot[rng], lo[rng], hi[rng])
            tried += len(pivot)
            items, docs, scores = np.r_[items, item], np.r_[docs, pivot], np.r_[scores, np.add.reduceat(wgt * hit, starts)]
            best = np.lexsort([docs, -scores, items])
            own = items[best]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
            last = best[place == k - 1]
            last_score[items[last]], last_doc[items[last]] = scores[last], docs[last]
            best = best[place < k]
            items, docs, scores = items[best], docs[best], scores[best]
            # the halves of the ranges, and their cells
            left, right = before >= 0, after >= 0
            halves = np.r_[2 * rng[left], 2 * rng[right] + 1]
            order = np.argsort(halves, kind="stable")
            wgt, node = np.r_[wgt[left], wgt[right]][order], np.r_[before[left], after[right]][order]
            some, rng = np.unique(halves[order], return_inverse=True)
            item, lo, hi = np.repeat(item, 2)[some], np.c_[lo, pivot + 1].ravel()[some], np.c_[pivot - 1, hi].ravel()[some]
        return items, docs, scores, tried


def _searched(items: list[tuple[int, dict[int, int]]], weights: list[int], n_docs: int, all_terms: int, k: int, docs_most: int, postings_most: int, sc):
    """The function that searches forward-index batches, segment by segment, for every item: rows (no, doc_id, score)."""
    shared = sc.broadcast(([(no, {t: n * weights[t] for t, n in own.items()}) for no, own in items], n_docs, all_terms))

    def segment(batches):
        import numpy as np
        import pyarrow as pa

        asked, n_docs, all_terms = shared.value
        rows = pa.Table.from_batches(batches)
        ids, sizes = rows.column("doc_id"), rows.column("n").to_pylist()
        some = ids.is_valid().to_numpy()
        values = ids.fill_null(0).to_numpy()
        order = np.lexsort([values, ~some])  # null ids last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = rows.column("terms").combine_chunks()
        owner = np.repeat(np.arange(len(order)), lists.value_lengths().to_numpy())
        terms, counts = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy()
        norm = np.array(length_norms(sizes, n_docs, all_terms), np.int64)
        treaps = Treaps(terms, place[owner], (1_000_000_000 * counts) // (1000 * counts + 12 * norm[owner]))
        nos, out = np.array([no for no, _ in asked], np.int64), []
        for a in range(0, len(asked), TOGETHER):
            items, docs, scores, _ = treaps.top([own for _, own in asked[a : a + TOGETHER]], k)
            out.append((nos[items + a], docs, scores))
        nos, docs, scores = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in out)]) for c in range(3))
        at = order[docs]
        return pa.RecordBatch.from_arrays([pa.array(nos), pa.array(values[at], mask=~some[at]), pa.array(scores)], names=["no", "doc_id", "score"])

    def run(batches):
        held, n_held, n_counts = [], 0, 0
        for batch in batches:
            # a batch is cut where a segment is full
            while batch.num_rows:
                lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()
                fits = int(max(1, min(docs_most - n_held, (lengths <= postings_most - n_counts).sum())))
                part, batch = batch.slice(0, fits), batch.slice(fits)
                held.append(part)
                n_held, n_counts = n_held + part.num_rows, n_counts + int(lengths[part.num_rows - 1])
                if batch.num_rows:
                    yield segment(held)
                    held, n_held, n_counts = [], 0, 0
        if n_held:
            yield segment(held)

    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (no, doc_id, score) of each item, with ``rank``; first within groups of tasks, then over the groups."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = Window.partitionBy("no", "group").orderBy(*order)
    near = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGES))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).where(F.col("rank") <= k).drop("group")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = scratch.table(item_terms(items, item_key, item_text))
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        own = asked.where(F.col("block") == b)
        pairs = own.select("no", "term", "times").toArrow()  # about block_terms rows
        names = {t: i for i, t in enumerate(pairs.column("term").unique().to_pylist())}
        wanted: dict[int, dict[int, int]] = {}
        for no, t, n in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
            wanted.setdefault(no, {})[names[t]] = n
        forward = scratch.table(forward_index(docs, names, key, text))
        n_docs, all_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = [weight(n_docs, df) for df in document_frequencies(forward, len(names))]
        found = forward.mapInArrow(_searched(sorted(wanted.items()), weights, n_docs, all_terms, k, segment_docs, segment_postings, spark.sparkContext), "no long, doc_id long, score long")
        best = scratch.table(best_of(found, k))
        scratch.drop(forward)
        named = best.join(own.select("no", "item_id").distinct(), "no").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.union(named)
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same ranks by scoring every document.
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  qt AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
  len AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
  tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
  norm AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM len, tot),
  tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL),
  r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""
