"""Quality of documents by a linear-chain conditional random field over their lines.

Each line is good or bad. A line's features (shares of upper case, digits, marks and
symbols, repetition, word lengths and so on, cut into bins) and those of the lines
before and after it give its emission; transitions tie neighbours. The document's
quality is the mean of the lines' forward-backward marginals, weighted by length, on
a logistic scale whose middle is fitted with the rest.

Only documents have labels, so lines are labelled first: every line of a good
document is good, and a line of a bad document is bad unless a line model that was
fitted to the documents' labels finds it good.

Results for odd input: a null or empty text is one empty line and gets a score like
any other; very long texts are read whole, a few MB at a time; a null key stays null;
repeated rows get the same score; labels that contradict each other count as their
mean; without any label of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Labelled documents that the model is fitted to, at most; which, the hash of their id decides.
MAX_TRAINING_DOCUMENTS = 4_000
BINS = 8
NAMES = ("upper", "digit", "exclaim", "symbol", "mark", "distinct", "short", "word_length", "length", "repeated", "ends", "begins", "run")

# byte classes: 0 letters, 1 capitals, 2 digits, 3 blanks, 4 marks of sentences, 5 exclamation marks, 6 other symbols
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 6
_CLASS[[*range(0x61, 0x7B)]] = 0
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_CLASS[[*range(0x00, 0x21)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[ord("!")] = 5


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, words of each line, features of each line)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    lines = [t.split(b"\n") for t in raw]
    n = np.array([len(x) for x in lines])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    kind = _CLASS[buf]
    count = [np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(7)]
    blank = kind == 3
    begins = ~blank & np.r_[True, blank[:-1]]
    words = np.add.reduceat(begins, starts, dtype=np.int64)
    at = np.flatnonzero(begins)
    gap = np.flatnonzero(~blank & np.r_[blank[1:], True]) - at + 1
    small = np.zeros(len(buf), bool)
    small[at[gap <= 3]] = True
    short = np.add.reduceat(small, starts, dtype=np.int64)
    distinct, repeated, run = np.ones(len(starts)), np.zeros(len(starts)), np.zeros(len(starts))
    k = 0
    for own in lines:
        seen: set[bytes] = set()
        for line in own:
            w = line.split()
            if len(w) > 1:
                distinct[k] = len(set(w)) / len(w)
                if distinct[k] < 0.7:
                    run[k] = sum(map(bytes.__eq__, w, w[1:])) / len(w)
            repeated[k] = line in seen
            seen.add(line)
            k += 1
    some, letters, inside = np.maximum(words, 1), np.maximum(count[0] + count[1], 1), np.maximum(ends - starts - count[3] + 1, 1)
    # the share of distinct words falls with length in any text; this takes that out
    distinct = distinct * np.maximum(words / 10, 1) ** 0.1
    x = np.stack([count[1] / letters, count[2] / inside, count[5] / some, count[6] / some, count[4] / some, distinct, short / some, inside / some, np.log1p(ends - starts), repeated, kind[np.maximum(ends - 1, 0)] == 4, kind[starts] == 1, run], 1)
    return n, words, x.astype(np.float32)


def _walk(n: np.ndarray):
    """For texts of ``n`` lines: (texts by falling line count, their first lines, how many have a line t, for each t)."""
    order = np.argsort(-n, kind="stable")
    first = np.r_[0, np.cumsum(n)[:-1]][order]
    return first, np.searchsorted(-n[order], -np.arange(n.max() if len(n) else 0), side="left")


def forward_backward(n: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of good for each line, expected transitions, log-likelihood's normaliser) of chains of ``n`` lines.

    ``emit``: the log-odds of good of each line; ``trans``: log-potentials [from, to].
    """
    first, active = _walk(n)
    e, a = np.exp(np.stack([np.minimum(-emit, 0), np.minimum(emit, 0)], 1)), np.exp(trans)
    alpha, beta, scale = np.zeros((len(emit), 2)), np.ones((len(emit), 2)), np.ones(len(emit))
    for t, k in enumerate(active):
        at = first[:k] + t
        now = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        scale[at] = now.sum(1)
        alpha[at] = now / scale[at, None]
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        beta[at - 1] = (beta[at] * e[at]) @ a.T / scale[at, None]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    heads = np.zeros(len(emit), bool)
    heads[first] = True
    later = np.flatnonzero(~heads)
    pair = alpha[later - 1][:, :, None] * a[None] * (beta[later] * e[later])[:, None, :] / scale[later][:, None, None]
    return gamma[:, 1], pair.sum(0), float(np.log(scale).sum() - np.minimum(-emit, 0).sum())


@dataclass
class Model:
    """Bin edges, weights [place (before, own, after), feature, bin], bias, transitions, and the scale of scores."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float
    middle: float

    def bins(self, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each line and place the bins of its features; ``BINS`` (no weight) where there is no such line."""
        own = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)
        out = np.full((3, *own.shape), BINS)
        heads = np.zeros(len(x), bool)
        heads[np.r_[0, np.cumsum(n)[:-1]]] = True
        tails = np.r_[heads[1:], True]
        out[1] = own
        out[0][~heads] = own[np.flatnonzero(~heads) - 1]
        out[2][~tails] = own[np.flatnonzero(~tails) + 1]
        return out

    def emit(self, bins: np.ndarray) -> np.ndarray:
        k = np.arange(bins.shape[2])
        return self.bias + sum(self.weights[p][k, bins[p]].sum(1) for p in range(3))

    def raw(self, n: np.ndarray, words: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each text, as log-odds."""
        good, _, _ = forward_backward(n, self.emit(self.bins(n, x)), self.trans)
        at = np.r_[0, np.cumsum(n)[:-1]]
        mean = np.add.reduceat(good * (words + 1), at) / np.add.reduceat(words + 1, at)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * self.raw(*line_features(texts)) + self.middle)))


def _descend(gradient, params: list[np.ndarray], steps: int, rate: float = 0.1) -> None:
    """Adam, in place."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def fit(n: np.ndarray, words: np.ndarray, x: np.ndarray, label: np.ndarray, steps: int = 120, ridge: float = 2.0) -> Model:
    """The model for texts of ``n`` lines with features ``x`` and labels (1 good, 0 bad)."""
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(NAMES)
    # a feature that is rarely set has equal quantiles; its larger values get bins of their own
    edges = [np.unique(np.r_[e, np.quantile(x[:, k], [0.95, 0.99])])[: BINS - 1] if len(x) and len(e) < 4 else e for k, e in enumerate(edges)]
    model = Model(edges, np.zeros((3, len(NAMES), BINS + 1)), 0.0, np.zeros((2, 2)), 0.0, 0.0)
    if not len(label) or label.min() == label.max():
        return model
    bins, text = model.bins(n, x), np.repeat(np.arange(len(n)), n)
    y, k = label[text].astype(float), np.arange(len(NAMES))
    # both classes weigh the same, and so does each text
    balance = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    w = (balance / n)[text] * n.mean()
    bias = np.zeros(1)

    def into(d: np.ndarray) -> np.ndarray:
        g = np.zeros_like(model.weights)
        for p in range(3):
            for f in k:
                g[p, f] = np.bincount(bins[p][:, f], d, BINS + 1)
        g[:, :, BINS] = 0
        return g

    def lines():
        model.bias = bias[0]
        d = w * (1 / (1 + np.exp(-model.emit(bins))) - y)
        return [into(d) / len(n) + ridge * model.weights / len(n), np.array([d.sum() / len(n)])]

    _descend(lines, [model.weights, bias], steps)
    model.bias = bias[0]
    y = np.where((y == 1) | (model.emit(bins) > 0), 1.0, 0.0)
    heads = np.zeros(len(x), bool)
    heads[np.r_[0, np.cumsum(n)[:-1]]] = True
    later = np.flatnonzero(~heads)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)

    def chain():
        model.bias = bias[0]
        good, pair, _ = forward_backward(n, model.emit(bins), model.trans)
        d = good - y
        return [into(d) / len(n) + ridge * model.weights / len(n), np.array([d.sum() / len(n)]), (pair - seen) / len(n) + ridge * model.trans / len(n)]

    _descend(chain, [model.weights, bias, model.trans], steps)
    model.bias = bias[0]
    raw, scale = model.raw(n, words, x), np.array([1.0, 0.0])

    def platt():
        d = 1 / (1 + np.exp(-(scale[0] * raw + scale[1]))) - label
        return [np.array([(d * raw).mean() + 0.001 * scale[0], d.mean()])]

    _descend(platt, [scale], 300)
    model.slope, model.middle = scale
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAINING_DOCUMENTS) -> Model:
    """A model fitted to ``most`` labelled documents at most. Features are computed where documents are read."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            if not batch.num_rows:
                continue
            n, words, x = line_features([t or "" for t in batch.column(1).to_pylist()])
            at = np.r_[0, np.cumsum(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["label", "n", "words", "x"])

    found = docs.join(F.broadcast(chosen), docs[key] == chosen["key"]).select("label", F.col(text).alias("text"))
    rows = found.mapInArrow(run, "label int, n long, words binary, x binary").toPandas()
    rows = rows.sort_values(["label", "n", "x"], kind="stable")  # the same model for any order of arrival
    if not len(rows):
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(NAMES)), np.float32), np.zeros(0, int))
    return fit(rows["n"].to_numpy(), np.frombuffer(b"".join(rows["words"]), np.int64), np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, len(NAMES)), rows["label"].to_numpy())


def scorer(model: Model):
    """A function from a column of texts to the column of their scores; nothing but texts goes to Python and nothing but scores comes back."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(texts) for texts in texts_of(batch))]))

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out``, in place of one that it has. No shuffle."""
    return docs.withColumn(out, scorer(model)(F.col(text)))


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fold_model(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model from the labels of the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fold_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
