"""Toxicity by a classifier chain of linear models.

Categories are label columns in a stated order.  Each category's model is a logistic regression on hashed words and
beginnings of words, counted over the fourth root of the text's length and screened for a clear difference between the classes; from the second on it also reads the
probabilities of the categories before it.  Those that it is trained on are out of fold: the model that gave a
training row's probability never saw that row.

Training takes at most MOST_LABELLED labelled rows, the first by a hash of the id (a parameter); every text is scored
whole.  The labels table names quality and toxic, so the chain is low_quality, then toxic.

Edge cases: null or empty text has no words and gets the models' intercepts; null labels and ids are not learned
from; of repeated labels the highest counts; a category without both classes among its rows gets their share as a
constant; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, first_by_hash
from .textbatch import NOT_ALNUM, U, Words, words

BITS, PREFIXES = 20, (4, 5, 6, 7)
MOST_LABELLED, FOLDS = 5_000, 5
LEAST_ROWS, LEAST_Z, RIDGE, STEPS, SCALE = 5, 4.5, 0.2, 150, 4.0
THRESHOLD = 0.5


@dataclass
class Linear:
    """weights by word bucket, by earlier category, and an intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def logit(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        return sums + before @ self.earlier + self.intercept


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def buckets(w: Words) -> np.ndarray:
    """Buckets of each word and of its beginnings, a row a word; -1 where there is no such beginning."""
    out = np.full((len(w.hash), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = w.hash >> U(64 - BITS)
    for k, h in enumerate(w.prefixes(PREFIXES), 1):
        out[:, k] = np.where(h, (h >> U(64 - BITS)).astype(np.int64), -1)
    return out


def scales(w: Words) -> np.ndarray:
    return SCALE / np.maximum(1, np.diff(w.bounds)) ** 0.25


def _sum_by(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, n) if len(row) else np.zeros(n)


def fit_linear(row: np.ndarray, col: np.ndarray, val: np.ndarray, before: np.ndarray, y: np.ndarray, width: int) -> Linear:
    """Ridge logistic regression by full-batch Adam over entries (row, col, val); the same on every run."""
    n = len(y)
    share = float(y.mean()) if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        odds = np.log((share * n + 0.5) / ((1 - share) * n + 0.5)) if n else -5.0
        return Linear(np.zeros(width), np.zeros(before.shape[1]), float(odds))
    # only features whose share of rows differs between the classes by LEAST_Z standard errors
    ones, zeros = np.bincount(col, y[row], width), np.bincount(col, 1 - y[row], width)
    p = (ones + zeros) / n
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / y.sum() + 1 / (1 - y).sum()))
    used = (ones + zeros >= LEAST_ROWS) & (np.abs(ones / y.sum() - zeros / (1 - y).sum()) >= LEAST_Z * error)
    row, col, val = row[used[col]], col[used[col]], val[used[col]]
    k = before.shape[1]
    theta = np.zeros(width + k + 1)
    theta[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = _sum_by(row, theta[col] * val, n) + before @ theta[width:-1] + theta[-1]
        e = _sigmoid(z) - y
        g = np.concatenate([_sum_by(col, e[row] * val, width) + RIDGE * theta[:width], before.T @ e + RIDGE * theta[width:-1], [e.sum()]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(theta[:width], theta[width:-1], float(theta[-1]))


def fit_chain(row: np.ndarray, col: np.ndarray, val: np.ndarray, labels: np.ndarray, categories: list[str], width: int) -> Chain:
    """Models in order; row and col are sorted by row; labels is rows by categories, NaN where unknown."""
    n = len(labels)
    fold = np.random.Generator(np.random.PCG64(3)).permutation(n) % FOLDS
    before = np.zeros((n, 0))
    models = []

    def on(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.cumsum(mask) - 1
        keep = mask[row]
        return at[row[keep]], col[keep], val[keep]

    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        models.append(fit_linear(*on(known), before[known], labels[known, k], width))
        if k + 1 == len(categories):
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            mine, others = fold == f, (fold != f) & known
            one = fit_linear(*on(others), before[others], labels[others, k], width)
            r, c, v = on(mine)
            out[mine] = _sigmoid(one.logit(_sum_by(r, one.weights[c] * v, int(mine.sum())), before[mine]))
        before = np.column_stack([before, out])
    return Chain(list(categories), models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> Chain:
    """A chain from docs(doc_id, text) and a label expression over `labels` (0, 1 or null) for each category."""
    bounded_batches(docs.sparkSession)
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), *[c.cast("int").alias(f"_y{k}") for k, c in enumerate(categories.values())]).filter("_id IS NOT NULL")
    some = F.lit(False)
    for k in range(len(names)):
        some = some | F.col(f"_y{k}").isNotNull()
    marked = first_by_hash(marked.filter(some), "_id", MOST_LABELLED).groupBy("_id").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(names))])
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_t"))
    rows = rows.join(F.broadcast(marked), F.col("_doc") == F.col("_id")).select("_id", *[f"_y{k}" for k in range(len(names))], "_t")  # MOST_LABELLED rows at most
    # one text of an id, however many rows repeat it
    rows = rows.groupBy("_id", *[f"_y{k}" for k in range(len(names))]).agg(F.min("_t").alias("_t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(batch.num_columns - 1), NOT_ALNUM, latin=True):
                each, scale = buckets(w), scales(w)
                held = []
                for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
                    got, count = np.unique(each[a:b], return_counts=True)
                    count = count[got >= 0]
                    held.append(got[got >= 0].astype(np.int32).tobytes() + (count * scale[i]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(w.lo, w.hi - w.lo) for i in range(batch.num_columns - 1)] + [pa.array(held, pa.binary())], names=[*batch.schema.names[:-1], "held"])

    got = rows.mapInArrow(make, ", ".join(["_id long", *[f"_y{k} int" for k in range(len(names))], "held binary"])).collect()
    got.sort(key=lambda r: (r["_id"], bytes(r["held"])))
    cols = [np.frombuffer(bytes(r["held"]), np.int32, len(r["held"]) // 8) for r in got]
    val = np.concatenate([np.frombuffer(bytes(r["held"]), np.float32, offset=len(r["held"]) // 2) for r in got]).astype(float) if got else np.zeros(0)
    row = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    # only buckets that occur: the rest have no weight
    seen, col = np.unique(np.concatenate(cols) if cols else np.zeros(0, np.int32), return_inverse=True)
    y = np.array([[np.nan if r[f"_y{k}"] is None else float(r[f"_y{k}"] > 0) for k in range(len(names))] for r in got]).reshape(len(got), len(names))
    chain = fit_chain(row, col, val, y, names, len(seen))
    for m in chain.models:
        full = np.zeros((1 << BITS) + 1, np.float32)
        full[seen] = m.weights
        m.weights = full
    return chain


def scorer(docs: DataFrame, chain: Chain):
    """Column function text -> array of probabilities, in the order of the chain."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("array<double>")
    def run(text: pa.Array) -> pa.Array:
        chain = sent.value
        out = []
        for w in words(text, NOT_ALNUM, latin=True):
            n = w.hi - w.lo
            each, doc, scale = buckets(w), w.doc, scales(w)
            p = np.zeros((n, 0))
            for m in chain.models:
                # weights end in a 0, which -1 reads
                p = np.column_stack([p, _sigmoid(m.logit(_sum_by(doc, m.weights[each].sum(1), n) * scale, p))])
            out.append(p)
        flat = np.concatenate(out).reshape(-1) if out else np.zeros(0)
        k = len(chain.models)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(text) * k + 1, k, dtype=np.int32)), pa.array(flat))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(doc_id, toxic, toxicity, low_quality) for every row of docs: a flag and the chain's probabilities."""
    chain = chain or train(docs, labels, {"low_quality": 1 - F.col("quality").cast("int"), "toxic": F.col("toxic").cast("int")})
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, chain)(F.col("text").cast("string")).alias("_p"))
    at = {name: F.get("_p", F.lit(k)) for k, name in enumerate(chain.categories)}
    return out.select("doc_id", (at["toxic"] >= THRESHOLD).alias("toxic"), at["toxic"].alias("toxicity"), at["low_quality"].alias("low_quality"))
