"""Language-model scoring with Brown class-based n-grams.

P(text) = product over tokens of P(class | class before) * P(word | class).  Tokens are the lower-cased (A-Z) words
`[^\\x20\\x09-\\x0D]+` and then one end; the class before the first token is the end's.

* Word counts of all training documents are added up in the cluster (64-bit word hashes).
* The CLUSTERED most frequent words get one of CLASSES classes by exchange clustering: each word in turn moves to the
  class that raises the likelihood of the class bigrams most.  The bigram counts it needs, of those words and the fixed
  classes, come from all training documents and are at most (CLUSTERED + 5)^2 numbers.
* Every other head word joins the learned class that raises that likelihood most, given the classes that its neighbours
  in all training documents have at this point (unclustered ones count by length; ties: the class of smallest number).
  Then the class bigrams are counted again.
* Words outside the head, too rare to be placed, fall in one of four tail classes by length; the end has its own.
  Transitions have add-DELTA and words add-one smoothing in their class, so unknown words have a probability.
* The head, the most frequent words and at most HEAD, is looked up in the tasks; entries of the others are joined to the
  counts by word, once for each distinct text and partition.

Score columns: base_score, the contract's add-one unigram sum of log10; score, the model's log10 probability.

Edge cases: null or empty text is just an end; a null doc_id is not held out and not learned from; without training
documents every word is unknown (N = V = 0); repeated rows count and stay; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, cut
from .textbatch import U, Words, words

CLUSTERED, CLASSES, SWEEPS = 512, 24, 4
HEAD, DELTA = 100_000, 0.5
TAILS, END = 4, 1
#: Distinct words held in a task before it sends their counts on.
HELD = 2_000_000
#: Word lengths, in bytes, up to which a word is in the first, second or third tail class.
TAIL_LENGTHS = (4, 7, 11)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out())


def keys(w: Words) -> np.ndarray:
    """A word's key: its hash, with the tail class in the two lowest bits."""
    tail = np.searchsorted(np.array(TAIL_LENGTHS), w.end - w.start, "left").astype(np.uint64)
    return w.hash & ~U(3) | tail


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, n_docs = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        by = np.argsort(k, kind="stable")
        k, c = k[by], c[by]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[at], np.add.reduceat(c, at)

    def send(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["word", "n"])

    for batch in batches:
        n_docs += batch.num_rows
        for w in words(batch.column(0)):
            if len(w.hash):
                k, c = np.unique(keys(w), return_counts=True)
                held.append((k, c.astype(np.int64)))
                size += len(k)
        if size > HELD:
            one = merged()
            held, size = [one], len(one[0])
            if size > HELD // 2:
                yield send(*one)
                held, size = [], 0
    if held:
        yield send(*merged())
    if n_docs:  # ends, under a null word
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n_docs], pa.int64())], names=["word", "n"])


def _prior(w: Words, own: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol before, symbol) of every token, ends included, in order of text."""
    bounds = w.bounds
    n = len(own) + len(bounds) - 1
    out = np.empty(n, np.int64)
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    out[is_end] = end
    out[~is_end] = own
    return np.concatenate([[end], out[:-1]]), out


def _pairs(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, place, symbols = sent.value  # sorted keys of placed words, their symbols, how many those are
        m = symbols + TAILS + END
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for w in words(batch.column(0)):
                before, now = _prior(w, _symbols(keys(w), top, place, symbols), m - 1)
                total += np.bincount(before * m + now, minlength=m * m)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return run


def _counted(text: DataFrame, top: np.ndarray, place: np.ndarray, symbols: int) -> np.ndarray:
    """Bigrams of symbols, the tails' and the end's last, over all texts."""
    m = symbols + TAILS + END
    sent = text.sparkSession.sparkContext.broadcast((top, place, symbols))
    out = np.zeros(m * m)
    for r in text.mapInArrow(_pairs(sent), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(m, m)


def _found(k: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted `top`, and whether they are there."""
    if not len(top) or not len(k):
        return np.zeros(len(k), np.int64), np.zeros(len(k), bool)
    i = np.minimum(np.searchsorted(top, k), len(top) - 1)
    return i, top[i] == k


def _symbols(k: np.ndarray, top: np.ndarray, place: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols of placed words; others, and those with a negative one, have the tail symbols after them."""
    tail = symbols + (k & U(3)).astype(np.int64)
    i, hit = _found(k, top)
    return np.where(hit & (place[i] >= 0), place[i], tail) if len(top) else tail


def _neighbours(sent):
    """(word, symbol, n): for head words without a class, by place in `top`, the classes before and, from c on, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, place, clusters = sent.value
        c = clusters + TAILS + END
        total = np.zeros(len(top) * 2 * c, np.int64)
        for batch in batches:
            for w in words(batch.column(0)):
                k = keys(w)
                i, hit = _found(k, top)
                before, now = _prior(w, _symbols(k, top, place, clusters), c - 1)
                free = np.flatnonzero(hit & (place[i] < 0))
                at = free + w.doc[free]  # ends stand between
                np.add.at(total, i[free] * 2 * c + before[at], 1)
                np.add.at(total, i[free] * 2 * c + c + now[at + 1], 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((part // (2 * c)).astype(np.int32)), pa.array((part % (2 * c)).astype(np.int32)), pa.array(total[part])], names=["word", "symbol", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_class(table: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, clusters: int) -> np.ndarray:
    """The class below `clusters` that each word, moved there from class `own`, raises the likelihood of `table` most.

    table: bigrams of classes, the words' included.  left, right: a row a word, its neighbours' classes.
    """
    at_own = (np.arange(len(table)) == own[:, None])[:, None, :]
    l_d, r_d = left[:, :clusters], right[:, :clusters]
    rows = table[None, :clusters] - l_d[:, :, None] * at_own  # the class before the word, without it
    cols = table.T[None, :clusters] - r_d[:, :, None] * at_own
    gain = (_xlogx(rows + right[:, None]) - _xlogx(rows)).sum(2) + (_xlogx(cols + left[:, None]) - _xlogx(cols)).sum(2)
    loop = np.diag(table)[:clusters]  # is in both sums
    gain += _xlogx(loop + r_d + l_d) + _xlogx(loop) - _xlogx(loop + r_d) - _xlogx(loop + l_d)
    for margin, more in ((table.sum(1)[:clusters], right), (table.sum(0)[:clusters], left)):
        gain -= _xlogx(margin + more.sum(1, keepdims=True)) - _xlogx(margin)
    return gain.argmax(1)


def _assigned(text: DataFrame, top: np.ndarray, place: np.ndarray, table: np.ndarray, clusters: int) -> np.ndarray:
    """`place` (classes of the sorted `top`, negative for none) with a class for every word."""
    sc = text.sparkSession.sparkContext
    sent, c = sc.broadcast((top, place, clusters)), len(table)
    near = text.mapInArrow(_neighbours(sent), "word int, symbol int, n long")
    # a word's rows are at most 2 c a task, and 2 c after the sum
    lists = near.repartition("word").groupBy("word", "symbol").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("symbol", "n")).alias("near"))

    @F.arrow_udf("int")
    def best(word: pa.Array, near: pa.Array) -> pa.Array:
        counts = np.zeros((len(word), 2 * c))
        row = near.value_parent_indices().to_numpy()
        flat = near.flatten()
        counts[row, flat.field("symbol").to_numpy()] = flat.field("n").to_numpy()
        own = clusters + (sent.value[0][word.to_numpy()] & U(3)).astype(np.int64)
        return pa.array(best_class(table, counts[:, :c], counts[:, c:], own, clusters).astype(np.int32))

    out = place.copy()
    for r in lists.select("word", best("word", "near").alias("class")).collect():  # HEAD rows at most
        out[r["word"]] = r["class"]
    return out


def exchange(bigrams: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol of bigrams (symbols by symbols); symbols from `movable` on keep a class each of their own.

    Exchange clustering: the objective is sum n(c, d) log n(c, d) - sum n(c, .) log n(c, .) - sum n(., d) log n(., d).
    """
    m = len(bigrams)
    classes = max(1, min(classes, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(m - movable)]).astype(np.int64)
    c = classes + m - movable

    xlogx = _xlogx

    def gathered() -> np.ndarray:
        one = np.zeros((m, c))
        one[np.arange(m), of] = 1
        return one.T @ bigrams @ one

    table = gathered()
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a = of[w]
            right = np.bincount(of, bigrams[w], c)  # w followed by class
            left = np.bincount(of, bigrams[:, w], c)
            loop = bigrams[w, w]
            # take w out
            base = table.copy()
            base[a] -= right
            base[:, a] -= left
            base[a, a] += loop
            right[a] -= loop
            left[a] -= loop
            rows, cols = base.sum(1), base.sum(0)
            plain = xlogx(base)
            value = np.empty(classes)
            total_r, total_l = right.sum() + loop, left.sum() + loop
            for d in range(classes):
                row, col = base[d] + right, base[:, d] + left
                row_d = base[d, d] + right[d] + left[d] + loop
                gain = (xlogx(row) - plain[d]).sum() + (xlogx(col) - plain[:, d]).sum()
                gain -= xlogx(row[d : d + 1])[0] - plain[d, d] + xlogx(col[d : d + 1])[0] - plain[d, d]
                gain += xlogx(np.array([row_d]))[0] - plain[d, d]
                row_sum, col_sum = rows[d] + left[d], cols[d] + right[d]  # d before w and after it
                gain -= xlogx(np.array([row_sum + total_r]))[0] - xlogx(np.array([row_sum]))[0]
                gain -= xlogx(np.array([col_sum + total_l]))[0] - xlogx(np.array([col_sum]))[0]
                value[d] = gain
            # other classes' margins change alike whatever d is
            best = int(value.argmax())
            best = int(a) if value[a] >= value[best] - 1e-9 else best
            table = base
            table[best] += right
            table[:, best] += left
            table[best, best] += loop
            moved += best != a
            of[w] = best
        if not moved:
            break
    return of


@dataclass
class Brown:
    """Fixed-size model; counts of tail words stay in the cluster, as the table `counts`."""

    total: int  # N
    distinct: int  # V
    head: np.ndarray  # sorted keys
    head_count: np.ndarray
    head_class: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    class_norm: np.ndarray  # add-one denominators of the classes
    clusters: int  # classes of clustered words; tails and the end follow

    @property
    def end(self) -> int:
        return self.clusters + TAILS

    @property
    def base_norm(self) -> float:
        return float(self.total + self.distinct + 1)


def _head(counts: DataFrame) -> DataFrame:
    """The words above a count that at most HEAD words reach; a sixteenth of a doubling is one step of it.

    Each task then sends only such words, not a list of its own as long as the head.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect()  # 16 rows for each doubling
    least, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["v"]
        if total > HEAD:
            break
        least = r["step"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def train(docs: DataFrame) -> tuple[Brown, DataFrame]:
    """The model, and the counts (word, n) of all training words, from docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    text = training(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("text")
    counts = cut(text.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tail = F.col("word").bitwiseAND(F.lit(3).cast("long"))
    sums = counts.groupBy(F.when(F.col("word").isNull(), F.lit(None)).otherwise(tail).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    ends = sum(r["n"] for r in sums if r["tail"] is None)
    words_only = counts.filter("word IS NOT NULL")
    top = _head(words_only).collect()  # HEAD rows at most
    top.sort(key=lambda r: (-r["n"], r["word"]))
    key = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    m = min(CLUSTERED, len(key))
    by = np.argsort(key[:m])
    size = m + TAILS + END
    bigrams = _counted(text, key[:m][by], by, m)
    of = exchange(bigrams, m)
    clusters = int(of[m]) if len(of) > m else 0
    c = clusters + TAILS + END
    one = np.zeros((size, c))
    one[np.arange(size), of] = 1
    table = one.T @ bigrams @ one
    order = np.argsort(key)
    klass = np.concatenate([of[:m], np.full(len(key) - m, -1)]).astype(np.int64)[order]
    if len(key) > m:
        klass = _assigned(text, key[order], klass, table, clusters)
        table = _counted(text, key[order], klass, clusters)
    transitions = np.log10((table + DELTA) / (table.sum(1, keepdims=True) + DELTA * c))
    # add-one in each class: its tokens + its words + 1 for the unknown
    norm = np.ones(c)
    norm[:clusters] += np.bincount(klass, n[order] + 1, c)[:clusters]
    for r in sums:
        if r["tail"] is not None:
            norm[clusters + r["tail"]] += r["n"] + r["v"]
    norm[clusters : clusters + TAILS] -= np.bincount((key & U(3)).astype(np.int64), n + 1, TAILS)[:TAILS]
    norm[-1] += ends
    return Brown(int(total), int(distinct), key[order], n[order], klass, transitions, norm, clusters), words_only


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _tokens(w: Words, model: Brown) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, count, whether it is a head word) of each word."""
    k = keys(w)
    klass = model.clusters + (k & U(3)).astype(np.int64)
    count = np.zeros(len(k), np.int64)
    if len(model.head) and len(k):
        i = np.minimum(np.searchsorted(model.head, k), len(model.head) - 1)
        hit = model.head[i] == k
        klass = np.where(hit, model.head_class[i], klass)
        count = np.where(hit, model.head_count[i], 0)
    else:
        hit = np.zeros(len(k), bool)
    return k, klass, count, hit


def _near(sent):
    """Per text: tokens, known head words, and what needs no count of a tail word."""

    def run(text: pa.Array) -> pa.Array:
        model, ends = sent.value
        n_tokens, n_known, base, score = [], [], [], []
        for w in words(text):
            _, klass, count, hit = _tokens(w, model)
            before, now = _prior(w, klass, model.end)
            size = np.diff(w.bounds)
            with_end = np.concatenate([[0], np.cumsum(size + 1)])
            n_tokens.append(size + 1)
            n_known.append(_sums(hit.astype(float), w.bounds).round().astype(np.int64) + (1 if ends else 0))
            base.append(_sums(np.where(hit, np.log10((count + 1) / model.base_norm), 0.0), w.bounds) + np.log10((ends + 1) / model.base_norm))
            emit = np.where(hit, np.log10((count + 1) / model.class_norm[klass]), 0.0)
            # the end's class has one word, so its emission is certain
            score.append(_sums(model.transitions[before, now], with_end) + _sums(emit, w.bounds))
        cols = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, n_known, base, score)]
        return pa.StructArray.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, float, float))], names=["n_tokens", "n_known", "base", "score"])

    return F.arrow_udf(run, "struct<n_tokens long, n_known long, base double, score double>")


def _far(sent):
    """(word, key, tf) of tail words, once for each distinct text of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = sent.value
        seen: set[int] = set()
        for batch in batches:
            text_key = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1)):
                k, _, _, hit = _tokens(w, model)
                mine = text_key[w.lo : w.hi]
                fresh = np.ones(len(mine), bool)
                for i, x in enumerate(mine.tolist()):
                    if x in seen:
                        fresh[i] = False
                    elif len(seen) < 1_000_000:
                        seen.add(x)
                doc = w.doc
                at = np.flatnonzero(~hit & fresh[doc])
                if not len(at):
                    continue
                by = at[np.lexsort((k[at], doc[at]))]
                d, kk = doc[by], k[by]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (kk[1:] != kk[:-1])]))
                tf = np.diff(np.append(first, len(by)))
                yield pa.RecordBatch.from_arrays([pa.array(kk[first].view(np.int64)), pa.array(mine[d[first]]), pa.array(tf.astype(np.int32))], names=["word", "key", "tf"])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs(doc_id, text)."""
    model, counts = train(docs)
    ends = int(round(model.class_norm[-1] - 1)) if model.total else 0
    sent = docs.sparkSession.sparkContext.broadcast((model, ends))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), _near(sent)(text).alias("_n"))
    far = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(_far(sent), "word long, key long, tf int")
    norm = [float(x) for x in model.class_norm[model.clusters : model.clusters + TAILS]]
    tail = F.col("word").bitwiseAND(F.lit(3).cast("long"))
    log_norm = F.element_at(F.array(*[F.lit(float(np.log10(x))) for x in norm]), (tail + 1).cast("int"))
    # one entry for each text and word, whichever partitions sent it: entries meet by word, where the count is too
    far = far.repartition("word").groupBy("word", "key").agg(F.first("tf").alias("tf"))
    joined = far.join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    tails = joined.groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("_known"),
        F.sum(F.col("tf") * (F.log10(c + 1) - F.lit(float(np.log10(model.base_norm))))).alias("_base"),
        F.sum(F.col("tf") * (F.log10(c + 1) - log_norm)).alias("_score"),
    )
    out = rows.join(tails, F.col("_key") == F.col("key"), "left")
    score = F.col("_n.score") + F.coalesce("_score", F.lit(0.0))
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col("_n.n_tokens").alias("n_tokens"), (F.col("_n.n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("_n.base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("_n.n_tokens")).alias("perplexity"),
    )
