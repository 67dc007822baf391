"""Benchmark decontamination by latent semantic retrieval.

1. Features are the words of the benchmark (A-Z and Latin-1 capitals lower-cased, ASCII punctuation aside).  One pass over all
   documents counts in how many 32-word blocks each occurs; features in over MOST_BLOCKS of them are dropped,
   but for the rarer half of each item's words; the others weigh by IDF.
2. A distributed randomised SVD of the TF-IDF passages (64-word windows, stride 32, of all documents, and the
   benchmark's own passages with the same total energy): tasks add up Z = A^T (A Omega), a fixed-size matrix;
   the driver takes the Nystrom eigen-decomposition of A^T A from Z and Omega.
3. Every window of every document is projected and compared by cosine with every benchmark passage, in blocks.
   The basis has RANK columns whatever the benchmark's size, so beside it places are looked up exactly: text that holds
   enough of an item's words to be a leak must hold some of its rarest ones, so many and so near that none is left out
   (leaks within two lengths of the item).
4. Candidates are checked on words: longest common subsequence with the whole item (bit-parallel), and how much
   of the item's answer - its closing words - stands in the same place.

A document is contaminated by an item when LCS >= LCS_SHARE of the item's words, or LCS >= LCS_WITH_ANSWER and
the answer is found; items of under SHORT_ITEM words, which chance matches sooner, need SHORT_MORE more, and those of under
TINY_ITEM words TINY_MORE (three words in four).  Items of under LEAST_WORDS words are matched only as consecutive
words, and looked up by a hash of them.

Edge cases: null or empty texts match nothing; null ids are carried through; repeated rows give repeated
results, one (doc_id, item_id) pair each; of places with equal shares the cosine search's, then the first, is told; an
empty benchmark or table gives an empty result; other columns are ignored.  Benchmarks of over MOST_ITEMS items
or MOST_CHARS characters are searched in parts, each with its own basis.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textbatch import NOT_ALNUM, U, Words, chain, trim, trimmed, words

BLOCK = 32
RANK = 192
#: Beyond MOST_FEATURES distinct words, words share features, which adds candidates and loses none.
MOST_BLOCKS, MOST_FEATURES, MAP_BITS = 0.05, 1 << 16, 20
COSINE, MASS = 0.45, 0.5
LCS_SHARE, LCS_WITH_ANSWER, ANSWER_SHARE, ANSWER_WORDS, LEAST_WORDS = 0.5, 0.45, 0.6, 8, 8
SHORT_ITEM, SHORT_MORE = 24, 0.1
TINY_ITEM, TINY_MORE = 12, 0.25
#: Rare features of an item that a place must hold, where its words allow that; items looked up at once.
DISTINCT, GROUP = 5, 4096
#: Runs up to which sums of rows are taken together; counters of places, by a hash.
RUN, PLACE_BITS = 64, 18
_SPREAD = U(0x9E3779B97F4A7C15)
#: Items and their characters that the driver and the tasks hold at a time; a larger benchmark is searched in parts.
MOST_ITEMS, MOST_CHARS = 200_000, 40_000_000


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray  # uint64


@dataclass
class Rare:
    """GROUP items by their rarest features."""

    post: np.ndarray  # feature -> its first place in items
    items: np.ndarray
    first: int  # these three by item, from the first one on
    size: np.ndarray
    need: np.ndarray


@dataclass
class Index:
    """What tasks need: bounded by the benchmark and by fixed parameters, whatever the corpus."""

    items: list[Item]
    feature: np.ndarray  # int32[2^MAP_BITS]: word hash -> feature, or -1
    width: int
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None  # width by RANK, scaled by idf
    queries: np.ndarray | None = None  # unit rows
    query_item: np.ndarray | None = None
    least_mass: float = 0.0
    lookup: list[Rare] = field(default_factory=list)
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # words -> sorted hashes of items of so many, items


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for w in words(pa.array(texts, pa.string()), NOT_ALNUM, latin=True):
        out += [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - MAP_BITS)).astype(np.int64)


def _index(rows: list) -> Index:
    items = [Item(i, h.copy()) for (i, _), h in zip(rows, _hashes([t for _, t in rows])) if len(h)]
    feature = np.full(1 << MAP_BITS, -1, np.int32)
    if items:
        slots = np.unique(_slot(np.unique(np.concatenate([x.words for x in items]))))
        feature[slots] = np.arange(len(slots)) % MOST_FEATURES
        return Index(items, feature, min(len(slots), MOST_FEATURES))
    return Index(items, feature, 0)


def _blocks(w: Words, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that are features: position and feature, block; and the first block of each text (and end)."""
    got = feature[_slot(w.hash)]
    at = np.flatnonzero(got >= 0)
    size = np.diff(w.bounds)
    first = np.concatenate([[0], np.cumsum(-(-size // BLOCK))])
    doc = np.searchsorted(w.bounds, at, "right") - 1
    block = first[doc] + (at - w.bounds[doc]) // BLOCK
    return at, got[at], block, first


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        total, blocks = np.zeros(index.width, np.int64), 0
        for batch in batches:
            for w in words(batch.column(0), NOT_ALNUM, latin=True):
                _, ids, block, first = _blocks(w, index.feature)
                n = int(first[-1])
                for lo in range(0, n, step := max(1, (1 << 24) // index.width)):
                    a, e = np.searchsorted(block, [lo, lo + step])
                    held = np.zeros((min(step, n - lo), index.width), bool)
                    held[block[a:e] - lo, ids[a:e]] = True
                    total += np.count_nonzero(held, axis=0)
                blocks += n
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(total, blocks).tobytes()], pa.binary())], names=["part", "numbers"])

    return run


def _sum(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(numbers.as_buffer(), kind).astype("f8" if kind == "f4" else kind)
                total[part] = total[part] + got if part in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "numbers"])

    return run


_SUMS = "part int, numbers binary"


def _sums(numbers: DataFrame, kind: str, parts: int) -> dict[int, np.ndarray]:
    """Fixed-size numbers from every task, added up part by part in the cluster."""
    rows = numbers.repartition(max(2, parts), "part").mapInArrow(_sum(kind), _SUMS).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        got = np.frombuffer(bytes(r.numbers), "f8" if kind == "f4" else kind)
        out[r.part] = out[r.part] + got if r.part in out else got
    return out


def _row_sums(matrix: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of matrix[rows] over consecutive runs of so many rows each (none empty).

    Long runs are summed one by one; the others all at once, their first rows, their second rows and so on.
    """
    out = np.zeros((len(size), matrix.shape[1]), np.float32)
    start = np.cumsum(size) - size
    for j in np.flatnonzero(size > RUN).tolist():
        for a in range(int(start[j]), int(start[j] + size[j]), 4096):
            out[j] += matrix[rows[a : min(a + 4096, int(start[j] + size[j]))]].sum(axis=0)
    by = np.flatnonzero(size <= RUN)
    by = by[np.argsort(-size[by], kind="stable")]
    start, size = start[by], size[by]
    some, held = np.zeros((len(by), matrix.shape[1]), np.float32), np.empty((len(by), matrix.shape[1]), np.float32)
    for k in range(int(size[0]) if len(by) else 0):
        m = int(np.searchsorted(-size, -k, "left"))
        some[:m] += np.take(matrix, rows[start[:m] + k], axis=0, out=held[:m], mode="clip")
    out[by] = some
    return out


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _windows(ids: np.ndarray, block: np.ndarray, first: np.ndarray, matrix: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each window, projected windows, squared TF-IDF mass); windows are two blocks of one text,
    or the one block there is."""
    n = int(first[-1])
    z = np.zeros((n, matrix.shape[1]), np.float32)
    mass = np.bincount(block, idf[ids] ** 2, n)
    at, size = _runs_of(block)
    z[block[at]] = _row_sums(matrix, ids, size)
    last = np.zeros(n, bool)
    size = np.diff(first)
    last[first[1:][size > 0] - 1] = True
    alone = np.zeros(n, bool)
    alone[first[:-1][size == 1]] = True
    start = np.flatnonzero(~last | alone)
    follow = ~last[start]
    pair = start[follow] + 1
    out, m = z[start], mass[start]
    out[follow] += z[pair]
    m[follow] += mass[pair]
    return start, out, m


def _range_finder(sent, seed: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        omega = _omega(index.width, seed) * index.idf[:, None].astype(np.float32)
        total, energy, any_rows = np.zeros((index.width, RANK), np.float64), 0.0, False
        keep = index.feature.copy()
        keep[keep >= 0] = np.where(index.idf[keep[keep >= 0]] > 0, keep[keep >= 0], -1)
        for batch in batches:
            for w in words(batch.column(0), NOT_ALNUM, latin=True):
                _, ids, block, first = _blocks(w, keep)
                if not len(ids):
                    continue
                start, y, mass = _windows(ids, block, first, omega, index.idf)
                any_rows = True
                energy += float(mass.sum())
                # a word's weight goes to each window that holds its block
                of = np.full(int(first[-1]) + 1, -1)
                of[start] = np.arange(len(start))
                per = np.zeros((int(first[-1]), RANK), np.float32)
                per[start] += y
                pair = start[np.isin(start, first[1:] - 1, invert=True)]
                per[pair + 1] += y[of[pair]]
                by = np.argsort(ids, kind="stable")
                at, size = _runs_of(ids[by])
                total[ids[by][at]] += _row_sums(per, block[by], size)
        if any_rows:
            total *= index.idf[:, None]
            pieces = np.array_split(total.astype(np.float32), parts)
            rows = [p.tobytes() for p in pieces] + [np.array([energy], np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts + 1), pa.int32()), pa.array(rows, pa.binary())], names=["part", "numbers"])

    return run


def _omega(width: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((width, RANK)).astype(np.float32)


def _passages(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the benchmark's passages (64 words, stride 32) one after the other, their number in each, and its item."""
    ids, size, owner = [], [], []
    for k, item in enumerate(index.items):
        h = item.words
        f = index.feature[_slot(h)]
        for a in range(0, max(1, len(h) - BLOCK), BLOCK) if len(h) > 2 * BLOCK else (0,):
            ids.append(f[a : a + 2 * BLOCK])
            size.append(len(ids[-1]))
            owner.append(k)
    return np.concatenate(ids), np.array(size, np.int64), np.array(owner, np.int64)


def _more(n: int) -> float:
    """What an item of n words needs beyond a long one's share."""
    return TINY_MORE if n < TINY_ITEM else SHORT_MORE if n < SHORT_ITEM else 0.0


@cache
def _least(n: int) -> int:
    """The fewest words in common order that make an item of n words a leak."""
    need = LCS_WITH_ANSWER + _more(n)
    return next(t for t in range(n + 1) if t / n >= need)


def _rarest(words_: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The item's rarest features, and how many of them every text that holds _least of its words must hold."""
    ids, times = np.unique(feature[_slot(words_)], return_counts=True)
    by = np.argsort(counts[ids], kind="stable")
    rest, least = len(words_) - np.cumsum(times[by]), _least(len(words_))
    for need in range(min(DISTINCT, len(ids)), 0, -1):
        most: list[int] = []  # words that under `need` of the features so far can give
        for j, t in enumerate(times[by].tolist()):
            insort(most, t)
            most = most[len(most) - need + 1 :] if len(most) >= need else most
            if rest[j] + sum(most) < least:
                return ids[by[: j + 1]], need
    raise AssertionError("one feature at least is held")


def _lookup(index: Index, counts: np.ndarray) -> list[Rare]:
    out = []
    for lo in range(0, len(index.items), GROUP):
        part = index.items[lo : lo + GROUP]
        size, need = np.array([len(x.words) for x in part], np.int64), np.zeros(len(part), np.int64)
        ids, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, item in enumerate(part):
            if len(item.words) >= LEAST_WORDS:
                got, need[k] = _rarest(item.words, index.feature, counts)
                ids.append(got)
                owner.append(np.full(len(got), k))
        every, of = np.concatenate(ids), np.concatenate(owner)
        by = np.argsort(every, kind="stable")
        out.append(Rare(np.searchsorted(every[by], np.arange(index.width + 1)), of[by], lo, size, need))
    return out


def _few(docs: DataFrame) -> DataFrame:
    """Fewer, larger tasks where each sends a matrix."""
    n = docs.rdd.getNumPartitions()
    return docs.coalesce(max(48, n // 8)) if n > 48 else docs


def fit(docs: DataFrame, benchmark: DataFrame, seed: int = 11) -> list[Index]:
    """An index of each part of the benchmark."""
    bounded_batches(docs.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    out = []
    for part in _parts(rows):
        index = _index(part)
        if index.items:
            out.append(_fit(docs, index, seed))
    return out


def _parts(rows: Iterator) -> Iterator[list]:
    """Runs of rows of at most MOST_ITEMS items and, but for a longer item alone, MOST_CHARS characters."""
    held, size = [], 0
    for row in rows:
        n = len(row[1] or "")
        if held and (len(held) >= MOST_ITEMS or size + n > MOST_CHARS):
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def _fit(docs: DataFrame, index: Index, seed: int) -> Index:
    sc = docs.sparkSession.sparkContext
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = _sums(text.mapInArrow(trimmed(_count(sc.broadcast(index))), _SUMS), "i8", 1).get(0)
    counts = np.zeros(index.width + 1) if counts is None else counts.astype(float)
    index.lookup, index.runs = _lookup(index, counts), _runs(index.items)
    blocks = max(1.0, counts[-1])
    index.idf = np.log((1 + blocks) / (1 + counts[:-1]))
    common = counts[:-1] > max(8, MOST_BLOCKS * blocks)
    for item in index.items:  # a passage that much of the corpus holds makes its own words common
        ids = np.unique(index.feature[_slot(item.words)])
        common[ids[np.argsort(counts[ids], kind="stable")][: max(LEAST_WORDS, len(ids) // 2)]] = False
    index.idf[common] = 0.0
    omega = _omega(index.width, seed)
    parts = 16
    sums = _sums(_few(text).mapInArrow(trimmed(_range_finder(sc.broadcast(index), seed, parts)), _SUMS), "f4", parts)
    z, energy = np.zeros((index.width, RANK)), 0.0
    if sums:
        z, energy = np.concatenate([sums[k].reshape(-1, RANK) for k in range(parts)]), float(sums[parts][0])
    ids, size, owner = _passages(index)
    seen = _row_sums(omega * index.idf[:, None].astype(np.float32), ids, size)
    by = np.argsort(ids, kind="stable")
    at, times = _runs_of(ids[by])
    mine = np.zeros((index.width, RANK))
    mine[ids[by][at]] = _row_sums(seen, np.repeat(np.arange(len(size)), size)[by], times)
    own = float((index.idf[ids] ** 2).sum()) or 1.0
    z += (energy or own) / own * mine * index.idf[:, None]
    # A^T A = Z (Omega^T Z)^-1 Z^T on the range of Z
    core = omega.T.astype(float) @ z
    shift = 1e-9 * max(1e-12, np.trace(core) / RANK)
    lam, vec = np.linalg.eigh((core + core.T) / 2 + shift * np.eye(RANK))
    half = z @ (vec / np.sqrt(np.maximum(lam, shift)))
    left, sigma, _ = np.linalg.svd(half, full_matrices=False)
    left = left[:, sigma > 1e-7 * max(sigma[0], 1e-30)]
    index.basis = np.ascontiguousarray(left * index.idf[:, None], np.float32)
    q = _row_sums(index.basis, ids, size)
    norm = np.sqrt((q**2).sum(1))
    some = norm > 0
    index.queries, index.query_item = (q[some] / norm[some, None]).astype(np.float32), owner[some]
    index.least_mass = float((MASS * norm[some].min()) ** 2) if some.any() else np.inf
    return index


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    return _lcs(a, _masks(a), b)


def _masks(a: list[int]) -> dict[int, int]:
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return at


def _lcs(a: list[int], at: dict[int, int], b: list[int]) -> int:
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        m = at.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def check(item: list[int], span: list[int]) -> tuple[float, bool, bool]:
    """(share of the item's words in common order, whether its answer is found, whether that is contamination)."""
    n = len(item)
    if n < LEAST_WORDS:
        found = any(span[i : i + n] == item for i in range(len(span) - n + 1))
        return float(found), found, found
    share = lcs(item, span) / n
    answer = item[-min(ANSWER_WORDS, n // 2) :]
    found = lcs(answer, span) >= ANSWER_SHARE * len(answer)
    need = LCS_WITH_ANSWER if found else LCS_SHARE
    return share, found, share >= need + _more(n)


_FOUND = "doc_id long, item_id long, lcs_share double, cosine double, answer_found boolean, first_word long, last_word long"


def _places(w: Words, ids: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, cell) where cells `cell` and `cell` + 1, of two lengths of the item each, hold enough of its rarest features."""
    for rare in index.lookup:
        at = np.flatnonzero(ids >= 0)
        size = rare.post[ids[at] + 1] - rare.post[ids[at]]
        at, size = at[size > 0], size[size > 0]
        if not len(at):
            continue
        f = ids[at]
        item = rare.items[np.arange(int(size.sum())) + np.repeat(rare.post[f] - np.cumsum(size) + size, size)]
        doc = (np.searchsorted(w.bounds, at, "right") - 1).astype(np.int32)
        within = (at - w.bounds[doc]).astype(np.int32)
        doc, within, f = np.repeat(doc, size), np.repeat(within, size), np.repeat(f, size)
        wide = (2 * rare.size[item]).astype(np.int32)
        cell = within // wide
        # no two texts share a number: text d has those from its first word's place by `wide` + 2 d on
        number = w.bounds[doc] // wide + (2 * doc + cell)
        # each feature counts for its cell and for the one before; most of these can't gather enough, whatever is counted twice
        later = np.flatnonzero(cell > 0)
        place = item << 30 | number
        place, of = np.concatenate([place, place[later] - 1]), np.concatenate([np.arange(len(item)), later])
        slot = (place.astype(U) * _SPREAD >> U(64 - PLACE_BITS)).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot, minlength=1 << PLACE_BITS)[slot] >= rare.need[item[of]])
        key, at = np.unique(place[some].astype(U) << U(16) | f[of[some]].astype(U), return_index=True)
        one, _ = _runs_of(key >> U(16))
        ok = np.diff(np.append(one, len(key))) >= rare.need[(key[one] >> U(46)).astype(np.int64)]
        at = some[at[one[ok]]]
        k, back = of[at], at >= len(item)
        yield doc[k], rare.first + item[k], cell[k] - back


def _likely(w: Words, ids: np.ndarray, index: Index, doc: np.ndarray, item: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which places hold _least of the item's features in common order: the bit-parallel LCS of all places at once.

    Features stand for words, so no place that `check` would take is lost.  Items of over 64 words are left to it.
    """
    by = np.argsort(item, kind="stable")
    at, size = _runs_of(item[by])
    bits = np.zeros(index.width + 1, U)  # feature -> its places in one item; the last is for words that are none
    keep, mask, of, full, least = [], [], [], np.zeros(len(item), U), np.zeros(len(item), np.int64)
    for a, m in zip(at.tolist(), size.tolist()):
        mine = by[a : a + m]
        own = index.items[int(item[mine[0]])].words
        n = len(own)
        if n > 64:
            keep.append(mine)
            continue
        f = index.feature[_slot(own)]
        np.bitwise_or.at(bits, f, U(1) << np.arange(n, dtype=U))
        lo = w.bounds[doc[mine]] + 2 * n * cell[mine]
        # behind the text's end its last word again, which adds places to look at and loses none
        span = np.minimum(lo[:, None] + np.arange(4 * n), w.bounds[doc[mine] + 1][:, None] - 1)
        got = bits[ids[span]]
        bits[f] = 0
        row, _ = np.nonzero(got)
        mask.append(got[got > 0])
        of.append(mine[row])
        full[mine], least[mine] = U((1 << n) - 1), _least(n)
    if mask:
        mask, of = np.concatenate(mask), np.concatenate(of)
        at, size = _runs_of(of)
        place = of[at]
        rich = np.flatnonzero(size >= least[place])
        rich = rich[np.argsort(-size[rich], kind="stable")]
        at, size, place = at[rich], size[rich], place[rich]
        row = full[place]
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))
            u = row[:m] & mask[at[:m] + k]
            row[:m] = (row[:m] + u | row[:m] - u) & full[place[:m]]
        keep.append(place[np.bitwise_count(full[place] ^ row) >= least[place]])
    return np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)


def _runs(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for n in range(1, LEAST_WORDS):
        of = np.array([k for k, x in enumerate(items) if len(x.words) == n], np.int64)
        if len(of):
            h = chain(np.concatenate([items[k].words for k in of]), n)[::n]
            by = np.argsort(h, kind="stable")
            out[n] = h[by], of[by]
    return out


def _whole(w: Words, index: Index) -> Iterator[tuple[int, int, int]]:
    """(text, item, first word) of the first place of each item of under LEAST_WORDS words in each text."""
    for n, (h, of) in index.runs.items():
        c = chain(w.hash, n)
        at = np.flatnonzero(np.isin(c, h))
        doc = np.searchsorted(w.bounds, at, "right") - 1
        inside = at + n <= w.bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        lo = np.searchsorted(h, c[at], "left")
        size = np.searchsorted(h, c[at], "right") - lo
        item = of[np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)]
        at, doc = np.repeat(at, size), np.repeat(doc, size)
        _, one = np.unique(doc * len(index.items) + item, return_index=True)
        yield from zip(doc[one].tolist(), item[one].tolist(), (at - w.bounds[doc])[one].tolist())


def _found_at(item: list[int], masks: dict[int, int], text: np.ndarray, cell: int) -> tuple[float, bool, int, int] | None:
    """The best leak among the runs of two lengths of the item, a quarter of one apart, that start in the cell."""
    n, best = len(item), None
    own = [x for x in text[2 * n * cell : 2 * n * (cell + 2)].tolist() if x in masks]
    least = _least(n)
    if len(own) < least or _lcs(item, masks, own) < least:
        return None
    if not check(item, text[2 * n * cell : 2 * n * (cell + 2)].tolist())[2]:
        return None
    step = max(1, n // 4)
    for a in range(-(-2 * n * cell // step) * step, min(len(text), 2 * n * (cell + 1)), step):
        share, answer, leak = check(item, text[a : a + 2 * n].tolist())
        if leak and (best is None or best[0] < share):
            best = (share, answer, a, min(len(text), a + 2 * n) - 1)
    return best


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        keep = index.feature.copy()
        keep[keep >= 0] = np.where(index.idf[keep[keep >= 0]] > 0, keep[keep >= 0], -1)
        masks: dict[int, dict[int, int]] = {}
        for batch in batches:
            for w in words(batch.column(1), NOT_ALNUM, latin=True):
                _, ids, block, first = _blocks(w, keep)
                start, z, mass = _windows(ids, block, first, index.basis, index.idf)
                z /= np.maximum(np.sqrt((z**2).sum(1)), 1e-12)[:, None]
                rich = np.flatnonzero(mass >= index.least_mass) if len(ids) else np.zeros(0, np.int64)
                best: dict[tuple[int, int], tuple] = {}

                def cosine(doc: int, item: int, a: int, e: int) -> float:
                    lo, hi = np.searchsorted(start, [max(first[doc], first[doc] + a // BLOCK - 1), min(first[doc + 1], first[doc] + e // BLOCK + 1)])
                    own = index.queries[slice(*np.searchsorted(index.query_item, [item, item + 1]))]
                    return float((z[lo:hi] @ own.T).max()) if lo < hi and len(own) else 0.0

                many = max(16, min(4096, (1 << 24) // max(1, len(index.queries))))
                for k in range(0, len(rich), many):
                    part = rich[k : k + many]
                    cos = z[part] @ index.queries.T
                    for i, q in zip(*np.nonzero(cos >= COSINE)):
                        b = int(start[part[i]])
                        doc = int(np.searchsorted(first, b, "right")) - 1
                        item = int(index.query_item[q])
                        n = len(index.items[item].words)
                        lo, hi = int(w.bounds[doc]), int(w.bounds[doc + 1])
                        at = lo + (b - int(first[doc])) * BLOCK
                        a, e = max(lo, at - n // 2), min(hi, at + 2 * BLOCK + n // 2)
                        share, answer, leak = check(index.items[item].words.tolist(), w.hash[a:e].tolist())
                        if leak and ((doc, item) not in best or best[doc, item][0] < share):
                            best[doc, item] = (share, float(cos[i, q]), answer, a - lo, e - lo - 1)
                every = index.feature[_slot(w.hash)]
                likely = []
                for place in _places(w, every, index):
                    some = _likely(w, every, index, *place)
                    likely += zip(*(x[some].tolist() for x in place))
                for doc, item, cell in likely:
                    if (doc, item) in best and best[doc, item][0] == 1.0:
                        continue
                    if item not in masks:
                        masks[item] = _masks(index.items[item].words.tolist())
                    got = _found_at(index.items[item].words.tolist(), masks[item], w.hash[w.bounds[doc] : w.bounds[doc + 1]], cell)
                    if got and ((doc, item) not in best or best[doc, item][0] < got[0]):
                        share, answer, a, e = got
                        best[doc, item] = (share, cosine(doc, item, a, e), answer, a, e)
                for doc, item, a in _whole(w, index):
                    e = a + len(index.items[item].words) - 1
                    if (doc, item) not in best:
                        best[doc, item] = (1.0, cosine(doc, item, a, e), True, a, e)
                if best:
                    ids_of = batch.column(0)
                    rows = [(ids_of[w.lo + d].as_py(), index.items[i].item_id, *v) for (d, i), v in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, index: list[Index] | None = None) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine, answer_found, first_word, last_word) for each contaminated document and item."""
    index = fit(docs, benchmark) if index is None else index
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not index:
        return docs.sparkSession.createDataFrame([], _FOUND)
    sc = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionAll, [rows.mapInArrow(trimmed(_search(sc.broadcast(x))), _FOUND) for x in index])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents (rows without an id are judged by their text all the same)."""
    for index in fit(docs, benchmark):
        docs = docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(index))(F.col("text").cast("string")))
    return docs


def _clean(sent):
    search = _search(sent)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        bad = np.zeros(len(text), bool)
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], names=["doc_id", "text"])
        for found in search(iter([numbered])):
            bad[found.column(0).to_numpy()] = True
        trim()
        return pa.array(~bad)

    return clean
