"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of distinct 5-word shingles; two link when 100 * intersection >= 75 * union.

* Equal sets collapse to one *node* before anything is compared, so exact copies never meet as pairs.
* A fixed-size sketch of shingle counts over the whole corpus tells short inverted lists from long ones, as far as its
  noise lets it; lists that turn out long all the same, counted over the nodes' rarest shingles, are marked in a
  fixed-size bitmap and go last.  Both only fix an order: any order gives exact results.
* Nodes gather in *cells* around the most popular node they share minimum hashes with.  Inside a cell
  (blocks of bounded bytes, block against block) a task runs DivideSkip: it merges a query's short lists,
  keeps nodes on at least T - L of them, and binary-probes the L long lists.
* Nodes of different cells meet through the short lists of their rarest shingles, spread by shingle: with
  an overlap of at least T, at least SHORT_HITS of the n - T + SHORT_HITS rarest shingles agree (T - L =
  SHORT_HITS), and more where the sizes are alike.  What reaches that count is verified on whole sets.  One node of each
  component found so far meets the others first, so that only pairs of still different components are made.
  Lists that are equal, as those of a passage's shingles, are one list of their number's weight; on a list of more than
  MANY nodes, pairs are counted in the task over all lists they share, so what falls short of the hits is never a row.
* Links become connected components; the result has a row for each document, never all pairs of a group.

Edge cases: null or blank text gives an empty set, `n_shingles` 0 and a component of its own; fewer than
five words make one shingle; repeated rows and equal ids stay, a row each; a null doc_id takes part in links
and stays null, components being named by the smallest non-null id (null if there is none); an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .session import bounded_batches, components, cut, release, small
from .textbatch import U, Words, mix, shingle_sets, trim, trimmed, words

SKETCH_BITS, SKETCH_PARTS = 18, 64
#: Minimum hashes a node, and how many a node shares with the hub of its cell.  They steer work, not results.
HASHES, SHARED = 8, 3
SALTS = 8
SHORT_HITS = 4
#: Shingles in a block of a cell; entries of a frequent shingle in one task.
BLOCK, HEAVY = 1_500_000, 50_000
#: Entries that a task looks at together.
GATHER = 50_000
#: Nodes that make a list long; bits of the map of long lists, in parts.
LONG, MAP_BITS, MAP_PART = 6, 26, 20
#: Nodes from which on a list's pairs are counted in arrays and not as rows.
MANY = 4
#: Counts in a node's signature: its shingles by a byte of their hash.
SIGN = 256
#: Rows up to which node tables (three longs a row) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 150_000

_ODD = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
_DOCS = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sign", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def least_overlap(n: int) -> int:
    """The overlap that a node of n shingles needs with any partner: 3/4 of the larger, so at least of n."""
    return -(-3 * n // 4)


def node_of(s: np.ndarray) -> int:
    """Identity of a set: 64 bits over its members, in no order, and its size."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ U(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + U(len(s))]))[0].view(np.int64))


def sign_of(s: np.ndarray) -> bytes:
    """How many members of a set have each value of a byte of their hash, 255 at most.

    Two sets share no more members than the smaller counts of all values add up to, as long as none is cut off.
    """
    return np.minimum(255, np.bincount((s >> U(20) & U(SIGN - 1)).astype(np.int64), minlength=SIGN)).astype(np.uint8).tobytes()


def shareable(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The most members that sets with the signatures `some` (rows) can share with one of signature `one`."""
    least = np.minimum(some, one)
    out = least.sum(axis=1, dtype=np.int64)
    out[(least == 255).any(axis=1)] = np.iinfo(np.int64).max  # cut off: no bound
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for batch in batches:
        for w in words(batch.column(1)):
            ids = batch.column(0).slice(w.lo, w.hi - w.lo)
            sets = shingle_sets(w)
            sizes = np.array([len(s) for s in sets], np.int32)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), HASHES), np.uint64)
            if len(full):
                flat = np.concatenate(sets)
                sketch += np.bincount((flat >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint64)
                at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                for k in range(HASHES):
                    keys[full, k] = mix(np.minimum.reduceat(flat * _ODD[k], at) ^ _ODD[k])
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * HASHES + 1, HASHES, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            none = pa.nulls(len(sets))
            signs = pa.array([sign_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), nodes, pa.array(sizes), lists, signs, none.cast(pa.int32()), none.cast(pa.binary())], schema=_DOCS)
    parts = np.split(sketch, SKETCH_PARTS)
    some = [i for i, p in enumerate(parts) if p.any()]
    if some:
        none = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(_DOCS.field("keys").type), none.cast(pa.binary()), pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], schema=_DOCS)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint64)
            total[part] = total[part] + got if part in total else got.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Counts by the leading bits of the shingle hash: 2^18 numbers whatever the corpus, added up in the cluster."""
    rows = scanned.filter("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS // 4, "part").mapInArrow(_add_up, "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    for r in rows:
        out[r.part] += np.frombuffer(bytes(r.counts), np.uint64)
    return out.reshape(-1)


def _cells(nodes: DataFrame) -> DataFrame:
    """(node, n, rep, cell): each node that shares enough minimum hashes with a hub, hubs included."""
    # a key that very many nodes share is spread over SALTS tasks in both joins, and counted before it is sent
    keyed = nodes.select("node", F.explode("keys").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", "size", every)
    met = cut(keyed.join(sizes, ["key", "salt"]))
    popular = met.groupBy("node").agg(F.sum("size").alias("popular"))
    ranked = met.join(popular, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("hub")).select("key", "hub", every)
    near = (
        ranked.join(hubs, ["key", "salt"]).groupBy("node", "hub").agg(F.count("*").alias("shared")).filter(F.col("shared") >= SHARED)
        .groupBy("node").agg(F.max(F.struct("hub.popular", "shared", "hub.node")).alias("best")).select("node", F.col("best.node").alias("cell"))
    )
    cells = cut(near)
    for _ in range(3):  # a hub's own hub
        cells = cells.join(cells.select(F.col("node").alias("cell"), F.col("cell").alias("up")), "cell", "left").select("node", F.coalesce("up", "cell").alias("cell"))
    return cut(cells.join(nodes.select("node", "n", "rep"), "node"))


def sets_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles binary) of each row with an id, or none, that a wanted (node, rep) has, made again from the text.

    The caller joins on node: however many rows share an id, or have none, each is one row here.
    """
    ids = small(wanted.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_ROWS)
    rows = docs.join(ids, "doc_id", "left_semi").select("text").union(docs.filter("doc_id IS NULL").select("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0)):
                kept = [s for s in shingle_sets(w) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in kept], pa.int64()), pa.array([len(s) for s in kept], pa.int32()), pa.array([s.tobytes() for s in kept], pa.binary())], names=["node", "n", "shingles"])

    return rows.mapInArrow(trimmed(make), "node long, n int, shingles binary")


def divide_skip(sets: list[np.ndarray], side: np.ndarray, cross: bool, links: bool = False) -> list[tuple[int, int]]:
    """T-occurrence search among `sets` (sorted uint64 arrays), smaller sets indexed first.

    For each query of n members, T = ceil(3n/4) is the least overlap with any set of at most n members.
    The L longest of its inverted lists are set aside; the others are merged, and sets on at least T - L
    of them are probed in the long lists.  Returns links that span every component of the block, or every
    link if `links`.  With `cross`, only pairs whose `side` differs.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, side, sets = size[order], np.asarray(side)[order], [sets[i] for i in order]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), size)
    by = np.lexsort((owner, flat))
    member, post = flat[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
    length = np.diff(np.concatenate([first, [len(member)]]))
    name = np.empty(len(flat), np.int64)
    name[by] = np.repeat(np.arange(len(first)), length)
    at = np.concatenate([[0], np.cumsum(size)])
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    out: list[tuple[int, int]] = []
    for q in range(1, m):
        n, t = int(size[q]), least_overlap(int(size[q]))
        lists = name[at[q] : at[q + 1]]
        lists = lists[length[lists] > 1]
        if len(lists) < t:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        # the longer the lists, the more are set aside; T - 1 at most, so that every answer is on a short one
        aside = min(t - 1, int(t / (0.02 * np.log2(max(2, int(length[lists[-1]]))) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        seen = np.concatenate([post[first[x] : first[x] + length[x]] for x in short.tolist()])
        count = np.bincount(seen[seen < q], minlength=q)
        cand = np.flatnonzero(count >= t - aside)
        cand = cand[4 * size[cand] >= 3 * n]
        if cross:
            cand = cand[side[cand] != side[q]]
        if not links and len(cand):
            mine = find(q)
            cand = cand[[find(int(c)) != mine for c in cand]]
        if not len(cand):
            continue
        got = count[cand]
        for i, x in enumerate(long.tolist()):
            run = post[first[x] : first[x] + length[x]]
            k = np.searchsorted(run, cand)
            got = got + ((k < len(run)) & (run[np.minimum(k, len(run) - 1)] == cand))
            if i % 16 == 15:  # those that can't get there any more
                able = 7 * (got + len(long) - 1 - i) >= 3 * (n + size[cand])
                cand, got = cand[able], got[able]
                if not len(cand):
                    break
        for c in cand[7 * got >= 3 * (n + size[cand])].tolist():
            if links or find(c) != find(q):
                root[find(c)] = find(q)
                out.append((int(order[c]), int(order[q])))
    return out


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, i, j): one block, or two, in memory at a time."""
    key, held = None, {}

    def answer() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes = list(held)
            pairs = divide_skip([held[x][1] for x in nodes], np.array([held[x][0] for x in nodes]), key[1] != key[2])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in pairs], pa.int64()), pa.array([nodes[b] for _, b in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        cell, i, j, side, node = (batch.column(k).to_pylist() for k in range(5))
        sets = batch.column(5)
        for r in range(batch.num_rows):
            if (now := (cell[r], i[r], j[r])) != key:
                yield from answer()
                key, held = now, {}
            held[node[r]] = (side[r], np.frombuffer(sets[r].as_buffer(), np.uint64).copy())
    yield from answer()


def _links_in_cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    size = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("total")).filter("m > 1")
    members = cells.join(size, "cell").withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = cut(members.select("node", "rep", "cell", "side", "blocks"))
    placed = sets_for(docs, members).join(small(members, BROADCAST_ROWS), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "shingles")
    return placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(trimmed(_search_cells), "a long, b long")


def _ordered(sketch: np.ndarray, often: np.ndarray):
    """Shingles -> (sort key, slot of the sketch): the rarer by the sketch the earlier, those marked as long lists last."""
    level = np.minimum(127, np.round(4 * np.log2(sketch.astype(float) + 1))).astype(np.uint64) << U(56)

    def key(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (s >> U(64 - SKETCH_BITS)).astype(np.int64)
        bit = s & U((1 << MAP_BITS) - 1)
        last = (often[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8) & np.uint8(1)).astype(np.uint64)
        return last << U(63) | level[slot] | (s & U((1 << 56) - 1)), slot

    return key


def _rarest(w: Words, key, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(node, n, keys, slots) of each set not seen in this task: its n - T + SHORT_HITS rarest shingles."""
    for s in shingle_sets(w):
        n = len(s)
        if not n or (node := node_of(s)) in seen:
            continue
        if len(seen) < 1_000_000:
            seen.add(node)
        t = least_overlap(n)
        p = n - t + min(SHORT_HITS, t)
        keys, slots = key(s)
        part = np.argpartition(keys, p - 1)[:p] if p < n else np.arange(n)
        yield node, n, keys[part], slots[part]


def _long_lists(docs: DataFrame, sketch: np.ndarray) -> np.ndarray:
    """A map of 2^MAP_BITS bits, by the last bits of a shingle: set for shingles among the rarest of LONG texts and more.

    Copies in several tasks count several times, which marks more and changes no result.
    """
    often = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    sc = docs.sparkSession.sparkContext

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = (batch.column(k).to_numpy() for k in range(2))
            for p in np.unique(part).tolist():
                parts.setdefault(p, np.zeros(1 << MAP_PART, bool))[bit[part == p]] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1) for x in parts.values()], pa.binary())], names=["part", "bits"])

    sent = sc.broadcast((sketch, often))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = _ordered(*sent.value), set()
        for batch in batches:
            for w in words(batch.column(0)):
                some = [k for _, _, k, _ in _rarest(w, key, seen)]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], names=["token"])

    counted = docs.select("text").mapInArrow(trimmed(tokens), "token long").groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") >= LONG)
    bits = counted.select(F.expr(f"cast(token >> {MAP_PART} & {(1 << (MAP_BITS - MAP_PART)) - 1} AS int)").alias("part"), F.expr(f"cast(token & {(1 << MAP_PART) - 1} AS int)").alias("bit"))
    for r in bits.repartition("part").mapInArrow(mark, "part int, bits binary").collect():
        got = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
        often[r.part * len(got) : (r.part + 1) * len(got)] |= got
    return often


def _entries(docs: DataFrame, sketch: np.ndarray, often: np.ndarray) -> DataFrame:
    """(token, block, node, n, side): the rarest shingles of each node, the lists that DivideSkip merges."""
    blocks = 1 + np.maximum(0, sketch.astype(float) - 3 * sketch.mean() - 1) // HEAVY
    sent = docs.sparkSession.sparkContext.broadcast((sketch, often, blocks.astype(np.int64)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *order, blocks = sent.value
        key = _ordered(*order)
        seen: set[int] = set()  # copies in this partition send their entries once
        for batch in batches:
            for w in words(batch.column(0)):
                some = list(_rarest(w, key, seen))
                if not some:
                    continue
                nodes, sizes, tokens, slots = zip(*some)
                each = [len(x) for x in tokens]
                token, node, n, nb = np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), each), np.repeat(np.array(sizes, np.int64), each), blocks[np.concatenate(slots)]
                side = np.mod(node, nb)
                if nb.max() > 1:  # each block of a frequent shingle's list meets each other
                    again = np.repeat(np.arange(len(nb)), nb)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(nb) - nb, nb)
                    token, node, n, side = token[again], node[again], n[again], side[again]
                    block = np.minimum(side, other) << 20 | np.maximum(side, other)
                else:
                    block = np.zeros(len(token), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(block), pa.array(node), pa.array(n | side << 32)], names=["token", "block", "node", "n_side"])

    return docs.select("text").mapInArrow(trimmed(make), "token long, block long, node long, n_side long")


def hits_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the rarest shingles two sets of these sizes must share to link.

    Of the set whose rarest shingles end first in the order, all common shingles up to there are hits, and no more
    than its other n - p = T - SHORT_HITS can follow; hits and those must reach the overlap that the sizes need.
    """
    overlap = -(-3 * (a + b) // 7)
    larger = -(-3 * np.maximum(a, b) // 4)
    return np.maximum(np.minimum(SHORT_HITS, overlap), overlap - (larger - np.minimum(SHORT_HITS, larger)))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows joined up to `rows` and more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _lists(run):
    """A partition function that calls run(columns) on whole lists: rows come sorted by (token, block), a list in one task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in gathered(batches, GATHER):
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            done = len(same) - int(same.sum())  # the last list may go on
            rest = [x[done:] for x in now]
            if done:
                yield from run([x[:done] for x in now])
        if rest is not None:
            yield from run(rest)

    return trimmed(whole)


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _live(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The lists on which nodes of different cells meet, each node once; a list is named by a hash of its nodes, not by its token."""
    at = _starts(*cols[:3])  # copies from several partitions
    token, block, node, n_side, cell = cols = [c[at] for c in cols]
    at = _starts(token, block)
    size = np.diff(np.append(at, len(token)))
    mixed = np.minimum.reduceat(cell, at) != np.maximum.reduceat(cell, at)
    kept = np.flatnonzero(np.repeat(mixed, size))
    if len(kept):
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(node.view(np.uint64) ^ U(0x6C8E9CF570932BD5)), at) ^ mix(block[at].view(np.uint64)) ^ size.astype(np.uint64)).view(np.int64)
        out = [np.repeat(name, size), block, node, n_side, cell, np.repeat(size, size)]
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in out], names=["list", "block", "node", "n_side", "cell", "m"])


_MET = "a long, b long, list long, need int, weight int"


def _met(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, name: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    ok = np.flatnonzero(4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))
    if len(ok):
        a, b = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(name[ok]), pa.array(hits_needed(na[ok], nb[ok]).astype(np.int32)), pa.array(weight[ok].astype(np.int32))], names=["a", "b", "list", "need", "weight"])


def _stars(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """On each list one node of each component meets one of the list's largest; rows sorted by label and node within a list."""
    name, block, node, n_side, _, weight, label = cols
    n = n_side & 0xFFFFFFFF
    rep = _starts(name, block, label)
    size = np.diff(np.append(rep, len(name)))
    of = _starts(name[rep], block[rep])
    each = np.diff(np.append(of, len(rep)))
    by = np.lexsort((-size, np.repeat(np.arange(len(of)), each)))
    hub = np.repeat(rep[by[of]], each)
    rep, hub = rep[rep != hub], hub[rep != hub]
    yield from _met(node[rep], node[hub], n[rep], n[hub], name[rep], weight[rep])


def _pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """On each short list, the pairs of nodes of different cells and components."""
    name, block, node, n_side, cell, weight, label = cols
    n, side = n_side & 0xFFFFFFFF, n_side >> 32
    crossed = (block >> 20) != (block & 0xFFFFF)
    alive, d = np.arange(len(name)), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(name)]
        alive = alive[(name[alive] == name[alive + d]) & (block[alive] == block[alive + d])]
        i, j = alive, alive + d
        ok = (cell[i] != cell[j]) & (label[i] != label[j]) & (~crossed[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        yield from _met(node[i], node[j], n[i], n[j], name[i], weight[i])


def _counted(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """On each long list, the pairs of nodes of different cells and components that all the lists they share, long and short,
    give hits enough: T-occurrence in arrays, so that what falls short is never a row.

    Of each node the profile is known, the lists it is on and their weights, and its signature, which bounds what two sets share.
    """
    name, block, node, n_side, cell, _, label, lists, weights, signs = cols
    at = np.append(_starts(name, block), len(name))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        m = hi - lo
        if m < 2:
            continue
        n, side, own = n_side[lo:hi] & 0xFFFFFFFF, n_side[lo:hi] >> 32, node[lo:hi]
        crossed = (block[lo] >> 20) != (block[lo] & 0xFFFFF)
        sign = np.frombuffer(b"".join(signs[lo:hi]), np.uint8).reshape(m, SIGN)
        each = np.array([len(x) for x in lists[lo:hi]])
        flat, weight = np.concatenate(lists[lo:hi]), np.concatenate(weights[lo:hi]).astype(np.int64)
        owner = np.repeat(np.arange(m), each)
        by = np.argsort(flat, kind="stable")
        post, start = owner[by], _starts(flat[by])
        size = np.diff(np.append(start, len(flat)))
        place = np.empty(len(flat), np.int64)
        place[by] = np.repeat(np.arange(len(start)), size)
        first = np.append(0, np.cumsum(each))
        total = np.add.reduceat(weight, first[:-1])
        least = np.minimum(SHORT_HITS, hits_needed(n, -(-3 * n // 4)))  # with the smallest partner; larger ones ask for as many
        for q in range(1, m):
            if total[q] < least[q]:
                continue
            mine = place[first[q] : first[q + 1]]
            some = size[mine] > 1
            runs = [post[start[x] : start[x] + size[x]] for x in mine[some].tolist()]
            if not runs:
                continue
            seen = np.concatenate(runs)
            gained = np.repeat(weight[first[q] : first[q + 1]][some], size[mine[some]])
            back = seen < q
            hits = np.bincount(seen[back], gained[back], minlength=q)
            cand = np.flatnonzero(hits >= least[q])
            ok = (cell[lo + cand] != cell[lo + q]) & (label[lo + cand] != label[lo + q]) & (hits[cand] >= hits_needed(n[cand], np.full(len(cand), n[q])))
            cand = cand[ok & ((side[cand] != side[q]) if crossed else True)]
            if len(cand):
                cand = cand[7 * np.minimum(shareable(sign[cand], sign[q]), 1 << 40) >= 3 * (n[cand] + n[q])]
            if len(cand):
                yield from _met(own[cand], np.full(len(cand), own[q]), n[cand], np.full(len(cand), n[q]), np.full(len(cand), -1, np.int64), hits[cand])


def _verified(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """Links (a, b) among the pairs that met on lists enough, compared on whole sets."""
    # a pair that several long lists counted, each all there is, is one of them
    pairs = met.groupBy("a", "b", "list").agg(F.first("need").alias("need"), F.max("weight").alias("weight"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("weight").alias("hits"), F.first("need").alias("need")).filter("hits >= need").select("a", "b")
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep"), "node"))
    whole = cut(sets_for(docs, wanted).join(small(wanted.select("node"), BROADCAST_ROWS), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    both = both.join(whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(k) for k in range(4))
            kept = []
            for r in range(batch.num_rows):
                x, y = np.frombuffer(sa[r].as_buffer(), np.uint64), np.frombuffer(sb[r].as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 7 * common >= 3 * (len(x) + len(y)):
                    kept.append(r)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64()))], names=["a", "b"])

    return cut(both.select("a", "b", "sa", "sb").mapInArrow(trimmed(verify), "a long, b long"))


def _links_across(docs: DataFrame, nodes: DataFrame, cells: DataFrame, sketch: np.ndarray, edges: DataFrame) -> DataFrame:
    """Links between cells that, with `edges`, span every component.

    First one node of each component on a list meets one of the largest there, and components grow by what links; then
    the nodes of still different components meet.  So a group of near copies spread over cells makes no pairs of its own.
    """
    often = _long_lists(docs, sketch)
    release(docs.sparkSession)
    entries = _entries(docs, sketch, often)
    known = small(cells.select("node", "cell"), BROADCAST_ROWS)
    entries = entries.join(known, "node", "left").select("token", "block", "node", "n_side", F.coalesce("cell", "node").alias("cell"))
    live = cut(entries.repartition("token", "block").sortWithinPartitions("token", "block", "node").mapInArrow(_lists(_live), "list long, block long, node long, n_side long, cell long, m long"))
    del entries  # their shuffle is the largest, and done with
    release(docs.sparkSession)
    # shingles whose lists are equal, as those of a passage are, count as one list of their number's weight
    one = [F.first(c).alias(c) for c in ("n_side", "cell", "m")]
    merged = cut(live.groupBy("list", "block", "node").agg(*one, F.count("*").cast("int").alias("weight")))
    found = edges
    for run in (_stars, _pairs):
        if not merged.limit(1).count():
            break
        labels = small(components(found).select(F.col("id").alias("node"), "label"), BROADCAST_ROWS)
        named = merged.join(labels, "node", "left").select("list", "block", "node", "n_side", "cell", "weight", F.coalesce("label", "node").alias("label"), "m")
        if run is _pairs:
            met = _in_order(named.filter(F.col("m") <= MANY).drop("m")).mapInArrow(_lists(_pairs), _MET)
            many = named.filter(F.col("m") > MANY).drop("m")
            on_many = many.select("node").distinct()
            profile = merged.join(on_many, "node", "left_semi").groupBy("node").agg(F.collect_list(F.struct("list", "weight")).alias("p"))
            profile = profile.join(nodes.select("node", "sign"), "node").select("node", F.col("p.list").alias("lists"), F.col("p.weight").alias("weights"), "sign")
            many = many.join(profile, "node").select("list", "block", "node", "n_side", "cell", "weight", "label", "lists", "weights", "sign")
            met = met.union(_in_order(many).mapInArrow(_lists(_counted), _MET))
        else:
            met = _in_order(named.drop("m")).mapInArrow(_lists(_stars), _MET)
        found = found.union(_verified(docs, nodes, met))
    return found


def _in_order(named: DataFrame) -> DataFrame:
    return named.repartition("list", "block").sortWithinPartitions("list", "block", "label", "node")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every row, and (node, rep, label, component_id) of every set; rep is its smallest id."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = cut(docs.mapInArrow(trimmed(_scan), "doc_id long, node long, n int, keys array<long>, sign binary, part int, counts binary"))
    table = scanned.filter("part IS NULL").select("doc_id", "node", "n", "keys", "sign")
    nodes = cut(table.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sign").alias("sign")))
    sketch = _sketch(scanned)
    cells = _cells(nodes)
    edges = cut(_links_in_cells(docs, cells))
    release(docs.sparkSession)
    edges = _links_across(docs, nodes, cells, sketch, edges)
    release(docs.sparkSession)
    labels = components(edges)
    named = nodes.select("node", "rep").join(labels.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return table.select("doc_id", "node", "n"), named.join(least, "label").select("node", "rep", "label", "component_id")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for every row of docs(doc_id, text); see the module's notes."""
    table, named = _classes(docs)
    out = table.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("node").alias("set_id"))


@F.arrow_udf(LongType())
def _node(text: pa.Array) -> pa.Array:
    """The set of each text, null where it has none."""
    out = [node_of(s) if len(s) else None for w in words(text) for s in shingle_sets(w)]
    trim()
    return pa.array(out, pa.int64())


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group stays: one that has the smallest id of the group, among several the one of the smallest set,
    and of equal rows one.  Rows without words are nobody's copy and stay, however many share an id.

    Rows are judged one by one, not by id: where an id repeats, or is null, its rows are told apart by their sets.  A
    group without any id keeps one row.
    """
    table, named = _classes(docs)
    kept = cut(named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("k")).select(F.col("k.rep").alias("_millrace_rep"), F.col("k.node").alias("_millrace_node")))
    several = cut(table.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 OR doc_id IS NULL").select("doc_id"))
    # an id that stands once is judged by its one row
    gone = table.filter("node IS NOT NULL AND doc_id IS NOT NULL").join(kept, F.col("node") == F.col("_millrace_node"), "left")
    gone = gone.filter("NOT doc_id <=> _millrace_rep").select(F.col("doc_id").alias("_millrace_gone")).distinct()
    several = several.select(F.col("doc_id").alias("_millrace_again"))
    odd = several.limit(1).count() > 0
    plain = docs.join(small(gone, BROADCAST_ROWS), F.col("doc_id").cast("long") == F.col("_millrace_gone"), "left_anti")
    if not odd:
        return plain
    ids = small(several.filter("_millrace_again IS NOT NULL"), BROADCAST_ROWS)
    same = F.col("doc_id").cast("long") == F.col("_millrace_again")
    plain = plain.filter("doc_id IS NOT NULL").join(ids, same, "left_anti")
    again = docs.join(ids, same, "left_semi").unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))
    again = again.withColumn("_millrace_set", _node(F.col("text").cast("string")))
    blank = again.filter("_millrace_set IS NULL")
    first = again.join(kept, (F.col("_millrace_set") == F.col("_millrace_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_millrace_rep"))).dropDuplicates(["_millrace_set"])
    return plain.unionByName(blank.select(docs.columns)).unionByName(first.select(docs.columns))


#: The contract's result by joining all shingles with all.
SQL = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), members AS (
    SELECT r, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.r AS a, b.r AS b FROM members a JOIN members b ON a.g = b.g AND a.r <> b.r
    GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT r, r AS other FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.r JOIN sets o ON o.r = reach.other GROUP BY reach.r
"""
