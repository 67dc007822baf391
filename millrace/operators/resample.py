"""Bootstrap replicates of a cell's numbers, by draw counts that weigh its builds.

A cell of n builds is drawn from n times in each replicate, each time by a hash of (seed, replicate, cell, draw), whatever its
size.  A block holds the counts of draws of at most BLOCK builds as a matrix, replicates by builds, a few replicates at a
time, and a sum over the drawn builds is a product of that matrix with the builds' values.  Only such partial sums leave the block:
a row for each block and replicate, never for a drawn build.

A cell of more than BLOCK builds is cut into ranges of their order; each block goes through all n draws of a replicate and counts those
that fall into its range, so that it needs nothing from the others.

Percentiles of one block are read from its sorted values and counts.  Across blocks the place of a percentile lies, for
all replicates, within a few standard errors of the observed one: blocks count what they drew below that bracket and hand
on the values inside it (some multiple of the root of n) with their counts; ranks inside it are found for CHUNK replicates
at a time.  If a replicate should fall outside, brackets are widened and the search for percentiles is done again.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import selection
from ..functions.formula import PERCENTILES, Plan
from ..functions.rng import M
from ..session import cut, small

BLOCK, CHUNK = 1 << 20, 128
#: Draws that are held at a time.
DRAWS = 1 << 19
#: Half a bracket's width in ranks, by the root of the number of known values; a draw's standard error is half of that root at most.
ERRORS = 4.0


def picks(seed: int, cell: int, replicates: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """replicates x draws [first, last) of n places in [0, n): the arithmetic of `rng.draw`, a replicate a row."""
    draws = np.arange(first, n if last is None else last, dtype=np.int64)
    x = (replicates.astype(np.int64)[:, None] * 7919 + cell * 104729 + draws[None, :] * 1299709 + seed) % M
    y = (x * 48271) % M
    return ((y * y + x * 69621) % M) % n


def counts(seed: int, cell: int, block: int, n: int, size: int, path: list[dict], replicates: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(replicates from 1, draw counts replicates x size) of a block, as many replicates at a time in all blocks of a cell."""
    start = path[0]["start"] if path else 0
    step = max(1, min(CHUNK, DRAWS // n))
    for at in range(0, replicates, step):
        reps = np.arange(at + 1, min(at + step, replicates) + 1)
        w = np.zeros(len(reps) * size, np.int64)
        for first in range(0, n, DRAWS):
            drawn = picks(seed, cell, reps, n, first, min(n, first + DRAWS)) - start
            own = drawn + (np.arange(len(reps)) * size)[:, None]
            w += np.bincount(own[(drawn >= 0) & (drawn < size)] if path else own.ravel(), minlength=len(w))
        yield reps, w.reshape(len(reps), size)


def weighted_percentile(values: np.ndarray, weights: np.ndarray, p: float) -> np.ndarray:
    """Of each row of weights: the percentile of the ascending values, each as often as its weight; NaN of none."""
    if not len(values):
        return np.full(len(weights), np.nan)
    upto = np.cumsum(weights, axis=1)
    total = upto[:, -1]
    place = p * (total - 1)
    low, high = (values[np.minimum((upto <= f(place)[:, None]).sum(axis=1), len(values) - 1)] for f in (np.floor, np.ceil))
    # equal ends are taken as they are
    out = np.where(low == high, low, low + (high - low) * (place - np.floor(place)))
    return np.where(total > 0, out, np.nan)


def _blocks(builds: DataFrame, keys: list[str], terms: dict[str, tuple[str, Column]], order: str) -> tuple[DataFrame, bool]:
    """(cell, block, n, path, order, values) of every build, and whether any cell has more than one block."""
    cells = cut(builds.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("cell", F.row_number().over(Window.orderBy(*keys))))  # a row a cell
    cells = cells.withColumn("depth", (F.col("n") > BLOCK).cast("int"))  # whether it has more than one block
    deep = cells.agg(F.max("depth")).first()[0] or 0
    named = cells.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "cell", "n", "depth")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    columns = [c.cast("double").alias(n) for n, (_, c) in terms.items()]
    rows = builds.select(*keys, F.col(order).cast("string").alias("_order"), *columns).join(small(named, selection.FEW), same)
    rows = rows.select(*keys, "cell", "n", "depth", "_order", *terms)
    empty = F.array().cast("array<struct<start:bigint>>")
    if not deep:
        return rows.withColumns({"block": F.lit(0).cast("long"), "path": empty}), False
    rows = selection.numbered(rows, ["cell"], ["_order"], "_place")
    block = F.when(F.col("depth") > 0, F.floor(F.col("_place") / BLOCK)).otherwise(F.lit(0)).cast("long")
    path = F.when(F.col("depth") > 0, F.array(F.struct((F.col("block") * BLOCK).alias("start")))).otherwise(empty)
    return rows.withColumn("block", block).withColumn("path", path).drop("_place"), True


def replicate_terms(builds: DataFrame, plans: Iterable[Plan], keys: Iterable[str], replicates: int, seed: int, order: str = "build_id") -> DataFrame:
    """rep, keys, n_builds and the plans' terms in each of `replicates` bootstrap replicates of every cell."""
    plans, keys = list(plans), list(keys)
    if any(p.hoisted for p in plans):
        return _written_out(builds, plans, keys, replicates, seed, order)
    terms = {n: (t.kind, t.over) for p in plans for n, t in p.terms.items() if t.kind != "rows"}
    rows, split = _blocks(builds, keys, terms, order)
    schema = "rep int, cell int, drawn double, " + ", ".join(f"{n}_s double, {n}_c double" for n in terms) if terms else "rep int, cell int, drawn double"
    names = list(terms)
    kinds = {n: k for n, (k, _) in terms.items()}

    def block_sums(table: pa.Table) -> Iterable[pa.RecordBatch]:
        table = table.take(np.argsort(np.array(table["_order"].to_pylist(), dtype=object), kind="stable")) if table.num_rows > 1 else table
        size = table.num_rows
        cell, block, n, path = (table[c][0].as_py() for c in ("cell", "block", "n", "path"))
        values = {t: table[t].to_numpy() for t in names}
        known = {t: ~np.isnan(v) for t, v in values.items()}
        far = {t: np.flatnonzero(np.isinf(values[t])) for t in names}  # a draw count of 0 takes no part of an infinity
        sums = np.stack([np.where(np.isfinite(values[t]), values[t], 0.0) for t in names] + [known[t].astype(float) for t in names] + [np.ones(size)], axis=1)
        for reps, w in counts(seed, cell, block, n, size, path, replicates):
            got = w.astype(np.float64) @ sums
            out = {"rep": pa.array(reps, pa.int32()), "cell": pa.array(np.full(len(reps), cell), pa.int32()), "drawn": pa.array(got[:, -1])}
            for i, t in enumerate(names):
                s, c = got[:, i], got[:, len(names) + i]
                for j in far[t]:
                    s = s + np.where(w[:, j] > 0, values[t][j], 0.0)
                if kinds[t] in ("min", "max"):
                    none = np.inf if kinds[t] == "min" else -np.inf
                    ends = np.where((w > 0) & known[t][None, :], values[t][None, :], none)
                    s = ends.min(axis=1) if kinds[t] == "min" else ends.max(axis=1)
                elif kinds[t] in PERCENTILES:
                    up = np.argsort(values[t][known[t]], kind="stable")
                    s = np.full(len(reps), np.nan) if path else weighted_percentile(values[t][known[t]][up], w[:, known[t]][:, up], PERCENTILES[kinds[t]])
                out[f"{t}_s"], out[f"{t}_c"] = pa.array(s, pa.float64(), from_pandas=True), pa.array(c, pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(block_sums(table)))

    sums = rows.select("cell", "block", "n", "path", "_order", *names).groupBy("cell", "block").applyInArrow(whole, schema)
    merged = sums.groupBy("rep", "cell").agg(F.sum("drawn").cast("long").alias("n_builds"), *[_merge(kinds[t], t).alias(t) for t in names])
    for p in plans:  # the number of builds drawn is the cell's size
        merged = merged.withColumns({n: F.col("n_builds").cast("double") for n, t in p.terms.items() if t.kind == "rows"})
    spread = {n: PERCENTILES[k] for n, k in kinds.items() if k in PERCENTILES}
    if split and spread:
        apart = _percentiles_over_blocks(rows, spread, replicates, seed)
        merged = merged.alias("m").join(apart.alias("p"), ["rep", "cell"], "left")
        merged = merged.select("rep", "cell", "m.n_builds", *[F.coalesce(F.col(f"p.{c}"), F.col(f"m.{c}")).alias(c) if c in spread else F.col(f"m.{c}") for p in plans for c in p.terms])
    of = rows.select("cell", *keys).distinct()
    return merged.join(small(cut(of), selection.FEW), "cell").drop("cell")


def _merge(kind: str, t: str) -> Column:
    """A term from its blocks' sums s and counts of known values c; null where nothing known was drawn."""
    s, c = F.col(f"{t}_s"), F.sum(f"{t}_c")
    match kind:
        case "sum":
            return F.when(c > 0, F.sum(s))
        case "mean":
            return F.when(c > 0, F.sum(s) / c)
        case "hits":
            return F.sum(s)
        case "share":
            return F.sum(s) / F.sum("drawn")
        case "min" | "max":
            return F.when(c > 0, F.min(s) if kind == "min" else F.max(s))
    return F.max(s)  # a percentile of a single block


def _percentiles_over_blocks(rows: DataFrame, spread: dict[str, float], replicates: int, seed: int) -> DataFrame:
    """rep, cell and the percentiles of the cells that have more than one block."""
    big = cut(rows.filter("depth > 0").select("cell", "block", "n", "path", "_order", *spread))
    errors = ERRORS
    while True:
        known = big.groupBy("cell").agg(*[F.count(t).alias(f"{t}_n") for t in spread])
        brackets = {}
        for t, p in spread.items():
            n = F.col(f"{t}_n")
            # of the draws, a binomial number has a known value, so ranks spread a little more than shares
            width = errors * F.sqrt(n.cast("double")) + 2
            brackets[t] = (F.greatest(F.lit(0.0), F.floor(p * (n - 1) - width)), F.least((n - 1).cast("double"), F.ceil(p * (n - 1) + width)))
        by = known.select("cell", F.explode(F.array(*[F.struct(F.lit(i).alias("col"), *[b.cast("long").alias(e) for b, e in zip(brackets[t], ("lo", "hi"))], F.col(f"{t}_n").alias("n")) for i, t in enumerate(spread)])).alias("b")).select("cell", "b.*").filter("n > 0")
        by = cut(by)
        codes = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), selection.ordered_bits(F.col(t)).alias("code")) for i, t in enumerate(spread)])).alias("e")
        long = cut(big.select("cell", codes).select("cell", "e.*").filter("code IS NOT NULL"))
        ranks = by.select("cell", "col", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
        at = selection.order_statistics(long, ["cell", "col"], ranks).join(by, ["cell", "col"])
        ends = at.groupBy("cell").agg(*[F.max(F.when((F.col("col") == i) & (F.col("k") == F.col(e)), selection.from_bits(F.col("code")))).alias(f"{t}_{e}") for i, t in enumerate(spread) for e in ("lo", "hi")])
        found = cut(_bracketed(big.join(small(cut(ends), selection.FEW), "cell"), spread, replicates, seed))
        if not found.filter("outside").limit(1).count():
            return found.drop("outside")
        errors *= 2


def _bracketed(rows: DataFrame, spread: dict[str, float], replicates: int, seed: int) -> DataFrame:
    """rep, cell, percentiles and whether one lies outside its bracket; rows have the brackets <term>_lo, <term>_hi."""
    names = list(spread)

    def inside(table: pa.Table) -> pa.Table:
        """What a block drew: below the bracket and in all by replicate (place null), and each value inside it."""
        table = table.take(np.argsort(np.array(table["_order"].to_pylist(), dtype=object), kind="stable")) if table.num_rows > 1 else table
        cell, block, n, path = (table[c][0].as_py() for c in ("cell", "block", "n", "path"))
        out: list[tuple] = []
        for reps, w in counts(seed, cell, block, n, table.num_rows, path, replicates):
            of = int(reps[0])
            for i, t in enumerate(names):
                v = table[t].to_numpy()
                lo, hi = table[f"{t}_lo"][0].as_py(), table[f"{t}_hi"][0].as_py()
                if lo is None:
                    continue
                out.append((cell, of, i, None, w[:, v < lo].sum(axis=1).tolist(), w[:, ~np.isnan(v)].sum(axis=1).tolist()))
                within = np.flatnonzero((v >= lo) & (v <= hi))
                for x in np.unique(v[within]):
                    out.append((cell, of, i, float(x), w[:, within[v[within] == x]].sum(axis=1).tolist(), None))
        cols = list(zip(*out)) or [()] * 6
        types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cell", "of", "col", "value", "low", "total"])

    def placed(table: pa.Table) -> pa.Table:
        """The percentile of each replicate of a chunk, from all blocks' parts."""
        cell, of, col = (table[c][0].as_py() for c in ("cell", "of", "col"))
        p = spread[names[col]]
        edge = table.filter(pa.compute.is_null(table["value"]))
        low, total = (np.array(edge[c].to_pylist(), np.int64).sum(axis=0) for c in ("low", "total"))
        mid = table.filter(pa.compute.is_valid(table["value"]))
        values, where = np.unique(mid["value"].to_numpy(), return_inverse=True)
        weights = np.zeros((len(values), len(low)), np.int64)
        np.add.at(weights, where, np.array(mid["low"].to_pylist(), np.int64).reshape(-1, len(low)))
        upto = np.cumsum(weights, axis=0) + low[None, :]
        place = p * (total - 1)
        ends, lost = [], np.zeros(len(low), bool)
        for f in (np.floor, np.ceil):
            k = f(place)
            at = (upto <= k[None, :]).sum(axis=0)
            lost |= (total > 0) & ((k < low) | (at >= len(values)))
            ends.append(values[np.minimum(at, len(values) - 1)])
        got = np.where(ends[0] == ends[1], ends[0], ends[0] + (ends[1] - ends[0]) * (place - np.floor(place)))
        got = np.where(total > 0, got, np.nan)
        n = len(low)
        return pa.table({"rep": pa.array(np.arange(of, of + n), pa.int32()), "cell": pa.array(np.full(n, cell), pa.int32()), "col": pa.array(np.full(n, col), pa.int32()), "p": pa.array(got, pa.float64(), from_pandas=True), "outside": pa.array(lost)})

    parts = rows.groupBy("cell", "block").applyInArrow(inside, "cell int, of int, col int, value double, low array<bigint>, total array<bigint>")
    each = parts.groupBy("cell", "of", "col").applyInArrow(placed, "rep int, cell int, col int, p double, outside boolean")
    return each.groupBy("rep", "cell").agg(*[F.max(F.when(F.col("col") == i, F.col("p"))).alias(t) for i, t in enumerate(names)], F.max("outside").alias("outside"))


def _written_out(builds: DataFrame, plans: list[Plan], keys: list[str], replicates: int, seed: int, order: str) -> DataFrame:
    """The same for formulas whose `clip` bounds are taken over the cell: they change with the replicate, and with them the
    builds' values, so drawn builds are written out."""
    from .cells import cell_terms

    rows, _ = _blocks(builds, keys, {}, order)

    def drawn(table: pa.Table) -> pa.Table:
        names = np.array(table["_order"].to_pylist(), dtype=object)
        names = names[np.argsort(names, kind="stable")]
        cell, block, n, path = (table[c][0].as_py() for c in ("cell", "block", "n", "path"))
        parts = []
        for reps, w in counts(seed, cell, block, n, len(names), path, replicates):
            r, j = np.nonzero(w)
            parts.append(pa.table({"rep": pa.array(reps[r], pa.int32()), "_drawn": pa.array(names[j], pa.string()), "_times": pa.array(w[r, j], pa.int64())}))
        return pa.concat_tables(parts)

    some = rows.select("cell", "block", "n", "path", "_order").groupBy("cell", "block").applyInArrow(drawn, "rep int, _drawn string, _times long")
    again = F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))).alias("_again")
    return cell_terms(some.join(builds, F.col("_drawn") == F.col(order).cast("string")).select("*", again), plans, ["rep", *keys])
