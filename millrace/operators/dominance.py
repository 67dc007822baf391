"""Pareto dominance as joins: fronts, layers, relaxations, hypervolume.  Smaller is better throughout.

Every function takes `on`, the key columns of a comparison, so that one job covers all comparisons, thresholds or
replicates.  Rows with a null objective take no part: what was not observed has no place in an order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import HV_EXACT_POINTS, HV_REFERENCE, HV_SAMPLES
from ..session import rewritten, small

#: Rows of a comparison that are layered in one task, and nodes of a graph whose cycles are; more are spread.
LAYER_BLOCK, CYCLE_NODES = 4096, 500


def both(a: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, a)


def either(a: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x | y, a)


def complete(df: DataFrame, objectives: list[str]) -> DataFrame:
    return df.filter(both(F.col(c).isNotNull() for c in objectives))


def beats(p: str, q: str, objectives: list[str]) -> Column:
    """Row q dominates row p: nowhere worse, somewhere better."""
    return both(F.col(f"{q}.{c}") <= F.col(f"{p}.{c}") for c in objectives) & either(F.col(f"{q}.{c}") < F.col(f"{p}.{c}") for c in objectives)


def prune(df: DataFrame, on: list[str], objectives: list[str]) -> DataFrame:
    """Drops rows that another row of the same task dominates: all that a front needs, before any shuffle.

    Whatever dominates a row is itself dominated only by rows that dominate it too, so the front is unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in objectives])
            key = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in on]).factorize()[0] if on else np.zeros(len(x), int)
            keep = np.zeros(len(x), bool)
            for k in np.unique(key):
                rows = np.flatnonzero(key == k)
                rows = rows[np.argsort(x[rows].sum(1), kind="stable")]
                held = np.zeros((0, x.shape[1]))
                for r in rows:
                    if not ((held <= x[r]).all(1) & (held < x[r]).any(1)).any():
                        keep[r] = True
                        held = np.vstack([held, x[r]])
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def front(df: DataFrame, on: list[str], objectives: list[str], pruned: bool = False) -> DataFrame:
    """Rows that no row of their comparison dominates; `pruned` for comparisons of many rows."""
    live = complete(df, objectives)
    if pruned:
        live = prune(live, on, objectives)
    p, q = live.alias("p"), live.select(*on, *objectives).alias("q")
    return p.join(q, both([*(F.col(f"p.{k}") == F.col(f"q.{k}") for k in on), beats("p", "q", objectives)]), "left_anti")


def flagged(df: DataFrame, on: list[str], ident: list[str], objectives: list[str], name: str = "on_front") -> DataFrame:
    """df with a boolean for front members; null where an objective is."""
    best = front(df, on, objectives).select(*on, *ident).withColumn("_on", F.lit(True))
    out = df.join(best, [*on, *ident], "left")
    return out.withColumn(name, F.when(both(F.col(c).isNotNull() for c in objectives), F.coalesce("_on", F.lit(False)))).drop("_on")


def _inside(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Layers of the rows of x, which are in an order where none dominates an earlier one; base: the layers behind them already."""
    layer = base + 1
    for i in range(len(x)):
        over = (x[:i] <= x[i]).all(1) & (x[:i] < x[i]).any(1)
        if over.any():
            layer[i] = max(layer[i], layer[:i][over].max() + 1)
    return layer


def layers(df: DataFrame, on: list[str], ident: list[str], objectives: list[str]) -> DataFrame:
    """on, ident, layer: 1 for the front, 2 for the front of the rest, and so on; null if incomplete.

    A row's layer is one more than the highest layer among the rows that dominate it.  In the order of (sum of the
    objectives, objectives) none dominates an earlier one, so ranges of that order, of about LAYER_BLOCK rows, are settled one
    after another, in all comparisons at once: a range meets the settled rows in a join that keeps a maximum for each
    of its rows, then itself in a task.
    """
    keys = [*on, *ident]
    whole = complete(df.select(*keys, *objectives), objectives)
    total = sum((F.col(c).cast("double") for c in objectives[1:]), F.col(objectives[0]).cast("double"))
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(objectives)]
    x = [f"_x{i}" for i in range(len(objectives))]
    rows = rewritten(whole.select(*keys, total.alias("_sum"), *numbers))
    order = ["_sum", *x, *ident]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, *x]) + ", layer long"

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ["_sum", *x]])
        values = np.column_stack([table[c].to_numpy() for c in x]) if table.num_rows else np.zeros((0, len(x)))
        return table.select([*keys, *x]).append_column("layer", pa.array(_inside(values, table["_base"].to_numpy().copy()), pa.int64()))

    def settled(part: DataFrame) -> DataFrame:
        return part.groupBy(*on, "_range").applyInArrow(settle, schema)

    most = rows.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    if most <= LAYER_BLOCK:
        done = settled(rows.withColumns({"_range": F.lit(0), "_base": F.lit(0).cast("long")}))
    else:
        n = -(-rows.count() // LAYER_BLOCK)
        dealt = rewritten(rows.repartitionByRange(n, *on, *order).withColumn("_range", F.spark_partition_id()))
        turn = F.dense_rank().over(Window.partitionBy(*on).orderBy("_range")).alias("_turn")
        turns = dealt.select(*on, "_range").distinct().select(*on, "_range", turn)  # a row a range
        turns = rewritten(turns)
        same = both(F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*on, "_range"])
        dealt = dealt.alias("d").join(small(turns, LAYER_BLOCK * 16).alias("t"), same).select("d.*", "t._turn")
        done = None
        for k in range(1, (turns.agg(F.max("_turn")).first()[0] or 0) + 1):
            now = dealt.filter(F.col("_turn") == k)
            if done is None:
                now = now.withColumn("_base", F.lit(0).cast("long"))
            else:
                # a row dominated by one of an upper layer is dominated by one of each layer below: the highest counts
                held = small(now.select(*on, *ident, *x), LAYER_BLOCK * 16).alias("p")
                pairs = done.alias("q").join(held, both([*(F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in on), beats("p", "q", x)]))
                base = pairs.groupBy(*[F.col(f"p.{c}").alias(c) for c in [*keys, *x]]).agg(F.max("q.layer").alias("_base"))
                same = both(F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, *x])
                now = now.alias("n").join(base.alias("b"), same, "left").select("n.*", F.coalesce("b._base", F.lit(0)).cast("long").alias("_base"))
            now = rewritten(settled(now))
            done = now if done is None else done.unionByName(now)
            if k % 16 == 0:
                done = rewritten(done)
    lost = df.filter(either(F.col(c).isNull() for c in objectives)).select(*keys, F.lit(None).cast("long").alias("layer"))
    return done.select(*keys, "layer").unionByName(lost)


def epsilon_front(df: DataFrame, on: list[str], objectives: list[str], epsilon: dict[str, float | Column]) -> DataFrame:
    """Front on boxes floor(x / epsilon); an epsilon of 0 or less keeps the value itself.  A resolution, not a test."""
    boxed = complete(df, objectives)
    for c in objectives:
        e = epsilon[c] if isinstance(epsilon[c], Column) else F.lit(float(epsilon[c]))
        boxed = boxed.withColumn(f"_box_{c}", F.when(e > 0, F.floor(F.col(c) / F.nullif(e, F.lit(0.0))).cast("double")).otherwise(F.col(c)))
    return front(boxed, on, [f"_box_{c}" for c in objectives]).drop(*[f"_box_{c}" for c in objectives])


def k_beats(p: str, q: str, objectives: list[str], k: int) -> Column:
    """q is nowhere worse on at least k objectives, and better on one."""
    no_worse = sum((F.col(f"{q}.{c}") <= F.col(f"{p}.{c}")).cast("int") for c in objectives)
    return (no_worse >= k) & either(F.col(f"{q}.{c}") < F.col(f"{p}.{c}") for c in objectives)


def k_front(df: DataFrame, on: list[str], objectives: list[str], k: int) -> DataFrame:
    """Rows that none k-dominates.  Not transitive: the result is a set, and may be empty."""
    live = complete(df, objectives)
    return live.alias("p").join(live.select(*on, *objectives).alias("q"), both([*(F.col(f"p.{c}") == F.col(f"q.{c}") for c in on), k_beats("p", "q", objectives, k)]), "left_anti")


def k_edges(df: DataFrame, on: list[str], ident: str, objectives: list[str], k: int) -> DataFrame:
    """on, src, dst: src k-dominates dst."""
    live = complete(df, objectives)
    q = live.select(*on, F.col(ident).alias("src"), *objectives).alias("q")
    p = live.select(*on, F.col(ident).alias("dst"), *objectives).alias("p")
    joined = q.join(p, both([*(F.col(f"p.{c}") == F.col(f"q.{c}") for c in on), F.col("src") != F.col("dst"), k_beats("p", "q", objectives, k)]))
    return joined.select(*[F.col(f"q.{c}").alias(c) for c in on], "src", "dst")


def cycles(edges: DataFrame, on: list[str]) -> DataFrame:
    """on, cycle (smallest member), member: strongly connected components of more than one node.

    Forward and backward reach: what lies on no cycle is trimmed; each node takes the least node that reaches it, along
    links; those of a colour that reach the node it is named after are its component.  Components are taken out and the rest
    is coloured anew.  All of it is joins over links and nodes, keyed by comparison, so that no task holds a graph;
    graphs of at most CYCLE_NODES nodes are closed as matrices, one a task.
    """
    links = rewritten(edges.filter("src <> dst").select(*on, "src", "dst").distinct())
    nodes = links.select(*on, F.col("src").alias("v")).union(links.select(*on, F.col("dst").alias("v"))).distinct()
    if (nodes.groupBy(*on).count().agg(F.max("count")).first()[0] or 0) <= CYCLE_NODES:
        return _closed(links, on)
    kind = links.schema["src"].dataType.simpleString()
    found = None
    while True:
        links = _trimmed(links, on)
        if not links.limit(1).count():
            break
        colour = _coloured(links, on)
        ends = [F.col(f"a.{c}").eqNullSafe(F.col(f"l.{c}")) for c in on]
        of = links.alias("l").join(colour.alias("a"), both([*ends, F.col("a.v") == F.col("l.src")])).select("l.*", F.col("a.colour").alias("_src"))
        of = of.alias("l").join(colour.alias("a"), both([*ends, F.col("a.v") == F.col("l.dst")])).select("l.*", F.col("a.colour").alias("_dst"))
        inner = rewritten(of.filter("_src = _dst").select(*on, "src", "dst", F.col("_src").alias("colour")))
        reached = rewritten(colour.filter("v = colour"))
        edge = reached
        while edge.limit(1).count():
            back = inner.alias("l").join(edge.alias("a"), both([*ends, F.col("a.v") == F.col("l.dst")])).select(*[F.col(f"l.{c}").alias(c) for c in on], F.col("l.src").alias("v"), "l.colour").distinct()
            edge = rewritten(back.alias("n").join(reached.alias("r"), both([*(F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on), F.col("n.v") == F.col("r.v")]), "left_anti"))
            reached = rewritten(reached.unionByName(edge))
        several = reached.groupBy(*on, "colour").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        same = both([*(F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in on), F.col("r.colour") == F.col("s.colour")])
        part = rewritten(reached.alias("r").join(several.alias("s"), same, "left_semi").select(*on, F.col("colour").alias("cycle"), F.col("v").alias("member")))
        found = part if found is None else rewritten(found.unionByName(part))
        for end in ("src", "dst"):
            gone = both([*(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on), F.col(f"l.{end}") == F.col("r.v")])
            links = links.alias("l").join(reached.alias("r"), gone, "left_anti")
        links = rewritten(links)
    if found is None:
        return links.select(*on, F.lit(None).cast(kind).alias("cycle"), F.lit(None).cast(kind).alias("member")).filter("false")
    return found


def _trimmed(links: DataFrame, on: list[str]) -> DataFrame:
    """Links between nodes that are entered and left: the rest is on no cycle."""
    n = links.count()
    while n:
        def ends(end: str) -> DataFrame:
            return links.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(end).alias("_v")).distinct()

        def meets(end: str) -> Column:
            return both([*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on), F.col(end) == F.col("_v")])

        less = rewritten(links.join(ends("dst"), meets("src"), "left_semi").join(ends("src"), meets("dst"), "left_semi"))
        m = less.count()
        if m == n:
            break
        links, n = less, m
    return links


def _coloured(links: DataFrame, on: list[str]) -> DataFrame:
    """on, v, colour: the least node from which v is reached, itself included."""
    nodes = links.select(*on, F.col("src").alias("v")).distinct()  # trimmed: every node is left
    colour = rewritten(nodes.withColumn("colour", F.col("v")))
    moved = colour
    while moved.limit(1).count():
        step = links.alias("l").join(moved.alias("m"), both([*(F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in on), F.col("l.src") == F.col("m.v")]))
        least = step.groupBy(*[F.col(f"l.{c}").alias(c) for c in on], F.col("l.dst").alias("v")).agg(F.min("m.colour").alias("_new"))
        same = both([*(F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}")) for c in on), F.col("c.v") == F.col("n.v")])
        both_ = rewritten(colour.alias("c").join(least.alias("n"), same, "left").select("c.*", (F.coalesce("n._new", "c.colour") < F.col("c.colour")).alias("_moved"), F.least("c.colour", "n._new").alias("_least")))
        colour = both_.select(*on, "v", F.col("_least").alias("colour"))
        moved = both_.filter("_moved").select(*on, "v", F.col("_least").alias("colour"))
    return colour


def _closed(links: DataFrame, on: list[str]) -> DataFrame:
    """`cycles` of graphs of bounded size, by squaring their matrices."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["src"]) | set(rows["dst"]))
        at = {x: i for i, x in enumerate(names)}
        reach = np.zeros((len(names), len(names)), bool)
        reach[[at[x] for x in rows["src"]], [at[x] for x in rows["dst"]]] = True
        while True:  # paths twice as long each time
            more = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
            if (more == reach).all():
                break
            reach = more
        mutual = reach & reach.T
        out = [(names[int(np.flatnonzero(mutual[i])[0])], x) for i, x in enumerate(names) if mutual[i].any()]
        got = pd.DataFrame(out, columns=["cycle", "member"])
        for c in on:
            got[c] = rows[c].iloc[0]
        return got[[*on, "cycle", "member"]]

    fields = {f.name: f.dataType.simpleString() for f in links.schema}
    return links.groupBy(*on).applyInPandas(run, ", ".join([*(f"`{c}` {fields[c]}" for c in on), f"cycle {fields['src']}, member {fields['src']}"]))


def skyline_frequency(df: DataFrame, on: list[str], ident: list[str], objectives: list[str]) -> DataFrame:
    """on, ident, frequency: in how many of the 2^d - 1 subspaces the row is on the front."""
    masks = F.explode(F.sequence(F.lit(1), F.lit(2 ** len(objectives) - 1)))
    live = complete(df, objectives).select(*on, *ident, *objectives, masks.alias("_mask"))
    used = [F.col("p._mask").bitwiseAND(F.lit(1 << j)) != 0 for j in range(len(objectives))]
    no_worse = both(~u | (F.col(f"q.{c}") <= F.col(f"p.{c}")) for u, c in zip(used, objectives))
    better = either(u & (F.col(f"q.{c}") < F.col(f"p.{c}")) for u, c in zip(used, objectives))
    keys = [*on, "_mask"]
    best = live.alias("p").join(live.select(*keys, *objectives).alias("q"), both([*(F.col(f"p.{c}") == F.col(f"q.{c}") for c in keys), no_worse, better]), "left_anti")
    count = best.groupBy(*on, *ident).agg(F.count("*").alias("frequency"))
    return complete(df, objectives).select(*on, *ident).join(count, [*on, *ident], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)).cast("long"))


def distance_to_ideal(df: DataFrame, on: list[str], ident: list[str], objectives: list[str]) -> DataFrame:
    """on, ident, l1, l2, linf from the best value of each objective in the comparison."""
    w = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    gaps = [F.col(c) - F.min(c).over(w) for c in objectives]
    live = complete(df, objectives).select(*on, *ident, *[g.alias(f"_g{i}") for i, g in enumerate(gaps)])
    g = [F.col(f"_g{i}") for i in range(len(objectives))]
    return live.select(*on, *ident, sum(g[1:], g[0]).alias("l1"), F.sqrt(sum((x * x for x in g[1:]), g[0] * g[0])).alias("l2"), (F.greatest(*g) if len(g) > 1 else g[0]).alias("linf"))


def _field(points: str, name: str) -> Column:
    return F.transform(points, lambda x: x.getField(name))


def hypervolume(df: DataFrame, on: list[str], objectives: list[str], reference: float = HV_REFERENCE, seed: int = 1) -> DataFrame:
    """on, hypervolume, points, method: volume that the front dominates, up to the reference on every axis.

    Inclusion-exclusion over subsets of at most HV_EXACT_POINTS points; above that, HV_SAMPLES hashed draws.
    """
    inside = both(F.col(c) < reference for c in objectives)
    points = front(df, on, objectives).filter(inside).dropDuplicates([*on, *objectives])
    everything = df.select(*on).distinct()
    boxes = points.groupBy(*on).agg(F.collect_list(F.struct(*objectives)).alias("_p"), F.count("*").alias("points"))
    exact = boxes.filter(F.col("points") <= HV_EXACT_POINTS)
    exact = exact.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2.0), "points").cast("int") - 1)))
    chosen = F.filter(F.col("_p"), lambda x, i: F.pmod(F.floor(F.col("_mask") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1)
    exact = exact.withColumn("_c", chosen)
    volume = reduce(lambda a, b: a * b, [F.lit(reference) - F.array_max(_field("_c", c)) for c in objectives])
    signed = F.when(F.size("_c") % 2 == 1, volume).otherwise(-volume)
    exact = exact.groupBy(*on, "points").agg(F.sum(signed).alias("hypervolume"), F.lit("exact").alias("method"))
    low = [F.array_min(_field("_p", c)) for c in objectives]
    draws = boxes.filter(F.col("points") > HV_EXACT_POINTS).withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(HV_SAMPLES))))
    uniform = lambda j: (F.pmod(F.xxhash64("_s", F.lit(j), F.lit(seed)), F.lit(2**31)) + 0.5) / 2.0**31
    draws = draws.withColumns({f"_x{j}": lo + uniform(j) * (F.lit(reference) - lo) for j, lo in enumerate(low)})
    hit = F.exists("_p", lambda x: both(x.getField(c) <= F.col(f"_x{j}") for j, c in enumerate(objectives)))
    box = reduce(lambda a, b: a * b, [F.lit(reference) - lo for lo in low])
    sampled = draws.groupBy(*on, "points").agg((F.avg(hit.cast("double")) * F.first(box)).alias("hypervolume"), F.lit("sampled").alias("method"))
    found = exact.select(*on, "hypervolume", "points", "method").unionByName(sampled.select(*on, "hypervolume", "points", "method"))
    if not on:
        return found
    out = everything.join(found, on, "left")
    return out.select(*on, F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"), F.coalesce("points", F.lit(0)).cast("long").alias("points"), F.coalesce("method", F.lit("exact")).alias("method"))


def weighted(df: DataFrame, on: list[str], ident: list[str], objectives: list[str], ranks: list[str], weights: list[float] | None = None) -> DataFrame:
    """on, ident, weighted_sum (null if incomplete), average_rank (over the ranks there are)."""
    weights = weights or [1.0 / len(objectives)] * len(objectives)
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(objectives, weights)])
    known = sum((F.col(r).isNotNull().cast("int") for r in ranks), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(F.col(r), F.lit(0.0)) for r in ranks), F.lit(0.0)), known.cast("double"))
    return df.select(*on, *ident, total.alias("weighted_sum"), mean.alias("average_rank"))


def knee_2d(df: DataFrame, on: list[str], ident: list[str], x: str, y: str) -> DataFrame:
    """on, ident, bend: angle at each point of a front of two objectives, 0 at its ends; fronts of three and more."""
    best = front(df, on, [x, y])
    w = Window.partitionBy(*on).orderBy(x, *ident)
    size = F.count("*").over(Window.partitionBy(*on))
    ax, ay = F.lag(x).over(w) - F.col(x), F.lag(y).over(w) - F.col(y)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    best = best.select(*on, *ident, ax.alias("_ax"), ay.alias("_ay"), bx.alias("_bx"), by.alias("_by"), size.alias("_n")).filter("_n >= 3")
    norm = F.sqrt(F.expr("_ax * _ax + _ay * _ay")) * F.sqrt(F.expr("_bx * _bx + _by * _by"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("_ax * _bx + _ay * _by") / F.nullif(norm, F.lit(0.0))))
    return best.select(*on, *ident, F.when(norm > 0, F.lit(np.pi) - F.acos(cosine)).otherwise(0.0).alias("bend"))


def staircase(df: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    """on, x, least: the least y of points at or before each x, the boundary of what two objectives attain."""
    live = complete(df, [x, y]).groupBy(*on, F.col(x).alias("x")).agg(F.min(y).alias("_y"))
    w = Window.partitionBy(*on).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return live.select(*on, "x", F.min("_y").over(w).alias("least"))


def knee_plane(df: DataFrame, on: list[str], ident: str, objectives: list[str]) -> DataFrame:
    """on, ident, score, method: distance from the plane through the front's extreme points (three and more objectives)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ident, kind="stable")
        x = rows[objectives].to_numpy(float)
        ends = list(dict.fromkeys(int(x[:, j].argmin()) for j in range(x.shape[1])))
        score, method = -np.sqrt((x**2).sum(1)), "distance to ideal"
        if len(ends) == x.shape[1] and abs(np.linalg.det(x[ends])) > 1e-12:
            plane = np.linalg.solve(x[ends], np.ones(len(ends)))
            score, method = np.abs(x @ plane - 1) / np.sqrt((plane**2).sum()), "hyperplane"
        out = rows[[*on, ident]].assign(score=score, method=method)
        return out if len(rows) >= 3 else out.iloc[:0]

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    best = front(df, on, objectives).select(*on, ident, *objectives)
    return best.groupBy(*on).applyInPandas(run, ", ".join([*(f"`{c}` {fields[c]}" for c in [*on, ident]), "score double", "method string"]))


def delta_subsets(df: DataFrame, on: list[str], objectives: list[str]) -> DataFrame:
    """on, mask, size, delta: the most that a row which the subset ranks above another is worse on any objective."""
    live = complete(df, objectives).withColumn("_id", F.monotonically_increasing_id())
    a, b = live.alias("a"), live.alias("b")
    gap = F.greatest(*[F.col(f"a.{c}") - F.col(f"b.{c}") for c in objectives])
    pairs = a.join(b, both([*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in on), F.col("a._id") != F.col("b._id")]) if on else F.col("a._id") != F.col("b._id"))
    pairs = pairs.select(*[F.col(f"a.{c}").alias(c) for c in on], gap.alias("_gap"), *[(F.col(f"a.{c}") <= F.col(f"b.{c}")).alias(f"_le{j}") for j, c in enumerate(objectives)], *[(F.col(f"a.{c}") < F.col(f"b.{c}")).alias(f"_lt{j}") for j, c in enumerate(objectives)])
    pairs = pairs.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(2 ** len(objectives) - 1))))
    used = [F.col("mask").bitwiseAND(F.lit(1 << j)) != 0 for j in range(len(objectives))]
    ranks = both(~u | F.col(f"_le{j}") for j, u in enumerate(used)) & either(u & F.col(f"_lt{j}") for j, u in enumerate(used))
    return pairs.groupBy(*on, "mask").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(ranks, F.col("_gap"))), F.lit(0.0))).alias("delta")).withColumn("size", F.bit_count("mask"))


def moss_ladders(subsets: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """on, size, added, mask, delta, smallest_exact: the ladder of each comparison from its delta_subsets.

    A comparison is a row, the mask it has reached; each round it takes the larger mask of least delta, the objective
    named first on ties.  The smallest exact rung is the first whose delta is 0, to 1e-9.
    """
    bits = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(1 << j).alias("bit"), F.lit(n).alias("added")) for j, n in enumerate(names)]))
    at, rungs = subsets.select(*on).distinct().withColumn("mask", F.lit(0)), []
    of = subsets.select(*on, F.col("mask").alias("to"), "delta")
    for size in range(1, len(names) + 1):
        more = at.select(*on, "mask", bits.alias("_b")).filter(F.col("mask").bitwiseAND(F.col("_b.bit")) == 0)
        more = more.select(*on, F.col("_b.j").alias("j"), F.col("_b.added").alias("added"), F.col("mask").bitwiseOR(F.col("_b.bit")).alias("to")).join(of, [*on, "to"])
        best = more.groupBy(*on).agg(F.min_by(F.struct("added", "to", "delta"), F.struct("delta", "j")).alias("_r"))
        rung = best.select(*on, F.lit(size).alias("size"), "_r.added", F.col("_r.to").cast("long").alias("mask"), "_r.delta")
        rungs.append(rung)
        at = best.select(*on, F.col("_r.to").alias("mask"))
    ladder = reduce(DataFrame.unionByName, rungs)
    first = F.min(F.when(F.col("delta") <= 1e-9, F.col("size"))).over(Window.partitionBy(*on))  # a row an objective
    return ladder.withColumn("smallest_exact", F.coalesce(F.col("size") == first, F.lit(False)))


def moss_ladder(subsets: list[dict], names: list[str]) -> dict:
    """Greedy order of objectives, each step the one with the least delta; at most 255 subsets come from the cluster."""
    delta = {r["mask"]: r["delta"] for r in subsets}
    rungs, mask, left = [], 0, list(range(len(names)))
    while left:
        best = min(left, key=lambda j: delta.get(mask | 1 << j, 0.0))
        mask |= 1 << best
        left.remove(best)
        rungs.append({"size": len(names) - len(left), "subset": [*(rungs[-1]["subset"] if rungs else []), names[best]], "delta": delta.get(mask, 0.0)})
    return {"ladder": rungs, "smallest_exact_subset": next((r["subset"] for r in rungs if r["delta"] <= 1e-9), None)}
