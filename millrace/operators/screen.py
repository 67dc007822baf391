"""Which objectives conflict: Kendall's tau-b over cells, axis order, clusters; and the null model of a front's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CONFLICTING_TAU, NULL_BAND, REDUNDANT_TAU, SEED
from ..functions.rng import draw
from ..session import cut
from .dominance import complete, front


def kendall(df: DataFrame, on: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """on, n, tau over the rows where both are known; null for fewer than three rows or without untied pairs."""
    live = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*on, F.struct(*order).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    a, b = live.alias("a"), live.alias("b")
    cond = F.col("a._i") < F.col("b._i")
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    dx, dy = F.col("a._x") - F.col("b._x"), F.col("a._y") - F.col("b._y")
    pairs = a.join(b, cond).select(*[F.col(f"a.{c}").alias(c) for c in on], F.signum(dx).alias("_dx"), F.signum(dy).alias("_dy"))
    s = F.col("_dx") * F.col("_dy")
    sums = pairs.groupBy(*on).agg(F.count("*").alias("_pairs"), F.sum(s).alias("_s"), F.count_if((F.col("_dx") != 0)).alias("_nx"), F.count_if(F.col("_dy") != 0).alias("_ny"))
    n = F.round((1 + F.sqrt(1 + 8 * F.col("_pairs"))) / 2).cast("long")
    norm = F.sqrt(F.col("_nx").cast("double") * F.col("_ny").cast("double"))
    return sums.select(*on, n.alias("n"), F.when((n >= 3) & (norm > 0), F.col("_s") / F.nullif(norm, F.lit(0.0))).alias("tau"))


def long_series(cells: DataFrame, ident: list[str], series: dict[str, Column]) -> DataFrame:
    """ident, series, value: wide columns to rows, nulls kept."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), c.cast("double").alias("value")) for n, c in series.items()]))
    return cells.select(*ident, rows.alias("_r")).select(*ident, "_r.series", "_r.value")


def conflict_screen(cells: DataFrame, ident: list[str], left: dict[str, Column], right: dict[str, Column]) -> DataFrame:
    """a, b, n, tau for each series of `left` against each of `right`, in one job."""
    a = long_series(cells, ident, left).withColumnsRenamed({"series": "a", "value": "x"})
    b = long_series(cells, ident, right).withColumnsRenamed({"series": "b", "value": "y"})
    return kendall(a.join(b, ident), ["a", "b"], ident, "x", "y")


def verdict(tau: Column) -> Column:
    return F.when(tau.isNull(), None).when(F.abs(tau) >= REDUNDANT_TAU, "redundant").when(tau <= CONFLICTING_TAU, "conflicting").otherwise("independent")


def screen_within(cells: DataFrame, on: list[str], ident: list[str], series: dict[str, Column]) -> DataFrame:
    """on, a, b, tau for each two series (a before b in the given order) over the rows of each comparison, in one job."""
    place = F.array_position(F.array(*[F.lit(n) for n in series]), F.col("series"))
    rows = long_series(cells, [*on, *ident], series).withColumn("_p", place)
    a = rows.withColumnsRenamed({"series": "a", "value": "x", "_p": "_pa"})
    b = rows.withColumnsRenamed({"series": "b", "value": "y", "_p": "_pb"})
    pairs = a.join(b, [*on, *ident]).filter("_pa < _pb")
    return kendall(pairs, [*on, "a", "b"], ident, "x", "y").drop("n")


def _both_ways(taus: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """on, i, j, tau with the places of the names, both ways round."""
    place = lambda c: (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1).cast("int")
    one = taus.filter("tau IS NOT NULL").select(*on, place("a").alias("i"), place("b").alias("j"), "tau").filter("i >= 0 AND j >= 0 AND i <> j")
    return one.union(one.select(*on, F.col("j").alias("i"), F.col("i").alias("j"), "tau"))


def axis_orders(taus: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """on, position, axis: a chain from the most conflicting pair of each comparison, each time on to the axis that conflicts most
    with its end; an unknown tau counts as 1, ties go to the axis named first.  Without any tau, or with fewer than three axes, the order is as given.

    A comparison is a row - the axes it has as a mask, and its end - that grows by an axis a round, at most 8.
    """
    links = cut(_both_ways(taus, on, names))
    start = links.filter("i < j").groupBy(*on).agg(F.min_by(F.struct("i", "j"), F.struct("tau", "i", "j")).alias("p"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1), c)
    chain = start.select(*on, F.array("p.i", "p.j").alias("order"), bit(F.col("p.i")).bitwiseOR(bit(F.col("p.j"))).alias("mask"))
    every = F.array(*[F.lit(k) for k in range(len(names))])
    for _ in range(len(names) - 2):
        left = chain.withColumn("j", F.explode(F.filter(every, lambda k: ~F.array_contains("order", k))))
        left = left.withColumn("i", F.element_at("order", -1)).join(links, [*on, "i", "j"], "left")
        best = left.groupBy(*on, "order").agg(F.min_by("j", F.struct(F.coalesce("tau", F.lit(1.0)), "j")).alias("j"))
        chain = best.select(*on, F.concat("order", F.array("j")).alias("order"))
    if len(names) < 3:
        chain = chain.filter("false").select(*on, "order")
    plain = taus.select(*on).distinct().join(chain.select(*on, "order"), on, "left").select(*on, F.coalesce("order", every).alias("order"))
    named = F.transform("order", lambda k: F.element_at(F.array(*[F.lit(n) for n in names]), k + 1))
    return plain.select(*on, F.posexplode(named).alias("position", "axis"))


def reductions(taus: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """on, objective, representative, kept: single linkage of objectives by |tau| of REDUNDANT_TAU and more, the first by name kept.

    An objective's cluster is a mask; it takes in the masks of those it holds, so that chains twice as long are closed a round.
    """
    order = sorted(names)
    bits = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(n).alias("objective")) for k, n in enumerate(order)]))
    own = taus.select(*on).distinct().select(*on, bits.alias("_b")).select(*on, "_b.i", "_b.objective")
    links = _both_ways(taus, on, order).filter(F.abs("tau") >= REDUNDANT_TAU)
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.col(c))
    near = links.groupBy(*on, "i").agg(F.bit_or(bit("j")).alias("near"))
    held = cut(own.join(near, [*on, "i"], "left").select(*on, "i", "objective", bit("i").bitwiseOR(F.coalesce("near", F.lit(0))).alias("mask")))
    for _ in range(max(1, (len(names) - 1).bit_length())):
        other = held.select(*on, F.col("i").alias("_i"), F.col("mask").alias("_mask"))
        joined = held.join(other, on).filter(F.col("mask").bitwiseAND(bit("_i")) != 0)
        held = joined.groupBy(*on, "i", "objective").agg(F.bit_or("_mask").alias("mask"))
    first = F.log2(F.col("mask").bitwiseAND(-F.col("mask")).cast("double")).cast("int")
    named = F.element_at(F.array(*[F.lit(n) for n in order]), first + 1)
    return held.select(*on, "objective", named.alias("representative"), (named == F.col("objective")).alias("kept"))


def axis_order(names: list[str], taus: dict[tuple[str, str], float | None]) -> list[str]:
    """A chain from the most conflicting pair, each time on to the axis that conflicts most with its end (at most 8 axes)."""
    of = lambda a, b: taus.get((a, b), taus.get((b, a)))
    known = [(of(a, b), a, b) for i, a in enumerate(names) for b in names[i + 1 :] if of(a, b) is not None]
    if len(names) < 3 or not known:
        return list(names)
    _, a, b = min(known, key=lambda t: t[0])
    chain, left = [a, b], [n for n in names if n not in (a, b)]
    while left:
        nxt = min(left, key=lambda n: 1.0 if of(chain[-1], n) is None else of(chain[-1], n))
        chain.append(nxt)
        left.remove(nxt)
    return chain


def reduction(names: list[str], taus: dict[tuple[str, str], float | None]) -> dict:
    """Clusters of objectives linked by |tau| of REDUNDANT_TAU and more, the first by name kept of each."""
    group = {n: {n} for n in names}
    for (a, b), t in taus.items():
        if t is not None and abs(t) >= REDUNDANT_TAU and a in group and b in group and group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    clusters = [sorted(g) for g in {id(g): g for g in group.values()}.values()]
    kept = sorted(c[0] for c in clusters)
    return {"clusters": clusters, "kept": kept, "dropped": sorted(set(names) - set(kept))}


def expected_maxima(n: int, d: int) -> float:
    """Expected maxima of n independent points: A(n, d) = A(n-1, d) + A(n, d-1) / n, and 1 at either edge."""
    if n < 1 or d < 1:
        return 0.0
    row = [1.0] * n
    for _ in range(d - 1):
        total, nxt = 0.0, []
        for i, a in enumerate(row, 1):
            total += a / i
            nxt.append(total)
        row = nxt
    return row[-1]


def expected_maxima_table(spark, n: int, d: int) -> DataFrame:
    """n, d, a for all sizes up to (n, d): nested running sums."""
    base = spark.range(1, n + 1).select(F.col("id").alias("n"), F.lit(1.0).alias("a"))
    out, level = [base.withColumn("d", F.lit(1).cast("long"))], base
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # n rows, a parameter
    for k in range(2, d + 1):
        level = level.withColumn("a", F.sum(F.col("a") / F.col("n")).over(w))
        out.append(level.withColumn("d", F.lit(k).cast("long")))
    table = out[0]
    for x in out[1:]:
        table = table.unionByName(x)
    return table.select("n", "d", "a")


def permuted_fronts(df: DataFrame, on: list[str], ident: list[str], objectives: list[str], replicates: int, seed: int = SEED) -> DataFrame:
    """on, rep, size: front sizes after shuffling each objective by itself; rep 0 is the observed front."""
    live = complete(df, objectives)
    no = F.dense_rank().over(Window.orderBy(*on)) if on else F.lit(1)
    rows = live.select(*on, *ident, *objectives, F.row_number().over(Window.partitionBy(*on).orderBy(*ident)).alias("_i"))
    names = rows.select(*on).distinct().withColumn("_no", no)  # as many rows as comparisons
    rows = rows.join(F.broadcast(names), on)
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    long = reps.select(*on, "rep", "_no", "_i", F.posexplode(F.array(*objectives)).alias("_j", "_v"))
    order = Window.partitionBy(*on, "rep", "_j").orderBy(draw(F.col("rep"), F.col("_no") * 8 + F.col("_j"), F.col("_i"), seed), "_i")
    dealt = long.withColumn("_at", F.row_number().over(order)).groupBy(*on, "rep", "_at").agg(*[F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(c) for j, c in enumerate(objectives)])
    every = dealt.select(*on, "rep", *objectives).unionByName(rows.select(*on, F.lit(0).alias("rep"), *objectives))
    return front(every, [*on, "rep"], objectives).groupBy(*on, "rep").agg(F.count("*").alias("size"))


def null_model(sizes: DataFrame, on: list[str], n_cells: DataFrame, n_objectives: int) -> DataFrame:
    """on, observed, mean, p05, p95, percentile, verdict, closed_form of front sizes by replicate."""
    seen = sizes.filter("rep = 0").select(*on, F.col("size").alias("observed"))
    reps = sizes.filter("rep > 0").join(seen, on)
    sorted_sizes = F.array_sort(F.collect_list("size"))
    at = lambda q: F.element_at(F.col("_s"), (F.floor(F.lit(q) * (F.size("_s") - 1)) + 1).cast("int"))
    out = reps.groupBy(*on, "observed").agg(F.avg("size").alias("mean"), sorted_sizes.alias("_s"), ((F.count_if(F.col("size") < F.col("observed")) + 0.5 * F.count_if(F.col("size") == F.col("observed"))) / F.count("*")).alias("percentile"))
    p = F.col("percentile")
    closed = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n_objectives - 1))), F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda _: F.lit(1.0)), _running, lambda a: F.element_at(a, -1))
    if n_objectives < 2:
        closed = F.lit(1.0)
    out = out.join(n_cells, on).filter("n >= 3")
    return out.select(*on, "n", "observed", "mean", at(0.05).alias("p05"), at(0.95).alias("p95"), "percentile", F.when(p > NULL_BAND[1], "CONFLICTING").when(p < NULL_BAND[0], "AGREEING").otherwise("NOT INFORMATIVE").alias("verdict"), closed.alias("closed_form"))


def _running(a: Column, _: Column) -> Column:
    """Running sums of a(i) / i: one more dimension of the recurrence."""
    step = F.transform(a, lambda x, i: x / (i + 1))
    return F.transform(step, lambda x, i: F.aggregate(F.slice(step, F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + y))
