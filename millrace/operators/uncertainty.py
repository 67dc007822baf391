"""Replicates of the cell matrix, and what they say: P(on front), dominance rates, epsilon, attainment bands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ATTAINMENT_GRID, SEED, UTILITY_SAMPLES
from ..functions.formula import Plan
from ..functions.metrics import Metric
from ..functions.rng import gaussian, uniform
from ..session import cut
from . import resample
from .cells import KEYS, evaluate, metric_values
from .dominance import beats, both, complete, front


def to_reference(value: Column, lo: Column, hi: Column) -> Column:
    """Scaled by the observed range; a constant range keeps differences, around 0.5."""
    return F.when(hi == lo, 0.5 + (value - lo) / F.greatest(F.lit(1.0), F.abs(lo))).otherwise((value - lo) / F.nullif(hi - lo, F.lit(0.0)))


def bootstrap(builds: DataFrame, objectives: Iterable[Metric], replicates: int, seed: int = SEED) -> DataFrame:
    """rep, grp, win and each objective, scaled: builds drawn with replacement inside each cell, as many as it has.

    Parameters of formula normalisers and of the chart scale stay at their observed values.  Draws are counts that weigh
    builds (see `resample`); no build is written out once for each replicate.
    """
    objectives = list(objectives)
    frozen: dict = {}
    observed = cut(evaluate(builds, objectives, KEYS, scales=frozen))
    signed = {m.name: F.col(m.name) * m.sign for m in objectives}
    bounds = observed.agg(*[f(c).alias(f"{k}_{n}") for n, c in signed.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    plans = [Plan(m.formula, f"_m{i}_") for i, m in enumerate(objectives)]
    values = metric_values(resample.replicate_terms(builds, plans, KEYS, replicates, seed), objectives, plans, frozen=frozen)
    return values.select("rep", *KEYS, *[to_reference(c, F.lit(bounds[f"lo_{n}"]).cast("double"), F.lit(bounds[f"hi_{n}"]).cast("double")).alias(n) for n, c in signed.items()])


def parametric(cells: DataFrame, names: list[str], replicates: int, seed: int = SEED) -> DataFrame:
    """rep, grp, win and each objective, scaled: normal draws from `<name>` and `<name>_se`, within the range and three errors."""
    bounds = cells.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    rows = cells.withColumn("_cell", F.row_number().over(Window.orderBy(*KEYS)))  # a row a cell
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    out = []
    for j, n in enumerate(names):
        point, se, lo, hi = F.col(n), F.col(f"{n}_se"), F.col(f"lo_{n}"), F.col(f"hi_{n}")
        raw = point + se * gaussian(F.col("rep"), F.col("_cell"), F.lit(j), seed)
        value = F.when(se == 0, point).when(se.isNotNull() & point.isNotNull(), F.greatest(lo - 3 * se, F.least(hi + 3 * se, raw)))
        out.append(to_reference(value, lo, hi).alias(n))
    return rows.select("rep", *KEYS, *out)


def p_on_front(replicates: DataFrame, on: list[str], ident: list[str], objectives: list[str]) -> DataFrame:
    """on, ident, usable, wins, p_on_front over the replicates in which the cell is complete."""
    live = complete(replicates, objectives)
    wins = front(live, [*on, "rep"], objectives).groupBy(*on, *ident).agg(F.count("*").alias("wins"))
    usable = replicates.groupBy(*on, *ident).agg(F.count_if(both(F.col(c).isNotNull() for c in objectives)).alias("usable"))
    out = usable.join(wins, [*on, *ident], "left").withColumn("wins", F.coalesce("wins", F.lit(0)).cast("long"))
    return out.withColumn("p_on_front", F.try_divide("wins", "usable"))


def dominance_rates(replicates: DataFrame, on: list[str], ident: str, objectives: list[str]) -> DataFrame:
    """on, a, b, comparable, rate: how often a dominates b, replicate by replicate."""
    live = complete(replicates, objectives)
    keys = [*on, "rep"]
    q, p = live.alias("q"), live.alias("p")
    pairs = q.join(p, both([*(F.col(f"q.{k}") == F.col(f"p.{k}") for k in keys), F.col(f"q.{ident}") != F.col(f"p.{ident}")]))
    pairs = pairs.select(*[F.col(f"q.{k}").alias(k) for k in on], F.col(f"q.{ident}").alias("a"), F.col(f"p.{ident}").alias("b"), beats("p", "q", objectives).cast("double").alias("_won"))
    return pairs.groupBy(*on, "a", "b").agg(F.count("*").alias("comparable"), F.avg("_won").alias("rate"))


def epsilons(replicates: DataFrame, on: list[str], ident: list[str], objectives: list[str]) -> DataFrame:
    """on and, for each objective, the median over cells (of ten draws and more) of half the 95 % interval."""
    live = complete(replicates, objectives)
    drawn = live.groupBy(*on, *ident).agg(F.count("*").alias("_n"), *[F.array_sort(F.collect_list(c)).alias(c) for c in objectives]).filter("_n >= 10")
    at = lambda c, q: F.element_at(F.col(c), (F.floor(F.lit(q) * (F.col("_n") - 1)) + 1).cast("int"))
    half = drawn.select(*on, *[((at(c, 0.975) - at(c, 0.025)) / 2).alias(c) for c in objectives])
    return half.groupBy(*on).agg(*[F.greatest(F.lit(1e-9), F.percentile(c, 0.5)).alias(c) for c in objectives])


def attainment(replicates: DataFrame, on: list[str], x: str, y: str, grid: int = ATTAINMENT_GRID) -> DataFrame:
    """on, x, p10, p50, p90: quantiles over replicates of the least y at no more than x; null where not attained."""
    points = replicates.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*on, "rep", F.col(x).alias("_x"), F.col(y).alias("_y"))
    xs = points.select(*on, "_x").distinct()
    every = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))
    xs = xs.withColumn("_i", F.row_number().over(every.orderBy("_x")) - 1).withColumn("_n", F.count("*").over(every))
    places = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.least(F.col("_n") - 1, F.floor(i * (F.col("_n") / grid))))
    xs = xs.filter((F.col("_n") <= grid) | F.array_contains(places, F.col("_i"))).select(*on, F.col("_x").alias("x"))
    reps = replicates.select(*on, "rep").distinct()
    wide = (reps.join(xs, on) if on else reps.crossJoin(F.broadcast(xs))).alias("g")  # at most `grid` rows a comparison
    cond = both([*(F.col(f"g.{k}") == F.col(f"p.{k}") for k in on), F.col("g.rep") == F.col("p.rep"), F.col("p._x") <= F.col("g.x")])
    best = wide.join(points.alias("p"), cond, "left").groupBy(*[F.col(f"g.{k}").alias(k) for k in on], F.col("g.rep").alias("rep"), F.col("g.x").alias("x")).agg(F.coalesce(F.min("p._y"), F.lit(float("inf"))).alias("_least"))
    sorted_ = best.groupBy(*on, "x").agg(F.array_sort(F.collect_list("_least")).alias("_s"))
    at = lambda q: F.element_at("_s", F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size("_s"))).cast("int"))
    known = lambda c: F.when(c != float("inf"), c)
    return sorted_.select(*on, "x", known(at(0.1)).alias("p10"), known(at(0.5)).alias("p50"), known(at(0.9)).alias("p90"))


def marginal_utility(df: DataFrame, on: list[str], ident: list[str], objectives: list[str], samples: int = UTILITY_SAMPLES, seed: int = SEED) -> DataFrame:
    """on, ident, wins: share of sampled weight vectors (uniform on the simplex) under which the front member is best."""
    best = front(df, on, objectives)
    size = F.count("*").over(Window.partitionBy(*on)) if on else F.count("*").over(Window.partitionBy(F.lit(0)))
    best = best.withColumn("_n", size).filter("_n >= 3").select(*on, *ident, *objectives)
    draws = best.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    parts = [-F.ln(uniform(F.col("_s"), F.lit(j), F.lit(0), seed)) for j in range(len(objectives))]
    score = sum((w * F.col(c) for w, c in zip(parts[1:], objectives[1:])), parts[0] * F.col(objectives[0]))
    won = draws.withColumn("_score", score).groupBy(*on, "_s").agg(F.min_by(F.struct(*ident), F.struct("_score", *ident)).alias("_w"))
    wins = won.groupBy(*on, *[F.col(f"_w.{c}").alias(c) for c in ident]).agg(F.count("*").alias("_c"))
    return best.select(*on, *ident).join(wins, [*on, *ident], "left").select(*on, *ident, (F.coalesce("_c", F.lit(0)) / samples).alias("utility"))
