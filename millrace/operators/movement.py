"""What changes from window to window: travel of a group, movement of its mix, persistence on the front."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ANGLES, FALLBACK_DIVERGENCE, IMPACT_CLASSES
from .dominance import both

def by_time():
    """Windows of a group in order; labels sort by time."""
    return Window.partitionBy("grp").orderBy("win")


def _add(a: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, a)


def travel(cells: DataFrame, objectives: list[str]) -> DataFrame:
    """grp, from_win, to_win, available, magnitude, angle (degrees to the ideal), reading.

    `objectives` are scaled columns; the ideal is 0 on each.
    """
    before = [F.lag(c).over(by_time()) for c in objectives]
    rows = cells.select("grp", F.lag("win").over(by_time()).alias("from_win"), F.col("win").alias("to_win"), *[b.alias(f"_a{i}") for i, b in enumerate(before)], *[F.col(c).alias(f"_b{i}") for i, c in enumerate(objectives)]).filter("from_win IS NOT NULL")
    n = range(len(objectives))
    known = both(F.col(f"_{k}{i}").isNotNull() for k in "ab" for i in n)
    step = [F.col(f"_b{i}") - F.col(f"_a{i}") for i in n]
    size = F.sqrt(_add([s * s for s in step]))
    to_ideal = F.sqrt(_add([F.col(f"_a{i}") * F.col(f"_a{i}") for i in n]))
    dot = _add([-s * F.col(f"_a{i}") for i, s in zip(n, step)])
    rows = rows.select("grp", "from_win", "to_win", known.alias("available"), F.when(known, size).alias("magnitude"), F.when(known, to_ideal).alias("_t"), F.when(known, dot).alias("_dot"), *[F.when(known, s).alias(f"delta_{c}") for s, c in zip(step, objectives)])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.nullif(F.col("magnitude") * F.col("_t"), F.lit(0.0))))
    moved = (F.col("magnitude") > 0) & (F.col("_t") > 0)
    rows = rows.withColumn("angle", F.when(moved, F.degrees(F.acos(cosine))))
    reading = (
        F.when(~F.col("available"), "unavailable").when(F.col("angle").isNull(), "no movement").when(F.col("angle") < ANGLES[0], "improving on the objectives together")
        .when(F.col("angle") < ANGLES[1], "improving on balance, with a trade").when(F.col("angle") < ANGLES[2], "trading one objective against another").otherwise("worse on the objectives together")
    )
    return rows.withColumn("reading", reading).drop("_t", "_dot")


def clr(parts: list[Column], n_builds: Column) -> tuple[list[Column], Column]:
    """Centred log-ratios of shares, and the replacement for zeros; null for an empty composition."""
    zeros = _add([F.when(p <= 0, 1).otherwise(0) for p in parts])
    total = _add([F.greatest(p, F.lit(0.0)) for p in parts])
    delta = F.least(0.5 / F.greatest(F.lit(1), n_builds), 0.5 / F.greatest(F.lit(1), zeros))
    filled = [F.when(zeros == 0, p).when(p <= 0, delta).otherwise(p * (1 - delta * zeros) / F.nullif(total, F.lit(0.0))) for p in parts]
    logs = [F.when(total > 0, F.ln(x)) for x in filled]
    mean = _add(logs) / len(parts)
    return [x - mean for x in logs], F.when(total > 0, delta)


def with_clr(cells: DataFrame, parts: tuple[str, ...] = IMPACT_CLASSES) -> DataFrame:
    """cells with clr_<part> and clr_delta."""
    ratios, delta = clr([F.col(f"share_{p}") for p in parts], F.col("n_builds"))
    return cells.withColumns({f"clr_{p}": c for p, c in zip(parts, ratios)} | {"clr_delta": delta})


def mix_movement(cells: DataFrame, parts: tuple[str, ...] = IMPACT_CLASSES) -> DataFrame:
    """grp, from_win, to_win, available, distance (Aitchison), top_ratio, top_contribution, zeros replaced."""
    rows = with_clr(cells, parts)
    zero = lambda: F.array_compact(F.array(*[F.when(F.col(f"share_{p}") == 0, F.lit(p)) for p in parts]))
    rows = rows.select("grp", "win", *[F.col(f"clr_{p}").alias(f"_b{i}") for i, p in enumerate(parts)], F.col("clr_delta").alias("_d"), zero().alias("_z"))
    rows = rows.select("grp", F.lag("win").over(by_time()).alias("from_win"), F.col("win").alias("to_win"), *[F.col(f"_b{i}") for i in range(len(parts))], *[F.lag(f"_b{i}").over(by_time()).alias(f"_a{i}") for i in range(len(parts))], F.lag("_d").over(by_time()).alias("delta_from"), F.col("_d").alias("delta_to"), F.lag("_z").over(by_time()).alias("zeros_from"), F.col("_z").alias("zeros_to")).filter("from_win IS NOT NULL")
    pairs = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))]
    term = {p: (F.col(f"_a{p[0]}") - F.col(f"_a{p[1]}")) - (F.col(f"_b{p[0]}") - F.col(f"_b{p[1]}")) for p in pairs}
    known = F.col("_a0").isNotNull() & F.col("_b0").isNotNull()
    # the largest squared ratio, the first named on a tie
    every = F.array(*[F.struct((term[p] * term[p]).alias("c"), F.lit(-k).alias("k"), F.lit(f"{parts[p[0]]}:{parts[p[1]]}").alias("r")) for k, p in enumerate(pairs)])
    rows = rows.withColumn("_every", F.when(known, every)).withColumn("_top", F.array_max("_every"))
    distance = F.sqrt(F.aggregate("_every", F.lit(0.0), lambda a, x: a + x.getField("c")) / len(parts))
    return rows.select("grp", "from_win", "to_win", known.alias("available"), distance.alias("distance"), F.col("_top.r").alias("top_ratio"), F.col("_top.c").alias("top_contribution"), "delta_from", "delta_to", "zeros_from", "zeros_to")


def persistence(members: DataFrame, on_front: str = "on_front") -> DataFrame:
    """grp, windows_on_front, windows_considered: over comparisons that were drawn and cells with a place in them."""
    seen = members.filter(F.col(on_front).isNotNull())
    return seen.groupBy("grp").agg(F.count_if(F.col(on_front)).alias("windows_on_front"), F.count("*").alias("windows_considered"))


def lead_time_check(cells: DataFrame, on: list[str]) -> DataFrame:
    """on, mixed cells, spread of the share of lead times measured to deployment, divergent."""
    spread = F.max("fallback_share") - F.min("fallback_share")
    return cells.groupBy(*on).agg(F.count_if(F.col("n_sources") > 1).alias("mixed_cells"), spread.alias("spread")).withColumn("divergent", F.coalesce(F.col("spread") > FALLBACK_DIVERGENCE, F.lit(False)))
