"""Builds to cells: all metrics of a run in one aggregation, compositions, scales and ranks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import IMPACT_CLASSES, QUESTION_CLASSES
from ..functions import selection
from ..functions.formula import PERCENTILES, Plan, finite, normalise
from ..functions.metrics import Metric
from ..session import cut, small

KEYS = ("grp", "win")


def share(hit: Column) -> Column:
    """Share of a cell's builds; null counts as a miss and stays in the denominator."""
    return F.count_if(F.coalesce(hit, F.lit(False))) / F.count(F.lit(1))


def compositions() -> list[Column]:
    """Shares of the fixed classes, not renormalised, and of builds outside the question classes."""
    out = [share(F.col("impact") == c).alias(f"share_{c}") for c in IMPACT_CLASSES]
    out += [share(F.col("question") == c).alias(f"share_{c}") for c in QUESTION_CLASSES]
    out.append((1 - F.count_if(F.coalesce(F.col("question").isin(*QUESTION_CLASSES), F.lit(False))) / F.count(F.lit(1))).alias("unclassified_share"))
    return out


def lead_time_sources() -> list[Column]:
    source = F.col("lead_time_source")
    return [
        F.count_distinct(source).alias("n_sources"),
        F.try_divide(F.count_if(source == "DEPLOYED"), F.count(source)).alias("fallback_share"),
        F.avg(F.col("gate_unavailable").cast("double")).alias("gate_unavailable_share"),
    ]


def mix_levels(builds: DataFrame) -> DataFrame:
    """grp, win, n_builds and the impact shares of every cell and, with null keys, of all builds: one pass."""
    shares = [share(F.col("impact") == c).alias(f"share_{c}") for c in IMPACT_CLASSES]
    return builds.groupingSets([[F.col("grp"), F.col("win")], []], F.col("grp"), F.col("win")).agg(F.count(F.lit(1)).alias("n_builds"), *shares)


def norm_parameters(deferred: DataFrame, plans: list[Plan]) -> dict[str, tuple[float | None, float | None]]:
    """Of each normaliser node: (low, high) or (mean, deviation) over all cells; one row is collected."""
    wanted = {}
    for p in plans:
        for k, node in enumerate(p.formula.normalisers):
            d = F.col(f"{p.prefix}d{k}")
            wanted[f"{p.prefix}z{k}"] = (F.min(d), F.max(d)) if node.func.id == "minmax" else (F.avg(d), F.when(F.count(d) == 1, 0.0).otherwise(F.stddev_samp(d)))
    if not wanted:
        return {}
    row = deferred.agg(*[c.alias(f"{n}_{i}") for n, pair in wanted.items() for i, c in enumerate(pair)]).first()
    return {n: (row[f"{n}_0"], row[f"{n}_1"]) for n in wanted}


def cell_terms(builds: DataFrame, plans: Iterable[Plan], keys: Iterable[str], extra: Iterable[Column] = ()) -> DataFrame:
    """keys, n_builds, extra and the terms of all plans, in one aggregation.

    Percentiles are taken from sorted arrays where every cell is small, by selection beside the aggregation where one is not.
    """
    plans, keys = list(plans), list(keys)
    bounds = [(n, inner) for p in plans for n, inner in p.hoisted.items()]
    if bounds:  # a row a cell
        own = cell_terms(builds, [inner for _, inner in bounds], keys).select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[inner.value.alias(n) for n, inner in bounds], *[c.alias(f) for _, inner in bounds for f, (c, _) in inner.flags.items()])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
        builds = builds.join(small(cut(own), selection.FEW), same).drop(*[f"_of_{k}" for k in keys])
    terms = {n: t.column() for p in plans for n, t in p.terms.items() if t.kind not in PERCENTILES}
    wanted = {n: w for p in plans for n, w in p.percentiles.items()}
    ordered: dict[str, Column] = {}
    apart = bool(wanted) and selection.largest(builds, keys) > selection.DIRECT
    if wanted and not apart:
        lists, ordered = selection.inline(wanted)
        terms |= lists
    cells = builds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_builds"), *extra, *[c.alias(n) for n, c in terms.items()])
    if apart:
        found = selection.percentiles(builds, keys, wanted)
        same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], F.lit(True))
        cells = cells.alias("c").join(found.alias("p"), same, "left").select("c.*", *[f"p.{n}" for n in wanted])
    return cells.withColumns(ordered) if ordered else cells


def evaluate(builds: DataFrame, metrics: Iterable[Metric], keys: tuple[str, ...] = KEYS, extra: Iterable[Column] = (), scales: dict | None = None) -> DataFrame:
    """keys, n_builds, extra, a column for each metric, and null_<metric> (nulls skipped), note_<metric>.

    Normalisers pool every row of the result; `scales` (a dict) is filled with the parameters that were used.
    """
    metrics = list(metrics)
    plans = [Plan(m.formula, f"_m{i}_") for i, m in enumerate(metrics)]
    return metric_values(cell_terms(builds, plans, keys, extra), metrics, plans, scales=scales)


def metric_values(cells: DataFrame, metrics: list[Metric], plans: list[Plan], frozen: dict | None = None, scales: dict | None = None) -> DataFrame:
    """Metrics over the terms of cells, with notes on what became null on the way; `frozen` gives the normalisers' parameters
    instead of taking them from these cells.

    A sum that leaves the range of doubles, though none of its values does, ends the query with an error.
    """
    kept = [c for c in cells.columns if not c.startswith("_m")]
    raw = {f"{p.prefix}r{k}": c for p in plans for k, c in p.inner.items()}
    notes = {m.name: list(p.notes) for m, p in zip(metrics, plans)}
    if raw:
        cells = cells.withColumns(raw).withColumns({f"{p.prefix}d{k}": finite(F.col(f"{p.prefix}r{k}")) for p in plans for k in p.inner})
        if frozen is None:
            cells = cut(cells)  # read twice: for the parameters, and with them; a row a cell, so builds are read once
        parameters = frozen if frozen is not None else norm_parameters(cells, plans)
        if scales is not None:
            scales.update(parameters)
        normed = {}
        for m, p in zip(metrics, plans):
            for k, node in enumerate(p.formula.normalisers):
                a, b = parameters[f"{p.prefix}z{k}"]
                d, kind = F.col(f"{p.prefix}d{k}"), node.func.id
                normed[f"{p.prefix}z{k}"] = normalise(kind, d, F.lit(a).cast("double"), F.lit(b).cast("double"))
                notes[m.name].append((F.col(f"{p.prefix}r{k}").isNotNull() & d.isNull(), f"{m.name}: {kind} of a number that is not finite -> null"))
                if a is not None and (a == b if kind == "minmax" else b == 0):
                    notes[m.name].append((d.isNotNull(), f"{m.name}: {kind} of a constant -> {'0.5' if kind == 'minmax' else '0.0'}"))
        cells = cells.withColumns(normed)
    values = {f"_m{i}_value": p.value.cast("double") for i, p in enumerate(plans)}
    cells = cells.withColumns(values)
    out = [F.col(c) for c in kept]
    for i, (m, p) in enumerate(zip(metrics, plans)):
        value = F.col(f"_m{i}_value")
        notes[m.name].append((value.isNotNull() & finite(value).isNull(), f"{m.name}: the result is not finite -> null"))
        value = finite(value)
        for flag in p.overflows:
            value = F.when(flag, F.raise_error(F.lit(f"{m.name}: a sum lies outside the range of numbers")).cast("double")).otherwise(value)
        out.append(value.alias(m.name))
    for m, p in zip(metrics, plans):
        out.append(sum((F.col(n) for n in p.nulls), F.lit(0)).cast("long").alias(f"null_{m.name}"))
        said = F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in notes[m.name]])))
        out.append(said.alias(f"note_{m.name}"))
    return cells.select(*out)


def build_cells(builds: DataFrame, metrics: Iterable[Metric], scales: dict | None = None) -> DataFrame:
    """A row for each (grp, win): n_builds, compositions, lead-time sources and metrics."""
    return evaluate(builds, metrics, KEYS, [*compositions(), *lead_time_sources()], scales)


def scaled(cells: DataFrame, objectives: Iterable[Metric]) -> DataFrame:
    """Adds <objective>_norm: min-max over all cells, smaller better; 0.5 where all cells agree."""
    objectives = list(objectives)
    signed = {m.name: F.col(m.name) * m.sign for m in objectives}
    bounds = cells.agg(*[f(c).alias(f"_{k}_{n}") for n, c in signed.items() for k, f in (("lo", F.min), ("hi", F.max))])
    out = cells.crossJoin(F.broadcast(bounds))  # one row
    for n, c in signed.items():
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        out = out.withColumn(f"{n}_norm", F.when(c.isNotNull(), F.when(lo == hi, 0.5).otherwise((c - lo) / F.nullif(hi - lo, F.lit(0.0)))))
    return out.drop(*bounds.columns)


def average_rank(c: Column, partition: Iterable[str] = ()) -> Column:
    """Mean rank among the non-null values, scaled to [0, 1]; ties share their mean, nulls stay null.

    Ranks need an order over all cells; cells are groups times windows, not builds.
    """
    known = c.isNotNull()
    every = Window.partitionBy(*partition, known)
    place = F.rank().over(every.orderBy(c)) - 1 + (F.count(c).over(Window.partitionBy(*partition, c)) - 1) / 2
    return F.when(known, place / F.greatest(F.lit(1), F.count(c).over(every) - 1))


def ranked(cells: DataFrame, objectives: Iterable[Metric]) -> DataFrame:
    """Adds <objective>_rank over all cells, smaller better."""
    return cells.withColumns({f"{m.name}_rank": average_rank(F.col(m.name) * m.sign) for m in objectives})
