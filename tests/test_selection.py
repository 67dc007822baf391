"""Percentiles by selection, and bootstrap terms by draw counts, against plain computations."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import selection as S
from millrace.functions.formula import Plan
from millrace.functions.metrics import Metric
from millrace.operators import cells, resample
from millrace.operators.cells import cell_terms

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3, 2.0**52, 2.0**53 - 1, 1023.9999999999999, 1024.0, 1e-300, 4.9e-310, math.pi]


def test_bits_keep_order(spark):
    rng = random.Random(1)
    values = ODD + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.choice([-1, 1]) * 2.0 ** rng.randrange(-1074, 1024) for _ in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = df.select("x", S.ordered_bits(F.col("x")).alias("c")).withColumn("back", S.from_bits(F.col("c"))).collect()
    for r in got:
        if math.isnan(r["x"]):
            assert math.isnan(r["back"]) and r["c"] == (2047 << 52) + 1
        else:
            assert r["back"] == r["x"]
            raw = struct.unpack("<q", struct.pack("<d", r["x"]))[0]
            assert r["c"] == (raw if raw >= 0 else -(raw & (2**63 - 1)))
    assert spark.range(1).select(S.ordered_bits(F.lit(None).cast("double")).alias("c")).first()["c"] is None


@pytest.mark.parametrize("direct", [10_000, 40, 1])
def test_percentiles(spark, monkeypatch, direct):
    monkeypatch.setattr(S, "DIRECT", direct)
    rng = random.Random(2)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 900), ("d", 301), (None, 57), ("none", 9)):
        for _ in range(n):
            x = rng.choice([rng.gauss(0, 1), rng.choice([0.0, 2.5, -7.0]), rng.lognormvariate(0, 30), -1e-9 * rng.random()])
            rows.append((g, None if g == "none" or rng.random() < 0.1 and n > 2 else x, rng.choice([3.0, 3.0, 4.0])))
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    wanted = {"m": (F.col("x"), 0.5), "lo": (F.col("x"), 0.1), "hi": (F.col("x"), 0.9), "y": (F.col("y"), 0.5)}
    got = {r["g"]: r for r in S.percentiles(df, ["g"], wanted).collect()}
    for g in {r[0] for r in rows}:
        for name, p, col in (("m", 50, 1), ("lo", 10, 1), ("hi", 90, 1), ("y", 50, 2)):
            values = [r[col] for r in rows if r[0] == g and r[col] is not None]
            assert got[g][name] == (pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-300) if values else None)
    assert S.percentiles(df, [], {"m": (F.col("y"), 0.5)}).first()["m"] == 3.0
    assert S.percentiles(df.filter("false"), ["g"], wanted).collect() == []


def builds(spark, sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for cell, n in sizes.items():
        for i in range(n):
            rows.append((f"b{cell}-{i:05d}", cell, "2024-01", rng.lognormvariate(1, 1) if rng.random() > 0.1 else None, float(rng.randrange(5)), rng.choice(["impactful", "sunk"]), float(rng.randrange(1, 9))))
    return spark.createDataFrame(rows, "build_id string, grp string, win string, lead_time_days double, bugs double, impact string, cost_usd double").cache()


PLAN = "median(lead_time_days) + p90(lead_time_days) + mean(bugs) + min(lead_time_days) + max(cost_usd) + share(sunk) + count(bugs > 2) + sum(cost_usd) / count()"


def counted(replicates, seed, sizes):
    """Draw counts of single-block cells, draw by draw."""
    out = {}
    for c, (g, n) in enumerate(sorted(sizes.items()), 1):
        for r in range(1, replicates + 1):
            w = np.zeros(n, int)
            for i in range(n):
                x = (r * 7919 + c * 104729 + i * 1299709 + seed) % 2147483647
                y = (x * 48271) % 2147483647
                w[((y * y + x * 69621) % 2147483647) % n] += 1
            out[g, r] = w
    return out


def test_terms_of_replicates(spark):
    sizes = {"a": 1, "b": 40, "c": 7}
    df = builds(spark, sizes)
    plan = Plan(Metric("x", "objective", "min", PLAN).formula, "_m0_")
    got = {(r["grp"], r["rep"]): r for r in resample.replicate_terms(df, [plan], cells.KEYS, 30, 11).collect()}
    assert len(got) == 90
    by = {g: sorted([r for r in df.collect() if r["grp"] == g], key=lambda r: r["build_id"]) for g in sizes}
    names = list(plan.terms)
    for (g, rep), w in counted(30, 11, sizes).items():
        drawn = [r for r, k in zip(by[g], w) for _ in range(k)]
        lead = [r["lead_time_days"] for r in drawn if r["lead_time_days"] is not None]
        want = {"median": np.percentile(lead, 50) if lead else None, "p90": np.percentile(lead, 90) if lead else None, "mean": np.mean([r["bugs"] for r in drawn]), "min": min(lead, default=None), "max": max(r["cost_usd"] for r in drawn), "share": sum(r["impact"] == "sunk" for r in drawn) / len(drawn), "sum": sum(r["cost_usd"] for r in drawn), "rows": len(drawn)}
        for n in names:
            kind = plan.terms[n].kind
            if kind in want and not n.startswith("_m0_b"):  # those are bounds on sums
                assert got[g, rep][n] == (None if want[kind] is None else pytest.approx(want[kind]))
        assert got[g, rep]["n_builds"] == len(drawn) == sizes[g]


def test_cells_of_many_blocks(spark, monkeypatch):
    """The same numbers from the draw counts of all blocks together, exactly n draws a replicate, spread as a bootstrap is."""
    monkeypatch.setattr(resample, "BLOCK", 50)
    monkeypatch.setattr(S, "DIRECT", 20)
    sizes = {"a": 700, "b": 30}
    df = builds(spark, sizes)
    plan = Plan(Metric("x", "objective", "min", PLAN).formula, "_m0_")
    got = resample.replicate_terms(df, [plan], cells.KEYS, 150, 5).collect()
    assert all(r["n_builds"] == sizes[r["grp"]] for r in got) and len(got) == 300
    kinds = {t.kind: n for n, t in plan.terms.items()}
    rows, split = resample._blocks(df, list(cells.KEYS), {"lead": ("median", F.col("lead_time_days")), "cost": ("sum", F.col("cost_usd"))}, "build_id")
    assert split
    weights, values = {}, {}
    for r in rows.filter("grp = 'a'").collect():
        values.setdefault(r["block"], []).append((r["_order"], r["lead"], r["cost"], r["n"], [x.asDict() for x in r["path"]]))
    for block, members in values.items():
        members.sort(key=lambda m: m[0])
        parts = list(resample.counts(5, 1, block, members[0][3], len(members), members[0][4], 150))
        weights[block] = np.concatenate([w for _, w in parts])
    every = np.concatenate([weights[b] for b in values], axis=1)
    lead = np.array([m[1] if m[1] is not None else np.nan for b in values for m in values[b]])
    cost = np.array([m[2] for b in values for m in values[b]])
    assert (every.sum(axis=1) == 700).all()
    for r in got:
        if r["grp"] == "a":
            w = every[r["rep"] - 1]
            drawn = np.repeat(lead, w)
            drawn = drawn[~np.isnan(drawn)]
            assert r[kinds["median"]] == pytest.approx(np.percentile(drawn, 50)) and r[kinds["p90"]] == pytest.approx(np.percentile(drawn, 90))
            assert r[kinds["sum"]] == pytest.approx(float(cost @ w)) and r[kinds["min"]] == drawn.min()
    # counts of one build are close to Poisson; means of the replicates spread as the error of a mean
    assert abs(every.var() - (1 - 1 / 700)) < 0.05
    means = every @ cost / 700
    assert abs(means.std() / (cost.std() / math.sqrt(700)) - 1) < 0.2 and abs(means.mean() - cost.mean()) < 4 * cost.std() / math.sqrt(700 * 150)


def test_narrow_brackets_are_widened(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 50)
    df = builds(spark, {"a": 400})
    plan = Plan(Metric("x", "objective", "min", "median(lead_time_days)").formula, "_m0_")
    (name,) = plan.percentiles
    order = lambda rows: {r["rep"]: r[name] for r in rows}
    want = order(resample.replicate_terms(df, [plan], cells.KEYS, 60, 5).collect())
    monkeypatch.setattr(resample, "ERRORS", 0.05)
    assert order(resample.replicate_terms(df, [plan], cells.KEYS, 60, 5).collect()) == want


def test_bounds_over_the_cell(spark):
    df = builds(spark, {"a": 25, "b": 12})
    plan = Plan(Metric("x", "objective", "min", "sum(clip(bugs, 0, median(bugs)))").formula, "_m0_")
    (total,) = [n for n, t in plan.terms.items() if t.kind == "sum"]
    got = {(r["grp"], r["rep"]): r[total] for r in resample.replicate_terms(df, [plan], cells.KEYS, 20, 7).withColumn("rep", F.col("rep")).collect()}
    by = {g: sorted([r for r in df.collect() if r["grp"] == g], key=lambda r: r["build_id"]) for g in ("a", "b")}
    for (g, rep), w in counted(20, 7, {"a": 25, "b": 12}).items():
        bugs = [r["bugs"] for r, k in zip(by[g], w) for _ in range(k)]
        assert got[g, rep] == pytest.approx(sum(max(0.0, min(float(np.median(bugs)), b)) for b in bugs))


def test_large_cells_take_selection(spark, monkeypatch):
    df = builds(spark, {"a": 300, "b": 5})
    plans = [Plan(Metric("x", "objective", "min", e).formula, f"_m{i}_") for i, e in enumerate(("median(lead_time_days)", "p90(lead_time_days) - p10(bugs)", "sum(clip(bugs, 0, median(bugs)))"))]
    want = sorted(map(tuple, cell_terms(df, plans, cells.KEYS).collect()))
    monkeypatch.setattr(S, "DIRECT", 50)
    got = cell_terms(df, plans, cells.KEYS)
    assert "percentile(" not in got._jdf.queryExecution().toString()
    cols = cell_terms(df, plans, cells.KEYS).columns
    monkeypatch.setattr(S, "DIRECT", 10_000)
    named = [c for c in cols if not c.endswith("_sorted")]
    a = sorted(tuple(r) for r in got.select(*named).collect())
    b = sorted(tuple(r) for r in cell_terms(df, plans, cells.KEYS).select(*named).collect())
    assert [x[:3] for x in a] == [x[:3] for x in b] and len(want) == 2
    for x, y in zip(a, b):
        assert x[3:] == pytest.approx(y[3:])


def test_draws_of_large_cells(spark, monkeypatch):
    """A cell of any size is drawn from by the hash of (seed, replicate, cell, draw), as the SQL of the queries has it."""
    df = spark.range(5000).select(F.lit("a").alias("grp"), F.lit("w").alias("win"), F.format_string("b-%05d", "id").alias("build_id"), (F.col("id") * F.col("id") % 977).cast("double").alias("cost_usd"))
    plan = Plan(Metric("x", "objective", "min", "sum(cost_usd) + median(cost_usd)").formula, "_m0_")
    kinds = {t.kind: n for n, t in plan.terms.items()}
    cost = (np.arange(5000) ** 2 % 977).astype(float)
    for block in (resample.BLOCK, 700):
        monkeypatch.setattr(resample, "BLOCK", block)
        got = {r["rep"]: r for r in resample.replicate_terms(df, [plan], cells.KEYS, 9, 20260910).collect()}
        for rep, places in enumerate(resample.picks(20260910, 1, np.arange(1, 10), 5000), 1):
            assert got[rep][kinds["sum"]] == pytest.approx(cost[places].sum()) and got[rep][kinds["median"]] == np.median(cost[places])
