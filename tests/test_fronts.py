import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions.metrics import DEFAULTS
from millrace.functions.rng import draw, gaussian
from millrace.operators import dominance as D
from millrace.operators import movement, prepare, screen, uncertainty
from millrace.operators.cells import average_rank
from millrace.plans.analysis import Params, compute, compute_aggregate
from millrace.plans.diff import diff_runs
from millrace.plans.explain import explain_cell
from millrace.plans.report import findings, render, summary
from millrace.sources import fixtures
from millrace.sources.aggregate import prepare_aggregate_cells

AS_OF = datetime(2026, 6, 1, tzinfo=timezone.utc)


def points(spark, rows, names="abc"):
    names = names[: len(rows[0])]
    return spark.createDataFrame([("k", f"p{i}", *r) for i, r in enumerate(rows)], "k string, id string, " + ", ".join(f"{c} double" for c in names)), list(names)


def dom(a, b):
    return all(x <= y for x, y in zip(a, b)) and a != b


def test_front_and_layers_against_loops(spark):
    rng = random.Random(4)
    rows = [tuple(float(rng.randrange(6)) for _ in range(3)) for _ in range(60)]
    df, names = points(spark, rows)
    best = {i for i, p in enumerate(rows) if not any(dom(q, p) for q in rows)}
    for pruned in (False, True):
        assert {int(r["id"][1:]) for r in D.front(df, ["k"], names, pruned).collect()} == best
    layer, left, k = {}, set(range(60)), 0
    while left:
        k += 1
        out = {i for i in left if not any(dom(rows[j], rows[i]) for j in left)}
        layer |= {i: k for i in out}
        left -= out
    assert {int(r["id"][1:]): r["layer"] for r in D.layers(df, ["k"], ["id"], names).collect()} == layer
    freq = {int(r["id"][1:]): r["frequency"] for r in D.skyline_frequency(df, ["k"], ["id"], names).collect()}
    for i, p in enumerate(rows):
        n = 0
        for mask in range(1, 8):
            pick = lambda r: [v for j, v in enumerate(r) if mask >> j & 1]
            n += not any(dom(pick(q), pick(p)) for q in rows)
        assert freq[i] == n


def test_nulls_have_no_place(spark):
    df, names = points(spark, [(1.0, 1.0), (0.5, None), (2.0, 2.0)])
    assert [r["layer"] for r in D.layers(df, ["k"], ["id"], names).orderBy("id").collect()] == [1, None, 2]
    assert [r["id"] for r in D.front(df, ["k"], names).collect()] == ["p0"]


def test_three_cycle(spark):
    df, names = points(spark, [(0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)])
    tri, n3 = points(spark, [(0.0, 1.0, 2.0), (1.0, 2.0, 0.0), (2.0, 0.0, 1.0)])
    assert D.k_front(tri, ["k"], n3, 2).count() == 0
    got = D.cycles(D.k_edges(tri, ["k"], "id", n3, 2), ["k"]).collect()
    assert {(r["cycle"], r["member"]) for r in got} == {("p0", f"p{i}") for i in range(3)}
    assert D.front(df, ["k"], names).count() == 3


def test_hypervolume(spark):
    df, names = points(spark, [(0.1, 0.1)])
    assert D.hypervolume(df, ["k"], names).first()["hypervolume"] == pytest.approx(1.0)
    df, names = points(spark, [(0.1, 0.1), (0.5, 0.5), (1.2, 0.0)])
    assert D.hypervolume(df, ["k"], names).first()["hypervolume"] == pytest.approx(1.0)
    many, names = points(spark, [(i / 20, math.sqrt(1 - (i / 20) ** 2)) for i in range(20)])
    r = D.hypervolume(many, ["k"], names).first()
    xs = sorted((i / 20, math.sqrt(1 - (i / 20) ** 2)) for i in range(20))
    exact = sum((1.1 - y) * ((xs[i + 1][0] if i + 1 < len(xs) else 1.1) - x) for i, (x, y) in enumerate(xs))
    assert r["method"] == "sampled" and r["hypervolume"] == pytest.approx(exact, abs=0.01)


def test_moss(spark):
    df, names = points(spark, [(0.0, 1.0), (1.0, 0.0)])
    got = D.moss_ladder([r.asDict() for r in D.delta_subsets(df, [], names).collect()], names)
    assert [x["delta"] for x in got["ladder"]] == [1.0, 0.0] and got["smallest_exact_subset"] == ["a", "b"]


def test_ranks_and_tau(spark):
    df = spark.createDataFrame([(0, 10.0), (1, None), (2, 30.0), (3, 20.0)], "i int, v double")
    assert [r["r"] for r in df.withColumn("r", average_rank(F.col("v"))).orderBy("i").collect()] == [0.0, None, 1.0, 0.5]
    rng = random.Random(1)
    xy = [(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(25)]
    c = d = tx = ty = 0
    for i in range(25):
        for j in range(i):
            a, b = xy[i][0] - xy[j][0], xy[i][1] - xy[j][1]
            tx += a == 0 and b != 0
            ty += b == 0 and a != 0
            c += a * b > 0
            d += a * b < 0
    got = screen.kendall(spark.createDataFrame([("k", i, *p) for i, p in enumerate(xy)], "k string, i int, x double, y double"), ["k"], ["i"], "x", "y").first()
    assert got["tau"] == pytest.approx((c - d) / math.sqrt((c + d + tx) * (c + d + ty)))


def test_expected_maxima(spark):
    assert screen.expected_maxima(10, 2) == pytest.approx(sum(1 / k for k in range(1, 11)))
    t = {(r["n"], r["d"]): r["a"] for r in screen.expected_maxima_table(spark, 8, 3).collect()}
    assert all(t[n, d] == pytest.approx(screen.expected_maxima(n, d)) for n, d in t)


def test_draws(spark):
    df = spark.range(200).select((F.col("id") + 1).alias("rep")).crossJoin(spark.range(100).select(F.col("id").alias("i")))
    r = df.agg(F.avg(draw(F.col("rep"), F.lit(3), F.col("i")) / 2147483647.0).alias("m"), F.avg(gaussian(F.col("rep"), F.lit(3), F.col("i"))).alias("g"), F.stddev(gaussian(F.col("rep"), F.lit(3), F.col("i"))).alias("s")).first()
    assert abs(r["m"] - 0.5) < 0.01 and abs(r["g"]) < 0.03 and abs(r["s"] - 1) < 0.03


def test_parametric_of_one_value(spark):
    """Where all cells agree, differences stay, around 0.5; where they do not, the observed range is the scale."""
    rows = [("g", "w1", 14.0, 0.5, 2.0, 0.5), ("g", "w2", 14.0, 0.0, 6.0, 0.0), ("h", "w1", 14.0, None, 4.0, 0.5), ("h", "w2", 14.0, 9.0, None, 0.5)]
    cells = spark.createDataFrame(rows, "grp string, win string, a double, a_se double, b double, b_se double")
    got = {(r["rep"], r["grp"], r["win"]): (r["a"], r["b"]) for r in uncertainty.parametric(cells, ["a", "b"], 30).collect()}
    index = spark.range(1, 31).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("cell"))
    z = {(r["rep"], r["cell"]): (r["a"], r["b"]) for r in index.select("rep", "cell", *[gaussian(F.col("rep"), F.col("cell"), F.lit(j)).alias(n) for j, n in enumerate("ab")]).collect()}
    assert len(got) == 120
    for (rep, grp, win), values in got.items():
        cell = [r[:2] for r in rows].index((grp, win))
        for j, (lo, hi) in enumerate(((14.0, 14.0), (2.0, 6.0))):
            point, se = rows[cell][2 + 2 * j : 4 + 2 * j]
            if point is None or se is None:
                assert values[j] is None
                continue
            drawn = max(lo - 3 * se, min(hi + 3 * se, point + se * z[rep, cell + 1][j]))
            assert values[j] == pytest.approx(0.5 + (drawn - lo) / 14 if lo == hi else (drawn - lo) / (hi - lo), abs=1e-12)


def test_attainment(spark):
    reps = spark.createDataFrame([("k", 1, 0.1, 0.2), *[("k", r, 0.8, 0.3) for r in range(2, 11)]], "k string, rep int, x double, y double")
    got = {r["x"]: (r["p10"], r["p50"], r["p90"]) for r in uncertainty.attainment(reps, ["k"], "x", "y").collect()}
    assert got[0.1] == (0.2, None, None) and got[0.8] == (0.2, 0.3, 0.3)


def test_aitchison_is_euclid_of_clr(spark):
    mixes = [(0.5, 0.3, 0.2, 0.0, 0.0, 0.0), (0.2, 0.2, 0.2, 0.2, 0.1, 0.1)]
    from millrace.constants import IMPACT_CLASSES

    df = spark.createDataFrame([("g", f"w{i}", 10, *m) for i, m in enumerate(mixes)], "grp string, win string, n_builds long, " + ", ".join(f"share_{c} double" for c in IMPACT_CLASSES))
    a, b = ([r[f"clr_{c}"] for c in IMPACT_CLASSES] for r in movement.with_clr(df).orderBy("win").collect())
    assert movement.mix_movement(df).first()["distance"] == pytest.approx(math.dist(a, b))
    empty = df.withColumns({f"share_{c}": F.lit(0.0) for c in IMPACT_CLASSES})
    assert movement.mix_movement(empty).first()["available"] is False


# -- whole runs over planted truth -----------------------------------------


@pytest.fixture(scope="module")
def truth(spark):
    typed, _ = prepare.coerce(fixtures.ground_truth(spark))
    return compute(typed, list(DEFAULTS), Params(as_of=AS_OF, u=1000.0, bootstrap=20, permutations=40), "r-truth")


def test_planted_front(truth):
    last = next(c for c in truth["comparisons"] if c["id"] == "across:2026-04")
    assert {x.split("/")[0] for x in last["front"]} == {"agent-heavy", "platform-core", "review-first"}
    moves = {t["grp"]: t for t in truth["stage7"]["direction_of_travel"]}
    assert moves["agent-heavy"]["angle"] < 60 and moves["legacy-owner"]["angle"] > 120
    assert truth["stage7"]["persistence"]["agent-heavy"]["windows_considered"] == 6


def test_document_and_reports(truth):
    page = render(truth)
    assert "http" not in page.replace("http-equiv", "") and "<script" in page and "r-truth" in summary(truth)
    kinds = {f[0] for f in findings(truth)}
    assert {"front", "axis_order", "persistence", "travel", "null_model", "hypervolume"} <= kinds
    e = explain_cell(truth, "legacy-owner/2026-04")
    across = next(c for c in e["comparisons"] if c["kind"] == "across_groups")
    assert not across["on_front"] and across["dominated_by"] and across["binding_objective"] in truth["run"]["objectives"]
    assert diff_runs(truth, truth)["verdict"] == "COMPARABLE"
    other = {**truth, "run": {**truth["run"], "metrics": [{**m, "version": 9} for m in truth["run"]["metrics"]]}}
    d = diff_runs(truth, other)
    assert d["verdict"] == "NOT COMPARABLE" and all(v is None for x in d["deltas"].values() for v in x.values())
    with pytest.raises(KeyError):
        explain_cell(truth, "nobody/2026-04")


def test_refusals(spark):
    typed, _ = prepare.coerce(fixtures.threshold(spark))
    quick = {"as_of": AS_OF, "bootstrap": 0, "permutations": 0}
    one = compute(typed, list(DEFAULTS), Params(objectives=["cost"], **quick))
    assert one["diagnostics"]["refusals"][0]["code"] == "TOO_FEW_OBJECTIVES" and one["cells"] == []
    many = compute(typed, list(DEFAULTS), Params(objectives=["cost"] * 9, **quick))
    assert many["diagnostics"]["refusals"][0]["code"] == "TOO_MANY_OBJECTIVES"
    with pytest.raises(ValueError):
        compute(typed, list(DEFAULTS), Params(objectives=["cost", "nothing"], **quick))
    with pytest.raises(ValueError):
        compute(typed, list(DEFAULTS), Params(objectives=["cost", "throughput"], **quick))
    with pytest.raises(ValueError):
        compute(typed, list(DEFAULTS), Params(epsilon_source="manual", **quick))
    got = compute(typed, list(DEFAULTS), Params(**quick))
    assert "TOO_FEW_CELLS" in {r["code"] for r in got["diagnostics"]["refusals"]}
    assert all(c["front_not_drawn"] and "front" not in c for c in got["comparisons"])
    assert got["sensitivity"]["verdict"] == "PROVISIONAL"


def test_overlap_and_censoring(spark):
    typed, _ = prepare.coerce(fixtures.overlap(spark))
    got = compute(typed, list(DEFAULTS), Params(objectives=["cost", "lead_time", "debt_composite"], as_of=AS_OF, u=1000.0, bootstrap=0, permutations=0))
    assert any(o["line"].startswith("OVERLAP") for o in got["stage0"]["overlaps"]) and got["stage2"]["taus"]["debt_composite|share(liability)"] > 0.7
    assert got["self_comparison"] and {c["kind"] for c in got["comparisons"]} == {"within_group"}
    edge = datetime(2026, 5, 15, tzinfo=timezone.utc)
    typed, _ = prepare.coerce(fixtures.censoring(spark, edge))
    got = compute(typed, list(DEFAULTS), Params(as_of=edge, u=1000.0, bootstrap=0, permutations=0))
    mixes = [c["impact_mix"] for c in got["cells"]]
    open_ = [m["unresolved"] for m in mixes]
    assert open_ == sorted(open_) and open_[-1] > 0 and all(sum(m.values()) == pytest.approx(1) for m in mixes)


def test_null_is_not_zero(spark):
    rows = [r for g in "abcd" for r in fixtures.cell(g, "2026-04", 10, 100.0, 5.0, 1.0)]
    for zero, front in ((None, 100.0), ("0", 50.0)):
        mine = [dict(r) for r in rows]
        for r in mine:
            r["cost_usd"] = "100"
        for r in [r for r in mine if r["group"] == "a"][:5]:
            r["cost_usd"] = zero
        typed, _ = prepare.coerce(fixtures.frame(spark, mine))
        got = compute(typed, list(DEFAULTS), Params(as_of=AS_OF, bootstrap=0, permutations=0))
        assert next(c for c in got["cells"] if c["group"] == "a")["objectives"]["cost"] == front


def test_aggregate_cells(spark):
    head = "`group` string, window string, n_builds string, cost string, lead_time string, cost_se string, lead_time_se string"
    rows = [("a", "2026-04", "12", "100", "5", "1", "0.5"), ("b", "2026-04", "12", "120", "4", "1", "0.5"), ("c", "2026-04", "12", "150", "3", "1", "0.5"), ("d", "2026-04", "12", "200", "9", "1", "0.5")]
    metrics = [m for m in DEFAULTS if m.name in ("cost", "lead_time")]
    typed, notes = prepare_aggregate_cells(spark.createDataFrame(rows, head), ["cost", "lead_time"])
    got = compute_aggregate(typed, metrics, Params(objectives=["cost", "lead_time"], bootstrap=20, permutations=20), warnings=notes)
    c = got["comparisons"][0]
    assert c["front"] == ["a/2026-04", "b/2026-04", "c/2026-04"] and c["p_on_front"]["a/2026-04"] > 0.9
    assert {w["code"] for w in got["diagnostics"]["warnings"]} == {"MIX_UNAVAILABLE", "LEAD_TIME_SOURCE_UNAVAILABLE"}
    bare, _ = prepare_aggregate_cells(spark.createDataFrame([r[:5] for r in rows], head.split(", cost_se")[0]), ["cost", "lead_time"])
    again = compute_aggregate(bare, metrics, Params(objectives=["cost", "lead_time"], bootstrap=20, permutations=0))
    assert "UNCERTAINTY_UNAVAILABLE" in {x["code"] for x in again["diagnostics"]["cautions"]}
    for bad in (("a", "2026-13", "1", "1", "1", "1", "1"), ("a", "2026-04", "0", "1", "1", "1", "1"), ("a", "2026-04", "1", "x", "1", "1", "1"), ("a", "2026-04", "1", "1", "1", "-1", "1")):
        with pytest.raises(ValueError):
            prepare_aggregate_cells(spark.createDataFrame([bad], head), ["cost", "lead_time"])
    with pytest.raises(ValueError):
        prepare_aggregate_cells(spark.createDataFrame([rows[0], rows[0]], head), ["cost", "lead_time"])


def test_front_is_about_order_only(spark):
    """Swapping axes or stretching one changes neither front nor layers nor skyline frequency."""
    rng = random.Random(11)
    rows = [tuple(rng.random() for _ in range(3)) for _ in range(30)]
    df, n = points(spark, rows)
    other = df.select("k", "id", F.exp("c").alias("a"), F.col("a").alias("b"), (F.col("b") * F.col("b") * 7 + 1).alias("c"))
    for f in (lambda d: D.front(d, ["k"], n).select("id"), lambda d: D.layers(d, ["k"], ["id"], n).select("id", "layer"), lambda d: D.skyline_frequency(d, ["k"], ["id"], n).select("id", "frequency")):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(other).collect()))


def test_null_model_agrees_with_closed_form(spark):
    typed, _ = prepare.coerce(fixtures.degeneracy(spark))
    got = compute(typed, list(DEFAULTS), Params(as_of=AS_OF, u=1000.0, bootstrap=0, permutations=100))
    drawn = [c["null_model"] for c in got["comparisons"] if c.get("null_model", {}).get("available")]
    assert drawn and all(abs(m["closed_form"] - m["mean"]) < 0.6 for m in drawn)
    assert sum(m["verdict"] == "NOT INFORMATIVE" for m in drawn) >= 0.6 * len(drawn)


def test_reruns_agree(spark):
    typed, _ = prepare.coerce(fixtures.overlap(spark))
    p = Params(as_of=AS_OF, u=1000.0, bootstrap=5, permutations=5)
    a, b = (compute(typed.repartition(n), list(DEFAULTS), p) for n in (1, 3))
    assert [c["null_model"] for c in a["comparisons"]] == [c["null_model"] for c in b["comparisons"]]
    assert [c["p_on_front"] for c in a["comparisons"]] == [c["p_on_front"] for c in b["comparisons"]]


def test_cautions(spark):
    rows = [r for i in range(8) for r in fixtures.cell(f"g{i}", "2026-04", 12 if i else 4, 100.0 + i, 5.0 + i, 1.0)]
    for r in rows:
        if r["group"] == "g1":
            r["served_at"], r["question"] = None, "style"
        if r["group"] == "g2" and r["served_at"] and r["build_id"].endswith("1"):
            r["served_at"] = None
    typed, _ = prepare.coerce(fixtures.frame(spark, rows))
    quick = {"as_of": AS_OF, "u": 1000.0, "bootstrap": 0, "permutations": 0}
    got = compute(typed, list(DEFAULTS), Params(**quick))
    assert {"BELOW_BUILD_FLOOR", "QUESTION_UNCLASSIFIED", "CUBE_CLUTTER_CAP", "MIXED_LEAD_TIME_SOURCE"} <= {c["code"] for c in got["diagnostics"]["cautions"]}
    assert "DIVERGENT_LEAD_TIME_SOURCE" in {c["code"] for c in got["diagnostics"]["refusals"]}
    mixed = compute(typed, list(DEFAULTS), Params(allow_mixed_lead_time=True, **quick))
    assert "DIVERGENT_LEAD_TIME_SOURCE" in {c["code"] for c in mixed["diagnostics"]["cautions"]} and any("front" in c for c in mixed["comparisons"])
    assert not next(c for c in mixed["cells"] if c["group"] == "g0")["plotted"]
    few = compute(typed.filter("grp in ('g3', 'g4', 'g5', 'g6')"), list(DEFAULTS), Params(**quick))
    assert "PROVISIONAL_FRONT" in {c["code"] for c in few["diagnostics"]["cautions"]}
    one = compute(typed.filter("grp in ('g3', 'g4')").unionByName(typed.filter("grp = 'g5'").limit(1)), list(DEFAULTS), Params(**(quick | {"bootstrap": 3})))
    assert "UNCERTAINTY_UNAVAILABLE" in {c["code"] for c in one["diagnostics"]["cautions"]}


@pytest.mark.parametrize("block", [4096, 17])
def test_layers_in_blocks(spark, monkeypatch, block):
    """Settled range by range or in one task: the same layers as peeling, with ties, nulls and a null key."""
    monkeypatch.setattr(D, "LAYER_BLOCK", block)
    rng = random.Random(12)
    rows = []
    for k, n in (("big", 150), ("small", 9), (None, 40), ("chain", 45)):
        for i in range(n):
            x = [float(i), i + 0.5, -1.0] if k == "chain" else [rng.choice([None, 0.0, 0.1, 0.2, 0.7, 1.0, rng.random()]) if rng.random() < 0.9 else None for _ in range(3)]
            rows.append((k, f"r{k}{i}", *x))
    names = ["a", "b", "c"]
    got = {r["id"]: r["layer"] for r in D.layers(spark.createDataFrame(rows, "k string, id string, a double, b double, c double").repartition(4), ["k"], ["id"], names).collect()}
    assert len(got) == len(rows)
    for k in ("big", "small", None, "chain"):
        left = {r[1]: r[2:] for r in rows if r[0] == k}
        for i in [i for i, x in left.items() if None in x]:
            assert got[i] is None
            del left[i]
        depth = 0
        while left:
            depth += 1
            top = [i for i, x in left.items() if not any(all(p <= q for p, q in zip(y, x)) and y != x for y in left.values())]
            for i in top:
                assert got[i] == depth
                del left[i]


@pytest.mark.parametrize("nodes", [500, 2])
def test_cycles_by_reach(spark, monkeypatch, nodes):
    """Components by joins and by matrices against mutual reach."""
    monkeypatch.setattr(D, "CYCLE_NODES", nodes)
    rng = random.Random(13)
    edges = [("ring", f"n{i}", f"n{(i + 1) % 7}") for i in range(7)] + [("ring", "x", "n0"), ("ring", "n3", "y"), ("ring", "y", "z")] + [("none", "a", "b"), ("none", "b", "c"), ("none", "a", "a")]
    edges += [("two", "a", "b"), ("two", "b", "a"), ("two", "b", "c"), ("two", "c", "d"), ("two", "d", "c"), ("two", "d", "d")]
    edges += [("wild", f"w{rng.randrange(25)}", f"w{rng.randrange(25)}") for _ in range(34)]
    want = set()
    for k in ("ring", "none", "two", "wild"):
        mine = {(a, b) for g, a, b in edges if g == k}
        reach = {a: {b for x, b in mine if x == a} for a in {v for e in mine for v in e}}
        for _ in reach:
            reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
        for a in reach:
            mates = {b for b in reach[a] if a in reach[b]} | {a}
            if len(mates) > 1:
                want.add((k, min(mates), a))
    got = {tuple(r) for r in D.cycles(spark.createDataFrame(edges, "k string, src string, dst string"), ["k"]).collect()}
    assert got == want and any(k == "wild" for k, _, _ in got)
    assert D.cycles(spark.createDataFrame([], "k string, src string, dst string"), ["k"]).collect() == []
