"""One run: builds (or aggregate cells) to the analysis document.

All comparisons - groups of a window, windows of a group - go through each operator together, keyed by comparison;
only cell-level rows reach the driver.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.metrics import DEFAULTS, Metric, by_name, definitions_hash, greyed, readings, told
from ..operators import dominance as D
from ..operators import movement, prepare, screen, uncertainty
from ..operators.cells import KEYS, build_cells, ranked, scaled
from ..session import cut


@dataclass
class Params:
    objectives: list[str] = field(default_factory=lambda: list(K.DEFAULT_OBJECTIVES))
    window_spec: str = K.WINDOW_SPEC
    windows_retained: int | None = K.WINDOWS_RETAINED
    L_days: int = K.RESOLUTION_DAYS
    u: float | None = None
    as_of: datetime | None = None
    baseline: str | None = None
    min_builds: int = K.MIN_BUILDS
    bootstrap: int = K.BOOTSTRAP
    permutations: int = K.PERMUTATIONS
    seed: int = K.SEED
    epsilon_source: str = "bootstrap"
    epsilon_manual: list[float] | None = None
    allow_mixed_lead_time: bool = False
    weights: list[float] | None = None

    def check(self) -> None:
        if self.epsilon_source not in ("bootstrap", "manual", "none"):
            raise ValueError("epsilon_source is bootstrap, manual or none")
        if self.epsilon_source == "manual" and (not self.epsilon_manual or len(self.epsilon_manual) != len(self.objectives)):
            raise ValueError("epsilon_source manual needs a value for each objective")
        if self.weights and len(self.weights) != len(self.objectives):
            raise ValueError("weights need a value for each objective")


def _note(code: str, message: str, **more) -> dict:
    return {"code": code, "message": message, **more}


def _header(run_id: str, params: Params, metrics: list[Metric]) -> dict:
    return {"run_id": run_id, "objectives": params.objectives, "metrics": [m.as_dict() for m in metrics], "roles_hash": definitions_hash(metrics), "params": asdict(params)}


def compute(builds: DataFrame, metrics: list[Metric] | None = None, params: Params | None = None, run_id: str = "r-0", warnings: list[dict] | None = None) -> dict:
    """The analysis of typed builds (prepare.derive's columns)."""
    params, metrics = params or Params(), list(metrics or DEFAULTS)
    refused = _early(run_id, params, metrics)
    if refused:
        return refused
    kept, dropped = prepare.windows_of(builds, params.windows_retained)
    if kept:  # read for the gate, cells, replicates and levels: what builds are made of is joined once
        builds = cut(builds.filter(prepare.within(kept)))
    gate = prepare.derive_gate(builds, params.as_of, params.u, params.windows_retained, params.baseline, params.L_days)
    gate.dropped = dropped
    warnings = list(warnings or [])
    if gate.dropped:
        warnings.append(_note("WINDOWS_DROPPED", f"older than the {len(gate.windows)} newest windows: {', '.join(gate.dropped)}"))
    prepared = prepare.classify(builds, gate)
    used = [m for m in metrics if m.role == "descriptor" or m.name in params.objectives]
    objectives = by_name(metrics, params.objectives)
    cells = cut(build_cells(prepared, used))
    smallest = cells.agg(F.min("n_builds")).first()[0]
    replicates = None
    cautions = []
    if params.bootstrap and smallest is not None and smallest >= 2:
        replicates = cut(uncertainty.bootstrap(prepared, objectives, params.bootstrap, params.seed))
    elif params.bootstrap:
        cautions.append(_note("UNCERTAINTY_UNAVAILABLE", "a cell has a single build, which cannot be resampled"))
    out = _analyse(run_id, params, metrics, cells, objectives, replicates, gate.as_dict(), warnings, cautions)
    out["sensitivity"] = _sensitivity(builds, gate)
    return out


def compute_aggregate(cells: DataFrame, metrics: list[Metric], params: Params, run_id: str = "r-0", warnings: list[dict] | None = None) -> dict:
    """The analysis of cells that came aggregated (sources.aggregate's columns)."""
    refused = _early(run_id, params, metrics)
    if refused:
        return refused
    objectives = by_name(metrics, params.objectives)
    names = [m.name for m in objectives]
    for c, kind in (("n_sources", "long"), ("gate_unavailable_share", "double"), ("unclassified_share", "double")):
        cells = cells.withColumn(c, F.lit(None).cast(kind))
    cells = cut(cells)
    cautions, replicates = [], None
    have = [f"{n}_se" in cells.columns for n in names]
    missing = not all(have) or cells.filter(D.either(F.col(f"{n}_se").isNull() for n in names)).limit(1).count() > 0
    if params.bootstrap and not missing:
        replicates = cut(uncertainty.parametric(cells, names, params.bootstrap, params.seed))
    elif params.bootstrap:
        cautions.append(_note("UNCERTAINTY_UNAVAILABLE", "a cell lacks a standard error"))
    out = _analyse(run_id, params, metrics, cells, objectives, replicates, None, list(warnings or []), cautions)
    out["sensitivity"] = {"available": False, "reason": "aggregate cells carry no builds"}
    return out


def _early(run_id: str, params: Params, metrics: list[Metric]) -> dict | None:
    """Refusals that need no data."""
    params.check()
    objectives = by_name(metrics, params.objectives)
    wrong = [m.name for m in objectives if m.role != "objective"]
    if wrong:
        raise ValueError(f"not an objective: {', '.join(wrong)}")
    m = len(objectives)
    code = "TOO_MANY_OBJECTIVES" if m > K.MOST_OBJECTIVES else "TOO_FEW_OBJECTIVES" if m < K.LEAST_OBJECTIVES else None
    if not code:
        return None
    read = readings(objectives)
    return {
        "run": _header(run_id, params, metrics), "stage0": {"overlaps": told(read), "greyed": greyed(read)}, "cells": [], "comparisons": [], "windows": [], "groups": [], "gate": None,
        "diagnostics": {"refusals": [_note(code, f"{m} objectives; from {K.LEAST_OBJECTIVES} to {K.MOST_OBJECTIVES} are allowed")], "cautions": [], "warnings": []},
    }


def _rows(df: DataFrame) -> list[dict]:
    """Cell-level rows only."""
    return [r.asDict() for r in df.collect()]


def _by(rows: list[dict], *keys: str) -> dict:
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]].append(r)
    return out


def _analyse(run_id, params: Params, metrics, cells: DataFrame, objectives: list[Metric], replicates: DataFrame | None, gate, warnings, cautions) -> dict:
    names = [m.name for m in objectives]
    norms = [f"{n}_norm" for n in dict.fromkeys(names)]
    names = list(dict.fromkeys(names))
    objectives = by_name(objectives, names)
    m = len(names)
    cells = cut(ranked(scaled(cells, objectives), objectives).withColumn("label", F.concat_ws("/", *KEYS)))
    table = sorted(_rows(cells), key=lambda r: (r["grp"], r["win"]))
    groups, windows = sorted({r["grp"] for r in table}), sorted({r["win"] for r in table})
    small = [r["label"] for r in table if r["n_builds"] < params.min_builds]
    if small:
        cautions.append(_note("BELOW_BUILD_FLOOR", f"{len(small)} cell(s) under {params.min_builds} builds are reported, not plotted", cells=small))
    loose = [r["label"] for r in table if r["unclassified_share"]]
    if loose:
        cautions.append(_note("QUESTION_UNCLASSIFIED", "builds outside the question classes", cells=loose))
    if len(groups) > K.CUBE_GROUPS or len(windows) > K.CUBE_WINDOWS + K.CUBE_SLACK:
        cautions.append(_note("CUBE_CLUTTER_CAP", f"{len(groups)} groups and {len(windows)} windows are more than the cube shows"))

    # stages 2 and 3
    series = {n: F.col(f"{n}_rank") for n in names}
    right = series | {f"share({c})": F.col(f"share_{c}") for c in (*K.IMPACT_CLASSES, *K.QUESTION_CLASSES)}
    right |= {x.name: F.col(x.name) for x in metrics if x.role == "descriptor" and x.name in cells.columns}
    taus = {(r["a"], r["b"]): r["tau"] for r in _rows(screen.conflict_screen(cells, list(KEYS), series, right))}
    pairs = {(a, b): taus.get((a, b)) for i, a in enumerate(names) for b in names[i + 1 :]}
    verdicts = [{"a": a, "b": b, "tau": t, "verdict": "redundant" if abs(t) >= K.REDUNDANT_TAU else "conflicting" if t <= K.CONFLICTING_TAU else "independent"} for (a, b), t in pairs.items() if t is not None]
    plotted = cells.filter(F.col("n_builds") >= params.min_builds)
    moss = screen_moss(plotted, names, norms)

    # comparisons
    across = plotted.withColumns({"kind": F.lit("across_groups"), "comparison": F.concat(F.lit("across:"), "win")})
    within = plotted.withColumns({"kind": F.lit("within_group"), "comparison": F.concat(F.lit("within:"), "grp")})
    members = cut(within if len(groups) == 1 else across.unionByName(within))
    known = D.both(F.col(c).isNotNull() for c in norms)
    facts = _rows(members.groupBy("kind", "comparison").agg(F.count_if(known).alias("complete"), F.array_sort(F.collect_list("label")).alias("labels")))
    lead = {r["comparison"]: r for r in _rows(movement.lead_time_check(members.withColumn("n_sources", F.coalesce("n_sources", F.lit(0))), ["comparison"]))}
    reads_lead = any("lead_time_days" in x.formula.reads.columns for x in objectives)
    comparisons, drawn = [], []
    for f in sorted(facts, key=lambda r: (r["kind"], r["comparison"])):
        c = {"kind": f["kind"], "label": f["comparison"].split(":", 1)[1], "id": f["comparison"], "cells": f["labels"], "objectives": names, "refusals": [], "cautions": []}
        if reads_lead and f["kind"] == "across_groups":
            check = lead[f["comparison"]]
            if check["mixed_cells"]:
                c["cautions"].append(_note("MIXED_LEAD_TIME_SOURCE", f"{check['mixed_cells']} cell(s) measure some builds to use and some to deployment"))
            if check["divergent"]:
                entry = _note("DIVERGENT_LEAD_TIME_SOURCE", f"shares measured to deployment differ by {check['spread']:.0%}", spread=check["spread"])
                c["cautions" if params.allow_mixed_lead_time else "refusals"].append(entry)
        if f["complete"] < m + 1:
            c["refusals"].append(_note("TOO_FEW_CELLS", f"{f['complete']} complete cells for {m} objectives"))
        elif f["complete"] < 2 * m:
            c["cautions"].append(_note("PROVISIONAL_FRONT", f"{f['complete']} complete cells for {m} objectives"))
        if c["refusals"]:
            c["front_not_drawn"] = True
        else:
            c["n"] = f["complete"]
            drawn.append(f["comparison"])
        comparisons.append(c)
    if drawn:
        _fronts({c["id"]: c for c in comparisons}, members.filter(F.col("comparison").isin(*drawn)), names, norms, params, replicates)

    # stage 7
    across_rows = [(c["label"], x.split("/", 1)[0], x in c["front"]) for c in comparisons if c["kind"] == "across_groups" and not c.get("front_not_drawn") for x in c["cells"] if c["layers"].get(x) is not None]
    persist = {g: {"windows_on_front": sum(on for _, h, on in across_rows if h == g), "windows_considered": sum(h == g for _, h, _ in across_rows)} for g in groups}
    best_layer, best_p = {}, {}
    for c in comparisons:
        if c["kind"] == ("within_group" if len(groups) == 1 else "across_groups") and not c.get("front_not_drawn"):
            best_layer |= c["layers"]
            best_p |= c["p_on_front"]
    read = readings(objectives)
    return {
        "run": _header(run_id, params, metrics), "schema": 2, "gate": gate, "windows": windows, "groups": groups, "self_comparison": len(groups) == 1,
        "stage0": {"overlaps": told(read), "greyed": greyed(read)},
        "stage2": {"taus": {f"{a}|{b}": t for (a, b), t in taus.items() if a != b}, "verdicts": verdicts, "axis_order": screen.axis_order(names, pairs)},
        "stage3": {"reduction": screen.reduction(names, pairs), "delta_moss": moss},
        "stage7": {"persistence": persist, "direction_of_travel": _rows(movement.travel(plotted, norms)), "mix_movement": _rows(movement.mix_movement(plotted))},
        "comparisons": comparisons,
        "cells": [_cell(r, names, metrics, best_layer, best_p, params) for r in table],
        "diagnostics": {"refusals": [{**r, "comparison": c["id"]} for c in comparisons for r in c["refusals"]], "cautions": cautions + [{**x, "comparison": c["id"]} for c in comparisons for x in c["cautions"]], "warnings": warnings},
    }


def screen_moss(plotted: DataFrame, names: list[str], norms: list[str]) -> dict:
    rows = _rows(D.delta_subsets(plotted, [], norms)) if len(names) <= K.MOST_OBJECTIVES else []
    return {"available": bool(rows), **(D.moss_ladder(rows, names) if rows else {})}


def _cell(r: dict, names: list[str], metrics: list[Metric], layer: dict, p: dict, params: Params) -> dict:
    return {
        "label": r["label"], "group": r["grp"], "window": r["win"], "n_builds": r["n_builds"], "plotted": r["n_builds"] >= params.min_builds,
        "objectives": {n: r[n] for n in names}, "objectives_norm": {n: r[f"{n}_norm"] for n in names}, "objectives_rank": {n: r[f"{n}_rank"] for n in names},
        "descriptors": {m.name: r[m.name] for m in metrics if m.role == "descriptor" and m.name in r},
        "impact_mix": {c: r[f"share_{c}"] for c in K.IMPACT_CLASSES}, "question_mix": {c: r[f"share_{c}"] for c in K.QUESTION_CLASSES},
        "unclassified_share": r["unclassified_share"], "lead_time_fallback_share": r["fallback_share"], "gate_unavailable_share": r["gate_unavailable_share"],
        "layer": layer.get(r["label"]), "p_on_front": p.get(r["label"]), "notes": [n for m in metrics for n in r.get(f"note_{m.name}") or []],
    }


def _fronts(by_id: dict[str, dict], members: DataFrame, names: list[str], norms: list[str], params: Params, replicates: DataFrame | None) -> None:
    """Stages 4 to 6 of all drawn comparisons, filled into their entries."""
    on, m = ["comparison"], len(names)
    members = cut(members)
    for r in _rows(D.layers(members, on, ["label"], norms)):
        by_id[r["comparison"]].setdefault("layers", {})[r["label"]] = r["layer"]
    for c in by_id.values():
        if "layers" in c:
            c["front"] = sorted(x for x, k in c["layers"].items() if k == 1)
            c["degeneracy_layer1_fraction"] = len(c["front"]) / c["n"]
            c |= {"null_model": {"available": False, "reason": "fewer than 3 complete cells"}, "p_on_front": {x: None for x in c["cells"]}, "probabilistic_dominance": {}, "relaxation_ladder": {}, "level_diagram": {}, "attainment": {}}
    if params.permutations:
        sizes = screen.permuted_fronts(members, on, ["label"], norms, params.permutations, params.seed)
        n = D.complete(members, norms).groupBy(*on).agg(F.count("*").alias("n"))
        for r in _rows(screen.null_model(cut(sizes), on, n, m)):
            by_id[r.pop("comparison")]["null_model"] = {"available": True, "replicates": params.permutations, **r}
    epsilon = None
    if replicates is not None:
        drawn = replicates.join(F.broadcast(members.select(*KEYS, "comparison", "label")), list(KEYS))  # a row a cell and comparison
        drawn = cut(drawn)
        for r in _rows(uncertainty.p_on_front(drawn, on, ["label"], names)):
            by_id[r["comparison"]]["p_on_front"][r["label"]] = r["p_on_front"]
        for r in _rows(uncertainty.dominance_rates(drawn, on, "label", names)):
            by_id[r["comparison"]]["probabilistic_dominance"].setdefault(r["a"], {})[r["b"]] = r["rate"]
        some = drawn.filter(F.col("rep") <= K.ATTAINMENT_REPLICATES)
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                for r in sorted(_rows(uncertainty.attainment(some, on, x, y)), key=lambda r: r["x"]):
                    by_id[r.pop("comparison")]["attainment"].setdefault(f"{x}|{y}", []).append(r)
        if params.epsilon_source == "bootstrap":
            own = uncertainty.epsilons(drawn, on, ["label"], names)
            pooled = uncertainty.epsilons(drawn.withColumn("_all", F.lit(0)), ["_all"], ["label"], names).drop("_all").withColumnsRenamed({n: f"_p_{n}" for n in names})
            epsilon = members.select("comparison").distinct().join(own, on, "left").crossJoin(F.broadcast(pooled)).select("comparison", *[F.coalesce(n, f"_p_{n}").alias(f"_eps_{n}") for n in names])
    if params.epsilon_source == "manual":
        epsilon = members.select("comparison").distinct().select("comparison", *[F.lit(float(e)).alias(f"_eps_{n}") for n, e in zip(names, params.epsilon_manual)])
    ladder = lambda c: by_id[c]["relaxation_ladder"]
    if epsilon is not None:
        epsilon = cut(epsilon)
        for r in _rows(epsilon):
            ladder(r["comparison"])["epsilon_dominance"] = {"epsilon": {n: r[f"_eps_{n}"] for n in names}, "epsilon_source": params.epsilon_source, "front": []}
        boxed = D.epsilon_front(members.join(F.broadcast(epsilon), on), on, norms, {c: F.col(f"_eps_{n}") for n, c in zip(names, norms)})
        for r in _rows(boxed.select("comparison", "label")):
            ladder(r["comparison"])["epsilon_dominance"]["front"].append(r["label"])
    sweep = None
    for k in range(m, 1, -1):
        one = D.k_front(members, on, norms, k).select(F.lit(k).alias("k"), "comparison", "label")
        sweep = one if sweep is None else sweep.unionByName(one)
    fronts = _by(_rows(sweep), "comparison", "k")
    edges = None
    for k in range(m, 1, -1):
        one = D.k_edges(members, on, "label", norms, k).withColumn("k", F.lit(k))
        edges = one if edges is None else edges.unionByName(one)
    loops = _by(_rows(D.cycles(edges, ["comparison", "k"])), "comparison", "k")
    ids = [c for c, x in by_id.items() if "layers" in x]
    for c in ids:
        steps = []
        for k in range(m, 1, -1):
            cycle = _by(loops.get((c, k), []), "cycle")
            steps.append({"k": k, "front": sorted(r["label"] for r in fronts.get((c, k), [])), "cycles": [sorted(r["member"] for r in v) for v in cycle.values()]})
        ladder(c)["k_dominance"] = {"sweep": steps}
        ladder(c)["skyline_frequency"] = {"subspaces": 2**m - 1, "scores": {}}
        ladder(c)["weighted_sum"] = {"weights": dict(zip(names, params.weights or [1 / m] * m)), "scores": {}, "average_rank": {}}
        ladder(c)["knees"] = {"available": False, "reason": "fewer than 3 cells on the front"}
    for r in _rows(D.skyline_frequency(members, on, ["label"], norms)):
        ladder(r["comparison"])["skyline_frequency"]["scores"][r["label"]] = r["frequency"]
    for r in _rows(D.weighted(members, on, ["label"], norms, [f"{n}_rank" for n in names], params.weights)):
        w = ladder(r["comparison"])["weighted_sum"]
        w["scores"][r["label"]], w["average_rank"][r["label"]] = r["weighted_sum"], r["average_rank"]
    knees = D.knee_2d(members, on, ["label"], *norms).withColumnsRenamed({"bend": "score"}).withColumn("method", F.lit("bend angle")) if m == 2 else D.knee_plane(members, on, "label", norms)
    for c, rows in _by(_rows(knees), "comparison").items():
        best = max(sorted(rows, key=lambda r: r["label"]), key=lambda r: r["score"])
        ladder(c)["knees"] = {"available": True, "method": best["method"], "scores": {r["label"]: r["score"] for r in rows}, "knee": best["label"], "marginal_utility": {}}
    for r in _rows(uncertainty.marginal_utility(members, on, ["label"], norms, seed=params.seed)):
        ladder(r["comparison"])["knees"].setdefault("marginal_utility", {})[r["label"]] = r["utility"]
    for r in _rows(D.distance_to_ideal(members, on, ["label"], norms)):
        by_id[r["comparison"]]["level_diagram"][r["label"]] = {k: r[k] for k in ("l1", "l2", "linf")}
    for r in _rows(D.hypervolume(members, on, norms, seed=params.seed)):
        by_id[r["comparison"]]["hypervolume"] = {"value": r["hypervolume"], "method": r["method"], "points_used": r["points"], "reference_point": K.HV_REFERENCE}


def _sensitivity(builds: DataFrame, gate: prepare.Gate) -> dict:
    if gate.u is None:
        return {"available": False, "reason": gate.u_source}
    rows = _rows(prepare.sensitivity(builds, gate, K.SENSITIVITY))
    levels: dict[str, dict] = {}
    for r in rows:
        levels.setdefault(r["level"], {})[f"{r['grp']}/{r['win']}"] = {c: r[f"share_{c}"] for c in K.IMPACT_CLASSES}
    overall = {}
    for level, rs in _by(rows, "level").items():
        n = sum(r["n_builds"] for r in rs)
        overall[level] = {c: sum(r[f"share_{c}"] * r["n_builds"] for r in rs) / n for c in K.IMPACT_CLASSES}
    flips = []
    for label in sorted(levels.get("u", {})):
        for part in K.IMPACT_CLASSES:
            values = [levels[x][label][part] for x, _ in K.SENSITIVITY]
            if max(values) - min(values) >= K.FLIP:
                flips.append({"cell": label, "part": part, "values": values})
    return {"available": True, "u_source": gate.u_source, "overall": overall, "levels": levels, "flips": flips, "verdict": "PROVISIONAL" if flips else "STABLE"}


def analyse_view(spark: SparkSession, sf_dir: str) -> dict:
    """The analysis of the builds view, with few replicates."""
    from ..sources import views

    params = Params(as_of=views.AS_OF, min_builds=1, bootstrap=20, permutations=50, allow_mixed_lead_time=True)
    return compute(views.builds(spark, sf_dir), list(DEFAULTS), params, "r-view")


def now() -> datetime:
    return datetime.now(timezone.utc)
