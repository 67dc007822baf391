"""Command line: `millrace cells ...` for builds, `millrace tail ...` for commits and sessions.

Exit codes: 0 done, 1 something was refused, 2 an error.
"""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys

from pyspark.sql import functions as F

from .. import __version__
from .. import constants as K
from ..functions.formula import Formula, FormulaError
from ..functions.metrics import DEFAULTS
from ..session import session
from .analysis import Params
from .commands import Workbench, parse_time
from .report import summary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="engine", required=True)
    s = sub.add_parser("cells").add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = s.add_parser(name)
        c.add_argument("--db", help="folder of the store; .millrace here, or in the home folder with --global, if there is one")
        c.add_argument("--global", dest="home", action="store_true")
        return c

    c = command("ingest")
    c.add_argument("csv")
    c.add_argument("--source")
    c = command("define")
    for a in ("--name", "--role", "--direction", "--expression"):
        c.add_argument(a, required=True)
    c.add_argument("--notes", default="")
    c = command("list")
    c.add_argument("what", choices=("metrics", "groups", "windows", "runs"))
    c = command("compute")
    for a in ("--builds", "--cells", "--metrics", "--out", "--as-of", "--baseline"):
        c.add_argument(a)
    c.add_argument("--groups", nargs="*")
    c.add_argument("--objectives", nargs="*", default=list(K.DEFAULT_OBJECTIVES))
    c.add_argument("--window", default=K.WINDOW_SPEC, choices=("week", "month", "quarter"))
    c.add_argument("--windows-retained", type=int, default=K.WINDOWS_RETAINED)
    c.add_argument("--resolution-days", type=int, default=K.RESOLUTION_DAYS)
    c.add_argument("--u", type=float)
    c.add_argument("--min-builds", type=int, default=K.MIN_BUILDS)
    c.add_argument("--bootstrap", type=int, default=K.BOOTSTRAP)
    c.add_argument("--permutations", type=int, default=K.PERMUTATIONS)
    c.add_argument("--seed", type=int, default=K.SEED)
    c.add_argument("--epsilon-source", default="bootstrap", choices=("bootstrap", "manual", "none"))
    c.add_argument("--epsilon", type=float, nargs="*")
    c.add_argument("--weights", type=float, nargs="*")
    c.add_argument("--allow-mixed-lead-time", action="store_true")
    c.add_argument("--no-save", action="store_true")
    c = command("render")
    c.add_argument("run", nargs="?")
    c.add_argument("--out", required=True)
    c = command("explain")
    c.add_argument("--cell", required=True)
    c.add_argument("--run")
    c = command("diff")
    c.add_argument("a")
    c.add_argument("b")
    c = s.add_parser("check")
    c.add_argument("expression")
    c = s.add_parser("fixture")
    c.add_argument("name", choices=("ground_truth", "degeneracy", "overlap", "threshold"))
    c.add_argument("--out", required=True)
    c.add_argument("--metrics", help="also write the shipped definitions here")
    t = sub.add_parser("tail")
    t.add_argument("--repo", default=".")
    for a in ("--since", "--until", "--deploys", "--archive", "--sessions", "--prices", "--cost", "--out"):
        t.add_argument(a)
    t.add_argument("--quiet-days", type=int, default=K.QUIET_DAYS)
    t.add_argument("--sweep", default=",".join(map(str, K.SWEEP)))
    t.add_argument("--front", nargs="*", help="earlier runs to compare")
    return p


def params_of(a: argparse.Namespace) -> Params:
    return Params(a.objectives, a.window, a.windows_retained, a.resolution_days, a.u, parse_time(a.as_of), a.baseline, a.min_builds, a.bootstrap, a.permutations, a.seed, a.epsilon_source, a.epsilon, a.allow_mixed_lead_time, a.weights)


def _show(x) -> None:
    print(json.dumps(x, indent=2, default=str))


def _store_path(a: argparse.Namespace) -> str | None:
    """The folder that was named; else .millrace, where it exists or something is to be stored."""
    if a.db:
        return a.db
    path = os.path.join(os.path.expanduser("~") if a.home else ".", ".millrace")
    return path if os.path.isdir(path) or a.home or a.command in ("ingest", "define") else None


def _fixture(a: argparse.Namespace) -> None:
    from ..sources import fixtures

    getattr(fixtures, a.name)(session()).toPandas().to_csv(a.out, index=False)
    if a.metrics:
        with open(a.metrics, "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f)
            w.writerow(["name", "role", "direction", "expression", "version", "notes"])
            w.writerows([m.name, m.role, m.direction, m.expression, m.version, m.notes] for m in DEFAULTS)


def on_cells(a: argparse.Namespace) -> int:
    if a.command == "check":
        _show(Formula("expression", a.expression).reads.as_dict())
        return 0
    if a.command == "fixture":
        _fixture(a)
        return 0
    bench = Workbench(session(), _store_path(a))
    match a.command:
        case "ingest":
            got = bench.ingest_csv(a.csv, a.source)
            _show(got)
            return 1 if got["conflict"] or got["rejected"] else 0
        case "define":
            _show(bench.define(a.name, a.role, a.direction, a.expression, a.notes))
        case "list":
            store = bench._need_store()
            _show({"metrics": lambda: [m.as_dict() for m in bench.metrics()], "groups": store.groups, "windows": lambda: bench.windows(Params()), "runs": store.list_runs}[a.what]())
        case "compute":
            got = bench.compute(params_of(a), a.builds, a.cells, a.metrics, a.groups, not a.no_save)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    json.dump(got, f, default=str)
            print(summary(got))
            return 1 if got["diagnostics"]["refusals"] else 0
        case "render":
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(bench.render(a.run))
        case "explain":
            _show(bench.explain(a.cell, a.run))
        case "diff":
            _show(bench.diff(a.a, a.b))
    return 0


def tail_run(spark, a: argparse.Namespace) -> dict:
    """The sweep over thresholds of one repository, with spend, outcomes and fan-out where their files are given."""
    from ..operators import sessions as S
    from ..operators import tail as T
    from ..session import cut
    from ..sources import files

    commits = cut(files.read_git_log(spark, a.repo, a.since, a.until))
    ends = commits.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["last"] is None:
        raise ValueError("no commits in the window")
    events = files.read_deploys(spark, a.deploys) if a.deploys else spark.createDataFrame([], "at timestamp, hint string")
    sweep = tuple(int(x) for x in a.sweep.split(","))
    results = cut(T.analyse(commits, events, sweep, a.quiet_days))
    curve = cut(T.survival(results, ["threshold"]))
    out: dict = {"window": {"first": ends["first"].isoformat(), "last": ends["last"].isoformat()}, "workflow": "unknown: needs --archive", "t0": a.deploys or "none supplied: every cluster is unattributed", "quiet_days": a.quiet_days, "sweep": {}}
    curves: dict[int, list] = {}
    for r in curve.orderBy("threshold", "t").collect():
        curves.setdefault(r["threshold"], []).append([r["t"], round(r["survival"], 4)])
    for r in T.summary(results, curve, ["threshold"]).collect():
        row = r.asDict()
        t = row.pop("threshold")
        out["sweep"][str(t)] = row | {"shipped_capability_count": row["clusters_resolved"], "survival_curve": curves.get(t, [])}
    if a.archive:
        parts = files.read_archive(spark, a.archive)
        label = [r["workflow"] for r in S.workflows(parts["archetypes"]).collect()]
        out["workflow"] = label[0] if label else "mixed"
        out["never_landed"] = [r.asDict() for r in S.never_landed(parts["outcomes"]).collect()]
        if a.prices:
            out["agent_spend"] = [r.asDict() for r in S.agent_spend(parts["tokens"], files.read_prices(spark, a.prices)).collect()]
        else:
            out["agent_spend"] = [{"status": "unpriced: needs --prices", **r.asDict()} for r in parts["tokens"].groupBy("model").agg(F.sum("tokens").alias("tokens")).collect()]
    if a.sessions:
        rows, unit = files.read_sessions(spark, a.sessions)
        out["fanout"] = {"unit": unit, **S.fanout(rows, S.session_roots(rows)).first().asDict()}
    return out


def tail_front(spark, a: argparse.Namespace) -> dict:
    """Which of several earlier runs no other beats, at how many of the thresholds they share."""
    from ..operators import tail as T
    from ..sources import files

    runs = files.read_runs(spark, a.front)
    if len(runs) < 2:
        raise ValueError("a frontier needs at least two runs")
    costs = {r["label"]: r for r in files.read_costs(spark, a.cost).collect()} if a.cost else {}
    rows = []
    for r in runs:
        for t, s in r["sweep"].items():
            cost = costs.get(r["label"])
            rows.append((r["label"], int(t), int(s["shipped_capability_count"]), s["never_stabilises_share"], int(s.get("churn_total") or 0), parse_time(r["window"]["first"]), parse_time(r["window"]["last"]), cost["dollars"] if cost else None, cost["engineer_months"] if cost else None))
    df = spark.createDataFrame(rows, "label string, threshold int, delivered long, never_stabilises_share double, churn_total long, first_at timestamp, last_at timestamp, dollars double, engineer_months double")
    every = [r.asDict() for r in T.flow_frontier(df).orderBy(F.desc("wins"), "label").collect()]
    if not every or not every[0]["thresholds"]:
        raise ValueError("the runs share no threshold")
    got = [r for r in every if r["used"]]
    by = {s: sorted(r["label"] for r in got if r["standing"] == s) for s in ("always", "sometimes")}
    return {"flows": got, "note": T.frontier_note(got), **by, "skipped": {r["label"]: r["why"] for r in every if r["skipped"]}}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.engine == "cells":
            return on_cells(a)
        spark = session()
        got = tail_front(spark, a) if a.front else tail_run(spark, a)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                json.dump(got, f, default=str)
        _show(got)
        return 0
    except (FormulaError, ValueError, KeyError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
