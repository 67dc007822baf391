"""Findings as rows, and one self-contained HTML page.  Nothing is computed here; nulls are gaps."""

from __future__ import annotations

import html
import json

from .. import constants as K


def findings(analysis: dict) -> list[tuple[str, str, str, str]]:
    """(kind, comparison, subject, value) of everything the page says, in a form to compare runs by."""
    out = [("axis_order", "", str(i), n) for i, n in enumerate(analysis.get("stage2", {}).get("axis_order", []))]
    out += [("overlap", "", o["metric"], o["line"]) for o in analysis["stage0"]["overlaps"]]
    out += [("conflict", "", f"{v['a']}|{v['b']}", v["verdict"]) for v in analysis.get("stage2", {}).get("verdicts", [])]
    for c in analysis["comparisons"]:
        if c.get("front_not_drawn"):
            out += [("refused", c["id"], r["code"], r["message"]) for r in c["refusals"]]
            continue
        out += [("front", c["id"], x, "on") for x in c["front"]]
        out.append(("null_model", c["id"], "verdict", c["null_model"].get("verdict", "unavailable")))
        out.append(("hypervolume", c["id"], "value", f"{c['hypervolume']['value']:.6f}"))
        if c["relaxation_ladder"]["knees"].get("knee"):
            out.append(("knee", c["id"], c["relaxation_ladder"]["knees"]["knee"], c["relaxation_ladder"]["knees"]["method"]))
    for g, p in analysis.get("stage7", {}).get("persistence", {}).items():
        out.append(("persistence", "", g, f"{p['windows_on_front']}/{p['windows_considered']}"))
    for t in analysis.get("stage7", {}).get("direction_of_travel", []):
        out.append(("travel", t["grp"], f"{t['from_win']}->{t['to_win']}", t["reading"]))
    out.append(("sensitivity", "", "verdict", analysis.get("sensitivity", {}).get("verdict", "unavailable")))
    for level in ("refusals", "cautions", "warnings"):
        out += [(level[:-1], d.get("comparison", ""), d["code"], d["message"]) for d in analysis["diagnostics"][level]]
    return out


def _e(x) -> str:
    return html.escape("" if x is None else f"{x:.3g}" if isinstance(x, float) else str(x))


def _table(head: list[str], rows: list[list]) -> str:
    return "<table><tr>" + "".join(f"<th>{_e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{_e(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>"


def _section(title: str, body: str) -> str:
    return f"<section><h2>{_e(title)}</h2>{body}</section>"


def _x(v: float) -> float:
    return round(20 + 260 * v / K.HV_REFERENCE, 1)


def _y(v: float) -> float:
    return round(280 - 260 * v / K.HV_REFERENCE, 1)


def _pair(cells: list[dict], front: set[str], a: str, b: str) -> str:
    """A scatter of two scaled objectives with the staircase of the least b so far."""
    points = sorted((c["objectives_norm"][a], c["objectives_norm"][b], c["label"]) for c in cells if c["objectives_norm"][a] is not None and c["objectives_norm"][b] is not None)
    steps, low = [], None
    for x, y, _ in points:
        if low is None or y < low:
            if low is not None:
                steps.append((x, low))
            steps.append((x, y))
            low = y
    line = " ".join(f"{_x(x)},{_y(y)}" for x, y in steps)
    dots = "".join(f'<circle cx="{_x(x)}" cy="{_y(y)}" r="{6 if label in front else 3}"><title>{_e(label)}</title></circle>' for x, y, label in points)
    return f'<figure><svg viewBox="0 0 300 300" width="300"><polyline points="{line}" fill="none" stroke="currentColor"/>{dots}</svg><figcaption>{_e(a)} against {_e(b)}</figcaption></figure>'


def _parallel(cells: list[dict], order: list[str], front: set[str]) -> str:
    gap = 260 / max(1, len(order) - 1)
    lines = []
    for c in cells:
        run: list[str] = []
        for i, n in enumerate(order):
            v = c["objectives_norm"][n]
            if v is None:  # a gap, not a zero
                lines.append((run, c["label"]))
                run = []
            else:
                run.append(f"{20 + gap * i:.1f},{_y(v)}")
        lines.append((run, c["label"]))
    drawn = "".join(f'<polyline points="{" ".join(r)}" fill="none" stroke="currentColor" stroke-width="{2 if label in front else 0.5}"><title>{_e(label)}</title></polyline>' for r, label in lines if len(r) > 1)
    return f'<svg viewBox="0 0 300 300" width="300">{drawn}</svg>'


def _cube(cells: list[dict], order: list[str]) -> str:
    """Paths of the groups through three objectives, drawn isometrically."""
    if len(order) < 3:
        return "<p>needs three objectives</p>"
    groups = sorted({c["group"] for c in cells})[: K.CUBE_GROUPS]
    out = []
    for g in groups:
        run = []
        for c in sorted((c for c in cells if c["group"] == g), key=lambda c: c["window"])[-K.CUBE_WINDOWS :]:
            v = [c["objectives_norm"][n] for n in order[:3]]
            if None not in v:
                run.append(f"{150 + 110 * (v[0] - v[1]):.1f},{230 + 60 * (v[0] + v[1]) / 2 - 160 * v[2]:.1f}")
        out.append(f'<polyline points="{" ".join(run)}" fill="none" stroke="currentColor"><title>{_e(g)}</title></polyline>')
    return f'<svg viewBox="0 0 300 320" width="300">{"".join(out)}</svg>'


def render(analysis: dict) -> str:
    """The page; cells under the floor and fronts that were refused are not drawn."""
    cells = [c for c in analysis["cells"] if c["plotted"]]
    order = analysis.get("stage2", {}).get("axis_order", [])
    parts = [_section("Diagnostics", _table(["level", "code", "comparison", "message"], [[k[:-1], d["code"], d.get("comparison"), d["message"]] for k in ("refusals", "cautions", "warnings") for d in analysis["diagnostics"][k]]))]
    by_label = {c["label"]: c for c in cells}
    for c in analysis["comparisons"]:
        if c.get("front_not_drawn"):
            parts.append(_section(f"{c['kind']} {c['label']}", "<p>No front drawn: " + _e("; ".join(r["message"] for r in c["refusals"])) + "</p>"))
            continue
        mine, front = [by_label[x] for x in c["cells"] if x in by_label], set(c["front"])
        figures = "".join(_pair(mine, front, a, b) for i, a in enumerate(order) for b in order[i + 1 :])
        ladder = c["relaxation_ladder"]
        rows = [[x, c["layers"].get(x), c["p_on_front"].get(x), ladder["skyline_frequency"]["scores"].get(x), ladder["weighted_sum"]["scores"].get(x), c["level_diagram"].get(x, {}).get("l2")] for x in c["cells"]]
        body = figures + _parallel(mine, order, front) + _table(["cell", "layer", "P(on front)", "skyline frequency", "weighted sum", "distance to ideal"], rows)
        body += _table(["k", "front", "cycles"], [[s["k"], ", ".join(s["front"]), "; ".join(",".join(x) for x in s["cycles"])] for s in ladder["k_dominance"]["sweep"]])
        parts.append(_section(f"{c['kind']} {c['label']} - {c['null_model'].get('verdict', 'no null model')}", body))
    groups, windows = analysis["groups"], analysis["windows"]
    on = {x for c in analysis["comparisons"] if c["kind"] == "across_groups" for x in c.get("front", [])}
    parts.append(_section("Membership", _table(["group", *windows], [[g, *["front" if f"{g}/{w}" in on else "" for w in windows]] for g in groups])))
    parts.append(_section("Compositions", _table(["cell", *K.IMPACT_CLASSES], [[c["label"], *[c["impact_mix"][p] for p in K.IMPACT_CLASSES]] for c in cells])))
    moves = analysis.get("stage7", {})
    parts.append(_section("Mix movement", _table(["group", "from", "to", "Aitchison", "top ratio"], [[r["grp"], r["from_win"], r["to_win"], r["distance"], r["top_ratio"]] for r in moves.get("mix_movement", [])])))
    parts.append(_section("Travel", _cube(cells, order) + _table(["group", "from", "to", "angle", "reading"], [[r["grp"], r["from_win"], r["to_win"], r["angle"], r["reading"]] for r in moves.get("direction_of_travel", [])])))
    s = analysis.get("sensitivity", {})
    parts.append(_section("Threshold sensitivity", _table(["level", *K.IMPACT_CLASSES], [[k, *v.values()] for k, v in s.get("overall", {}).items()]) + f"<p>{_e(s.get('verdict', s.get('reason')))}</p>"))
    data = json.dumps(findings(analysis), default=str).replace("<", "\\u003c")
    style = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px;text-align:left}figure{display:inline-block;margin:0 1em 0 0}"
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{_e(analysis["run"]["run_id"])}</title><style>{style}</style><h1>{_e(analysis["run"]["run_id"])}</h1>{"".join(parts)}<script type="application/json" id="findings">{data}</script></html>'


def summary(analysis: dict) -> str:
    """A few lines for a console."""
    lines = [f"run {analysis['run']['run_id']}: {len(analysis['cells'])} cells, {len(analysis['comparisons'])} comparisons, objectives {', '.join(analysis['run']['objectives'])}"]
    for c in analysis["comparisons"]:
        lines.append(f"  {c['kind']} {c['label']}: " + ("refused: " + "; ".join(r["code"] for r in c["refusals"]) if c.get("front_not_drawn") else f"front {', '.join(c['front'])}; {c['null_model'].get('verdict', 'no null model')}"))
    for k in ("refusals", "cautions", "warnings"):
        lines += [f"  {k[:-1]} {d['code']}: {d['message']}" for d in analysis["diagnostics"][k]]
    return "\n".join(lines)


def reply(analysis: dict) -> dict:
    """A short reply: fronts and diagnostics, and the cells if there are few."""
    out = {"run_id": analysis["run"]["run_id"], "objectives": analysis["run"]["objectives"], "windows": analysis["windows"], "groups": analysis["groups"], "diagnostics": analysis["diagnostics"], "n_cells": len(analysis["cells"])}
    out["comparisons"] = [{k: c.get(k) for k in ("kind", "label", "front", "front_not_drawn")} | {"verdict": c.get("null_model", {}).get("verdict")} for c in analysis["comparisons"]]
    if len(analysis["cells"]) <= K.SUMMARY_CELLS:
        out["cells"] = [{k: c[k] for k in ("label", "n_builds", "objectives", "layer", "p_on_front")} for c in analysis["cells"]]
    return out
