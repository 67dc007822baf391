"""Builds with planted truth, made by rule: points on an octant, groups that move in and out, shares that are exact."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import RAW_COLUMNS

MONTHS = ("2025-11", "2025-12", "2026-01", "2026-02", "2026-03", "2026-04")
#: Fixed geometry: group -> (direction on the octant in degrees, radius in the first and last month, builds).
GROUND_TRUTH = {
    "agent-heavy": ((35.0, 40.0), 1.9, 1.0, 18), "legacy-owner": ((35.0, 40.0), 1.1, 1.9, 12), "review-first": ((70.0, 20.0), 1.0, 1.0, 15),
    "contractors": ((70.0, 20.0), 1.35, 1.35, 13), "platform-core": ((20.0, 70.0), 1.0, 1.0, 16),
}


def octant(theta: float, phi: float, r: float) -> tuple[float, float, float]:
    t, p = math.radians(theta), math.radians(phi)
    return r * math.cos(t) * math.cos(p), r * math.cos(t) * math.sin(p), r * math.sin(t)


def to_units(f: tuple[float, float, float]) -> tuple[float, float, float]:
    """Cost, lead time in days, defects a thousand lines of a point of the unit sphere."""
    return 150 + 900 * f[0], 1.5 + 22 * f[1], 0.15 + 5 * f[2]


def shares_to_counts(shares: dict[str, float], n: int) -> dict[str, int]:
    """Whole counts that add up to n, by largest remainder, names first on a tie."""
    total = sum(shares.values()) or 1.0
    exact = {k: n * v / total for k, v in shares.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: n - sum(out.values())]:
        out[k] += 1
    return out


def cell(group: str, month: str, n: int, cost: float, lead: float, defects: float, mix: dict[str, float] | None = None, u: float = 1000.0) -> list[dict]:
    """n builds of one cell whose mean cost, median lead time and defect density are as asked, and whose classes have the shares of `mix`."""
    start = datetime.fromisoformat(f"{month}-01").replace(tzinfo=timezone.utc)
    classes = [k for k, c in shares_to_counts(mix or {"impactful": 0.6, "low_impact": 0.2, "liability": 0.1, "sunk": 0.1}, n).items() for _ in range(c)]
    served = sum(k in ("impactful", "low_impact") for k in classes)
    lines = 1000
    bugs = round(defects * n * lines / 1000)
    rows, s = [], 0
    for i, kind in enumerate(classes):
        at = start + timedelta(days=1 + 26 * i / max(1, n), hours=i % 7)
        off = (i - (n - 1) / 2) / n  # adds up to nothing
        row = dict.fromkeys(RAW_COLUMNS)
        row |= {"build_id": f"{group}-{month}-{i:03d}", "group": group, "ts": at.isoformat(), "loc_added": str(lines - 100), "loc_removed": "100", "bugs": str(bugs // n + (i < bugs % n)), "cost_usd": repr(cost * (1 + 0.2 * off)), "question": ("features", "correctness", "performance", "economics")[i % 4]}
        days = lead
        if kind in ("impactful", "low_impact"):
            days = lead * (1 + 0.3 * (s - (served - 1) / 2) / max(1, served))
            s += 1
            row |= {"usage": repr(u * 2 if kind == "impactful" else u / 10), "deployed_at": (at + timedelta(days=1)).isoformat(), "served_at": (at + timedelta(days=2)).isoformat()}
            row["first_commit_ts"] = (at + timedelta(days=2) - timedelta(days=days)).isoformat()
        else:
            if kind == "liability":
                row |= {"usage": "0", "deployed_at": (at + timedelta(days=1)).isoformat()}
            if kind == "carried":
                row["carried_into"] = f"{group}-{month}-000"
            row["first_commit_ts"] = (at - timedelta(days=days)).isoformat()
        rows.append(row)
    return rows


def ground_truth(spark: SparkSession) -> DataFrame:
    """Five groups over six months; latest front: agent-heavy, platform-core, review-first."""
    rows = []
    for group, (direction, first, last, n) in GROUND_TRUTH.items():
        for k, month in enumerate(MONTHS):
            r = first + (last - first) * k / (len(MONTHS) - 1)
            rows += cell(group, month, n, *to_units(octant(*direction, r)))
    return frame(spark, rows)


def censoring(spark: SparkSession, as_of: datetime) -> DataFrame:
    """One group whose last months lie inside the resolution lag."""
    mix = {"impactful": 0.5, "low_impact": 0.5}
    return frame(spark, [r for m in ("2025-12", "2026-01", "2026-02", "2026-03", "2026-04") for r in cell("team", m, 20, 300.0, 5.0, 1.0, mix) if datetime.fromisoformat(r["ts"]) < as_of])


def overlap(spark: SparkSession) -> DataFrame:
    """One group whose wasted share grows month by month."""
    rows = []
    for k, m in enumerate(MONTHS):
        waste = 0.05 + 0.10 * k
        rows += cell("team", m, 40, 300.0 + k, 5.0 + 0.1 * ((k * 3) % 5), 1.0, {"impactful": 1 - waste, "liability": waste / 2, "sunk": waste / 2})
    return frame(spark, rows)


def threshold(spark: SparkSession) -> DataFrame:
    """A group whose usage lies around its median, and a steady one."""
    rows = cell("knife-edge", "2026-04", 20, 300.0, 5.0, 1.0, {"impactful": 1.0})
    for i, r in enumerate(rows):
        r["usage"] = "85" if i % 2 else "115"
    steady = cell("steady", "2026-04", 14, 300.0, 5.0, 1.0, {"impactful": 1.0})
    for i, r in enumerate(steady):
        r["usage"] = "5" if i % 2 else "9000"
    return frame(spark, rows + steady)


def degeneracy(spark: SparkSession) -> DataFrame:
    """Four groups over six months with objectives that have nothing to do with each other."""
    rows, x = [], 12345
    for g in range(4):
        for m in MONTHS:
            v = []
            for _ in range(3):
                x = (x * 48271) % 2147483647
                v.append(x / 2147483647)
            rows += cell(f"g{g}", m, 15, *to_units((v[0], v[1], v[2])))
    return frame(spark, rows)


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], ", ".join(f"`{c}` string" for c in RAW_COLUMNS))
