"""What differs between two runs: cells, definitions, parameters, fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_cells(a: DataFrame, b: DataFrame, objectives: list[str], on: tuple[str, ...] = ("grp", "win"), comparable: bool = True) -> DataFrame:
    """on, status (added, removed, changed, same) and delta_<objective>; no deltas where definitions differ."""
    left = a.select(*on, *[F.col(c).alias(f"_a_{c}") for c in objectives], F.lit(True).alias("_a"))
    right = b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in objectives], F.lit(True).alias("_b"))
    both = left.join(right, list(on), "full_outer")
    delta = {c: F.col(f"_b_{c}") - F.col(f"_a_{c}") for c in objectives}
    moved = F.lit(False)
    for c in objectives:
        moved = moved | (F.coalesce(delta[c], F.lit(0.0)) != 0)
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(moved, "changed").otherwise("same")
    return both.select(*on, status.alias("status"), *[(delta[c] if comparable else F.lit(None).cast("double")).alias(f"delta_{c}") for c in objectives])


def diff_runs(a: dict, b: dict) -> dict:
    """Verdict and differences of two stored analyses; any change of a definition makes them NOT COMPARABLE."""
    defs = lambda x: {m["name"]: (m["role"], m["direction"], m["expression"], m["version"]) for m in x["run"]["metrics"]}
    da, db = defs(a), defs(b)
    changed = sorted(n for n in da.keys() | db.keys() if da.get(n) != db.get(n))
    params = {k: [a["run"]["params"].get(k), b["run"]["params"].get(k)] for k in sorted(a["run"]["params"].keys() | b["run"]["params"].keys()) if a["run"]["params"].get(k) != b["run"]["params"].get(k)}
    objectives = a["run"]["objectives"] == b["run"]["objectives"]
    hashes = a["run"]["roles_hash"] == b["run"]["roles_hash"]
    comparable = not changed and objectives and hashes
    ca, cb = ({c["label"]: c for c in x["cells"]} for x in (a, b))
    deltas = {}
    for label in sorted(ca.keys() & cb.keys()):
        deltas[label] = {n: (cb[label]["objectives"][n] - v if comparable and v is not None and cb[label]["objectives"].get(n) is not None else None) for n, v in ca[label]["objectives"].items()}
    fronts = lambda x: {c["label"]: set(c.get("front", [])) for c in x["comparisons"]}
    fa, fb = fronts(a), fronts(b)
    return {
        "verdict": "COMPARABLE" if comparable else "NOT COMPARABLE", "definitions_changed": changed, "objectives_changed": not objectives, "roles_hash_changed": not hashes, "params_changed": params,
        "cells_added": sorted(cb.keys() - ca.keys()), "cells_removed": sorted(ca.keys() - cb.keys()), "deltas": deltas,
        "fronts": {k: {"entered": sorted(fb[k] - fa[k]), "left": sorted(fa[k] - fb[k])} for k in sorted(fa.keys() & fb.keys())},
    }
