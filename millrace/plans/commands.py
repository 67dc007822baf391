"""What the command line and the tool server have in common: a store, a run, a rendering, an explanation, a difference."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import DEFAULTS, Metric
from ..operators import prepare
from ..sources import aggregate, files
from ..store import Store
from .analysis import Params, compute, compute_aggregate
from .diff import diff_runs
from .explain import explain_cell
from .report import render


#: Warnings of each code that an analysis lists; the store's table has every one.
SHOWN_WARNINGS = 50


def parse_time(text: str | None) -> datetime | None:
    if not text:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class Workbench:
    """Commands over one session and, if a path is given, one store."""

    def __init__(self, spark: SparkSession, store_path: str | None = None) -> None:
        self.spark = spark
        self.store = Store(spark, store_path) if store_path else None
        if self.store:
            self.store.seed()

    def _need_store(self) -> Store:
        if self.store is None:
            raise ValueError("this needs a store: give its path")
        return self.store

    def ingest(self, rows: DataFrame, source: str) -> dict:
        return self._need_store().ingest(rows, source)

    def ingest_csv(self, path: str, source: str | None = None) -> dict:
        return self.ingest(files.read_builds_csv(self.spark, path), source or path)

    def define(self, name: str, role: str, direction: str, expression: str, notes: str = "") -> dict:
        return self._need_store().define(name, role, direction, expression, notes).as_dict()

    def metrics(self, csv: str | None = None) -> list[Metric]:
        given = files.read_metrics_csv(self.spark, csv) if csv else []
        if self.store:
            return self.store.metrics(given)
        return list(({m.name: m for m in DEFAULTS} | {m.name: m for m in given}).values())

    def windows(self, params: Params) -> dict:
        """Retained windows and the gate, as a run would have them."""
        typed, _ = prepare.coerce(self._need_store().builds(), params.window_spec)
        gate = prepare.derive_gate(typed, params.as_of, params.u, params.windows_retained, params.baseline, params.L_days)
        return {"windows": gate.windows, "dropped": gate.dropped, "gate": gate.as_dict()}

    def compute(self, params: Params, builds_csv: str | None = None, cells_csv: str | None = None, metrics_csv: str | None = None, groups: list[str] | None = None, save: bool = True) -> dict:
        metrics = self.metrics(metrics_csv)
        run_id = self.store.next_run_id(datetime.now(timezone.utc)) if self.store else "r-0"
        refused = None
        if cells_csv:
            typed, notes = aggregate.prepare_aggregate_cells(files.read_cells_csv(self.spark, cells_csv), [m.name for m in metrics], params.window_spec, params.windows_retained)
            analysis = compute_aggregate(typed, metrics, params, run_id, notes)
        else:
            raw = files.read_builds_csv(self.spark, builds_csv) if builds_csv else self._need_store().builds()
            if groups:
                raw = raw.filter(F.coalesce("group", F.lit("all")).isin(*groups))
            typed, refused, seen = prepare.coerced(raw, params.window_spec)
            some = lambda code: [r.asDict() for r in refused.filter(F.col("code") == code).select("row", "message").orderBy("row").limit(SHOWN_WARNINGS).collect()]
            notes = [{"code": c, "message": f"{seen[c]} rows; the first are listed, the store has all", "rows": seen[c], "listed": some(c)} for c in prepare.CODES if seen[c]]
            analysis = compute(typed, metrics, params, run_id, notes)
        if self.store and save and analysis["cells"]:
            self.store.save_run(analysis, refused)
        return analysis

    def run(self, ref: str | None) -> dict:
        """A run by id, or an analysis document by path."""
        if ref and ref.endswith(".json"):
            return json.loads("\n".join(r[0] for r in self.spark.read.text(ref).collect()))
        return self._need_store().load_run(ref)

    def explain(self, label: str, ref: str | None = None) -> dict:
        return explain_cell(self.run(ref), label)

    def diff(self, a: str, b: str) -> dict:
        return diff_runs(self.run(a), self.run(b))

    def render(self, ref: str | None = None) -> str:
        return render(self.run(ref))
