"""Cells that come aggregated: checked, typed, and cut to the last windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IMPACT_CLASSES, QUESTION_CLASSES, WINDOWS_RETAINED
from ..operators.prepare import blank_to_null, retained

LABELS = {"month": r"^\d{4}-(0[1-9]|1[0-2])$", "week": r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$", "quarter": r"^\d{4}-Q[1-4]$"}


def prepare_aggregate_cells(raw: DataFrame, metrics: list[str], window_spec: str = "month", keep: int | None = WINDOWS_RETAINED) -> tuple[DataFrame, list[dict]]:
    """(typed cells, warnings); the first violation raises ValueError with its cell and reason."""
    text = raw.select(*[blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in raw.columns])
    numbers = [c for c in text.columns if c in (*metrics, *(f"{m}_se" for m in metrics), "n_builds", "lead_time_fallback_share") or c.startswith("share_")]
    typed = text.withColumns({f"_{c}": F.col(c).try_cast("double") for c in numbers})
    bad = F.when(F.col("window").isNull() | ~F.col("window").rlike(LABELS[window_spec]), F.concat(F.lit(f"window is not a {window_spec} label: "), F.coalesce("window", F.lit("blank"))))
    bad = bad.when(F.col("_n_builds").isNull() | (F.col("_n_builds") <= 0) | (F.floor("_n_builds") != F.col("_n_builds")), "n_builds must be a positive integer")
    for c in numbers:
        bad = bad.when(F.col(c).isNotNull() & (F.col(f"_{c}").isNull() | F.isnan(f"_{c}") | (F.abs(f"_{c}") == float("inf"))), f"{c} must be a finite number")
    for c in numbers:
        if c.endswith("_se"):
            bad = bad.when(F.col(f"_{c}") < 0, f"{c} must not be negative")
        if c.startswith("share_") or c == "lead_time_fallback_share":
            bad = bad.when((F.col(f"_{c}") < 0) | (F.col(f"_{c}") > 1), f"{c} must lie in [0, 1]")
    warnings = []
    for kind, classes, exact in (("impact", IMPACT_CLASSES, True), ("question", QUESTION_CLASSES, False)):
        have = [f"share_{c}" for c in classes if f"share_{c}" in numbers]
        if not have:
            warnings.append({"code": "MIX_UNAVAILABLE", "message": f"no {kind} shares"})
            typed = typed.withColumns({f"_share_{c}": F.lit(None).cast("double") for c in classes})
            continue
        if len(have) < len(classes):
            raise ValueError(f"{kind} shares must all be there or none")
        known = sum((F.col(f"_{c}").isNotNull().cast("int") for c in have), F.lit(0))
        total = sum((F.col(f"_{c}") for c in have[1:]), F.col(f"_{have[0]}"))
        bad = bad.when((known > 0) & (known < len(have)), f"{kind} shares must all be there or none")
        bad = bad.when(F.abs(total - 1) > 1e-9 if exact else total > 1 + 1e-9, f"{kind} shares must add up to {'1' if exact else 'at most 1'}")
    first = typed.withColumn("_bad", bad).filter("_bad IS NOT NULL").select("group", "window", "_bad").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['group'] or 'all'}/{first[0]['window']}: {first[0]['_bad']}")
    twice = typed.groupBy(F.coalesce("group", F.lit("all")).alias("group"), "window").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['group']}/{twice[0]['window']}: given more than once")
    kept, dropped = retained([r[0] for r in typed.select("window").distinct().collect()], keep)
    if dropped:
        warnings.append({"code": "WINDOWS_DROPPED", "message": f"older than the {len(kept)} newest windows: {', '.join(dropped)}"})
    if "lead_time_fallback_share" not in numbers:
        warnings.append({"code": "LEAD_TIME_SOURCE_UNAVAILABLE", "message": "no lead_time_fallback_share"})
        typed = typed.withColumn("_lead_time_fallback_share", F.lit(None).cast("double"))
    out = typed.filter(F.col("window").isin(*kept)).select(
        F.coalesce("group", F.lit("all")).alias("grp"), F.col("window").alias("win"), F.col("_n_builds").cast("long").alias("n_builds"),
        *[(F.col(f"_{m}") if m in numbers else F.lit(None).cast("double")).alias(m) for m in metrics], *[F.col(f"_{m}_se").alias(f"{m}_se") for m in metrics if f"{m}_se" in numbers],
        F.col("_lead_time_fallback_share").alias("fallback_share"), *[F.col(f"_share_{c}").alias(f"share_{c}") for c in (*IMPACT_CLASSES, *QUESTION_CLASSES)],
    )
    return out, warnings
