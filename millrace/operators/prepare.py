"""Raw build rows to prepared builds: coercion, lead time, window, the usage gate and the impact class."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import IMPACT_CLASSES, QUESTION_CLASSES, RESOLUTION_DAYS, WINDOW_SPEC, WINDOWS_RETAINED
from ..functions import selection
from ..session import cut, rewritten

RAW_COLUMNS = ("build_id", "group", "first_commit_ts", "ts", "deployed_at", "served_at", "usage", "loc_added", "loc_removed", "bugs", "cost_usd", "question", "carried_into")
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
_DAY_US = 86_400_000_000.0


def days_between(a: Column, b: Column) -> Column:
    """(b - a) in days, from microseconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(_DAY_US)


def blank_to_null(c: Column) -> Column:
    """Null for text of white space only; other text untouched."""
    return F.when(F.trim(c) != "", c)


def parse_timestamp(raw: Column) -> Column:
    """struct(at timestamp, wall timestamp_ntz, text string) of an ISO text, `Y/m/d` or `d/m/Y`; null where it is none.

    `wall` is the clock of the text's own offset, which names the window; a text without an offset is UTC.
    """
    t = F.trim(raw)
    t = F.regexp_replace(t, r"^(\d{4})/(\d{2})/(\d{2})$", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")

    def parts(t: Column) -> Column:  # bound to variables, so that nothing is worked out, or compiled, once for each use
        return F.transform(F.array(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.call_function("regexp_extract", t, F.lit(_ISO), k))), built)

    def built(part: Column) -> Column:
        at = lambda k: F.get(part, F.lit(k))
        clock = F.concat(at(0), F.lit(" "), F.when(at(1) == "", "00:00").otherwise(at(1)), F.when(at(2) == "", ":00").otherwise(at(2)), at(3))
        offset = F.when(at(4).isin("", "Z"), "+00:00").otherwise(at(4))
        return F.when(at(0) != "", F.struct(clock.alias("clock"), offset.alias("offset"), at(3).alias("fraction")))

    def read(p: Column) -> Column:
        wall, at = p["clock"].try_cast("timestamp_ntz"), F.concat(p["clock"], p["offset"]).try_cast("timestamp")
        text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), p["fraction"], p["offset"])
        return F.when(at.isNotNull() & wall.isNotNull(), F.struct(at.alias("at"), wall.alias("wall"), text.alias("text")))

    got = F.flatten(F.transform(F.array(t), parts))
    return F.get(F.transform(got, read), F.lit(0))


def number(c: Column) -> Column:
    """A finite double, or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def window_label(wall: Column, spec: str = WINDOW_SPEC) -> Column:
    """YYYY-MM, ISO YYYY-Www or YYYY-Qn of a wall-clock time."""
    if spec == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), wall), F.weekofyear(wall))
    if spec == "quarter":
        return F.format_string("%d-Q%d", F.year(wall), F.quarter(wall))
    return F.date_format(wall, "yyyy-MM")


#: What is told of a row that is left out, or of a question that is not counted.
MESSAGES = {"BAD_TIMESTAMP": "cannot parse a timestamp", "MISSING_REQUIRED": ("ts and first_commit_ts are required", "loc_added and loc_removed are required")}
CODES = ("BAD_TIMESTAMP", "MISSING_REQUIRED", "UNKNOWN_QUESTION")


def coerced(raw: DataFrame, window_spec: str = WINDOW_SPEC) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(typed builds, warnings(code, row, message), number of rows and of each code) from all-string rows.

    One pass parses the rows, marks each with what is wrong with it, counts while it writes, and leaves a table in the
    checkpoint folder from which both the builds and the warnings, a row each, are read.
    """
    have = [c for c in RAW_COLUMNS if c in raw.columns]
    text = raw.select(*[blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in have], *[F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS if c not in have], F.monotonically_increasing_id().alias("_row"))
    stamps = ("ts", "first_commit_ts", "deployed_at", "served_at")
    typed = text.withColumns({f"_{c}": parse_timestamp(F.col(c)) for c in stamps}).withColumns({f"_{c}": number(F.col(c)) for c in ("loc_added", "loc_removed", "usage", "bugs", "cost_usd")})
    bad = F.lit(False)
    for c in stamps:
        bad = bad | (F.col(c).isNotNull() & F.col(f"_{c}").isNull())
    missing = F.col("_ts").isNull() | F.col("_first_commit_ts").isNull()
    no_loc = F.col("_loc_added").isNull() | F.col("_loc_removed").isNull()
    odd = F.col("question").isNotNull() & ~F.col("question").isin(*QUESTION_CLASSES)
    no_stamp, no_lines = MESSAGES["MISSING_REQUIRED"]
    message = F.when(F.col("code") == CODES[0], MESSAGES[CODES[0]]).when(F.col("code") == CODES[1], F.when(missing, no_stamp).otherwise(no_lines)).when(F.col("code") == CODES[2], F.concat(F.lit("question '"), "question", F.lit("' is unclassified")))
    marked = typed.withColumn("code", F.when(bad, CODES[0]).when(missing | no_loc, CODES[1]).when(odd, CODES[2])).withColumn("message", message)
    marked = marked.select(
        "code", "message", F.coalesce("build_id", F.concat(F.lit("row-"), F.col("_row").cast("string"))).alias("build_id"), F.coalesce("group", F.lit("all")).alias("grp"),
        F.col("_ts.at").alias("ts_at"), F.col("_first_commit_ts.at").alias("first_commit_at"), F.col("_deployed_at.at").alias("deployed_at"), F.col("_served_at.at").alias("served_at"), F.col("_ts.wall").alias("ts_wall"),
        F.col("_ts.text").alias("ts_text"), F.col("_first_commit_ts.text").alias("first_commit_text"), F.col("_deployed_at.text").alias("deployed_text"), F.col("_served_at.text").alias("served_text"),
        F.col("_usage").alias("usage"), F.col("_loc_added").alias("loc_added"), F.col("_loc_removed").alias("loc_removed"), F.rint("_bugs").alias("bugs"), F.col("_cost_usd").alias("cost_usd"), "question", "carried_into",
    )
    seen = Observation()
    table = rewritten(marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("code") == c).alias(c) for c in CODES]))
    warnings = table.filter("code IS NOT NULL").select("code", F.col("build_id").alias("row"), "message")
    good = table.filter(F.col("code").isNull() | (F.col("code") == CODES[2])).drop("code", "message")
    return derive(good, window_spec), warnings, dict(seen.get)


def coerce(raw: DataFrame, window_spec: str = WINDOW_SPEC) -> tuple[DataFrame, DataFrame]:
    """(typed builds, warnings(code, row, message)) from all-string rows; unusable rows become warnings only."""
    return coerced(raw, window_spec)[:2]


def derive(typed: DataFrame, window_spec: str = WINDOW_SPEC) -> DataFrame:
    """Line total, deployed, served, lead time with its source, and the window.

    Use beats deployment; the deploy interval stands in only where use was not observed, never where there was none.
    """
    fallback = F.col("deployed_at").isNotNull() & (F.col("usage").isNull() | (F.col("usage") > 0))
    source = F.when(F.col("served_at").isNotNull(), "SERVED").when(fallback, "DEPLOYED")
    end = F.when(F.col("served_at").isNotNull(), F.col("served_at")).when(fallback, F.col("deployed_at"))
    return typed.withColumns(
        {
            "loc_total": F.col("loc_added") + F.col("loc_removed"),
            "deployed": F.col("deployed_at").isNotNull(),
            "served": F.col("served_at").isNotNull(),
            "lead_time_days": days_between(F.col("first_commit_at"), end),
            "lead_time_source": source,
            "win": window_label(F.col("ts_wall"), window_spec),
        }
    )


@dataclass
class Gate:
    u: float | None
    u_source: str
    as_of: datetime
    resolution_days: int = RESOLUTION_DAYS
    baseline: str | None = None
    windows: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"u": self.u, "u_source": self.u_source, "as_of": self.as_of.isoformat(), "L_days": self.resolution_days, "baseline": self.baseline}


def window_start(label: str) -> datetime:
    """The wall-clock time at which the window of a label begins."""
    year, rest = int(label[:4]), label[5:]
    if rest[0] == "W":
        return datetime.fromisocalendar(year, int(rest[1:]), 1)
    return datetime(year, 3 * int(rest[1:]) - 2 if rest[0] == "Q" else int(rest), 1)


def within(windows: list[str]) -> Column:
    """Builds of these windows; the bound on the time itself reaches the scan."""
    return (F.col("ts_wall") >= F.lit(window_start(windows[0]).isoformat()).cast("timestamp_ntz")) & F.col("win").isin(*windows)


def retained(windows: list[str], keep: int | None) -> tuple[list[str], list[str]]:
    """(kept, dropped): the last `keep` labels; labels of one spec sort by time."""
    every = sorted(windows)
    kept = every[-keep:] if keep else every
    return kept, [w for w in every if w not in kept]


def windows_of(builds: DataFrame, keep: int | None = WINDOWS_RETAINED) -> tuple[list[str], list[str]]:
    """(kept, dropped) labels of the builds' windows; as many rows are collected as there are windows."""
    return retained([r["win"] for r in builds.select("win").distinct().collect()], keep)


def derive_gate(builds: DataFrame, as_of: datetime | None = None, u: float | None = None, keep: int | None = WINDOWS_RETAINED, baseline: str | None = None, resolution_days: int = RESOLUTION_DAYS) -> Gate:
    """Windows to keep, and the usage threshold: the median usage of served builds in them, unless given."""
    kept, dropped = windows_of(builds, keep)
    if not kept:
        raise ValueError("nothing to analyse: the warnings say why each build was left out")
    as_of = as_of or datetime.now(timezone.utc)
    if u is not None:
        return Gate(float(u), "supplied with --u", as_of, resolution_days, baseline, kept, dropped)
    pool = builds.filter(within([w for w in kept if baseline in (None, w)] or ["9999-01"]) & F.col("served") & F.col("usage").isNotNull())
    pool = cut(pool.select("usage"))
    n, middle = pool.count(), {"u": (F.col("usage"), 0.5)}
    if n > selection.DIRECT:
        middle_usage = selection.percentiles(pool, [], middle).first()["u"]
    else:
        lists, columns = selection.inline(middle)
        middle_usage = pool.agg(*[c.alias(k) for k, c in lists.items()]).select(columns["u"].alias("u")).first()["u"]
    source = f"median usage over {n} served builds in {baseline or 'all retained windows'}" if n else "UNAVAILABLE: usage is missing from all served builds"
    return Gate(middle_usage, source, as_of, resolution_days, baseline, kept, dropped)


def impact_class(u: Column, resolution_days: int | Column = RESOLUTION_DAYS) -> Column:
    """First that holds: too young, not deployed, no usage signal, enough usage, some usage, none."""
    usage = F.col("usage")
    return (
        F.when(F.col("age_days") < resolution_days, "unresolved")
        .when(~F.col("deployed"), F.when(F.col("carried_into").isNotNull() & (F.col("carried_into") != ""), "carried").otherwise("sunk"))
        .when(usage.isNull() | u.isNull(), "impactful")
        .when(usage >= u, "impactful")
        .when(usage > 0, "low_impact")
        .otherwise("liability")
    )


def classify(builds: DataFrame, gate: Gate) -> DataFrame:
    """Retained builds with age, impact class and whether the gate lacked its signal."""
    u = F.lit(gate.u).cast("double")
    as_of = F.lit(gate.as_of).cast("timestamp")
    out = builds.filter(within(gate.windows)).withColumn("age_days", days_between(F.col("ts_at"), as_of))
    return out.withColumn("impact", impact_class(u, gate.resolution_days)).withColumn("gate_unavailable", F.col("deployed") & (F.col("usage").isNull() | u.isNull()))


def sensitivity(builds: DataFrame, gate: Gate, factors: tuple[tuple[str, float], ...]) -> DataFrame:
    """(level, grp, win, n_builds, share of each class) with the threshold at each factor, in one pass."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(f).alias("factor")) for n, f in factors]))
    out = classify(builds, gate).withColumn("_l", levels).withColumn("level", F.col("_l.level"))
    out = out.withColumn("impact", impact_class(F.lit(gate.u) * F.col("_l.factor"), gate.resolution_days))
    shares = [(F.count_if(F.col("impact") == c) / F.count(F.lit(1))).alias(f"share_{c}") for c in IMPACT_CLASSES]
    return out.groupBy("level", "grp", "win").agg(F.count(F.lit(1)).alias("n_builds"), *shares)
