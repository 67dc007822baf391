"""What happens after work ships: clusters of commits, ship moments, quiet splits, survival, frontier of flows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import DAYS_PER_MONTH, QUIET_DAYS
from ..functions.selection import numbered
from ..session import cut, small
from .asof import next_event
from .dominance import front

#: Hints that are broadcast; more are joined by shuffle.
FEW_HINTS = 100_000
#: Signatures and groups of them that are broadcast.
FEW_SIGNATURES = 20_000

# Fixed patterns and words of the clustering rules.
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
FLAG = r"(?i)\bflag[:/ ]+([a-z0-9][a-z0-9._-]{2,})"
SCOPE = r"^\w+\(([^)]{2,40})\)!?:"
REVERT = r'^Revert .*"(.{4,60})"'
INFRA = r"(^|/)(\.github|\.gitlab|ci|infra|terraform|helm|charts|deploy)(/|$)"
STOPWORDS = (
    "add added adds fix fixed fixes update updated updates remove removed chore refactor test tests wip bump merge revert the a an of to for and in on with "
    "from into make use using"
).split()


def anchor(subject: Column) -> Column:
    """kind:value of the first rule that matches: ticket, flag, conventional scope, revert; else null."""
    rules = (("ticket", TICKET), ("flag", FLAG), ("conventional-scope", SCOPE), ("revert", REVERT))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(rules):
        out = F.when(subject.rlike(pattern), F.concat(F.lit(f"{kind}:"), F.lower(F.trim(F.regexp_extract(subject, pattern, 1))))).otherwise(out)
    return out


def tokens(subject: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(subject), F.lit(r"([a-z][a-z0-9_]{2,})"), 1), F.array(*[F.lit(w) for w in STOPWORDS]))


def directories(files: Column) -> Column:
    """a/b of a/b/c and deeper, else the first part."""

    def one(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.element_at(parts, 1))

    return F.array_distinct(F.transform(files, one))


def infra_only(files: Column) -> Column:
    return (F.size(files) > 0) & F.forall(files, lambda f: f.rlike(INFRA))


def _agglomerate(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Greedy single pass: a commit joins the group it overlaps most, if by `threshold`, the earliest of equals, else starts one.

    `rows` has each signature (words and directories) once, at its first commit.  After that some group holds the whole
    signature, which is the largest overlap it can have: later commits of it join the earliest group that holds it, or start
    another where the signature is too light, and neither changes any group's words.  Returned are the earliest group of
    each signature from a commit on (`since`), and a row without a signature for each group that can be joined.  A group
    that begins inside an earlier one never wins over it, so it cannot and is not kept.
    """
    threshold = max(threshold, 1)
    groups: list[set] = []
    made: list[int] = []  # signature whose first commit started the group
    holding: dict[tuple[str, str], set[int]] = {}  # word or directory -> groups that hold it
    recurring: dict[tuple[str, str], list[int]] = {}  # the same -> signatures seen that come again
    into: dict[int, int] = {}
    items = [{("d", x): 2 for x in dirs} | {("t", x): 1 for x in words} for words, dirs in zip(rows["tokens"], rows["dirs"])]
    out = []
    for n, (own, times) in enumerate(zip(items, rows["times"])):
        weight = sum(own.values())
        order = sorted(own, key=lambda x: -len(holding.get(x, ())))
        spare = k = 0
        while k < len(order) and spare + own[order[k]] < threshold:  # a group that holds no more than these overlaps too little
            spare, k = spare + own[order[k]], k + 1
        near = set().union(*(holding.get(x, ()) for x in order[k:]))
        score = {g: sum(w for x, w in own.items() if x in groups[g]) for g in near}
        best = min(score, key=lambda g: (-score[g], g), default=None)
        if best is None or score[best] < threshold:
            if weight < threshold and (not own or any(own.keys() <= groups[g] for g in holding.get(order[-1], ()))):
                continue
            best = len(groups)
            groups.append(set())
            made.append(n)
        added = own.keys() - groups[best]
        groups[best].update(added)
        for x in added:
            holding.setdefault(x, set()).add(best)
        if weight >= threshold:
            out.append((n, n, best))
            if times > 1:
                into[n] = best
                for x in own:
                    recurring.setdefault(x, []).append(n)
        for m in {m for x in added for m in recurring.get(x, ()) if into[m] > best}:
            if items[m].keys() <= groups[best]:
                into[m] = best
                out.append((m, n, best))
    place = list(zip(rows["us"], rows["sha"]))
    words, dirs = list(rows["tokens"]), list(rows["dirs"])
    joined = [(words[m], dirs[m], *place[n], *place[made[g]], None) for m, n, g in out]
    named = [(None, None, None, None, *place[n], min((x for kind, x in groups[g] if kind == "d"), default=None)) for g, n in enumerate(made)]
    return pd.DataFrame(joined + named, columns=["tokens", "dirs", "us", "sha", "group_us", "group_sha", "label"]).astype({"us": "Int64", "group_us": "Int64"})


def cluster(commits: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """commits with threshold and key, a row for each threshold.

    Anchored commits need no order and stay distributed.  Of the rest each commit's group depends on all before it, but only
    the first commit of a signature - its words and directories - can change a group.  One ordered pass for each
    threshold sees the different signatures only; commits then look up theirs, and groups are numbered in ranges of
    their first commits.
    """
    marked = commits.withColumn("_key", anchor(F.col("subject")))
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    anchored = marked.filter("_key IS NOT NULL").withColumn("threshold", levels).withColumn("key", F.col("_key"))
    loose = marked.filter("_key IS NULL")

    none = F.array().cast("array<string>")
    signed = cut(loose.select(  # read three times; what an anchor is takes longest
        F.coalesce("sha", F.lit("")).alias("sha"), F.coalesce(F.unix_micros("at"), F.lit(2**63 - 1)).alias("us"),  # commits without a time come last
        F.coalesce(F.array_sort(tokens(F.col("subject"))), none).alias("tokens"), F.coalesce(F.array_sort(directories(F.col("files"))), none).alias("dirs"),
    ))
    signatures = cut(signed.groupBy("tokens", "dirs").agg(F.min(F.struct("us", "sha")).alias("_first"), F.count("*").alias("times")).select("tokens", "dirs", "_first.*", "times"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "sha"], kind="stable")
        threshold = int(rows["threshold"].iloc[0])
        return _agglomerate(rows, threshold).assign(threshold=threshold)

    told = cut(signatures.withColumn("threshold", levels).groupBy("threshold").applyInPandas(run, "tokens array<string>, dirs array<string>, us long, sha string, group_us long, group_sha string, label string, threshold int"))
    since = F.struct(F.struct("us", "sha").alias("since"), "group_us", "group_sha")
    into = told.filter("tokens IS NOT NULL").groupBy("threshold", "tokens", "dirs").agg(F.array_sort(F.collect_list(since)).alias("_into"))
    place = F.struct("us", "sha")
    found = signed.withColumn("threshold", levels).join(small(into, FEW_SIGNATURES), ["threshold", "tokens", "dirs"], "left")
    group = F.element_at(F.filter("_into", lambda x: x["since"] <= place), -1)
    heavy = 2 * F.size("dirs") + F.size("tokens") >= F.greatest(F.lit(1), F.col("threshold"))
    found = found.select("threshold", "us", "sha", F.array_min("dirs").alias("_own"), F.when(heavy, group["group_us"]).otherwise(F.col("us")).alias("group_us"), F.when(heavy, group["group_sha"]).otherwise(F.col("sha")).alias("group_sha"))
    starts = (F.col("us") == F.col("group_us")) & (F.col("sha") == F.col("group_sha"))
    open_ = told.filter("tokens IS NULL").select("threshold", "group_us", "group_sha", F.col("label").alias("_label"), F.lit(True).alias("_open"))
    by = ["threshold", "group_us", "group_sha"]
    groups = numbered(found.filter(starts).select(*by, "_own"), ["threshold"], ["group_us", "group_sha"], "_i").join(small(open_, FEW_SIGNATURES), by, "left")
    label = F.when(F.col("_open"), F.col("_label")).otherwise(F.col("_own"))
    groups = groups.withColumn("key", F.concat(F.lit("cluster:"), F.coalesce(label, F.concat(F.lit("group-"), "_i")), F.lit("#"), "_i"))
    joiners = found.filter(~starts).select("sha", *by).join(small(cut(groups.filter("_open").select(*by, "key")), FEW_SIGNATURES), by)
    named = groups.select("threshold", F.col("group_sha").alias("sha"), "key").unionByName(joiners.select("threshold", "sha", "key"))
    return anchored.drop("_key").unionByName(loose.drop("_key").withColumn("threshold", levels).join(named, ["threshold", "sha"]))


def anchored(commits: DataFrame) -> DataFrame:
    """Commits with an anchor, keyed by it."""
    return commits.withColumn("key", anchor(F.col("subject"))).filter("key IS NOT NULL")


def _bits(hints: DataFrame) -> tuple[DataFrame, int]:
    """_word, _set: a bit for the hash of each hint, 64 in a row, and by how much a hash is shifted to its bit.

    As many bits as sixteen times the hints, 64 million (a million rows) at most: with more hints more pieces pass that are none.
    """
    n = hints.count()
    size = min(26, max(10, (16 * n).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64("hint"), 64 - size)
    bit = F.expr("shiftleft(1L, cast(_at & 63 as int))")
    return hints.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_set")), 64 - size


def hinted(clustered: DataFrame, hints: DataFrame, on: list[str]) -> DataFrame:
    """on, hint: the hints (one column, `hint`, lower case) that lie within a cluster's key or within one of its subjects.

    Containment is an equi-join of whole hints with the pieces of a text that are as long as any hint.  Where hints are too many to
    broadcast, pieces whose hash no hint has are dropped before they are shuffled.
    """
    hints = hints.distinct()
    parts = clustered.select(*on, F.explode(F.array(F.lower("subject"), F.lower("key"))).alias("_part")).distinct()
    sizes = hints.select(F.length("hint").alias("_size")).distinct()
    pieces = parts.join(F.broadcast(sizes), F.length("_part") >= F.col("_size"))  # as many sizes as a hint has characters
    places = F.sequence(F.lit(1), F.length("_part") - F.col("_size") + 1)
    pieces = pieces.select(*on, F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("_part", i, F.col("_size"))))).alias("hint"))
    few = small(hints, FEW_HINTS)
    if few is hints:
        bits, shift = _bits(hints)
        at = F.shiftrightunsigned(F.xxhash64("hint"), shift)
        pieces = pieces.withColumn("_at", at).join(F.broadcast(bits), (F.shiftright("_at", 6) == F.col("_word")) & (F.expr("shiftrightunsigned(_set, cast(_at & 63 as int)) & 1L") == 1), "left_semi").drop("_at").distinct()
        return pieces.join(hints, "hint", "left_semi").select(*on, "hint")
    return pieces.join(few, "hint").select(*on, "hint").distinct()


def ship_moments(clustered: DataFrame, events: DataFrame, on: list[str]) -> DataFrame:
    """on, first_at, t0: the first event at or after the first commit whose hint is blank or part of the key or of a
    subject; infra-only commits are left out beforehand.

    A cluster looks up the next event of each of its hints (`asof.next_event`); blank hints are one more key that all
    clusters have, if there is such an event.
    """
    first = cut(clustered.groupBy(*on).agg(F.min("at").alias("first_at")))
    e = cut(events.select(F.col("at").alias("_when"), F.lower(F.trim(F.coalesce("hint", F.lit("")))).alias("hint")).distinct())
    pairs = hinted(clustered, e.filter("hint <> ''").select("hint"), on)
    if e.filter("hint = ''").limit(1).count():
        pairs = pairs.unionByName(first.select(*on, F.lit("").alias("hint")))
    found = next_event(pairs.join(first, on), e, ["hint"], "first_at", "_when", "_next")
    return first.join(found.groupBy(*on).agg(F.min("_next").alias("t0")), on, "left")


def quiet_split(clustered: DataFrame, moments: DataFrame, on: list[str], end: Column, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """on, commits, t0, pre_churn, post_churn, deploys_to_stability, censored of each cluster.

    Stability is reached at the first commit after t0 that `quiet_days` without another follow, or that is the last; it
    is censored when that is the last and the observed window ends too early to tell.
    """
    gap = F.expr(f"interval {quiet_days} days")
    churn = F.col("insertions") + F.col("deletions")
    rows = clustered.join(moments, on)
    after = F.col("at") >= F.col("t0")
    w = Window.partitionBy(*on, "_after").orderBy("at", "sha")
    rows = rows.withColumn("_after", F.coalesce(after, F.lit(False))).withColumn("_next", F.lead("at").over(w)).withColumn("_i", F.row_number().over(w))
    quiet = F.col("_after") & (F.col("_next").isNull() | (F.col("_next") - F.col("at") >= gap))
    out = rows.groupBy(*on, "t0").agg(
        F.count("*").alias("commits"), F.sum(F.when(F.col("t0").isNotNull(), F.when(F.col("_after"), 0).otherwise(churn)).otherwise(0)).alias("pre_churn"),
        F.sum(F.when(F.col("_after"), churn).otherwise(0)).alias("post_churn"), F.coalesce(F.min(F.when(quiet, F.col("_i"))), F.lit(0)).alias("deploys_to_stability"),
        F.count_if("_after").alias("_post"), F.max(F.when(F.col("_after"), F.col("at"))).alias("_last"),
    )
    censored = (F.col("_post") > 0) & (end - F.col("_last") < gap) & (F.col("deploys_to_stability") == F.col("_post"))
    return out.withColumn("censored", F.coalesce(censored, F.lit(False))).drop("_post", "_last")


def measured(results: DataFrame) -> DataFrame:
    """Adds resolved, rework_ratio and tail_mass (null without a base to divide by)."""
    return results.withColumns({"resolved": F.col("t0").isNotNull(), "rework_ratio": F.when(F.col("pre_churn") != 0, F.try_divide(F.col("post_churn"), F.col("pre_churn"))), "tail_mass": F.try_divide(F.col("post_churn"), F.col("pre_churn") + F.col("post_churn"))})


def survival(results: DataFrame, on: list[str]) -> DataFrame:
    """on, t, survival: Kaplan-Meier of deploys to stability; a point where something happened, and (0, 1) to begin with."""
    seen = results.filter("t0 IS NOT NULL")
    counts = seen.groupBy(*on, F.col("deploys_to_stability").cast("long").alias("t")).agg(F.count("*").alias("_n"), F.count_if(~F.col("censored")).alias("_events"))
    later = Window.partitionBy(*on).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_risk", F.sum("_n").over(later))
    upto = Window.partitionBy(*on).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    curve = counts.withColumn("survival", F.product(1 - F.col("_events") / F.col("_risk")).over(upto)).filter("_events > 0").select(*on, "t", "survival")
    start = counts.select(*on).distinct().select(*on, F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("survival"))
    return start.unionByName(curve)


def order_statistic(values: DataFrame, on: list[str], value: str, index: Callable[[Column], Column], name: str) -> DataFrame:
    """on and the value at index(n) of the sorted non-null values, counted from 0.

    Values come rounded: rounding keeps order, so a count of each distinct value is all that has to be sorted.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*on)
    counts = counts.withColumn("_upto", F.sum("_n").over(every.orderBy(value))).withColumn("_size", F.sum("_n").over(every))
    return counts.filter(F.col("_upto") > index(F.col("_size"))).groupBy(*on).agg(F.min(value).alias(name))


def summary(results: DataFrame, curve: DataFrame, on: list[str]) -> DataFrame:
    """on, counts, unattributed share, upper medians of tail mass and rework, censored share, plateau of the curve."""
    r = measured(results)
    ok = F.col("resolved")
    r = r.withColumns({"_tail": F.when(ok, F.round("tail_mass", 3)), "_rework": F.when(ok, F.round("rework_ratio", 3))})
    sums = r.groupBy(*on).agg(
        F.count("*").alias("clusters_total"), F.count_if(ok).alias("clusters_resolved"), F.sum(F.col("pre_churn") + F.col("post_churn")).alias("churn_total"),
        F.round(F.try_divide(F.count_if(~ok), F.count("*")), 3).alias("unattributed_share"), F.round(F.try_divide(F.count_if(ok & F.col("censored")), F.count_if(ok)), 3).alias("never_stabilises_share"),
    )
    middle = lambda n: F.floor(n / 2)
    for value, name in (("_tail", "tail_mass_median"), ("_rework", "rework_ratio_median")):
        sums = sums.join(order_statistic(r, on, value, middle, name), on, "left")
    last = curve.groupBy(*on).agg(F.round(F.min("survival"), 3).alias("survival_plateau"))
    return sums.join(last, on, "left")


def analyse(commits: DataFrame, events: DataFrame, thresholds: tuple[int, ...], quiet_days: int = QUIET_DAYS) -> DataFrame:
    """threshold, key and quiet_split's columns for every cluster at every threshold."""
    end = commits.agg(F.max("at").alias("_end"))
    on = ["threshold", "key"]
    feature = cluster(commits, thresholds).filter(~infra_only(F.col("files")))
    moments = ship_moments(feature, events, on)
    last = end.first()["_end"]
    return quiet_split(feature, moments, on, F.lit(last).cast("timestamp"), quiet_days)


def flow_points(runs: DataFrame) -> DataFrame:
    """label, threshold, why, per_spend, per_month, settled, spend_per_month from runs with delivered, never_stabilises_share,
    churn_total, first_at, last_at and (null without a cost) dollars, engineer_months.

    `why` says what a run lacks for a point; it is null, and the axes are known, where it has one.
    """
    days = F.greatest(F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / 86_400_000_000), F.lit(1))
    costed = F.col("dollars").isNotNull()
    per_spend = F.when(costed, F.try_divide(F.col("delivered"), F.col("dollars") / 10_000)).otherwise(F.try_divide(F.col("delivered"), F.col("churn_total") / 1000))
    per_month = F.when(costed, F.try_divide(F.col("delivered"), F.col("engineer_months"))).otherwise(F.col("delivered") / (days / DAYS_PER_MONTH))
    spent = F.when(costed, (F.col("dollars") > 0) & (F.col("engineer_months") > 0)).otherwise(F.col("churn_total") > 0)
    why = (
        F.when(~F.coalesce(F.col("delivered") > 0, F.lit(False)), "nothing delivered").when(F.col("never_stabilises_share").isNull(), "no share that settles").when(~F.coalesce(spent, F.lit(False)), "nothing spent")
    )
    known = lambda c: F.when(F.col("why").isNull(), c)
    points = runs.withColumn("why", why)
    return points.select("label", "threshold", "why", known(per_spend).alias("per_spend"), known(per_month).alias("per_month"), known(1 - F.col("never_stabilises_share")).alias("settled"), known(F.when(costed, F.try_divide("dollars", "engineer_months"))).alias("spend_per_month"))


def flow_frontier(runs: DataFrame) -> DataFrame:
    """label, wins, thresholds, won, used, standing, skipped, why: of each flow, the thresholds that all runs share and at
    which no other flow is better on all axes.

    `won` and `used` are masks, a bit for each shared threshold from the smallest up (63 at most): where the flow is on the frontier, and where
    it has a point at all.  Its standing is always, sometimes or never, over all shared thresholds; it is skipped if it
    lacks a point at any, and `why` names what it lacks there.
    """
    n = runs.select("label").distinct().agg(F.count("*").alias("_runs"))
    shared = runs.groupBy("threshold").agg(F.count_distinct("label").alias("_have")).crossJoin(F.broadcast(n)).filter("_have = _runs").select("threshold")
    shared = shared.withColumn("_bit", F.expr("shiftleft(1L, row_number() over (order by threshold) - 1)"))  # a row a threshold
    points = flow_points(runs.join(F.broadcast(shared), "threshold")).join(F.broadcast(shared), "threshold")
    axes = {f"_{a}": -F.col(a) for a in ("per_spend", "per_month", "settled")}
    best = front(points.withColumns(axes), ["threshold"], list(axes)).groupBy("label").agg(F.bit_or("_bit").alias("won"))
    own = points.groupBy("label").agg(F.coalesce(F.bit_or(F.when(F.col("why").isNull(), F.col("_bit"))), F.lit(0).cast("long")).alias("used"), F.array_join(F.array_sort(F.collect_set("why")), ", ").alias("_why"))
    total = shared.agg(F.count("*").alias("thresholds"))
    out = own.join(best, "label", "left").withColumn("won", F.coalesce("won", F.lit(0).cast("long"))).crossJoin(F.broadcast(total))
    out = out.withColumn("wins", F.bit_count("won").cast("long"))
    standing = F.when(F.col("wins") == F.col("thresholds"), "always").when(F.col("wins") > 0, "sometimes").otherwise("never")
    skipped = F.bit_count("used") < F.col("thresholds")
    return out.select("label", "wins", "thresholds", "won", "used", standing.alias("standing"), skipped.alias("skipped"), F.when(skipped, F.col("_why")).alias("why"))


def frontier_note(rows: list[dict], axes: int = 3) -> str | None:
    """DEGENERATE when every flow wins everywhere, CAUTION when there are few flows for the axes."""
    if len(rows) > 1 and all(r["wins"] == r["thresholds"] for r in rows):
        return f"DEGENERATE: none of {len(rows)} flows is ever beaten"
    if len(rows) < 2 * axes:
        return f"CAUTION: {axes} axes tell {len(rows)} flows apart poorly"
    return None
