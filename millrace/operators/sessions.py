"""Agent sessions: trees over parent links, fan-out, spend, outcomes, workflow labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, rewritten
from .tail import order_statistic


def session_roots(sessions: DataFrame) -> DataFrame:
    """sid, root: the end of each parent chain; an unknown parent makes a root, each node of a loop is its own root
    and a chain that leads into a loop takes the node where it enters.

    Pointer doubling: after k rounds a pointer spans 2^k links, so the rounds grow with the log of the depth.  Where
    pointers of nodes that never come to rest stand is a set that only shrinks; once a round leaves it as large as it
    was, links permute it, so it is the loops, whole, however long they are.
    """
    known = sessions.select(F.col("sid").alias("parent"))
    up = sessions.select("sid", "parent").dropDuplicates(["sid"]).join(known.distinct().withColumn("_k", F.lit(True)), "parent", "left")
    links = cut(up.select("sid", F.when(F.col("_k"), F.col("parent")).alias("up")))
    state, loops = _doubled(links.select("sid", F.coalesce("up", "sid").alias("at"), F.col("up").isNull().alias("done")))
    if loops is None:
        return state.select("sid", F.col("at").alias("root"))
    # every node of a loop is an end of its own; what leads into one comes to rest there
    ends = links.join(loops.withColumn("_loop", F.lit(True)), "sid", "left")
    rests = F.coalesce("_loop", F.lit(False)) | F.col("up").isNull()
    state, _ = _doubled(ends.select("sid", F.when(rests, F.col("sid")).otherwise(F.col("up")).alias("at"), rests.alias("done")))
    return state.select("sid", F.col("at").alias("root"))


def _doubled(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(sid, at, done) with pointers followed to their ends, and the nodes of loops (sid) if any pointer has no end.

    A node that is done points at itself.
    """
    state, before = rewritten(state), -1
    while True:
        moving = state.filter("NOT done").agg(F.count_distinct("at").alias("n")).first()["n"]
        if not moving:
            return state, None
        if moving == before:
            return state, cut(state.filter("NOT done").select(F.col("at").alias("sid")).distinct())
        before = moving
        far = state.select(F.col("sid").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        state = rewritten(state.join(far, "at").select("sid", F.col("_at").alias("at"), (F.col("done") | F.col("_done")).alias("done")))


def fanout(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: how much effort lies in sessions that no commit shows; upper percentiles over runs."""
    rows = sessions.join(roots, "sid")
    rated = F.col("commits").isNotNull()
    runs = rows.groupBy("root").agg(
        F.count("*").alias("n"), F.sum("effort").alias("effort"), F.count_if(rated).alias("rated"), F.coalesce(F.sum(F.when(rated & (F.col("commits") == 0), F.col("effort"))), F.lit(0.0)).alias("blind"),
        F.count_if(rated & (F.col("commits") != 0)).alias("landed"), F.coalesce(F.sum(F.when(rated, F.col("effort"))), F.lit(0.0)).alias("known"),
    )
    seen = (F.col("rated") > 0) & (F.col("effort") != 0)
    runs = runs.withColumn("_share", F.round(F.when(seen, F.col("blind") / F.nullif(F.col("effort"), F.lit(0.0))), 3)).withColumn("_all", F.lit(1))
    out = runs.groupBy("_all").agg(
        F.sum("n").alias("sessions"), F.count("*").alias("runs"), F.sum("effort").alias("_total"), F.count_if(F.col("n") > 1).alias("_multi"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("effort"))), F.lit(0.0)).alias("_multi_effort"),
        F.sum("known").alias("_known"), F.coalesce(F.sum(F.when(seen & (F.col("landed") == 0), F.col("effort"))), F.lit(0.0)).alias("_none"),
    )
    for q, name in ((0.5, "invisible_effort_share_median"), (0.9, "invisible_effort_share_p90")):
        place = lambda n, q=q: F.least(F.floor(F.lit(q) * n), n - 1)
        out = out.join(order_statistic(runs, ["_all"], "_share", place, name), "_all", "left")
    part = lambda c: F.round(F.try_divide(F.col(c), F.col("_total")), 3)
    return out.select(
        "sessions", "runs", F.round("_total", 2).alias("effort_total"), F.round(F.try_divide(F.col("_multi"), F.col("runs")), 3).alias("multi_session_run_share"), part("_multi_effort").alias("multi_session_effort_share"),
        "invisible_effort_share_median", "invisible_effort_share_p90", part("_none").alias("no_artifact_effort_share"),
        F.round(F.try_divide(F.col("_total") - F.col("_known"), F.col("_total")), 3).alias("unrated_effort_share"),
    )


def agent_spend(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """tokens(archive, model, tokens) priced by prices(model, usd_per_million_tokens): estimate, priced share, unpriced models."""
    joined = tokens.join(prices.dropDuplicates(["model"]), "model", "left")
    price = F.col("usd_per_million_tokens")
    out = joined.groupBy("archive").agg(
        F.sum("tokens").alias("tokens_total"), F.round(F.coalesce(F.sum(F.col("tokens") / 1_000_000 * price), F.lit(0.0)), 2).alias("usd_estimate"),
        F.coalesce(F.sum(F.when(price.isNotNull(), F.col("tokens"))), F.lit(0)).alias("_priced"), F.array_sort(F.collect_set(F.when(price.isNull(), F.col("model")))).alias("_unpriced"),
    )
    return out.select("archive", "tokens_total", "usd_estimate", F.round(F.try_divide(F.col("_priced"), F.col("tokens_total")), 3).alias("priced_share"), F.array_join("_unpriced", ",").alias("unpriced_models"))


def never_landed(outcomes: DataFrame) -> DataFrame:
    """outcomes(archive, outcome, n): shares of failure and of unknown among the three outcomes."""
    three = outcomes.filter(F.col("outcome").isin("success", "failure", "unknown")).groupBy("archive").agg(F.sum("n").alias("sessions"), *[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(f"_{o}") for o in ("failure", "unknown")])
    return three.filter("sessions > 0").select("archive", F.col("sessions").cast("long").alias("sessions"), F.round(F.col("_failure") / F.col("sessions"), 3).alias("failure_share"), F.round(F.col("_unknown") / F.col("sessions"), 3).alias("unknown_share"))


def workflow_label(shares: dict[str, Column]) -> Column:
    """Label from the shares of session archetypes."""
    of = lambda k: F.coalesce(shares.get(k, F.lit(0.0)), F.lit(0.0))
    return (
        F.when(of("automation") > 0.5, "automation-heavy").when(of("marathon") + of("deep") > 0.4, "prompt-and-iterate").when(of("quick") > 0.5, "spec-first").otherwise("mixed")
    )


def workflows(archetypes: DataFrame) -> DataFrame:
    """archetypes(archive, archetype, n) -> archive, workflow."""
    names = ("automation", "marathon", "deep", "quick")
    sums = archetypes.groupBy("archive").agg(F.sum("n").alias("_t"), *[F.coalesce(F.sum(F.when(F.col("archetype") == a, F.col("n"))), F.lit(0)).alias(f"_{a}") for a in names])
    total = F.when(F.col("_t") == 0, 1).otherwise(F.col("_t"))
    return sums.select("archive", workflow_label({a: F.col(f"_{a}") / total for a in names}).alias("workflow"))
