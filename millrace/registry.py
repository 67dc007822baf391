"""Named queries of the engine over the star-schema views, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .constants import ATTAINMENT_REPLICATES, BOOTSTRAP, IMPACT_CLASSES, PERMUTATIONS, QUESTION_CLASSES, SENSITIVITY, SWEEP
from .functions.metrics import DEFAULTS, Metric, by_name
from .operators import dominance as D
from .operators import movement, prepare, screen, sessions, tail, uncertainty
from .operators.cells import KEYS, build_cells, evaluate, ranked, scaled
from .session import cut, rewritten
from .sources import views

Query = Callable[[SparkSession, str], DataFrame]
OBJECTIVES = ("cost", "lead_time", "debt_defect")
NORMS = [f"{n}_norm" for n in OBJECTIVES]
#: Fixed parameters of the registered queries.
EPSILON, QUIET = 0.15, 7


def r6(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


# -- builds and cells -------------------------------------------------------


def prepared(spark: SparkSession, sf_dir: str, window_spec: str = "month") -> tuple[DataFrame, prepare.Gate]:
    builds = views.builds(spark, sf_dir, window_spec)
    kept, _ = prepare.windows_of(builds)
    builds = cut(builds.filter(prepare.within(kept)))  # read for the gate, for sizes and for cells: the joins run once
    gate = prepare.derive_gate(builds, as_of=views.AS_OF)
    return prepare.classify(builds, gate), gate


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all shipped metrics, scaled objectives and ranks; groups times windows, so cut and kept."""
    builds, _ = prepared(spark, sf_dir)
    objectives = by_name(DEFAULTS, OBJECTIVES)
    return cut(ranked(scaled(build_cells(builds, DEFAULTS), objectives), objectives))


def builds_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return b.select("build_id", "grp", "win", r6("lead_time_days", "lead_time_days"), "lead_time_source", r6("age_days", "age_days"), "impact", "gate_unavailable", "deployed", "served", "loc_total")


def coerced_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds written as text, read again."""
    typed, _ = prepare.coerce(views.written_builds(spark, sf_dir))
    return typed.select("build_id", "grp", "win", F.unix_micros("ts_at").alias("ts_us"), "lead_time_source", r6("lead_time_days", "lead_time_days"), "usage", "loc_total", "bugs", r6("cost_usd", "cost_usd"), "question", "deployed")


def coerce_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that was left out, or whose question is not counted, and why."""
    return prepare.coerce(views.written_builds(spark, sf_dir))[1]


def lead_time_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return b.groupBy("grp", "lead_time_source").agg(F.count("*").alias("n"), r6(F.avg("lead_time_days"), "mean_days"))


def window_counts(spec: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.builds(spark, sf_dir, spec).groupBy("win").agg(F.count("*").alias("n_builds"))


def impact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return b.groupBy("grp", "impact").agg(F.count("*").alias("n_builds"))


def derive_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gate = prepared(spark, sf_dir)
    return spark.createDataFrame([(gate.u, gate.windows[0], gate.windows[-1], len(gate.windows))], "u double, first_win string, last_win string, n_windows long")


def mix(classes: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return build_cells(b, ()).select(*KEYS, "n_builds", *[r6(f"share_{c}", f"share_{c}") for c in classes])


def mix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.cells import mix_levels as levels

    b, _ = prepared(spark, sf_dir)
    return levels(b).select(*KEYS, "n_builds", *[r6(f"share_{c}", f"share_{c}") for c in IMPACT_CLASSES])


def cell_column(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return build_cells(b, ()).select(*KEYS, r6(name, name))


def metric(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return evaluate(b, by_name(DEFAULTS, [name])).select(*KEYS, "n_builds", r6(name, "value"), F.col(f"null_{name}").alias("nulls_skipped"))


def formula(expression: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return evaluate(b, [Metric("value", "descriptor", "min", expression)]).select(*KEYS, r6("value", "value"))


def formula_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formulas say beside their values, a row a note."""
    b, _ = prepared(spark, sf_dir)
    metrics = [Metric(n, "descriptor", "min", e) for n, e in oracle.NOTED.items()]
    said = F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(f"note_{m.name}").alias("notes")) for m in metrics]))
    return evaluate(b, metrics).select(*KEYS, said.alias("_n")).select(*KEYS, "_n.metric", F.explode("_n.notes").alias("note"))


def objective_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(*KEYS, *[r6(n, n) for n in NORMS])


def objective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(*KEYS, *[r6(f"{n}_rank", f"{n}_rank") for n in OBJECTIVES])


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    right = {n: F.col(f"{n}_rank") for n in OBJECTIVES} | {f"share({x})": F.col(f"share_{x}") for x in (*IMPACT_CLASSES, *QUESTION_CLASSES)}
    got = screen.conflict_screen(c, list(KEYS), {n: F.col(f"{n}_rank") for n in OBJECTIVES}, right)
    return got.filter("a <> b").select("a", "b", "n", r6("tau", "tau"), screen.verdict(F.col("tau")).alias("verdict"))


# -- fronts -----------------------------------------------------------------


def pareto_front(on: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a window that no other dominates (on win), or windows of a group (on grp)."""
    return D.front(cells(spark, sf_dir), [on], NORMS).select(*KEYS, "n_builds", *[r6(n, n) for n in OBJECTIVES])


def pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.layers(cells(spark, sf_dir), ["win"], ["grp"], NORMS).select(*KEYS, "layer")


def epsilon_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.epsilon_front(cells(spark, sf_dir), ["win"], NORMS, {n: EPSILON for n in NORMS}).select(*KEYS)


def k_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    out = [D.k_front(c, ["win"], NORMS, k).select(F.lit(k).cast("long").alias("k"), *KEYS) for k in range(len(NORMS), 1, -1)]
    return out[0].unionByName(out[1])


def k_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cycles(D.k_edges(cells(spark, sf_dir), ["win"], "grp", NORMS, 2), ["win"])


def skyline_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.skyline_frequency(cells(spark, sf_dir), ["win"], ["grp"], NORMS)


def delta_moss_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.delta_subsets(cells(spark, sf_dir), ["win"], NORMS)
    return got.select("win", F.col("mask").cast("long").alias("mask"), r6("delta", "delta"))


def hypervolume_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hypervolume(cells(spark, sf_dir), ["win"], NORMS).select("win", r6("hypervolume", "hypervolume"), "points")


def hypervolume_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = spark.range(40).select((F.col("id") / 40).alias("x"), F.sqrt(1 - (F.col("id") / 40) * (F.col("id") / 40)).alias("y"))
    return D.hypervolume(pts.withColumn("k", F.lit("arc")), ["k"], ["x", "y"])


def distance_to_ideal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.distance_to_ideal(cells(spark, sf_dir), ["win"], ["grp"], NORMS).select(*KEYS, *[r6(c, c) for c in ("l1", "l2", "linf")])


def weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.weighted(cells(spark, sf_dir), ["win"], ["grp"], NORMS, [f"{n}_rank" for n in OBJECTIVES])
    return got.select(*KEYS, r6("weighted_sum", "weighted_sum"), r6("average_rank", "average_rank"))


def staircase_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.staircase(cells(spark, sf_dir), ["win"], NORMS[0], NORMS[1])
    return got.select("win", r6("x", "x"), r6("least", "least"))


def knee_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.knee_2d(cells(spark, sf_dir), ["win"], ["grp"], NORMS[0], NORMS[1]).select(*KEYS, r6("bend", "bend"))


def knee_hyperplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.knee_plane(cells(spark, sf_dir), ["win"], "grp", NORMS).select(*KEYS, r6("score", "score"), "method")


def expected_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.expected_maxima_table(spark, 30, 4).select("n", "d", r6("a", "a"))


def _taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win, a, b, tau of the ranks of objectives and of two shares, over the groups of each window."""
    names = [*OBJECTIVES, "share_sunk", "share_impactful"]
    ranks = {n: F.col(f"{n}_rank") for n in OBJECTIVES} | {n: F.col(n) for n in names[3:]}
    return screen.screen_within(cells(spark, sf_dir), ["win"], ["grp"], ranks)


def axis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*OBJECTIVES, "share_sunk", "share_impactful"]
    return screen.axis_orders(_taus(spark, sf_dir), ["win"], names)


def greedy_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*OBJECTIVES, "share_sunk", "share_impactful"]
    return screen.reductions(_taus(spark, sf_dir), ["win"], names)


def delta_moss_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.moss_ladders(cut(D.delta_subsets(cells(spark, sf_dir), ["win"], NORMS)), ["win"], list(OBJECTIVES))
    return got.select("win", "size", "added", "mask", r6("delta", "delta"), "smallest_exact")


def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    sizes = screen.permuted_fronts(c, ["win"], ["grp"], NORMS, PERMUTATIONS)
    n = D.complete(c, NORMS).groupBy("win").agg(F.count("*").alias("n"))
    got = screen.null_model(sizes, ["win"], n, len(NORMS))
    return got.select("win", "n", "observed", r6("mean", "mean"), "p05", "p95", r6("percentile", "percentile"), "verdict", r6("closed_form", "closed_form"))


# -- uncertainty ------------------------------------------------------------


def _replicates(spark: SparkSession, sf_dir: str, replicates: int = BOOTSTRAP) -> DataFrame:
    b, _ = prepared(spark, sf_dir)
    return cut(uncertainty.bootstrap(b, by_name(DEFAULTS, OBJECTIVES), replicates))


def bootstrap_p_on_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = uncertainty.p_on_front(_replicates(spark, sf_dir), ["win"], ["grp"], list(OBJECTIVES))
    return got.select(*KEYS, "usable", "wins", r6("p_on_front", "p_on_front"))


def prob_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = uncertainty.dominance_rates(_replicates(spark, sf_dir), ["win"], "grp", list(OBJECTIVES))
    return got.select("win", "a", "b", "comparable", r6("rate", "rate"))


def bootstrap_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = uncertainty.epsilons(_replicates(spark, sf_dir), ["win"], ["grp"], list(OBJECTIVES))
    return got.select("win", *[r6(c, f"eps_{c}") for c in OBJECTIVES])


def attainment_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = _replicates(spark, sf_dir, ATTAINMENT_REPLICATES).withColumns({c: F.round(c, 2) for c in ("cost", "lead_time")})
    got = uncertainty.attainment(reps, ["win"], "cost", "lead_time")
    return got.select("win", *[r6(c, c) for c in ("x", "p10", "p50", "p90")])


def marginal_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = uncertainty.marginal_utility(cells(spark, sf_dir), ["win"], ["grp"], NORMS)
    return got.select(*KEYS, r6("utility", "utility"))


def parametric_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).select(*KEYS, "cost", "lead_time", (F.col("cost") / 20).alias("cost_se"), F.when(F.col("grp") != "BUILDING", F.lit(0.5)).otherwise(0.0).alias("lead_time_se"))
    got = uncertainty.parametric(c, ["cost", "lead_time"], 20)
    return got.select("rep", *KEYS, F.round("cost", 5).alias("cost"), F.round("lead_time", 5).alias("lead_time"))


# -- time -------------------------------------------------------------------


def clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.with_clr(cells(spark, sf_dir)).select(*KEYS, *[r6(f"clr_{p}", f"clr_{p}") for p in IMPACT_CLASSES], r6("clr_delta", "clr_delta"))


def aitchison_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = movement.mix_movement(cells(spark, sf_dir))
    return got.select("grp", "from_win", "to_win", "available", r6("distance", "distance"), r6("top_contribution", "top_contribution"))


def direction_of_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = movement.travel(cells(spark, sf_dir), NORMS)
    return got.select("grp", "from_win", "to_win", "available", r6("magnitude", "magnitude"), F.round("angle", 4).alias("angle"), "reading")


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.persistence(D.flagged(cells(spark, sf_dir), ["win"], ["grp"], NORMS))


def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = views.builds(spark, sf_dir)
    gate = prepare.derive_gate(builds, as_of=views.AS_OF)
    got = prepare.sensitivity(builds, gate, SENSITIVITY)
    return got.select("level", *KEYS, "n_builds", *[r6(f"share_{c}", f"share_{c}") for c in IMPACT_CLASSES])


def lead_time_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.lead_time_check(cells(spark, sf_dir), ["win"]).select("win", "mixed_cells", r6("spread", "spread"), "divergent")


def explain_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.explain import dominators

    got = dominators(cells(spark, sf_dir), "win", "grp", list(OBJECTIVES), NORMS)
    return got.select("win", "grp", "dominators", "binding_objective", "closest_dominator", r6("largest_gap", "largest_gap"))


# -- store ------------------------------------------------------------------


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Builds as stored, and a batch of them with duplicates, conflicts and rows to reject."""
    raw = views.raw_builds(spark, sf_dir)
    n = F.expr("cast(substr(build_id, 3) as bigint)")
    base = raw.select("build_id", F.col("grp").alias("group"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.date_format("first_commit", "yyyy-MM-dd").alias("first_commit_ts"), F.col("loc_added").cast("string").alias("loc_added"), F.col("loc_removed").cast("string").alias("loc_removed"), F.round("cost_usd", 2).cast("string").alias("cost_usd")).withColumn("_n", n)
    stored = base.filter("_n % 3 <> 0").drop("_n")
    batch = base.filter("_n % 2 = 0").withColumn("cost_usd", F.when(F.col("_n") % 10 == 0, F.lit("1.0")).otherwise(F.col("cost_usd"))).withColumn("ts", F.when(F.col("_n") % 14 == 0, F.lit("")).otherwise(F.col("ts")))
    again = base.filter("_n % 8 = 0").withColumn("cost_usd", F.col("cost_usd"))
    batch = batch.withColumn("_order", F.col("_n") * 2).unionByName(again.withColumn("_order", F.col("_n") * 2 + 1)).drop("_n")
    return stored, batch


def ingest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import classify_ingest

    stored, batch = _incoming(spark, sf_dir)
    got = classify_ingest(batch, stored, order="_order")
    return got.groupBy("status", "field").agg(F.count("*").alias("n"))


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import latest

    t = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("version"), F.col("p_partkey").alias("defined"))
    t = t.groupBy("name", "version").agg(F.min("defined").alias("defined"))
    return latest(t, ["name"], "version").select("name", "version", "defined")


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.diff import diff_cells

    c = cells(spark, sf_dir).select(*KEYS, *OBJECTIVES)
    wins = sorted(r["win"] for r in c.select("win").distinct().collect())
    a, b = c.filter(F.col("win") != wins[-1]), c.filter(F.col("win") != wins[0]).withColumn("cost", F.col("cost") * 1.1)
    got = diff_cells(a, b, list(OBJECTIVES))
    return got.select(*KEYS, "status", *[r6(f"delta_{n}", f"delta_{n}") for n in OBJECTIVES])


def aggregate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.aggregate import prepare_aggregate_cells

    c = cells(spark, sf_dir)
    raw = c.select(F.col("grp").alias("group"), F.col("win").alias("window"), F.col("n_builds").cast("string").alias("n_builds"), *[F.round(n, 6).cast("string").alias(n) for n in OBJECTIVES], *[F.col(f"share_{x}").cast("string").alias(f"share_{x}") for x in IMPACT_CLASSES])
    got, _ = prepare_aggregate_cells(raw, list(OBJECTIVES), keep=4)
    return got.select(*KEYS, "n_builds", *[r6(n, n) for n in OBJECTIVES])


# -- the tail ---------------------------------------------------------------


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.anchored(views.commits(spark, sf_dir))


def _feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with an anchor of any kind, without infra commits."""
    return _anchored(spark, sf_dir).filter(~tail.infra_only(F.col("files")))


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quiet_split's rows of every anchored cluster."""
    feature = rewritten(_feature(spark, sf_dir).select("key", "sha", "at", "subject", "insertions", "deletions"))  # read three times
    t0 = tail.ship_moments(feature, views.deploy_events(spark, sf_dir), ["key"])
    end = views.table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("e")).first()["e"]
    return tail.quiet_split(feature, t0.select("key", "t0"), ["key"], F.lit(end).cast("timestamp"), QUIET)


def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir).groupBy("key").agg(F.count("*").alias("commits"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.count_if(tail.infra_only(F.col("files"))).alias("infra"))


def t0_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship moments of all anchored clusters by all hints."""
    got = tail.ship_moments(_feature(spark, sf_dir), views.deploy_events(spark, sf_dir), ["key"])
    return got.select("key", F.unix_micros("first_at").alias("first_us"), F.unix_micros("t0").alias("t0_us"))


def quiet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tail.measured(_shipped(spark, sf_dir))
    return got.select("key", "commits", "pre_churn", "post_churn", F.col("deploys_to_stability").cast("long").alias("deploys_to_stability"), "censored", "resolved", r6("rework_ratio", "rework_ratio"), r6("tail_mass", "tail_mass"))


def km_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tail.survival(_shipped(spark, sf_dir).withColumn("all", F.lit(1)), ["all"])
    return got.select("t", r6("survival", "survival"))


def tail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(_shipped(spark, sf_dir).withColumn("threshold", F.lit(1)))
    got = tail.summary(t, tail.survival(t, ["threshold"]), ["threshold"])
    return got.drop("threshold")


def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.cluster(views.commits(spark, sf_dir).drop("tick"), SWEEP).groupBy("threshold", "key").agg(F.count("*").alias("commits"))


def flow_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of the orders of each segment: what they delivered, by size threshold."""
    b = views.raw_builds(spark, sf_dir).filter("loc_added IS NOT NULL")
    b = b.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in SWEEP]))).filter(F.col("loc_added") >= F.col("threshold") * 20)
    runs = b.groupBy(F.col("grp").alias("label"), "threshold").agg(
        F.count_if(F.col("served").isNotNull()).alias("delivered"), F.round(F.count_if(F.col("bugs") > 1) / F.count("*"), 3).alias("never_stabilises_share"), F.sum(F.col("loc_added") + F.col("loc_removed")).alias("churn_total"),
        F.min("ts").cast("timestamp").alias("first_at"), F.max("ts").cast("timestamp").alias("last_at"),
    )
    # one flow has too few settled builds to tell at the largest size
    runs = runs.withColumn("never_stabilises_share", F.when((F.col("label") != "FURNITURE") | (F.col("threshold") < max(SWEEP)), F.col("never_stabilises_share")))
    costed = F.col("label").isin("BUILDING", "MACHINERY")
    runs = runs.withColumns({"dollars": F.when(costed, F.col("delivered") * 25.0), "engineer_months": F.when(costed, F.lit(24.0))})
    return tail.flow_frontier(cut(runs))


def session_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_roots(views.sessions(spark, sf_dir))


def session_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose parent links run in loops: of four, of one, with tails that lead into them, and into the next ones' tails."""
    ups = F.expr("case event_id % 12 when 0 then 3 when 1 then 0 when 2 then 1 when 3 then 2 when 4 then 0 when 5 then 4 when 6 then 5 when 7 then 7 when 8 then 7 when 10 then 9 when 11 then 18 end")
    links = views.table(spark, sf_dir, "events").select(F.concat(F.lit("s-"), "event_id").alias("sid"), F.concat(F.lit("s-"), F.col("event_id") - F.col("event_id") % 12 + ups).alias("parent"))
    return sessions.session_roots(links)


def session_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sessions(spark, sf_dir)
    return sessions.fanout(s, sessions.session_roots(s))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session archives made of events: archive, label, n."""
    e = views.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 7).alias("archive"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("tokens"))


def agent_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _archives(spark, sf_dir).select("archive", F.col("label").alias("model"), (F.col("tokens") * 1000).alias("tokens"))
    prices = spark.createDataFrame([("view", 3.0), ("click", 0.25), ("purchase", 15.0)], "model string, usd_per_million_tokens double")
    return sessions.agent_spend(tokens, prices)


def never_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("view", "success"), ("error", "failure"), ("signup", "unknown")) for x in p])
    return sessions.never_landed(_archives(spark, sf_dir).select("archive", F.try_element_at(names, F.col("label")).alias("outcome"), "n"))


def workflow_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("view", "quick"), ("click", "quick"), ("error", "automation"), ("purchase", "marathon"), ("signup", "deep")) for x in p])
    t = views.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 29).alias("archive"), F.element_at(names, F.col("event_type")).alias("archetype")).agg(F.sum(F.col("event_id") % 5).alias("n"))
    return sessions.workflows(t)


# -- documents --------------------------------------------------------------


def analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.analysis import analyse_view

    import json

    return spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in analyse_view(spark, sf_dir).items()], "section string, body string")


def findings_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.analysis import analyse_view
    from .plans.report import findings

    return spark.createDataFrame(findings(analyse_view(spark, sf_dir)), "kind string, comparison string, subject string, value string")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "pareto_front_across": partial(pareto_front, "win"), "pareto_front_within": partial(pareto_front, "grp"),
        "window_week": partial(window_counts, "week"), "window_quarter": partial(window_counts, "quarter"),
        "impact_mix": partial(mix, IMPACT_CLASSES), "question_mix": partial(mix, QUESTION_CLASSES),
        **{n: partial(cell_column, n) for n in ("unclassified_share", "fallback_share", "gate_unavailable_share")},
        **{f"metric_{m.name}": partial(metric, m.name) for m in DEFAULTS},
        **{f"formula_{k}": partial(formula, e) for k, e in oracle.FORMULAS.items()},
    }
    named = (
        builds_prepared, coerced_builds, coerce_warnings, lead_time_source, impact_gate, derive_u, formula_notes, objective_minmax, objective_rank, kendall_tau, pareto_layers, epsilon_front, k_dominance, k_cycles, skyline_frequency, delta_moss_subsets, delta_moss_ladder, axis_order, greedy_reduction,
        hypervolume_exact, hypervolume_mc, distance_to_ideal, weighted_sum, staircase_2d, mix_levels, knee_2d, knee_hyperplane, expected_maxima, permutation_null, bootstrap_p_on_front, prob_dominance, bootstrap_epsilon, attainment_bands,
        marginal_utility, parametric_replicates, clr, aitchison_movement, direction_of_travel, persistence, threshold_sensitivity, lead_time_divergence, explain_dominators, ingest_classify, registry_latest, run_diff,
        aggregate_cells, anchor_clusters, t0_resolve, quiet_split, km_survival, tail_summary, greedy_clusters, flow_frontier, session_roots, session_loops, session_fanout, agent_spend, never_landed, workflow_label, analysis_json, findings_block,
    )
    return out | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
