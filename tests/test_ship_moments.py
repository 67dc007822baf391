"""Ship moments of whole tables against brute force."""

from pyspark.sql import functions as F

from millrace import registry
from millrace.operators import tail
from millrace.sources import views


def test_every_cluster_and_hint(spark, sf_dir):
    commits = registry._feature(spark, sf_dir)
    texts, first = {}, {}
    for r in commits.select("key", "subject", F.unix_micros("at").alias("at")).collect():
        texts.setdefault(r["key"], {r["key"].lower()}).add(r["subject"].lower())
        first[r["key"]] = min(r["at"], first.get(r["key"], r["at"]))
    events = [(r["hint"], r["at"]) for r in views.deploy_events(spark, sf_dir).select("hint", F.unix_micros("at").alias("at")).collect()]
    assert any(len(h) > 7 for h, _ in events) and len(texts) > 60
    want = {(k, first[k], min((at for h, at in events if at >= first[k] and any(h in t for t in texts[k])), default=None)) for k in texts}
    assert {tuple(r) for r in registry.queries()["t0_resolve"](spark, sf_dir).select("key", "first_us", "t0_us").collect()} == want


def test_hints_of_any_length(spark):
    rows = spark.createDataFrame([("k1", "Fix AB now", 1), ("k1", "other", 5), ("k2", "long-name-of-it", 2), ("k3", "zz", 9)], "key string, subject string, s long").withColumn("at", F.timestamp_seconds("s"))
    hints = spark.createDataFrame([("b", 3), ("AB N", 2), (" long-name-of-it ", 4), ("o", 1), ("long-name-of-it-x", 3)], "hint string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["key"]: r["t0"] and r["t0"].timestamp() for r in tail.ship_moments(rows, hints, ["key"]).collect()}
    assert got == {"k1": 1.0, "k2": 4.0, "k3": None}
    blank = hints.unionByName(spark.createDataFrame([("", 10), (None, 11)], "hint string, s long").withColumn("at", F.timestamp_seconds("s")))
    assert {r["key"]: r["t0"].timestamp() for r in tail.ship_moments(rows, blank, ["key"]).collect()} == {"k1": 1.0, "k2": 4.0, "k3": 10.0}


def test_pieces_that_are_no_hint_are_not_shuffled(spark, monkeypatch):
    """With more hints than are broadcast, few of the pieces of a text reach the join with them, and none that is a hint is lost."""
    monkeypatch.setattr(tail, "FEW_HINTS", 10)
    rows = spark.range(300).select(F.concat(F.lit("Ticket:"), "id").alias("key"), F.concat(F.lit("ab-"), "id", F.lit(": some longer text of "), F.col("id") % 7).alias("subject"))
    hints = spark.range(0, 600, 2).select(F.concat(F.lit("ab-"), "id").alias("hint"))
    names = [f"ab-{i}" for i in range(0, 600, 2)]
    got = tail.hinted(rows, hints, ["key"])
    want = {(f"Ticket:{i}", h) for i in range(300) for h in names if h in f"ab-{i}: some longer text of {i % 7}"}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in plan.toString() and "_set" in plan.toString()
