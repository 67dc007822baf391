from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import prepare as P

RAW = ", ".join(f"`{c}` string" for c in P.RAW_COLUMNS)


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in P.RAW_COLUMNS) for r in rows], RAW)


def build(i, **more):
    return {"build_id": f"b-{i}", "group": "g", "first_commit_ts": "2026-04-01", "ts": "2026-04-05T10:00:00Z", "loc_added": "10", "loc_removed": "2"} | more


@pytest.mark.parametrize(
    "text, window",
    [("2026-04-30T23:30:00-05:00", "2026-04"), ("2026-04-30", "2026-04"), ("2026/05/01", "2026-05"), ("02/05/2026", "2026-05"), ("2026-05-01 00:10:00", "2026-05"), (" 2026-05-01T00:10Z ", "2026-05"), ("20260501", None), ("2026", None), ("soon", None)],
)
def test_timestamps(spark, text, window):
    good, bad = P.coerce(raw(spark, build(1, ts=text)))
    assert [r["win"] for r in good.collect()] == ([window] if window else [])
    assert [r["code"] for r in bad.collect()] == ([] if window else ["BAD_TIMESTAMP"])


def test_windows(spark):
    df = spark.sql("select timestamp_ntz'2021-01-03 10:00:00' as t")
    assert df.select(*[P.window_label(F.col("t"), s) for s in ("week", "quarter", "month")]).first()[:] == ("2020-W53", "2021-Q1", "2021-01")


@pytest.mark.parametrize("label, start", [("2026-04", (2026, 4, 1)), ("2026-Q4", (2026, 10, 1)), ("2020-W53", (2020, 12, 28)), ("2021-W01", (2021, 1, 4))])
def test_window_start(spark, label, start):
    assert P.window_start(label) == datetime(*start)
    spec = {"W": "week", "Q": "quarter"}.get(label[5], "month")
    df = spark.createDataFrame([(P.window_start(label).isoformat(),)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert df.select(P.window_label(F.col("t"), spec)).first()[0] == label


def test_warnings_and_defaults(spark):
    good, bad = P.coerce(raw(spark, build(1, group=" ", question="style", bugs="2.5", usage="nan"), build(2, loc_added=""), build(3, ts=None), build(4, build_id=None)))
    r = {x["build_id"]: x for x in good.collect()}
    assert r["b-1"]["grp"] == "all" and r["b-1"]["bugs"] == 2.0 and r["b-1"]["usage"] is None and r["b-1"]["loc_total"] == 12.0
    assert sorted(x["code"] for x in bad.collect()) == ["MISSING_REQUIRED", "MISSING_REQUIRED", "UNKNOWN_QUESTION"]
    assert any(k.startswith("row-") for k in r)


def test_lead_time_and_gate(spark):
    at = {"deployed_at": "2026-04-06", "served_at": "2026-04-08"}
    rows = [
        build(1, **at, usage="926"), build(2, **at, usage="10"), build(3, deployed_at="2026-04-06", usage="0"), build(4), build(5, carried_into="b-1"), build(6, deployed_at="2026-04-06"), build(7, deployed_at="2026-04-06", usage="-1"),
        build(8, deployed_at="2026-04-06", usage="3"), build(9, ts="2026-06-10", **at, usage="5"),
    ]
    good, _ = P.coerce(raw(spark, *rows))
    gate = P.derive_gate(good, datetime(2026, 6, 15, tzinfo=timezone.utc), u=100.0)
    got = {r["build_id"]: r for r in P.classify(good, gate).collect()}
    assert [got[f"b-{i}"]["impact"] for i in range(1, 10)] == ["impactful", "low_impact", "liability", "sunk", "carried", "impactful", "liability", "low_impact", "unresolved"]
    assert [got[f"b-{i}"]["lead_time_days"] for i in (1, 3, 6, 8)] == [7.0, None, 5.0, 5.0]
    assert [got[f"b-{i}"]["lead_time_source"] for i in (1, 3, 6)] == ["SERVED", None, "DEPLOYED"]
    assert got["b-6"]["gate_unavailable"] and not got["b-1"]["gate_unavailable"]


def test_retention_and_threshold(spark):
    rows = [build(i, ts=f"2026-{i:02d}-05", first_commit_ts=f"2026-{i:02d}-01", deployed_at=f"2026-{i:02d}-06", served_at=f"2026-{i:02d}-07", usage=str(i)) for i in range(1, 9)]
    good, _ = P.coerce(raw(spark, *rows))
    gate = P.derive_gate(good, datetime(2026, 12, 1, tzinfo=timezone.utc))
    assert gate.windows == [f"2026-{i:02d}" for i in range(3, 9)] and gate.dropped == ["2026-01", "2026-02"] and gate.u == 5.5
    one = P.derive_gate(good, datetime(2026, 12, 1, tzinfo=timezone.utc), baseline="2026-04")
    assert one.u == 4.0
    none = P.derive_gate(good.withColumn("usage", F.lit(None).cast("double")), datetime(2026, 12, 1, tzinfo=timezone.utc))
    assert none.u is None and none.u_source.startswith("UNAVAILABLE")


def test_nothing_usable(spark):
    good, _ = P.coerce(raw(spark, build(1, ts="never")))
    with pytest.raises(ValueError):
        P.derive_gate(good)
