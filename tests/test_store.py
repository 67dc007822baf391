import io
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.metrics import DEFAULTS
from millrace.operators.prepare import RAW_COLUMNS
from millrace.plans import cli, toolserver
from millrace.plans.commands import Workbench
from millrace.sources import fixtures
from millrace.store import SCHEMAS, Store, StoreChanged, bucket_of, classify_ingest
from millrace.streaming.ingest import RAW_SCHEMA, daily_counts, ingest_stream
from millrace.streaming.keyed import ingest_keyed


def rows(spark, *rs):
    return spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS) for r in rs], RAW_SCHEMA).coalesce(1)


def b(i, **more):
    return {"build_id": f"b{i}", "group": "g", "first_commit_ts": "2026-01-01", "ts": "2026-01-02", "loc_added": "1", "loc_removed": "0", "cost_usd": "5"} | more


def test_ingest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    first = s.ingest(rows(spark, b(1), b(2, cost_usd=""), b(2), b(3, ts=None), b(3)), "one")
    assert {k: first[k] for k in ("accepted", "duplicate", "conflict", "rejected")} == {"accepted": 2, "duplicate": 0, "conflict": 0, "rejected": 3}
    assert sorted(first["rejections"]) == [("b2", "build_id repeats"), ("b3", "build_id repeats"), ("b3", "ts")]
    again = s.ingest(rows(spark, b(1, cost_usd="5.0"), b(1, build_id=" b1 "), b(2, cost_usd="7"), b(4)), "two")
    assert (again["accepted"], again["duplicate"], again["conflict"], again["rejected"]) == (1, 1, 1, 1) and s.read("issues").count() == 5 and again["conflicts"] == [("b2", "cost_usd")]
    assert s.build_count() == 3 and s.groups() == ["g"] and s.builds(["h"]).count() == 0
    assert {r["build_id"]: r["cost_usd"] for r in s.builds().collect()}["b2"] is None


def test_absent_columns_count_as_null(spark):
    batch = spark.createDataFrame([("b1", "2026-01-02", "2026-01-01", "1")], "build_id string, ts string, first_commit_ts string, loc_added string")
    got = classify_ingest(batch, rows(spark, b(1))).first()
    assert (got["status"], got["field"]) == ("rejected", "loc_removed") and len(got) == 6
    got = classify_ingest(batch.withColumn("loc_removed", F.lit("0")), rows(spark, b(1))).first()
    assert (got["status"], got["field"]) == ("conflict", "group")
    got = classify_ingest(batch.select("build_id", "ts"), rows(spark, b(2))).first()
    assert (got["status"], got["field"]) == ("rejected", "first_commit_ts, loc_added, loc_removed")


def test_run_saved_again_replaces(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    cell = {"group": "g", "window": "2026-01", "n_builds": 3, "layer": 1, "p_on_front": None, "objectives": {}, "descriptors": {}, "impact_mix": {}}
    run = lambda i, n: {"run": {"run_id": i, "metrics": [], "objectives": [], "roles_hash": "", "params": {"n": n}}, "cells": [cell] * n}
    for i, n in (("r-1", 2), ("r-2", 1), ("r-1", 3)):
        s.save_run(run(i, n))
    assert s.read("runs").count() == 2 and s.read("results").count() == 4 and s.load_run("r-1")["run"]["params"]["n"] == 3


def test_failure_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    s.ingest(rows(spark, b(1), b(2)), "one")
    cell = {"group": "g", "window": "2026-01", "n_builds": 3, "layer": 1, "p_on_front": None, "objectives": {}, "descriptors": {}, "impact_mix": {}}
    run = lambda n: {"run": {"run_id": "r-1", "metrics": [], "objectives": [], "roles_hash": "", "params": {"n": n}}, "cells": [cell] * n}
    s.save_run(run(2))
    before = {n: sorted(map(str, s.read(n).collect())) for n in ("builds", "runs", "results", "ingests", "issues")}
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        for step in (lambda: s.ingest(rows(spark, b(3), b(1, cost_usd="9")), "two"), lambda: s.save_run(run(3))):
            with pytest.raises(OSError):
                step()
    assert before == {n: sorted(map(str, s.read(n).collect())) for n in before}
    # half-written data too
    with monkeypatch.context() as m:
        whole = Store._written
        m.setattr(Store, "_written", lambda self, name, df, **t: (_ for _ in ()).throw(OSError("full")) if name == "issues" else whole(self, name, df, **t))
        with pytest.raises(OSError):
            s.ingest(rows(spark, b(3), b(1, cost_usd="9")), "two")
    assert before == {n: sorted(map(str, s.read(n).collect())) for n in before}
    assert s.vacuum() >= 4 and before == {n: sorted(map(str, s.read(n).collect())) for n in before}
    again = s.ingest(rows(spark, b(3), b(1, cost_usd="9")), "two")
    assert (again["accepted"], again["conflict"], again["ingest_id"]) == (1, 1, "i-00002") and s.build_count() == 3


def test_two_writers(spark, tmp_path, monkeypatch):
    """A change that another one overtakes is made again on what that one left."""
    s, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    whole, overtaken = Store._publish, []

    def slow(self, version, tables):
        if self is s and not overtaken:
            overtaken.append(1)
            other.ingest(rows(spark, b(1, cost_usd="6"), b(2)), "other")
        return whole(self, version, tables)

    monkeypatch.setattr(Store, "_publish", slow)
    got = s.ingest(rows(spark, b(1), b(3)), "one")
    assert (got["accepted"], got["conflict"], got["ingest_id"]) == (1, 1, "i-00002") and s.build_count() == 3
    assert {r["build_id"]: r["cost_usd"] for r in s.builds().collect()} == {"b1": "6", "b2": "5", "b3": "5"}
    monkeypatch.setattr(Store, "_publish", lambda *a: False)
    with pytest.raises(StoreChanged):
        s.define("late", "descriptor", "min", "count()")


def test_a_batch_reads_its_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.ingest(rows(spark, *[b(i) for i in range(200)]), "one")
    few = rows(spark, b(7), b(8))
    buckets = [r[0] for r in few.select(bucket_of(F.col("build_id"))).distinct().collect()]
    read = s.read("builds", None, buckets)
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in scan and read.count() < 40 and {"b7", "b8"} <= {r["build_id"] for r in read.collect()}
    assert [r["build_id"] for r in s.builds().limit(3).collect()] == ["b0", "b1", "b10"]


def test_folders_without_manifests_are_taken_over(spark, tmp_path):
    path = str(tmp_path / "db")
    rows(spark, b(1), b(2)).withColumns({"source": F.lit("old"), "ingested_at": F.current_timestamp()}).write.parquet(f"{path}/builds")
    spark.createDataFrame([(r, None, "[]", "", "{}", "{}", json.dumps({"of": r})) for r in ("r-1", "r-2")], SCHEMAS["runs"]).write.parquet(f"{path}/runs")
    s = Store(spark, path)
    assert s.ingest(rows(spark, b(1), b(3)), "new")["duplicate"] == 1 and s.build_count() == 3
    s.save_run({"run": {"run_id": "r-2", "metrics": [], "objectives": [], "roles_hash": "", "params": {}}, "cells": []})
    assert s.read("runs").count() == 2 and s.load_run("r-1") == {"of": "r-1"} and s.load_run("r-2")["cells"] == []


def test_empty_batch(spark):
    none = spark.createDataFrame([], RAW_SCHEMA)
    assert classify_ingest(none, none).count() == 0


def test_metrics(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.seed()
    s.seed()
    assert len(s.latest_metrics()) == 8 and s.read("metrics").count() == 8
    assert s.define("mine", "descriptor", "min", "count()").version == 1
    assert s.define("mine", "descriptor", "min", "count()", "other notes").version == 1
    assert s.define("mine", "descriptor", "max", "count()").version == 2
    assert [m["version"] for m in s.metric_history("mine")] == [1, 2] and s.metric_at("mine", 1)["direction"] == "min"
    with pytest.raises(ValueError):
        s.define("bad", "descriptor", "min", "import os")


def test_cost_moves_on(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.define("cost", "objective", "min", "sum(cost_usd)", version=1)
    s.seed()
    assert {m.name: m.version for m in s.latest_metrics()}["cost"] == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows(spark, b(1), b(2)).write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema(RAW_SCHEMA).parquet(str(src))
        ingest_stream(stream, str(tmp_path / "db"), str(tmp_path / "cp")).awaitTermination()
        rows(spark, b(2), b(3)).write.mode("append").parquet(str(src))
    assert Store(spark, str(tmp_path / "db")).build_count() == 3
    q = daily_counts(spark.readStream.schema(RAW_SCHEMA).parquet(str(src))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").first()["builds"] == 6


def test_keyed_stream(spark, tmp_path):
    """Micro-batches with twins, conflicts and rejects, a restart in between: what batch ingests of the same rows report."""
    batches = [
        [b(1), b(2, cost_usd=""), b(2), b(3, ts=None), b(3), b(None), b(None)],
        [b(1, cost_usd="5.0"), b(1, build_id=" b1 "), b(2, cost_usd="7"), b(3), b(4, loc_added=" ")],
        [b(4), b(3, question="features"), b(9), b(10)],
    ]
    for row in batches[0][5:]:
        row["build_id"] = None
    plain, kept = Store(spark, str(tmp_path / "plain")), Store(spark, str(tmp_path / "keyed"))
    before = [b(9), b(10, cost_usd="1")]
    for s in (plain, kept):
        s.ingest(rows(spark, *before), "before")
    src = tmp_path / "in"
    for batch in batches:
        given = spark.createDataFrame([(*(r.get(c) for c in RAW_COLUMNS), k) for k, r in enumerate(batch)], f"{RAW_SCHEMA}, n long").repartition(3)
        given.write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(f"{RAW_SCHEMA}, n long").parquet(str(src))
        ingest_keyed(stream, str(tmp_path / "keyed"), str(tmp_path / "cp"), order="n").awaitTermination()
        plain.ingest(given, "batch", order="n")
    sizes = lambda s: [tuple(r) for r in s.read("ingests").orderBy("ingest_id").select("accepted", "duplicate", "conflict", "rejected").collect()]
    issues = lambda s: sorted(str((r["ingest_id"], r["build_id"], r["status"], r["field"])) for r in s.read("issues").collect())
    builds = lambda s: sorted(str([r[c] for c in RAW_COLUMNS]) for r in s.builds().collect())
    assert sizes(kept) == sizes(plain) and issues(kept) == issues(plain) and builds(kept) == builds(plain)
    marked = kept.builds().limit(1).withColumns({"status": F.lit("accepted"), "field": F.lit(None).cast("string")})
    assert kept.commit_classified(marked, "stream:0") is None and builds(kept) == builds(plain)  # done already


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    w = Workbench(spark, str(tmp_path_factory.mktemp("bench") / "db"))
    w.ingest(fixtures.ground_truth(spark), "fixture")
    return w


def test_tool_server(bench, tmp_path):
    server = toolserver.Server(bench, str(tmp_path))

    def ask(method, /, **params):
        return server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})["result"]

    def tool(called, /, **args):
        r = ask("tools/call", name=called, arguments=args)
        return r["isError"], r["content"][0]["text"]

    assert ask("initialize")["serverInfo"]["name"] == "millrace" and len(ask("tools/list")["tools"]) == 9 and ask("ping") == {}
    assert tool("list_groups")[1].startswith("[") and not tool("list_windows", as_of="2026-06-01")[0]
    assert tool("define_metric", name="x", role="descriptor", direction="min", expression="os.system('x')")[0]
    assert not tool("submit_builds", builds=[{"build_id": "n1", "ts": "2026-04-01", "first_commit_ts": "2026-03-01", "loc_added": 1, "loc_removed": 2, "group": "agent-heavy"}])[0]
    bad, text = tool("compute", as_of="2026-06-01", u=1000, bootstrap=0, permutations=0, out="a.json")
    got = json.loads(text)
    assert not bad and got["n_cells"] == 30 and (tmp_path / "a.json").exists()
    assert not tool("explain", cell="legacy-owner/2026-04")[0] and tool("explain", cell="no")[0]
    assert tool("render", out="../x.html")[0] and not tool("render", out="x.html")[0]
    assert not tool("diff", a=got["run_id"], b=got["run_id"])[0] and tool("nothing")[0] and tool("explain")[0]
    assert server.handle({"jsonrpc": "2.0", "id": 2, "method": "what"})["error"]["code"] == -32601
    assert server.handle({"jsonrpc": "2.0", "method": "note"}) is None
    out = io.StringIO()
    toolserver.serve(server, ["{bad\n", "\n", json.dumps({"jsonrpc": "2.0", "id": 3, "method": "ping"}) + "\n"], out)
    assert [("error" in json.loads(x)) for x in out.getvalue().splitlines()] == [True, False]


def test_cli(spark, tmp_path, capsys):
    db, csv, out = str(tmp_path / "db"), str(tmp_path / "b.csv"), str(tmp_path / "a.json")
    fixtures.ground_truth(spark).toPandas().to_csv(csv, index=False)
    assert cli.main(["cells", "ingest", csv, "--db", db]) == 0
    assert cli.main(["cells", "compute", "--db", db, "--as-of", "2026-06-01", "--u", "1000", "--bootstrap", "0", "--permutations", "0", "--out", out]) in (0, 1)
    assert cli.main(["cells", "explain", "--cell", "legacy-owner/2026-04", "--run", out]) == 0
    assert cli.main(["cells", "render", out, "--out", str(tmp_path / "p.html")]) == 0
    assert cli.main(["cells", "list", "runs", "--db", db]) == 0
    assert cli.main(["cells", "check", "sum(bugs) / count()"]) == 0
    assert cli.main(["cells", "fixture", "threshold", "--out", str(tmp_path / "f.csv"), "--metrics", str(tmp_path / "m.csv")]) == 0
    from millrace.sources import files

    assert [m.name for m in files.read_metrics_csv(spark, str(tmp_path / "m.csv"))] == [m.name for m in DEFAULTS] and files.read_builds_csv(spark, str(tmp_path / "f.csv")).count() == 34
    assert cli.main(["cells", "check", "import os"]) == 2
    assert cli.main(["cells", "compute", "--objectives", "cost", "nothing", "--builds", csv]) == 2
    capsys.readouterr()


def test_cli_tail(spark, tmp_path, capsys):
    runs = []
    for n, used in (("a", 5), ("b", 3)):
        p = tmp_path / f"{n}.json"
        p.write_text(json.dumps({"workflow": "unknown (x)", "window": {"first": "2026-01-01T00:00:00+00:00", "last": "2026-03-01T00:00:00+00:00"}, "sweep": {"2": {"shipped_capability_count": used, "never_stabilises_share": 0.2, "churn_total": 1000}}}))
        runs.append(str(p))
    assert cli.main(["tail", "--front", *runs]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [(f["label"], f["wins"]) for f in got["flows"]] == [("a", 1), ("b", 0)] and got["note"].startswith("CAUTION")
    assert cli.main(["tail", "--front", runs[0]]) == 2
