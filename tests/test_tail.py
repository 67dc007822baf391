import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import asof as A
from millrace.operators import sessions as S
from millrace.operators import tail as T
from millrace.sources import files, gitlog

DAY0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
COMMITS = "sha string, at timestamp, author string, subject string, files array<string>, insertions long, deletions long"


def commits(spark, *rows):
    return spark.createDataFrame([(f"{i:04d}", DAY0 + timedelta(days=d), "x", s, fs, n, 0) for i, (d, s, fs, n) in enumerate(rows)], COMMITS)


def test_anchors(spark):
    df = spark.createDataFrame([("ABC-12: add",), ("turn on flag: new-search now",), ("feat(cart)!: x",), ('Revert "drop the cache"',), ("tidy up",)], "s string")
    assert [r[0] for r in df.select(T.anchor(F.col("s"))).collect()] == ["ticket:abc-12", "flag:new-search", "conventional-scope:cart", "revert:drop the cache", None]


def test_directories_and_tokens(spark):
    df = spark.createDataFrame([(["a", "a/b", "a/b/c", "a/b/d"], "Fix the Parser for parser_x")], "f array<string>, s string")
    r = df.select(T.directories(F.col("f")), T.tokens(F.col("s")), T.infra_only(F.col("f"))).first()
    assert r[0] == ["a", "a/b"] and sorted(r[1]) == ["parser", "parser_x"] and r[2] is False
    assert df.select(T.infra_only(F.array(F.lit(".github/w.yml")))).first()[0] is True


def test_greedy_clusters(spark):
    c = commits(spark, (0, "speed parser", ["src/p/a"], 1), (1, "speed lexer", ["src/p/b"], 1), (2, "new theme", ["ui/x/a"], 1), (3, "theme colours", ["ui/y/b"], 1))
    got = {}
    for r in T.cluster(c, (1, 3)).collect():
        got.setdefault(r["threshold"], {}).setdefault(r["key"], []).append(r["sha"])
    assert sorted(map(sorted, got[1].values())) == [["0000", "0001"], ["0002", "0003"]]
    assert sorted(map(sorted, got[3].values())) == [["0000", "0001"], ["0002"], ["0003"]]
    assert "cluster:src/p#0" in got[1]


def greedy(rows, threshold):
    """Key of each (words, directories), by comparing every commit with every group."""
    groups, place = [], []
    for words, dirs in rows:
        scores = [2 * len(dirs & g[1]) + len(words & g[0]) for g in groups]
        best = max(range(len(groups)), key=lambda i: (scores[i], -i), default=None)
        if best is None or not scores[best] or scores[best] < threshold:
            best = len(groups)
            groups.append((set(), set()))
        groups[best][0].update(words)
        groups[best][1].update(dirs)
        place.append(best)
    return [f"cluster:{min(groups[i][1], default=f'group-{i}')}#{i}" for i in place]


@pytest.mark.parametrize("seed,words,dirs", [(1, 4, 2), (2, 9, 5), (3, 24, 12)])
def test_greedy_clusters_by_brute_force(spark, seed, words, dirs):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        w = {f"word{chr(97 + rng.randrange(words))}{chr(97 + rng.randrange(words) % 7)}" for _ in range(rng.randrange(4))}
        d = {f"dir{rng.randrange(dirs)}" for _ in range(rng.choice([0, 1, 1, 2]))}
        rows.append((rng.randrange(200), f"{i:04d}", w, d))
    rng.shuffle(rows)
    df = spark.createDataFrame([(sha, DAY0 + timedelta(days=at), "x", " ".join(w) or None, sorted(d), 1, 0) for at, sha, w, d in rows], COMMITS).repartition(3)
    got = {(r["threshold"], r["sha"]): r["key"] for r in T.cluster(df, (1, 2, 3, 4, 6, 9)).collect()}
    rows.sort(key=lambda r: r[:2])
    assert len(got) == 6 * 500
    for t in (1, 2, 3, 4, 6, 9):
        assert [got[t, r[1]] for r in rows] == greedy([r[2:] for r in rows], t)


def test_greedy_clusters_that_never_join(spark):
    """Each of 40,000 commits of two signatures that stay under the threshold is a group; every pair of them is not compared."""
    n = 40_000
    df = spark.range(n).select(F.format_string("%08d", "id").alias("sha"), F.timestamp_seconds("id").alias("at"), F.lit("x").alias("author"), F.lit("speed parser core").alias("subject"), F.array(F.concat(F.lit("src/p"), F.col("id") % 2, F.lit("/a"))).alias("files"), F.lit(1).cast("long").alias("insertions"), F.lit(0).cast("long").alias("deletions"))
    begun = time.monotonic()
    got = T.cluster(df, (6,)).select("sha", "key")
    assert got.filter(F.col("key") != F.concat(F.lit("cluster:src/p"), F.col("sha").cast("long") % 2, F.lit("#"), F.col("sha").cast("long"))).count() == 0
    assert time.monotonic() - begun < 60 and got.count() == n


def test_split_and_survival(spark):
    c = commits(spark, (0, "ONE-1 a", [], 10), (5, "ONE-1 b", [], 5), (30, "ONE-1 c", [], 1), (0, "TWO-2 a", [], 10), (38, "TWO-2 b", [], 10), (0, "SIX-3 a", [], 4), (40, "END-9 z", [], 1))
    ev = spark.createDataFrame([(DAY0 + timedelta(days=1), "one-1"), (DAY0 + timedelta(days=1), "two-2"), (DAY0 - timedelta(days=3), "six-3")], "at timestamp, hint string")
    got = {r["key"]: r for r in T.measured(T.analyse(c, ev, (2,), 7)).collect()}
    one, two, six = got["ticket:one-1"], got["ticket:two-2"], got["ticket:six-3"]
    assert (one["pre_churn"], one["post_churn"], one["deploys_to_stability"], one["censored"]) == (10, 6, 1, False) and one["tail_mass"] == 0.375
    assert two["censored"] and two["rework_ratio"] == 1.0 and not six["resolved"]
    curve = T.survival(T.analyse(c, ev, (2,), 7), ["threshold"]).orderBy("t").collect()
    assert [(r["t"], r["survival"]) for r in curve] == [(0, 1.0), (1, 0.5)]
    s = T.summary(T.analyse(c, ev, (2,), 7), T.survival(T.analyse(c, ev, (2,), 7), ["threshold"]), ["threshold"]).first()
    assert s["clusters_total"] == 4 and s["clusters_resolved"] == 2 and s["never_stabilises_share"] == 0.5


def test_frontier(spark):
    rows = [(n, t, d, nv, ch, DAY0, DAY0 + timedelta(days=61), None, None) for t in (2, 3) for n, d, nv, ch in (("a", 10, 0.1, 1000), ("b", 10, 0.2, 1000), ("c", 4, 0.0, 9000), ("d", 0, None, 1))]
    df = spark.createDataFrame(rows, "label string, threshold int, delivered long, never_stabilises_share double, churn_total long, first_at timestamp, last_at timestamp, dollars double, engineer_months double")
    every = {r["label"]: r for r in T.flow_frontier(df).collect()}
    assert (every["d"]["used"], every["d"]["skipped"], every["d"]["why"]) == (0, True, "nothing delivered")
    assert [every[x]["standing"] for x in "abcd"] == ["always", "never", "always", "never"] and every["a"]["won"] == every["a"]["used"] == 3 and every["a"]["why"] is None
    got = {x: (r["wins"], r["thresholds"]) for x, r in every.items() if r["used"]}
    assert got == {"a": (2, 2), "b": (0, 2), "c": (2, 2)}
    assert T.frontier_note([{"wins": 1, "thresholds": 1}] * 2).startswith("DEGENERATE")


def walk(parent):
    roots = {}
    for s in parent:
        seen, cur = set(), s
        while parent[cur] in parent and cur not in seen:
            seen.add(cur)
            cur = parent[cur]
        roots[s] = cur
    return roots


def test_session_roots(spark):
    rng = random.Random(3)
    deep = {f"d{i}": f"d{i - 1}" if i else None for i in range(40)}
    odd = {"x": "y", "y": "z", "z": "x", "in1": "x", "in2": "in1", "self": "self", "lost": "nobody"}
    wild = {f"w{i}": rng.choice([None, *[f"w{j}" for j in range(60)]]) for i in range(60)}
    parent = deep | odd | wild
    got = {r["sid"]: r["root"] for r in S.session_roots(spark.createDataFrame([(k, v) for k, v in parent.items()], "sid string, parent string")).collect()}
    assert got == walk(parent)


def test_long_loops_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = S.rewritten
    monkeypatch.setattr(S, "rewritten", lambda df: rounds.append(1) or plain(df))
    n = 100_000
    ring = spark.range(n).select(F.concat(F.lit("r"), "id").alias("sid"), F.concat(F.lit("r"), ((F.col("id") + 1) % n)).alias("parent"))
    assert S.session_roots(ring).filter("sid <> root").count() == 0 and len(rounds) < 5
    rounds.clear()
    into = spark.range(300).select(F.concat(F.lit("t"), "id").alias("sid"), F.when(F.col("id") == 0, F.lit("r7")).otherwise(F.concat(F.lit("t"), F.col("id") - 1)).alias("parent"))
    got = S.session_roots(ring.union(into))
    assert got.filter(F.col("sid").startswith("r") & (F.col("sid") != F.col("root"))).count() == 0
    assert got.filter(F.col("sid").startswith("t") & (F.col("root") != "r7")).count() == 0
    assert got.count() == n + 300 and len(rounds) <= 2 * 9 + 4  # both walks take the log of the longest tail


@pytest.mark.parametrize("parts", [1, 7])
def test_next_event(spark, parts):
    rng = random.Random(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        # one key with most of the rows, many equal times, keys without events, null keys and times
        key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None, f"k{rng.randrange(5)}"])
        rows = [(i, key(), rng.choice([None, rng.randrange(50)])) for i in range(400)]
        events = [(rng.choice(["hot", "hot", "a", None, "k1", "z"]), rng.choice([None, rng.randrange(60)])) for _ in range(60)]
        left = spark.createDataFrame(rows, "i int, k string, at int").repartition(3)
        got = {r["i"]: r["nx"] for r in A.next_event(left, spark.createDataFrame(events, "k string, e int"), ["k"], "at", "e", "nx").collect()}
        assert len(got) == 400
        for i, k, at in rows:
            assert got[i] == (None if at is None else min((e for h, e in events if h == k and e is not None and e >= at), default=None))
        plan = A.next_event(left, spark.createDataFrame(events, "k string, e int"), ["k"], "at", "e", "nx")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ship_moments(spark):
    """Hints blank, shared, within the key, within one subject but not across two."""
    c = commits(spark, (0, "ONE-1 start", [], 1), (9, "ONE-1 more", [], 1), (3, "TWO-2 red", [], 1), (4, "TWO-2 blue", [], 1), (20, "SIX-3 x", [], 1))
    clustered = T.anchored(c)
    at = lambda d: DAY0 + timedelta(days=d)
    events = [(at(1), "one-1"), (at(-1), "one-1"), (at(5), "red two"), (at(6), "BLUE"), (at(3), "six"), (at(30), None)]
    got = {r["key"]: r["t0"] for r in T.ship_moments(clustered, spark.createDataFrame(events, "at timestamp, hint string"), ["key"]).collect()}
    day = lambda d: (DAY0 + timedelta(days=d)).replace(tzinfo=None)
    assert got == {"ticket:one-1": day(1), "ticket:two-2": day(6), "ticket:six-3": day(30)}
    none = {r["key"]: r["t0"] for r in T.ship_moments(clustered, spark.createDataFrame([], "at timestamp, hint string"), ["key"]).collect()}
    assert set(none.values()) == {None}


def test_fanout(spark):
    rows = [("a", None, 10.0, 1), ("b", "a", 30.0, 0), ("c", None, 5.0, None), ("d", None, 5.0, 0)]
    df = spark.createDataFrame(rows, "sid string, parent string, effort double, commits long")
    r = S.fanout(df, S.session_roots(df)).first()
    assert (r["runs"], r["multi_session_effort_share"], r["invisible_effort_share_median"], r["no_artifact_effort_share"], r["unrated_effort_share"]) == (3, 0.8, 1.0, 0.1, 0.1)


def test_session_files(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text("# note\n\n" + "\n".join(json.dumps(x) for x in ({"session_id": "a", "tokens": 5, "produced_pr": "u"}, {"id": "b", "parent": "a", "usd": True, "commits": 0}, {"session_id": "c", "repo": "r"}, {"cost": 1})))
    df, unit = files.read_sessions(spark, str(p))
    got = {r["sid"]: (r["parent"], r["effort"], r["commits"], r["repo"]) for r in df.collect()}
    assert unit == "tokens" and got == {"a": (None, 5.0, 1, None), "b": ("a", 1.0, 0, None), "c": (None, 0.0, None, "r")}


def test_archives(spark, tmp_path):
    docs = [
        {"model_mix": {"m1": 100, "m2": {"tokens": 50}, "bad": "x"}, "archetypes": {"quick": 6, "deep": 4}, "outcomes": {"buckets": {"success": 6, "failure": 3, "unknown": 1}}},
        {"model_mix": [{"model": "m1", "total_tokens": 7}, {"name": "m3", "tokens": 3}, 5], "session_archetypes": {"automation": 9, "quick": 1}, "outcome_stats": {"failure": 2}}, {"model_mix": "none"},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    got = files.read_archive(spark, str(tmp_path))
    key = F.regexp_extract("archive", r"(\d)\.json", 1)
    assert sorted((r[0], r[1], r[2]) for r in got["tokens"].select(key, "model", "tokens").collect()) == [("0", "m1", 100), ("0", "m2", 50), ("1", "m1", 7), ("1", "m3", 3)]
    assert {r[0]: r[1] for r in S.workflows(got["archetypes"]).select(key, "workflow").collect()} == {"0": "spec-first", "1": "automation-heavy"}
    assert {r[0]: (r[1], r[2]) for r in S.never_landed(got["outcomes"]).select(key, "sessions", "failure_share").collect()} == {"0": (10, 0.3), "1": (2, 1.0)}
    prices = spark.createDataFrame([("m1", 2.0)], "model string, usd_per_million_tokens double")
    r = {x[0]: x for x in S.agent_spend(got["tokens"], prices).select(key, "tokens_total", "priced_share", "unpriced_models").collect()}
    assert r["0"][1:] == (150, 0.667, "m2")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("# c\n2026-01-01T00:00:00, Flag-A\n2026-01-02\n")
    (tmp_path / "c.csv").write_text("label,dollars,engineer_months\n# x\nteam,100,2\nshort,1\n")
    (tmp_path / "p.csv").write_text("model,usd\nm1,2.5\n")
    assert [(r["hint"], r["at"].day) for r in files.read_deploys(spark, str(tmp_path / "d.csv")).orderBy("at").collect()] == [("flag-a", 1), ("", 2)]
    assert [tuple(r) for r in files.read_costs(spark, str(tmp_path / "c.csv")).collect()] == [("team", 100.0, 2.0)]
    assert [tuple(r) for r in files.read_prices(spark, str(tmp_path / "p.csv")).collect()] == [("m1", 2.5)]


def test_git_log(spark):
    text = "abc\x1f2026-01-02T03:04:05+02:00\x1fme\x1fABC-1 x\x1f\n\n3\t1\ta/b.py\n-\t-\tlogo.png\n"
    r = files.parse_git_log(spark.createDataFrame([(text,)], "value string")).first()
    assert (r["sha"], r["files"], r["insertions"], r["deletions"], r["at"].hour) == ("abc", ["a/b.py", "logo.png"], 3, 1, 1)
    with pytest.raises(RuntimeError):
        files.read_git_log(spark, "/nowhere")


def test_git_source(spark, tmp_path):
    """Slices of two repositories, without merges, and bounds on time that reach git."""
    import subprocess

    repos = []
    for name, n in (("one", 7), ("two", 3)):
        repo = tmp_path / name
        repo.mkdir()
        run = lambda *a, day=1: subprocess.run(["git", *a], cwd=repo, check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), **{f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "me"), ("EMAIL", "me@x"), ("DATE", f"2026-01-{day:02d}T12:00:00+02:00"))}})  # noqa: E731, B023
        run("init", "-q")
        for d in range(1, n + 1):
            (repo / f"f{d}.txt").write_text("a\n" * d)
            run("add", ".")
            run("commit", "-qm", f"ABC-{d} add", day=d)
        repos.append(str(repo))
    df = files.read_git_log(spark, repos)
    assert df.count() == 10 and df.filter("insertions = 4").first()["files"] == ["f4.txt"]
    cut = spark.read.format("millrace_git").option("path", repos[0]).option("slice", 3).load()
    assert cut.rdd.getNumPartitions() == 3 and sorted(r["subject"] for r in cut.collect()) == [f"ABC-{d} add" for d in range(1, 8)]
    assert files.read_git_log(spark, repos[0], since="2026-01-05T00:00:00Z").count() == 3
    some = df.filter((F.col("at") >= F.lit("2026-01-02T10:00:00Z").cast("timestamp")) & (F.col("at") < F.lit("2026-01-04T10:00:00Z").cast("timestamp")) & (F.col("repo") == repos[0]))
    assert sorted(r["subject"] for r in some.collect()) == ["ABC-2 add", "ABC-3 add"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(at" in plan and ">=" not in plan and repos[0] not in plan  # the comparisons are the source's now
    reader = gitlog.GitReader({"path": "\n".join(repos)})
    late = gitlog.GreaterThan(("at",), DAY0 + timedelta(days=4))
    other = gitlog.EqualTo(("sha",), "x")
    assert list(reader.pushFilters([late, gitlog.EqualTo(("repo",), repos[0]), other])) == [other]
    assert reader.repos == repos[:1] and [x for p in reader.partitions() for x in reader.read(p)][-1][4] == "ABC-5 add"
    with pytest.raises(RuntimeError):
        files.read_git_log(spark, str(tmp_path))
