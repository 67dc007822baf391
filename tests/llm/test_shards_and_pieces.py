import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hilbert as H
from millrace.llm import pieces as P


def plain_hilbert(axes, bits):
    """Position along the curve, by walking it."""
    n = len(axes)
    x = list(axes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + (v >> b & 1)
    return out


def test_curve(spark):
    side = 1 << 3
    rows = [(a, b, c) for a in range(side) for b in range(side) for c in range(side)]
    got = spark.createDataFrame(rows, "a int, b int, c int").select("a", "b", "c", H.hilbert_index(F.array("a", "b", "c"), 3).alias("h")).collect()
    order = sorted((r["h"], (r["a"], r["b"], r["c"])) for r in got)
    assert [h for h, _ in order] == list(range(side**3))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in zip(order, order[1:]))
    assert all(r["h"] == plain_hilbert((r["a"], r["b"], r["c"]), 3) for r in got)


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_shards(docs, odd, texts, monkeypatch, slice_rows):
    monkeypatch.setattr(H, "SLICE", slice_rows)
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        got = H.hilbert_shards(df).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, [])) for k in range(H.SHARDS)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(H.SHARDS))
        assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_pruning(docs):
    """A shard sees fewer sources and a narrower range of sizes than the table does."""
    got = H.hilbert_shards(docs, 10).join(docs.select("doc_id", "source", "lang"), "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("s"), F.count_distinct("lang").alias("l")).collect()
    n = docs.select("source").distinct().count()
    assert sum(r["s"] for r in got) / len(got) < 0.7 * n


def test_written_shards(docs, odd, empty, tmp_path, spark):
    H.write_shards(docs, str(tmp_path / "a"), 4)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.drop("shard").count() == docs.count() and back.select("shard").distinct().count() == 4
    H.write_shards(odd, str(tmp_path / "b"), 4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == odd.count()
    assert H.hilbert_shards(empty).count() == 0


def test_shards_are_native(docs):
    plan = H.hilbert_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def segmentations(lat, s):
    if not s:
        yield ()
    for k in range(1, len(s) + 1):
        if s[:k] in lat.ids:
            for rest in segmentations(lat, s[k:]):
                yield (lat.ids[s[:k]], *rest)


@pytest.mark.parametrize("word", [" theion", " anhe"])
def test_samples_follow_the_lattice(word):
    lat = P.lattice()
    p = {g: math.exp(sum(lat.logp[i] for i in g)) for g in segmentations(lat, word)}
    total, n = sum(p.values()), 20_000
    got = Counter(tuple(x.tolist()) for x in P.encode([word] * n, list(range(n))))
    assert set(got) <= set(p)
    for g, v in p.items():
        e = v / total
        assert abs(got[g] / n - e) < 5 * math.sqrt(e * (1 - e) / n) + 1e-3
    keys = P.mix(np.arange(3000, dtype=np.uint64)).tolist()
    code = np.array([ord(c) for c in word], np.int64)
    slow = Counter(tuple(i for _, i in reversed(list(P._long(lat, code, k, 0)))) for k in keys)
    top = max(p, key=p.get)
    assert abs(slow[top] / 3000 - p[top] / total) < 0.05


def test_lossless(texts):
    odd = ["", " ", "  a ", "▁x ▁", "日本語\n\t\x00 €𐍈", "a" * 500 + " b", "é" * 45, None, "\r\n\r\n", "x" * 20_000]
    every = [*texts.values(), *odd]
    ids = P.encode(every, list(range(len(every))))
    assert [P.decode(x) for x in ids] == every


def test_reproducible(spark, docs, odd, empty):
    a = {r["doc_id"]: r["ids"] for r in P.encode_documents(docs.repartition(1)).collect()}
    b = {r["doc_id"]: r["ids"] for r in P.encode_documents(docs.repartition(5)).collect()}
    assert a == b
    other = {r["doc_id"]: r["ids"] for r in P.encode_documents(docs, seed=5).collect()}
    assert a != other
    got = P.encode_documents(odd).collect()
    assert len(got) == odd.count() and all(r["lossless"] for r in got) and sum(r["ids"] is None for r in got) == 1
    back = P.encode_documents(odd).select("doc_id", P.decoder()("ids").alias("t")).collect()
    assert Counter((r["doc_id"], r["t"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert P.encode_documents(empty).count() == 0


def test_string_cuts(spark):
    """Quantiles of strings that share long prefixes, against sorting; any string has its own order."""
    rng = random.Random(2)
    values = [f"https://example.org/shard/{rng.randrange(40):03d}" if rng.random() < 0.7 else rng.choice(["", "x", "https:", "é" * 9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s string").select(H._code(F.col("s")).alias("h"))
    order = sorted(v.encode().hex().upper() for v in values)
    assert H.string_cuts(df, ["h"], len(values))["h"] == sorted({order[int(len(values) * k / H.SIDE)] for k in range(1, H.SIDE)})
    assert H.string_cuts(df.limit(0), ["h"], 0) == {"h": []}


def test_shards_part_sources_with_one_prefix(spark):
    rows = [(i, "a b c", "en", f"https://example.org/{i % 8}") for i in range(800)]
    got = H.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    held = {}
    for r in got:
        held.setdefault(r["shard"], set()).add(r["doc_id"] % 8)
    assert len(got) == 800 and all(len(s) == 1 for s in held.values())


def test_long_units(monkeypatch):
    """Units without a space: whatever the window, the same pieces; a very long one is lossless in bounded time."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmno\u00e9\u65e5\u2581\U0001F600xyz0123") for _ in range(n)) for n in (41, 60, 500, 3000)] + ["the" * 40 + "quick" * 30]
    want = [P.encode([t], [k])[0].tolist() for k, t in enumerate(texts)]
    for window in (1, 7, 64):
        monkeypatch.setattr(P, "WINDOW", window)
        assert [P.encode([t], [k])[0].tolist() for k, t in enumerate(texts)] == want
    monkeypatch.undo()
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    assert P.decode(P.encode([text], [1])[0]) == text
