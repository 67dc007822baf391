import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import ngram_join as J
from millrace.llm.session import components
from millrace.llm.textbatch import shingle_sets, words

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(size, component) of each row by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def answer(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_jaccard_join(df).collect())


@pytest.fixture(scope="module")
def planted(spark):
    """Groups of copies with more and more words replaced, around a common passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(40)]
    rows, n = [], 0
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 60, 120]))]
        for _ in range(12):
            w = [word() if rng.random() < rng.choice([0.0, 0.01, 0.03, 0.06]) else x for x in base] + (common if g % 3 == 0 else [])
            rows.append((n, " ".join(w).title() if rng.random() < 0.3 else "  ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_documents(docs, texts):
    assert answer(docs) == brute(list(texts.items()))


def test_planted(spark, planted):
    assert answer(frame(spark, planted)) == brute(planted)


def test_every_way_beyond_the_bounds(spark, planted, monkeypatch):
    """Shuffled joins, several blocks a cell, salted lists of frequent shingles."""
    for name, value in (("BROADCAST_ROWS", 0), ("BLOCK", 300), ("HEAVY", 2)):
        monkeypatch.setattr(J, name, value)
    assert answer(frame(spark, planted)) == brute(planted)


def test_without_cells(spark, planted, monkeypatch):
    monkeypatch.setattr(J, "SHARED", 99)
    assert answer(frame(spark, planted)) == brute(planted)


def test_odd(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert answer(odd) == brute(rows)
    kept = J.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_keep_first_judges_rows_not_ids(spark):
    """Repeated and missing ids: of each group one row stays, and texts that are nobody's copy all stay."""
    text = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abcdefg"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (6, text["c"]), (6, text["d"]), (6, text["d"]), (None, text["e"]), (None, text["e"]), (None, text["c"]), (7, text["f"]), (7, text["f"] + " z"), (8, ""), (8, None), (None, ""), (9, text["g"])]
    kept = [(r["doc_id"], r["text"]) for r in J.keep_first(frame(spark, rows)).collect()]
    of = lambda t: next((x for x in "abcdefg" if t.startswith(text[x])), "")
    assert sorted(of(t or "") for _, t in kept) == ["", "", "", *"abcdefg"]
    assert {(d, of(t or "")) for d, t in kept} == {(1, "a"), (5, "b"), (6, "c"), (6, "d"), (None, "e"), (7, "f"), (8, ""), (None, ""), (9, "g")}


def test_many_rows_without_an_id(spark):
    """Near copies without ids, or all with one, are found without joining row to row."""
    rng = random.Random(4)
    for ident in (None, 3):
        rows = [(ident, " ".join(f"{g}w{i}" if rng.random() > 0.01 else f"x{rng.random()}" for i in range(60))) for g in range(8) for _ in range(6)]
        assert answer(frame(spark, rows)) == brute(rows)


def test_long_lists_go_last(spark, monkeypatch):
    """Texts that share a passage but are no copies meet less often, and links stay exact."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"{d}u{i}" for i in range(rng.randrange(40, 90))] + passage)) for d in range(160)] + [(900 + d, " ".join([f"{d}u{i}" for i in range(60)] + passage[: rng.randrange(50, 60)])) for d in range(20)]
    made = []
    df = frame(spark, rows)
    docs = df.select("doc_id", "text")
    sketch = np.zeros(1 << J.SKETCH_BITS, np.uint64)
    for least in (10**9, J.LONG):
        monkeypatch.setattr(J, "LONG", least)
        entries = J._entries(docs, sketch, J._long_lists(docs, sketch)).withColumn("cell", J.F.col("node"))
        live = entries.repartition("token", "block").sortWithinPartitions("token", "block", "node").mapInArrow(J._lists(J._live), "list long, block long, node long, n_side long, cell long, m long")
        made.append(live.agg(J.F.sum((J.F.col("m") - 1) / 2)).first()[0])  # pairs on those lists
    assert made[0] > 4 * made[1]  # one round of marking; what takes the marked ones' place is not counted again
    assert answer(df) == brute(rows)


def test_empty(empty):
    assert J.ngram_jaccard_join(empty).count() == 0 and J.keep_first(empty).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 80).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(80) < rng.choice([0.5, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**62, rng.integers(0, 20)).astype(np.uint64)])))
    side = rng.integers(0, 2, 60)
    for cross in (False, True):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j])) and (not cross or side[i] != side[j])}
        assert {tuple(sorted(p)) for p in J.divide_skip(sets, side, cross, links=True)} == want


def test_hits_needed():
    """No linked pair has fewer hits among its rarest members, in any order, than are asked for."""
    rng = np.random.default_rng(7)
    linked = 0
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        a = rng.permutation(200)[:n]
        keep = a[rng.random(n) < rng.choice([0.8, 0.9, 1.0])]
        b = np.union1d(keep, rng.integers(200, 300, rng.integers(0, n // 5 + 1)))
        common = len(np.intersect1d(a, b))
        if not len(b) or 7 * common < 3 * (len(a) + len(b)):
            continue
        linked += 1
        order = rng.permutation(300)
        rare = [sorted(x, key=lambda v: order[v])[: len(x) - J.least_overlap(len(x)) + min(J.SHORT_HITS, J.least_overlap(len(x)))] for x in (a.tolist(), b.tolist())]
        assert len(set(rare[0]) & set(rare[1])) >= J.hits_needed(np.array([len(a)]), np.array([len(b)]))[0]
    assert linked > 500


def test_words_and_shingles():
    texts = ["A b  c\nd e f", "", None, "ÀB àb", "x y z", "x y z"]
    got = [w for w in words(pa.array(texts))]
    assert [np.diff(w.bounds).tolist() for w in got] == [[6, 0, 0, 2, 3, 3]]
    s = shingle_sets(got[0])
    assert [len(x) for x in s] == [2, 0, 0, 1, 1, 1] and s[4] == s[5]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            root[find(max(a, b))] = find(min(a, b)) if find(a) != find(b) else find(a)
    groups = defaultdict(list)
    for x in root:
        groups[find(x)].append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plan_has_no_cross_join(docs):
    plan = J.ngram_jaccard_join(docs)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_near_copies_over_many_cells_make_few_pairs(spark, monkeypatch):
    """One large group, no two of its nodes in a cell: what meets grows with its size, not with the square."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(d, " ".join(f"x{rng.random()}" if rng.random() < 0.008 else x for x in base)) for d in range(240)]
    made = []
    verified = J._verified
    monkeypatch.setattr(J, "SHARED", 99)
    monkeypatch.setattr(J, "_verified", lambda docs, nodes, met: (made.append(met.count()), verified(docs, nodes, met))[1])
    assert answer(frame(spark, rows)) == brute(rows)
    assert sum(made) < 240 * 239 / 2 * 8


def test_shared_passages_make_no_square_of_pairs(spark, monkeypatch):
    """Texts made of 5 of 40 passages: pairs that share too little are counted in arrays, so rows grow with the texts; links stay exact."""
    rng = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(40)]
    made = []
    verified = J._verified
    monkeypatch.setattr(J, "_verified", lambda docs, nodes, met: (made.append(met.count()), verified(docs, nodes, met))[1])
    totals = []
    for n in (200, 1000):
        made.clear()
        rows = [(d, " ".join(rng.sample(passages, 5))) for d in range(n)]
        got = answer(frame(spark, rows))
        totals.append(sum(made))
        if n == 200:
            assert got == brute(rows)
    assert totals[1] < 10 * totals[0]  # the square would be 25 times


@pytest.mark.parametrize("many", [1, 8, 10**6])
def test_counting_in_arrays_and_as_rows(spark, monkeypatch, many):
    """Whichever lists count as long, groups across cells are the same: near copies, shared passages, small sets."""
    monkeypatch.setattr(J, "MANY", many)
    monkeypatch.setattr(J, "SHARED", 99)
    rng = random.Random(12)
    base = [[f"g{g}w{i}" for i in range(rng.choice([3, 6, 9, 40, 80]))] for g in range(12)]
    rows = []
    for d in range(150):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w += rng.choice(base)[: rng.randrange(9)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    assert answer(frame(spark, rows)) == brute(rows)


def test_signatures_bound_what_is_shared():
    rng = np.random.default_rng(8)
    for size in (1, 50, 3000, 90_000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(size) < 0.8], rng.integers(0, 2**63, size // 3, dtype=np.uint64)])) for _ in range(6)]
        signs = np.frombuffer(b"".join(map(J.sign_of, sets)), np.uint8).reshape(6, J.SIGN)
        for i, s in enumerate(sets):
            assert all(bound >= len(np.intersect1d(s, t)) for t, bound in zip(sets, J.shareable(signs, signs[i]).tolist()))
