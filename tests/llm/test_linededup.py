"""Line dedup against lines held in dictionaries; sliced keys; bitmaps."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import linededup as L

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def plain(rows):
    """(doc_id, n_lines, kept lines, n_dropped) of every (doc_id, text)."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(i)
    low = lambda i: -(2**70) if i is None else i
    keeper = {k: max(v, key=low) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = L.line_dedup(df).drop("keep").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_tables(docs, odd, empty):
    for df in (docs, odd, empty):
        check(df)


def repeats(spark, seed=6):
    rng = random.Random(seed)
    common = ["A common line of text number one", "another Common line of text, two", "short", "", " \t ", "exactly twenty chars", "nineteen characters", "ünï çödé line with accents", "\x00\x0b\x0c odd blanks at the ends \x0c"]
    rows = []
    for i in range(150):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in rng.choices(common, k=rng.randrange(8))]
        lines += [f"a line of its own, {rng.randrange(60)} and so on" for _ in range(rng.randrange(4))]
        if i % 3 == 0:
            lines = [common[0]] * rng.randrange(200) + lines
        rng.shuffle(lines)
        rows.append((None if i % 17 == 0 else i // 2, "\n".join(lines) if i % 13 else None))
    rows += [rows[1]] * 40 + [rows[0]] * 5
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("least", [500, 5])
def test_sliced_keys(spark, monkeypatch, least):
    monkeypatch.setattr(L, "LEAST", least)
    df = repeats(spark)
    if least == 5:
        assert L.frequent_keys(L.line_keys(df))[0]
    check(df)


def test_two_holders_keep(spark):
    line = "the same long line in documents"
    two = spark.createDataFrame([(1, line), (2, f"{line}\n{line}"), (2, line)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in L.line_dedup(two).collect())
    three = two.union(spark.createDataFrame([(None, f"x\n{line.upper()}\ny")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in L.line_dedup(three).collect()) == [(0, 1), (1, 1), (2, 0), (2, 0)]


def test_bitmap_says_what_stays(spark):
    text = "\n".join(f"line number {i} of the long document" for i in range(1000))
    rows = [(9, text), *[(k, "\n".join(f"line number {i} of the long document" for i in (0, 63, 64, 700))) for k in (10, 11)]]
    out = {r["doc_id"]: r for r in L.thinned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(e["gap"], e["bits"] & (2**64 - 1)) for e in out[9]["keep"]] == [(0, (2**64 - 1) & ~(1 | 1 << 63)), (0, (2**64 - 1) & ~1), (8, (2**64 - 1) & ~(1 << 700 % 64))]
    assert out[9]["text"].split("\n") == [x for i, x in enumerate(text.split("\n")) if i not in (0, 63, 64, 700)]
    assert out[11]["keep"] is None and out[10]["text"] == "" and out[10]["n_dropped"] == 4


def test_other_columns(odd):
    out = L.thinned(odd)
    assert set(out.columns) == set(odd.columns) | {"n_lines", "n_dropped", "keep"}
    assert out.count() == odd.count()


def test_no_python(docs):
    plan = L.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and docs.filter(F.lit(True)).count()
