"""Decontamination: places found whatever the size of the benchmark and of its items."""

import random

import pytest

from millrace.llm import decontaminate as C


def planted_in(spark, sizes, replaced, seed):
    """A benchmark of passages of such lengths over a Zipf vocabulary, and documents with one passage each among others' words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    weights = [1 / (k + 20) for k in range(len(vocabulary))]
    say = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [say(n) for n in sizes]
    rows, planted = [], {}
    for d, k in enumerate(rng.sample(range(len(items)), min(600, len(items)))):
        at = rng.randrange(150)
        w = [rng.choice(vocabulary) if rng.random() < replaced else x for x in items[k]]
        text = say(150)
        rows.append((d, " ".join(text[:at] + w + text[at:])))
        planted[d, k] = C.check(*(C._hashes([" ".join(x)])[0].tolist() for x in (items[k], w)))[2]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench, {p for p, leak in planted.items() if leak}


@pytest.mark.parametrize("replaced", [0.0, 0.25])
def test_benchmark_of_thousands(spark, replaced):
    """However many items there are, each planted passage that the check on words calls a leak is found."""
    df, bench, planted = planted_in(spark, [15 + k % 45 for k in range(2500)], replaced, 12)
    assert len(planted) > 400
    assert planted <= {(r["doc_id"], r["item_id"]) for r in C.contaminated(df, bench).collect()}


def test_benchmark_in_parts(spark, monkeypatch):
    df, bench, planted = planted_in(spark, [15 + k % 45 for k in range(90)], 0.0, 13)
    monkeypatch.setattr(C, "MOST_ITEMS", 40)
    assert len(C.fit(df, bench)) == 3
    assert planted <= {(r["doc_id"], r["item_id"]) for r in C.contaminated(df, bench).collect()}
    assert not {r["doc_id"] for r in C.decontaminated(df, bench).collect()} & {d for d, _ in planted}


def test_short_items(spark):
    """Whole copies of items of 1 to 23 words are found, and those of under 8 words nowhere else."""
    df, bench, _ = planted_in(spark, [1 + k % 23 for k in range(460)], 0.0, 14)
    items = {r["item_id"]: f" {r['text']} " for r in bench.collect()}
    truth = {(r["doc_id"], k) for r in df.collect() for k, t in items.items() if t in f" {r['text']} "}
    rows = C.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(got) == len(rows) and truth <= got
    few = {k for k, t in items.items() if len(t.split()) < C.LEAST_WORDS}
    assert {p for p in got if p[1] in few} == {p for p in truth if p[1] in few}


def test_clean_documents_stay(spark):
    """Unrelated items over the same vocabulary, short ones among them, flag no document."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    weights = [1 / (k + 20) for k in range(len(vocabulary))]
    say = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    bench = spark.createDataFrame([(k, say(8 + k % 33)) for k in range(440)], "item_id long, text string")
    df = spark.createDataFrame([(d, say(300)) for d in range(600)], "doc_id long, text string").repartition(4)
    assert C.contaminated(df, bench).collect() == []
    assert C.decontaminated(df, bench).count() == 600


@pytest.mark.parametrize("n", [8, 9, 10, 11])
def test_short_items_with_words_replaced(spark, n):
    """Items of 8 to 11 words are found with a quarter of their words, rounded down, replaced."""
    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    items, rows = [rng.sample(vocabulary, n) for _ in range(40)], []
    for k, item in enumerate(items):
        w = list(item)
        for j in rng.sample(range(n), n // 4):
            w[j] = "zzz"
        rows.append((k, " ".join([*rng.choices(vocabulary, k=90), *w, *rng.choices(vocabulary, k=90)])))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in C.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {(k, k) for k in range(40)} <= got


def test_parts_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(C, "MOST_CHARS", 10)
    rows = [(0, "abcd"), (1, "abcdef"), (2, "x" * 30), (3, None), (4, "abc")]
    assert [[i for i, _ in part] for part in C._parts(iter(rows))] == [[0, 1], [2], [3, 4]]
