"""Language ID, toxicity, quality rules, language model."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import brown, langid, quality, toxicity

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def more_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


def test_language_accuracy(more):
    lang = {r["doc_id"]: r["lang"] for r in more.select("doc_id", "lang").collect()}
    got = langid.identify(more).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert langid.identified(more).count() >= 0.97 * len(lang)


def test_nystrom_is_the_kernel(more):
    """Scores from the folded weights equal k(x, L) @ alpha worked out directly."""
    import pyarrow as pa

    texts = [r["text"] for r in more.select("text").limit(30).collect()]
    x = np.concatenate([langid.unit(p) for _, _, p, _ in langid.presence(pa.array(texts))])
    land = x[:8]
    alpha = np.random.default_rng(1).normal(size=(8, 3))
    assert np.allclose((x @ land.T) @ alpha, x @ (land.T @ alpha), atol=1e-4)
    shared = (x[3] > 0) & (x[5] > 0)
    assert np.isclose((x @ x.T)[3, 5], shared.sum() / math.sqrt((x[3] > 0).sum() * (x[5] > 0).sum()), atol=1e-5)


def test_language_edges(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    for r, t in zip(got, odd.collect()):
        if not re.search(r"[^\W\d_]", t["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(empty).count() == 0 and langid.identified(odd).columns == odd.columns


def test_toxicity(more, more_labels):
    labels = {r["doc_id"]: r["toxic"] for r in more_labels.collect()}
    half = more_labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(more, half).collect()}
    assert len(got) == more.count()
    unseen = [(got[i]["toxic"], t) for i, t in labels.items() if i % 2]
    assert sum(p for p, t in unseen if t) >= 0.5 * sum(t for _, t in unseen)
    assert sum(p for p, t in unseen if not t) <= 0.03 * sum(not t for _, t in unseen)


def test_chain_is_out_of_fold():
    """A first category that is pure noise must not look learned to the second model: in fold, its weight would be large."""
    rng = np.random.default_rng(0)
    n, width = 400, 300
    col = rng.integers(0, width, n * 20)
    row = np.repeat(np.arange(n), 20)
    y = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    y[:, 1] = y[:, 0]
    toxicity.LEAST_Z, was = 0.0, toxicity.LEAST_Z
    try:
        chain = toxicity.fit_chain(row, col, np.ones(len(row)), y, ["a", "b"], width)
    finally:
        toxicity.LEAST_Z = was
    assert chain.models[1].earlier[0] < 1.0
    clear = y.copy()
    col2 = np.where(np.arange(len(row)) % 20 == 0, clear[row, 0].astype(int), col)
    good = toxicity.fit_chain(row, col2, np.ones(len(row)), clear, ["a", "b"], width)
    assert good.models[1].earlier[0] > 0.5


def test_toxicity_edges(spark, odd, empty, more_labels):
    assert toxicity.score_toxicity(odd, more_labels).count() == odd.count() and toxicity.score_toxicity(empty, more_labels).count() == 0
    none = spark.createDataFrame([(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in toxicity.score_toxicity(odd, none).collect()] == [False] * odd.count()


def plain_quality(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cover = Counter(tri), set()
    for i, t in enumerate(tri):
        if c[t] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, more, odd, empty, more_labels):
    rng = random.Random(6)
    made = [" ".join(rng.choice(["a", "b", "c", "dd", "x\ny", "|", "é"]) for _ in range(rng.randrange(0, 80))) for _ in range(120)]
    made += ["a b c a b c", "a a a a", "a b", "a b c", "\n\n", "x\nx\n x\nx", ("abc " * 5 + "\n") * 40]
    rules = quality.train(more, more_labels)
    for df in (more, odd, spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = Counter()
        for i, t in rows:
            n, *rest = plain_quality(t)
            want[i, n, *rest, n < 50 or 100 * rest[-1] > 50 * n] += 1
        got = quality.judge(df, more_labels, rules).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.judge(empty, more_labels, rules).count() == 0


def test_rules(more, more_labels):
    rules = quality.train(more, more_labels)
    q = {r["doc_id"]: r["quality"] for r in more_labels.collect()}
    got = [(r["kept"], q[r["doc_id"]]) for r in quality.judge(more, more_labels, rules).collect() if r["doc_id"] in q and not r["base_failed"]]
    assert rules and sum(k for k, y in got if y == 1) >= 0.98 * sum(y == 1 for _, y in got) and sum(not k for k, y in got if y == 0) >= 0.7 * sum(y == 0 for _, y in got)


def test_rules_native_and_bare(spark, more, more_labels, odd):
    plan = quality.judge(more, more_labels, [])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = spark.createDataFrame([(None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, none) == []


def test_covering():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    low = (x["symbol_share"] > 0.8) | ((x["mean_word"] < 0.2) & (x["capital_share"] > 0.7))
    rules = quality.learn_rules(x, low)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covers(r, x, 3000)
    assert (hit & low).sum() > 0.9 * low.sum() and (hit & ~low).sum() < 0.02 * 3000


def test_brown_base(more, odd, empty, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 700)
    monkeypatch.setattr(brown, "CLUSTERED", 60)
    for df in (more, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        tok = [WORD.findall((t or "").translate(FOLD)) for _, t in rows]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        c = Counter()
        for (i, _), w, h in zip(rows, tok, held):
            if i is not None and not h:
                c.update([*w, None])
        n, v = sum(c.values()), len(c)
        want = Counter((i, h, len(w) + 1, sum(c[k] > 0 for k in w) + (c[None] > 0), n, round(sum(math.log10((c[k] + 1) / (n + v + 1)) for k in [*w, None]), 4)) for (i, _), w, h in zip(rows, tok, held))
        got = brown.score_documents(df).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] <= 0 for r in got)
    assert brown.score_documents(empty).count() == 0


def test_brown_is_a_model(more, spark):
    """Better than the unigram on unseen text, and probabilities that add up."""
    got = brown.score_documents(more).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    model, counts = brown.train(more)
    assert np.allclose((10.0**model.transitions).sum(1), 1.0)
    known = {r["word"]: r["n"] for r in counts.collect()}
    of = dict(zip(model.head.view(np.int64).tolist(), model.head_class.tolist()))
    for k in range(brown.TAILS):
        mass = sum(n + 1 for w, n in known.items() if of.get(w, model.clusters + (w & 3)) == model.clusters + k)
        assert model.class_norm[model.clusters + k] == mass + 1
    total = np.bincount(model.head_class, model.head_count + 1.0, model.clusters + 5)[: model.clusters] + 1
    assert np.allclose(total, model.class_norm[: model.clusters])


def plain_likelihood(b, of, c):
    """The exchange objective, from the bigrams of symbols."""
    t = np.zeros((c, c))
    np.add.at(t, (of[:, None], of[None, :]), b)
    x = lambda v: sum(i * math.log(i) for i in v.ravel() if i > 0)
    return x(t) - x(t.sum(0)) - x(t.sum(1))


def test_best_class_against_whole_likelihoods():
    """A word joins the class whose whole likelihood is largest (bigrams of a word with itself aside)."""
    rng = np.random.default_rng(4)
    n, clusters, c = 30, 4, 7
    for _ in range(5):
        b = rng.poisson(rng.gamma(0.3, 6, (n, n))).astype(float)
        np.fill_diagonal(b, 0)
        of = np.concatenate([np.arange(16) % clusters, clusters + np.arange(14) % (c - clusters)])
        one = np.eye(c)[of]
        table = one.T @ b @ one
        loose = np.arange(16, n)
        got = brown.best_class(table, (b.T @ one)[loose], (b @ one)[loose], of[loose], clusters)
        for w, d in zip(loose, got):
            moved = [plain_likelihood(b, np.where(np.arange(n) == w, k, of), c) for k in range(clusters)]
            assert moved[d] >= max(moved) - 1e-6


def test_exchange_moves_to_the_best_class():
    """One word, one sweep: the class whose whole likelihood is largest, own bigrams included."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        b = rng.poisson(rng.gamma(0.3, 6, (13, 13))).astype(float)
        start = np.concatenate([np.arange(12) % 3, [3]])
        want = start.copy()
        for w in range(12):
            moved = [plain_likelihood(b, np.where(np.arange(13) == w, k, want), 4) for k in range(3)]
            want[w] = int(np.argmax(moved)) if max(moved) > moved[want[w]] + 1e-9 else want[w]
        assert plain_likelihood(b, brown.exchange(b, 12, 3, 1), 4) == pytest.approx(plain_likelihood(b, want, 4))


def test_brown_score_against_plain_bigrams(more, monkeypatch):
    """The score of every document from the learned classes and counts of single tokens; every head word has a learned class."""
    monkeypatch.setattr(brown, "HEAD", 700)
    monkeypatch.setattr(brown, "CLUSTERED", 60)
    model, counts = brown.train(more)
    assert 60 < len(model.head) <= 700 and model.head_class.min() >= 0 and model.head_class.max() < model.clusters
    rows = [(r["doc_id"], r["text"]) for r in more.select("doc_id", "text").collect()]
    words = {i: WORD.findall((t or "").translate(FOLD)) for i, t in enumerate(t for _, t in rows)}
    train = [i for i, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for i in train for w in words[i])
    vocabulary = sorted({w for x in words.values() for w in x})
    hashed = next(brown.words(pa.array([" ".join(vocabulary)])))
    key = dict(zip(vocabulary, brown.keys(hashed).tolist()))
    of = dict(zip(model.head.tolist(), model.head_class.tolist()))
    klass = {w: of.get(k, model.clusters + (k & 3)) for w, k in key.items()}
    c = model.clusters + brown.TAILS + 1
    table, mass, end = np.zeros((c, c)), np.ones(c), c - 1
    for i in train:
        chain = [end, *(klass[w] for w in words[i]), end]
        for x, y in zip(chain, chain[1:]):
            table[x, y] += 1
    for w, n in count.items():
        mass[klass[w]] += n + 1
    step = np.log10((table + brown.DELTA) / (table.sum(1, keepdims=True) + brown.DELTA * c))
    want = Counter()
    for i, (d, _) in enumerate(rows):
        chain = [end, *(klass[w] for w in words[i]), end]
        want[d, round(sum(step[x, y] for x, y in zip(chain, chain[1:])) + sum(math.log10((count[w] + 1) / mass[klass[w]]) for w in words[i]), 3)] += 1
    assert Counter((r["doc_id"], round(r["score"], 3)) for r in brown.score_documents(more).collect()) == want


def test_exchange_finds_classes():
    """Words that alternate between two classes are told apart, and no move lowers the likelihood."""
    rng = np.random.default_rng(3)
    m = 20
    truth = np.arange(m) % 2
    b = np.zeros((m + 1, m + 1))
    for _ in range(6000):
        a = rng.integers(0, m)
        c = rng.choice(np.flatnonzero(truth != truth[a]) if rng.random() < 0.95 else np.arange(m))
        b[a, c] += 1
    of = brown.exchange(b, m, 2, 20)
    assert (of[:m] == truth).all() or (of[:m] == 1 - truth).all()
    start = np.concatenate([np.arange(m) % 2, [2]])

    def likelihood(of):
        one = np.zeros((m + 1, 3))
        one[np.arange(m + 1), of] = 1
        t = one.T @ b @ one
        x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
        return x(t) - x(t.sum(1)) - x(t.sum(0))

    rng.shuffle(start[:m])
    assert likelihood(of) >= likelihood(start)


def test_repeated_ids_give_one_text_to_learn_from(spark, more):
    """However many rows repeat a labelled id, the models are those of the first text of each id."""
    docs = more.select("doc_id", "text").limit(150).cache()
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"), (F.length("text") % 3 == 0).cast("int").alias("toxic"))
    again = docs.unionAll(docs).unionAll(docs)
    assert quality.train(docs, labels) == quality.train(again, labels)
    a, b = ([m.weights for m in toxicity.train(x, labels, {"toxic": F.col("toxic")}).models] for x in (docs, again))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_number_signs_are_no_letters(spark):
    texts = ["½ ²", "12 ⅷ", "Ⅷ", "٣", "a", "日", "ª", None, "1 ь"]
    for w in [x for x in langid.presence(pa.array(texts))]:
        assert w[3].tolist() == [bool(t) and any(unicodedata.category(c).startswith("L") for c in t) for t in texts]
