"""Secrets, licenses, benchmark passages."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np

from millrace.llm import decontaminate as C
from millrace.llm import licenses as L
from millrace.llm import secrets as S
from millrace.llm.textbatch import FOLD as _FOLD

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
assert _FOLD[65] == 97


def plain_secrets(text):
    """Base spans straight from the patterns of the contract."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_spans(spark, docs, texts):
    rng = random.Random(1)
    extra = ["token=password:abcdefgh1234", "token = 'short' TOKEN:longenough1", "AKIAAKIAAKIAAKIA99 AKIAshort", "f" * 31 + " " + "f" * 32, 'api_key"  :  "aaaa/bbbb==', "é secret=ſecret12 Token:kkkkkkkk", "apikey=" + "a" * 40]
    for _ in range(200):
        extra.append("".join(rng.choice(["token", "secret", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "zz", "password", "\n", "é"]) for _ in range(12)))
    for t in [*texts.values(), *extra]:
        assert S.base_spans(t) == plain_secrets(t)
    df = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for r in S.scan_secrets(df).collect():
        base = plain_secrets(extra[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_random_strings_show():
    rng = random.Random(2)
    found = 0
    for _ in range(200):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
        found += any(k == 3 for _, k, _ in S.scan(f"see {key} there")[1])
    assert found >= 195
    for letters, least in ((string.ascii_letters, 190), (string.ascii_letters + "+/", 190), (string.ascii_uppercase, 170)):
        keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
        assert sum(any(k == 3 for _, k, _ in S.scan(f"see {key} there")[1]) for key in keys) >= least
    clean = ["123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "1234567890123456789012345", "some/long/path/with_words/file-2024-01-02", "incomprehensibilities", "getElementsByClassNameAndSelector", "Donaudampfschifffahrtsgesellschaft", "a/b/c/d/e/f/g/h/i/j/k/l", "/usr/local/share/doc/libxml", "-" * 30, "=_" * 20, "ha" * 30]
    for c in clean:
        assert not any(k == 3 for _, k, _ in S.scan(f"see {c} there")[1])


def test_random_spans_are_judged_one_by_one():
    """Every run against every base span, and a run far beyond one piece."""
    rng = random.Random(5)
    pieces = ["token=", "password: ", "AKIAAKIAAKIAAKIA99", "f" * 32, " ", "\n", "kF9dQx2LmZ7pRt4vWb8nYc3s", "QwPzKxVbRtYmNcLdGhJf", "/plain/words/of/a/path", '"']
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(10))
        base = S.base_spans(t)
        want = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t) if S.is_random(m[0]) and not any(s <= m.start() and m.end() <= e for s, _, e in base)]
        assert S.random_spans(t, base) == want
    long = "".join(rng.choice(string.ascii_letters) for _ in range(300_000))
    assert S.scan(long)[1] == [(0, 3, len(long))] and S.scan("z" * 300_000)[1] == []


def test_redaction(odd, empty):
    assert S.redact('password = "hunter2hunter2" x') == 'password = "[SECRET]" x'
    assert S.redact(None) is None and S.redact("") == ""
    for t in ("token=abcdefgh12 " + "f" * 40, "AKIA" + "A" * 20):
        assert S.scan(S.redact(t))[1] == []
    assert S.scan_secrets(odd).count() == odd.count() and S.scan_secrets(empty).count() == 0
    out = S.redacted(odd)
    assert out.columns == odd.columns and [r["text"] for r in out.collect()] == [r["text"] for r in odd.collect()]


def plain_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    starts, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base(docs, texts, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = Counter((i, *plain_license(t)) for i, t in rows)
        got = L.scan_licenses(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in got)
    assert L.scan_licenses(empty).count() == 0


def test_templates_found(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i, (label, text) in enumerate(L.TEMPLATES):
        w = text.split()
        if len(w) < 20:
            continue
        cut = w[:]
        cut[len(w) // 2] = "changed"
        cut.insert(len(w) // 3, "put in")
        filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
        rows.append((i, f"{filler()} {' '.join(cut)} {filler()}"))
        want[i] = label
    rows.append((99, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))))
    rows.append((100, TEMPLATE_SHUFFLED))
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] > 0.6
    assert got[99]["labels"] == "" and got[99]["score"] == 0 and got[100]["labels"] == ""


TEMPLATE_SHUFFLED = " ".join(sorted("Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()))


def leaks(docs_rows, bench_rows):
    """Pairs by the definition: the longest common subsequence over sliding spans of every document and item."""
    h = C._hashes([t for _, t in docs_rows])
    b = C._hashes([t for _, t in bench_rows])
    out = {}
    for (d, _), words_ in zip(docs_rows, h):
        words_ = words_.tolist()
        for (i, _), item in zip(bench_rows, b):
            item, best = item.tolist(), 0.0
            n = len(item)
            if not n or len(set(item) & set(words_)) < 0.3 * len(set(item)):
                continue
            for a in range(0, max(1, len(words_) - n // 2), max(1, n // 4)):
                best = max(best, C.check(item, words_[a : a + 2 * n])[0])
            out[d, i] = best
    return out


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert C.lcs(a, b) == t[-1][-1]


def test_benchmark_passages(spark, sf_dir, docs, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rng = random.Random(5)
    rows = list(texts.items())
    planted = set()
    for k in range(40):  # exact, other case and punctuation, one word in five replaced
        item, text = items[k % len(items)]
        w = text.split()
        if len(w) < 20:
            continue
        w = w if k % 3 == 0 else [x.upper().strip(".,") for x in w] if k % 3 == 1 else [("zzz" if rng.random() < 0.2 else x) for x in w]
        around = rng.choice(rows)[1].split()[:300]
        at = rng.randrange(len(around) + 1)
        rows.append((10_000 + k, " ".join(around[:at] + w + around[at:])))
        planted.add((10_000 + k, item))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in C.contaminated(df, bench).collect()}
    truth = leaks(rows, items)
    sure = {p for p, s in truth.items() if s >= 0.65}
    assert planted <= set(got) and sure <= set(got)
    assert all(truth.get(p, 0) >= 0.4 for p in got)
    left = {r["doc_id"] for r in C.decontaminated(df, bench).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in got}


def test_passage_in_much_of_the_corpus(spark, sf_dir):
    """A leak that a third of all documents hold is found in each, though its words are then common."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(15)] + (items[0][1].split() if i % 3 == 0 else []) + [word() for _ in range(10)])) for i in range(600)]
    bench = spark.createDataFrame(items[:5], "item_id long, text string")
    got = {r["doc_id"] for r in C.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()}
    assert got == {i for i, _ in rows if i % 3 == 0}


def test_benchmark_edges(spark, sf_dir, odd, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert C.contaminated(odd, bench).count() == 0 and C.contaminated(empty, bench).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "item_id long, text string")
    assert C.contaminated(odd, none).count() == 0 and C.decontaminated(odd, none).count() == odd.count()
    short = spark.createDataFrame([(7, "one two three"), (None, "words here and there again and again and again and again")], "item_id long, text string")
    assert {r["doc_id"] for r in C.contaminated(odd, short).filter("item_id = 7").collect()} <= {4, None, 10}
    assert C.decontaminated(odd, bench).columns == odd.columns


def test_pieces_in_another_order_are_no_run():
    """The words of a template count only where they follow each other as they do in it."""
    n, k = 36, L.K
    whole = [(0, np.arange(n - k + 1))]
    assert L.best_run(whole, n) == (1.0, 0, n - 1)
    # 4-word pieces in reverse order: piece i of the template stands at place n - 4 - 4 i
    turned = sorted((n - 4 - 8 * i, np.array([n - 4 - 4 * i])) for i in range(n // 4))
    assert L.best_run(turned, n)[0] == 0.0
    # a word put in between
    assert L.best_run([(0, np.arange(15)), (1, np.arange(19, n - k + 2))], n)[0] == 1.0
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.integers(0, 12, rng.integers(0, 12)).tolist()
        got = [v[i] for i in L.rising(v)]
        best = [0] * len(v)  # longest that ends here
        for i, x in enumerate(v):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < x), default=0)
        assert len(got) == max(best, default=0) and all(a < b for a, b in zip(got, got[1:]))
