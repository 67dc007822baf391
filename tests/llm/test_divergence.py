"""Divergence of sources against a row for every group and kept term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import divergence as D

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain(rows):
    counts, lang_counts, docs_with = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").encode().translate(FOLD))
        lang, source = lang or "", source or ""
        counts[lang, source].update(words)
        lang_counts[lang].update(words)
        docs_with[lang].update(set(words))
    out = []
    for lang in {g for g, _ in counts}:
        kept = sorted(w for w, d in docs_with[lang].items() if d >= D.MIN_DOCS)
        groups = sorted(s for g, s in counts if g == lang)

        def p(c):
            whole = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // whole for w in kept}

        of, q = {s: p(counts[lang, s]) for s in groups}, p(lang_counts[lang])
        for s in groups:
            pairs = [(-sum(abs(of[s][w] - of[t][w]) for w in kept), t.encode()) for t in groups if t != s]
            terms = [(q[w] - of[s][w], w) for w in kept if counts[lang, s][w] and of[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def check(df):
    rows = [tuple(r) for r in df.select("text", "lang", "source").collect()]
    got = sorted(map(tuple, D.source_divergence(df).collect()))
    assert got == plain(rows)
    return got


def test_tables(docs, odd, empty, monkeypatch):
    assert check(docs)
    monkeypatch.setattr(D, "HELD", 50)
    monkeypatch.setattr(D, "MIN_DOCS", 1)
    monkeypatch.setattr(D, "PIECE", 1000)
    check(odd)
    assert check(empty) == []


@pytest.mark.parametrize("least", [1, 30])
def test_planted(spark, monkeypatch, least):
    monkeypatch.setattr(D, "MIN_DOCS", least)
    rng = random.Random(8)
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "EN", None, ""]), rng.choice(["a", "b", "ä", None, "c" * 3])
        words = rng.choices(["Alpha", "beta", "GAMMA", "é", "日本語", f"own{source}", "x2y", "--", f"rare{k % 90}"], k=rng.randrange(30))
        rows.append((rng.choice([" ", "1", "_", "\n"]).join(words) if k % 11 else None, lang, source))
    rows += [("alone here", "fr", "only"), (None, "it", "s"), ("", "it", "t"), ("1 2 3", "it", "u")]
    got = check(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert any(r[2] == "term" for r in got) and [r[4] for r in got if r[0] == "it" and r[2] == "pair"] == [0] * 6


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "BC", " ", "é", "1", "longer_words", "x" * 20]) for _ in range(rng.randrange(40))).encode()
        assert [w for part in D.text_terms(text) for w in part] == TERM.findall(text.translate(FOLD))
