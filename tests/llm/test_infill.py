"""Fill-in-the-middle: cuts against the pattern of the contract, an exact round trip, odd tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import infill as I

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|^[ \t\n\x0b\x0c\r]+", "points": r"(?s)."}


def numbers(doc_id, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain(doc_id, text, units="lines", rate=100, spm_rate=50):
    """(n, form, prefix, middle, output) unit by unit."""
    text = text or ""
    parts, h = re.findall(PATTERNS[units], text), numbers(doc_id)
    n = len(parts)
    if not text or any(s in text for s in I.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_selected_bits():
    rng = random.Random(4)
    for width in (1, 63, 64, 65, 1000, 4097):
        for density in (0.01, 0.5, 1.0):
            bits = sum(1 << i for i in range(width) if rng.random() < density)
            at = [i for i in range(width) if bits >> i & 1]
            ranks = sorted(rng.sample(range(len(at)), min(len(at), 9)))
            assert I.select(bits, width, ranks) == [at[r] for r in ranks]


@pytest.mark.parametrize("units", list(I.UNITS))
def test_cuts(units):
    rng = random.Random(5)
    pieces = ["a", "bc", "\n", "\n\n", " ", "  \t", "é", "日本", "<", "S>", "<S>", "<P", "😀\r\n", "x" * 50]
    for k in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        n, form, p, m, out = I.transform(text.encode(), numbers(k), units, 90, 30)
        assert (n, form, p, m, out.decode()) == plain(k, text, units, 90, 30)


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = []
    for i, t in rows:
        n, form, p, m, out = plain(i, t)
        want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, I.infill_digest(df).collect())) == order(want)


def test_tables(docs, odd, empty):
    for df in (docs, odd, empty):
        check(df)


def test_sentinels_across_joints(spark):
    texts = ["<S\n>S>\n<M", "<\n<P\n>", "<P>", "no <M> here", "<S\n<S\n<P\n<M\n", "\n", "one", "a\n<M\n\n\n>", "<\n" * 30]
    check(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string"))


def test_other_columns(odd):
    out = I.filled(odd)
    assert set(out.columns) == set(odd.columns) | {"n", "form", "prefix_chars", "middle_chars", "output"}
    back = out.select((I.restored(F.col("output"), F.col("form")) == F.coalesce("text", F.lit(""))).alias("same"), "n").collect()
    assert all(r["same"] for r in back) and len(back) == odd.count()
    with pytest.raises(ValueError):
        I.filled(odd, units="pages")


def test_invalid_bytes_and_long_texts(spark):
    bad = spark.sql("SELECT 3L AS doc_id, cast(unhex('61FF0A80C30A62') AS string) AS text UNION ALL SELECT 4L, repeat('é line of text\n', 400000) UNION ALL SELECT 5L, repeat('x', 5000000)")
    got = {r["doc_id"]: r for r in I.infill_digest(bad).collect()}
    assert [got[k]["n"] for k in (3, 4, 5)] == [3, 400_000, 1]
    assert got[3]["restored_sha256"] == hashlib.sha256(bytes.fromhex("61FF0A80C30A62")).hexdigest()
    assert got[5]["restored_sha256"] == hashlib.sha256(b"x" * 5_000_000).hexdigest()
    n, form, p, m, out = plain(4, "é line of text\n" * 400_000)
    assert (got[4]["form"], got[4]["prefix_chars"], got[4]["middle_chars"], got[4]["output_sha256"]) == (form, p, m, hashlib.sha256(out.encode()).hexdigest())
