"""Fill-in-the-middle transformation by bit-parallel work on big integers.

A text is cut at two places between its units (lines, by default) into prefix, middle and suffix, which are written in
another order behind sentinels, so that a model learns to fill the middle in.

A text's bytes become masks, one bit a byte: `bytes.translate` marks the bytes of a class, and the marks are read as a
binary number.  Where units start follows from shifted masks (a line starts behind a newline), `bit_count` gives their
number n, and the cut after k units is the k-th bit of that mask, found by halving the number and counting the half.
Nothing is done line by line or character by character in Python, a mask takes an eighth of the text's size, and texts
are never decoded: UTF-8's continuation bytes are a class of their own, by which code points are counted.

Where a text is cut, and in which order it is written, follows from `sha256("7:" + doc_id)` alone, so a lost task's rows
come out the same again.  `restored` puts a text together again from output and form with built-in functions.

Edge cases: a null text is the empty text; empty texts, and texts that hold a sentinel, stay as they are (form
`plain`, no lengths, n counted all the same); one unit gives n = 1 and cuts before or behind it; a null id is hashed as
no digits; rows with equal ids are cut alike; invalid UTF-8 passes through; an empty table gives an empty
result; other columns are kept by `filled`, unless they are called as the new ones are, which then replace them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, bounded_bytes
from .textbatch import SPACES, trim

#: Sentinels before prefix, suffix and middle; seed; shares, of a hundred, of texts transformed and of those in the order suffix first.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: From this width down a bit is found by shifting.
NARROW = 64


def _table(inside: Callable[[int], bool]) -> bytes:
    return bytes(0x31 if inside(b) else 0x30 for b in range(256))


_NEWLINE = _table(lambda b: b == 0x0A)
_SPACE = _table(lambda b: bool(SPACES[b]))
_LEADING = _table(lambda b: b & 0xC0 != 0x80)


def mask(data: bytes, table: bytes) -> int:
    """Bit i tells whether byte i is of the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def line_starts(data: bytes) -> int:
    """First byte of each line `[^\\n]*\\n|[^\\n]+`."""
    return (mask(data, _NEWLINE) << 1 | 1) & ((1 << len(data)) - 1)


def word_starts(data: bytes) -> int:
    """First byte of each word, which keeps the white space behind it; white space ahead of the first word is a unit."""
    every = (1 << len(data)) - 1
    space = mask(data, _SPACE)
    return (~space & (space << 1 | 1) | 1) & every


def point_starts(data: bytes) -> int:
    """First byte of each code point."""
    return mask(data, _LEADING)


UNITS: dict[str, Callable[[bytes], int]] = {"lines": line_starts, "words": word_starts, "points": point_starts}


def select(bits: int, width: int, ranks: list[int]) -> list[int]:
    """Positions of the set bits of the given ranks (from 0, ascending) among the lowest `width` bits.

    The number is halved and the lower half counted; ranks go on into the half that holds them.
    """
    if not ranks:
        return []
    if width <= NARROW:
        found = [i for i in range(width) if bits >> i & 1]
        return [found[r] for r in ranks]
    half = width >> 1
    low = bits & ((1 << half) - 1)
    below = low.bit_count()
    cut = sum(r < below for r in ranks)
    out = select(low, half, ranks[:cut])
    if cut < len(ranks):
        out += [half + p for p in select(bits >> half, width - half, [r - below for r in ranks[cut:]])]
    return out


def cut_points(data: bytes, starts: int, n: int, first: int, second: int) -> tuple[int, int]:
    """Bytes that the first `first` and the first `second` of n units take, first <= second."""
    inner = sorted({k for k in (first, second) if k < n})
    at = dict(zip(inner, select(starts, len(data), inner)))
    return at.get(first, len(data)), at.get(second, len(data))


def transform(data: bytes, h: tuple[int, int, int, int], units: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE):
    """(n, form, prefix code points, middle code points, output) of one text, given its four hash numbers."""
    starts = UNITS[units](data)
    n = starts.bit_count()
    pre, suf, mid = (s.encode() for s in SENTINELS)
    if not data or h[2] % 100 >= rate or any(s in data for s in (pre, suf, mid)):
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = cut_points(data, starts, n, a, b)
    leading = mask(data[:y], _LEADING)
    head = (leading & ((1 << x) - 1)).bit_count()
    lengths = head, leading.bit_count() - head
    if h[3] % 100 < spm_rate:
        return n, "spm", *lengths, b"".join((suf, data[y:], pre, data[:x], mid, data[x:y]))
    return n, "psm", *lengths, b"".join((pre, data[:x], suf, data[y:], mid, data[x:y]))


def _numbers(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def filled(docs: DataFrame, units: str = "lines", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix_chars, middle_chars and output, the transformed text."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    bounded_batches(docs.sparkSession)
    bounded_bytes(docs.sparkSession)

    @F.arrow_udf("struct<n long, form string, prefix_chars long, middle_chars long, output binary>")
    def move(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        numbers = zip(*(h.to_pylist() for h in (h1, h2, h3, h4)))
        rows = [transform(t.as_py() or b"", h, units, rate, spm_rate) for t, h in zip(text, numbers)]
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        out = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["n", "form", "prefix_chars", "middle_chars", "output"])
        del rows, cols
        trim()
        return out

    moved = move(F.col("text").cast("string").cast("binary"), *_numbers(F.col("doc_id"), seed))
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    out = docs.select(*kept, moved.alias("_moved"))
    return out.select(*kept, *[F.col(f"_moved.{c}") for c in new[:-1]], F.col("_moved.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that `filled` made output from, by the given form.  No part holds a sentinel, so the first of each is its own."""
    pre, suf, mid = SENTINELS

    def parts(rest: Column, second: str) -> Column:
        """What lies behind the first sentinel: up to the second one, from there up to the third, and behind that."""
        one = F.substring_index(rest, second, 1)
        tail = F.substr(rest, F.length(one) + F.lit(1 + len(second)))
        two = F.substring_index(tail, mid, 1)
        return F.struct(one.alias("one"), two.alias("two"), F.substr(tail, F.length(two) + F.lit(1 + len(mid))).alias("three"))

    psm, spm = parts(F.substr(output, F.lit(1 + len(pre))), suf), parts(F.substr(output, F.lit(1 + len(suf))), pre)
    psm = F.concat(psm["one"], psm["three"], psm["two"])
    spm = F.concat(spm["two"], spm["three"], spm["one"])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row of docs(doc_id, text)."""
    rows = filled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: The same result by plain string functions.
SQL = """
WITH base AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbers AS (
    SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[25:32] AS UBIGINT) AS h4,
           t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
    FROM base
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM numbers
), parts AS (
    SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           coalesce(array_to_string(list_slice(units, 1, CAST(a AS BIGINT)), ''), '') AS p,
           coalesce(array_to_string(list_slice(units, CAST(a AS BIGINT) + 1, CAST(b AS BIGINT)), ''), '') AS m,
           coalesce(array_to_string(list_slice(units, CAST(b AS BIGINT) + 1, n), ''), '') AS s
    FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
