"""Audit of how far the sources of a language differ in their words.

A language keeps the V terms that MIN_DOCS of its documents or more hold.  A group (lang, source), and the language as a
whole, gives each kept term p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), N the group's count of kept terms.
Part `pair` ranks the other sources of the language by the sum of |p - q| over all kept terms; part `term` ranks the
terms by which a group exceeds its language.

Most counts are zero, so a pair is not compared term by term.  Its sum starts at V times z = |p0 - q0|, what two zero
counts differ by, and postings, the sources that have a term with their p, only correct it:

* a term that s has and t may not: |p - q0| - z, which depends on p and on t's zero alone, so the terms of s are
  counted by p first and each count corrects once for each other source;
* a term that both have: |p - q| - |p - q0| - |p0 - q| + z, emitted from the term's postings where it is not zero.

Both add up to the sum over all kept terms, exactly: all arithmetic is in integers.  Texts are read once, in pieces
of bounded size, and counted in the task before anything is shuffled; a hot source only means more such counts.

Edge cases: null text, lang and source are ''; groups without kept terms have all their pairs (value V times z) and
no term rows; a language without kept terms has pairs of value 0; a single source has no pairs; each row of a repeated
document counts; ties are ranked by the item's UTF-8 bytes; invalid UTF-8 counts as it is; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import bounded_batches, bounded_bytes, cut, small
from .textbatch import trimmed

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a text that are split at a time; counts that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 200_000
#: Groups whose table is broadcast; more of them are joined by shuffle.
FEW = 50_000
#: Letters are folded, other ASCII becomes a blank; bytes of longer code points belong to terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def text_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end at a blank."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        piece = data[at:end].translate(_TERMS)
        while end < n and not piece.endswith(b" "):  # up to the end of the term
            more = data[end : end + PIECE].translate(_TERMS)
            stop = more.find(b" ")
            stop = len(more) if stop < 0 else stop + 1
            piece, end = piece + more[:stop], end + stop
        yield piece.split()
        at = end


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("d", pa.int64())])


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences n and documents d by group and term; a group's row without a term counts its documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(g[0], g[1], t, k, d[t]) for g, (n, d) in held.items() for t, k in n.items()]
        cols = list(zip(*flat)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        langs, sources, texts = (batch.column(k) for k in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            n, d = held[lang, source]
            size -= len(n)
            own: Counter = Counter()
            for terms in text_terms(text.as_py()):
                own.update(terms)
            n.update(own)
            d.update(own.keys())
            n[None] += 1
            d[None] += 1
            size += len(n)
            if size > HELD:
                yield rows()
                held.clear()
                size = 0
    if held:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: occurrences and documents; the rows of null term count the documents of each group."""
    bounded_batches(docs.sparkSession)
    bounded_bytes(docs.sparkSession)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source", "text")]
    read = docs.select(plain[0].alias("lang"), plain[1].alias("source"), plain[2].cast("binary").alias("text"))
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, d long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, v: Column) -> Column:
    """p of a count: exact, for counts of up to 20 digits."""
    whole = total.cast("decimal(20,0)") + v.cast("decimal(20,0)") * F.lit(PRIOR)
    wide = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, whole).cast("long") + 1


def measured(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v, total, lang_total, p0) and kept postings (lang, source, term, p, q), both written."""
    counts = cut(term_counts(docs))
    groups = counts.filter("term IS NULL").select("lang", "source")
    over = Window.partitionBy("lang", "term")  # a term's postings: as many rows as the language has sources, at most
    kept = counts.filter("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("n").over(over).alias("lang_n"), F.sum("d").over(over).alias("lang_d"))
    kept = cut(kept.filter(F.col("lang_d") >= MIN_DOCS).drop("lang_d"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
    of = groups.select("lang", "source", "v", "total", "lang_total", "p0")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    postings = cut(kept.join(of, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0"))
    return groups, postings


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value for each two different sources of a language, both ways round."""
    one = groups.select("lang", F.col("source").alias("s"), "v", F.col("p0").alias("s0"))
    two = small(groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("t0")), FEW)  # so that a frequent language stays spread
    zeros = F.abs(F.col("s0") - F.col("t0"))
    baseline = one.join(two, "lang").filter("s <> t").select("lang", "s", "t", F.coalesce(F.col("v") * zeros, F.lit(0)).alias("value"))
    # each count of s against the zero of t, for both orders of the pair
    steps = postings.groupBy("lang", F.col("source").alias("s"), "p", F.col("p0").alias("s0")).agg(F.count("*").alias("k"))
    alone = steps.join(two, "lang").filter("s <> t").select("lang", "s", "t", (F.col("k") * (F.abs(F.col("p") - F.col("t0")) - zeros)).alias("value"))
    alone = alone.filter("value <> 0").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    alone = alone.union(alone.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value"))
    a = postings.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("sp"), F.col("p0").alias("s0"))
    b = postings.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("tp"), F.col("p0").alias("t0"))
    met = F.abs(F.col("sp") - F.col("tp")) - F.abs(F.col("sp") - F.col("t0")) - F.abs(F.col("s0") - F.col("tp")) + zeros
    both = a.join(b, ["lang", "term"]).filter("s < t").select("lang", "s", "t", met.alias("value")).filter("value <> 0")
    both = both.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    both = both.union(both.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value"))
    every = baseline.union(alone).union(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    return every.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value")


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.filter(F.col("rank") <= most) if most else rows
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source)."""
    groups, postings = measured(docs)
    terms = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pair_values(groups, postings), "pair").union(_ranked(terms, "term", TOP))


#: The same result with a row for every group and kept term.
SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), words AS (
    SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), sizes AS (
    SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT g.lang, g.source, k.term, k.n AS lang_n, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
    FROM groups g JOIN kept k ON k.lang = g.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 5)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 5 * s.v) AS p,
           1 + (1000000000 * (c.lang_n + 5)) // (s.total + 5 * s.v) AS q
    FROM counts c JOIN sizes s ON s.lang = c.lang
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""
