"""Removal of lines that many documents hold, in DataFrame and SQL functions only.

A line's key is the line without white space at its ends, its A-Z in lower case.  A key of MIN_POINTS code points or more
that MIN_DOCS documents or more hold keeps its lines in the largest doc_id that holds it and loses all others.

Only digests of keys (128 bits) travel, never lines: rows (key, doc, mark, place) are dealt into ranges of the digest and
sorted in each by digest, document from the largest down, and place.  A window streams over that order: the documents of
a key are counted as they come, its first one is the keeper, and a line of any other is dropped if there is a third.
What is dropped comes back as one compressed bitmap a document, which `thinned` lays over the split text.

A key that very many lines have would be one task's run.  Digests are counted by their first two bytes (65,536 counts
whatever the table), then the keys under the frequent ones; a key of more than its share of all lines is dealt in
slices, each of which yields its first documents only, and a table of these keys, bounded by that share, names keepers.

The bitmap is an array of (gap, bits): `gap` words of 64 lines that all stay, then a word with a bit for each line that
stays; what follows the last word stays.

Edge cases: rows with one doc_id are one document, and null ids are one, below all others; equal rows have equal
results; null and empty texts are one empty line; keys shorter than MIN_POINTS (blank lines too) always stay; an
empty table gives an empty result; other columns are ignored (`thinned` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, delete, rewritten, shared_folder

MIN_POINTS, MIN_DOCS = 20, 3
BLANK = " \t\n\x0b\x0c\r"
#: A key with more than one of so many parts of all lines is sliced: of SHARES parts, or of four times the shuffle partitions, if that is more.
SHARES, LEAST = 400, 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _doc() -> Column:
    return F.col("doc_id").cast("long")


def line_keys(docs: DataFrame) -> DataFrame:
    """key, doc, mark, place of every line whose key is long enough; mark tells the texts of one doc_id apart."""
    split = F.split(F.translate(_text(), _UPPER, _LOWER), "\n", -1)
    lines = docs.select(_doc().alias("doc"), F.xxhash64(_text()).alias("mark"), F.posexplode(split).alias("place", "line"))
    lines = lines.select("doc", "mark", "place", F.btrim("line", F.lit(BLANK)).alias("line")).filter(F.length("line") >= MIN_POINTS)
    return lines.select(F.unhex(F.md5("line")).alias("key"), "doc", "mark", "place")


def frequent_keys(lines: DataFrame) -> tuple[list[bytes], int]:
    """The keys of more than their share of lines, fewer than there are shares, and that share."""
    shares = max(SHARES, 4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    head = F.substring("key", 1, 2)
    counts = lines.groupBy(head.alias("head")).agg(F.count("*").alias("n")).cache()  # 65,536 rows at most
    most = max(LEAST, (counts.agg(F.sum("n")).first()[0] or 0) // shares)
    heads = [r["head"] for r in counts.filter(F.col("n") > most).select("head").collect()]
    counts.unpersist()
    if not heads:
        return [], most
    keys = lines.filter(head.isin(heads)).groupBy("key").count().filter(F.col("count") > most)
    return [bytes(r["key"]) for r in keys.select("key").collect()], most


def dropped_lines(lines: DataFrame) -> DataFrame:
    """doc, mark, place of the lines that go."""
    hot, most = frequent_keys(lines)
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    slices = max(1, lines.count() // most + 1) if hot else 1
    rows = lines.withColumn("slice", F.when(is_hot, F.pmod(F.xxhash64("doc", "mark", "place"), F.lit(slices))).otherwise(0).cast("int"))
    order = [F.col("key"), F.col("slice"), F.col("doc").desc_nulls_last(), F.col("place"), F.col("mark")]
    rows = rows.repartitionByRange("key", "slice").sortWithinPartitions(*order)
    run = Window.partitionBy("key", "slice")
    stream = run.orderBy(F.col("doc").desc_nulls_last())
    rows = rows.withColumn("nth", F.dense_rank().over(stream))
    cold = rows.filter(~is_hot).withColumn("holders", F.max("nth").over(run)).filter((F.col("nth") > 1) & (F.col("holders") >= MIN_DOCS))
    out = cold.select("doc", "mark", "place")
    if hot:
        first = rows.filter(is_hot & (F.col("nth") <= MIN_DOCS)).groupBy("key").agg(F.collect_set(F.struct("doc")).alias("docs"))
        first = first.filter(F.size("docs") >= MIN_DOCS).select("key", F.array_max("docs")["doc"].alias("keeper"))
        late = lines.filter(is_hot).join(F.broadcast(first), "key").filter(~F.col("doc").eqNullSafe(F.col("keeper")))  # fewer rows than shares
        out = out.union(late.select("doc", "mark", "place"))
    return out


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc, mark, keep for every document that loses a line, keep the compressed bitmap of the lines that stay."""
    folder = shared_folder(docs.sparkSession, "lines")
    lines = rewritten(line_keys(docs), folder)
    word, bit = F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, place % 64)")
    words = dropped_lines(lines).groupBy("doc", "mark", word).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    per_doc = words.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct(F.col("word").cast("int").alias("word"), "bits"))).alias("w"))
    before = F.transform("w", lambda e, i: F.when(i > 0, F.get("w", i - 1)["word"]).otherwise(-1))
    keep = F.zip_with("w", before, lambda e, b: F.struct((e["word"] - b - 1).alias("gap"), e["bits"].alias("bits")))
    maps = cut(per_doc.select("doc", "mark", keep.alias("keep")))
    delete(docs.sparkSession, folder)
    return maps


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; null keep keeps all."""
    dense = F.flatten(F.transform(keep, lambda e: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["gap"]), F.array(e["bits"]))))

    def laid(words: Column) -> Column:  # bound to a variable, so that it is unpacked once and not for every line
        def stays(_, i: Column) -> Column:
            bits = F.get(words, F.shiftright(i, 6))
            return F.coalesce(F.getbit(bits, i.bitwiseAND(63)) == 1, F.lit(True))

        return F.filter(lines, stays)

    return F.when(keep.isNull(), lines).otherwise(F.get(F.transform(F.array(dense), laid), F.lit(0)))


def thinned(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of `text`, and n_lines (before), n_dropped, keep; columns of docs called so are replaced."""
    new = ("n_lines", "n_dropped", "keep")
    kept = [c for c in docs.columns if c.lower() not in new]
    maps = keep_bitmaps(docs).select(F.col("doc").alias("_millrace_doc"), F.col("mark").alias("_millrace_mark"), F.col("keep").alias("_millrace_keep"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), _doc().alias("_doc"), F.xxhash64(_text()).alias("_mark"), _text().alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_millrace_doc")) & (F.col("_mark") == F.col("_millrace_mark"))
    lines, keep = F.split("_text", "\n", -1), F.col("_millrace_keep")
    text = F.when(keep.isNull(), F.col("_text")).otherwise(F.array_join(kept_lines(lines, keep), "\n"))
    n_dropped = F.coalesce(F.aggregate(keep, F.lit(0).cast("long"), lambda n, e: n + 64 - F.bit_count(e["bits"])), F.lit(0).cast("long"))
    n_lines = (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long")
    out = row.join(maps, same, "left")
    columns = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in kept]
    return out.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), keep.alias("keep"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, keep) for every row of docs(doc_id, text)."""
    rows = thinned(docs.select(_doc().alias("doc_id"), F.col("text").cast("string").alias("text")))
    keep = F.transform("keep", lambda e: F.concat_ws(":", e["gap"].cast("string"), F.lpad(F.lower(F.hex(e["bits"])), 16, "0")))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"), F.coalesce(F.array_join(keep, ","), F.lit("")).alias("keep"))


#: The same result by counts of distinct ids (without the bitmaps).
SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT r, doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM docs
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key
    HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
), marked AS (
    SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
