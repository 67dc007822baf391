"""Sharding along a Hilbert curve, in DataFrame and SQL functions only.

The metadata (`source`, `lang`, size in bytes) is quantised, each to SIDE steps at its own quantiles, and rows are
ordered by the Hilbert index of their cell of that grid, so that neighbouring rows are alike in all three; the
order is cut into runs whose row counts differ by one at most (law `rows`).  A file of a shard then spans a narrow
range of each dimension.

The grid has SIDE^3 cells whatever the table.  A cell is split into slices of about SLICE rows by a hash, so no
task orders a hot cell by itself; a row's place is cell offset + slice offset + place in its slice.

Edge cases: null text has size 16 and CRC 0; null `source` or `lang` (or no such column) is the lowest step; equal
rows each get a slot of their own; null ids are placed too; with fewer rows than shards some shards stay empty; an
empty table gives an empty result; other columns are ignored (`write_shards` keeps them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, BITS, SLICE = 40, 4, 50_000
#: Hexadecimal digits by which a prefix grows; the part of a quantile step that is not looked into.
STEP, PART = 4, 64
SIDE = 1 << BITS
DIMENSIONS = ("source", "lang")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _code(c: Column) -> Column:
    """The bytes of a string as hexadecimal digits: same order as the strings, null lowest."""
    return F.coalesce(F.hex(c), F.lit(""))


def string_cuts(rows: DataFrame, names: list[str], n: int) -> dict[str, list[str]]:
    """The values at the SIDE-quantiles of each column of hexadecimal strings, exactly, or prefixes that part them as well.

    Counts by prefix, STEP digits longer a round: only prefixes in which a quantile falls, SIDE - 1 at most, are followed,
    until one value is left under each or what is under it is less than a PART-th of a step.
    """
    out: dict[str, list[str]] = {}
    for name in names:
        goal = [n * k / SIDE for k in range(1, SIDE)]
        found: set[str] = set()
        open_ = {"": (0, goal)}  # prefix -> rows below it, quantiles in it
        length = 0
        while open_:
            length += STEP
            head = F.substring(name, 1, length)
            some = rows if length == STEP else rows.filter(F.substring(name, 1, length - STEP).isin(sorted(open_)))
            counts = some.groupBy(head.alias("head")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy("head").collect()
            above, open_, below = open_, {}, dict.fromkeys(open_, 0)
            for r in counts:
                parent = r["head"][: length - STEP]
                at = above[parent][0] + below[parent]
                below[parent] += r["n"]
                mine = [g for g in above[parent][1] if at <= g < at + r["n"]]
                if mine and (r["lo"] == r["hi"] or r["n"] < n / SIDE / PART):
                    found.add(r["lo"])
                elif mine:
                    open_[r["head"]] = (at, mine)
        out[name] = sorted(found)
    return out


def hilbert_index(axes: Column, bits: int = BITS) -> Column:
    """Index along the Hilbert curve of array(axes) of non-negative ints of `bits` bits (Skilling's transform)."""
    n = F.size(axes)
    def at(x: Column, i: Column) -> Column:
        return F.get(x, i)

    def put(x: Column, i: Column, v: Column) -> Column:
        return F.transform(x, lambda old, k: F.when(k == i, v).otherwise(old))

    def undo(x: Column, step: Column) -> Column:
        q, i = step.getField("q"), step.getField("i")
        p = q - 1
        t = at(x, F.lit(0)).bitwiseXOR(at(x, i)).bitwiseAND(p)
        flipped = put(x, F.lit(0), at(x, F.lit(0)).bitwiseXOR(p))
        swapped = F.transform(x, lambda old, k: F.when((k == 0) & (i == 0), old).when((k == 0) | (k == i), old.bitwiseXOR(t)).otherwise(old))
        return F.when(at(x, i).bitwiseAND(q) != 0, flipped).otherwise(swapped)

    highest = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.flatten(F.transform(F.array(*[F.lit(q) for q in highest]), lambda q: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(q.alias("q"), i.alias("i")))))
    x = F.aggregate(steps, axes, undo)
    x = F.aggregate(F.sequence(F.lit(1), n - 1), x, lambda x, i: put(x, i, at(x, i).bitwiseXOR(at(x, i - 1))))

    def spread(x: Column) -> Column:
        t = F.aggregate(F.array(*[F.lit(q) for q in highest]), F.lit(0), lambda t, q: F.when(F.get(x, n - 1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    x = F.element_at(F.transform(F.array(x), spread), 1)
    # bits from the highest, axis by axis
    every = F.flatten(F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda b: F.transform(x, lambda v: F.pmod(F.floor(v / F.pow(F.lit(2.0), b)), F.lit(2)).cast("long"))))
    return F.aggregate(every, F.lit(0).cast("long"), lambda h, b: h * 2 + b)


def _steps(value: Column, cuts: list) -> Column:
    """How many cuts lie at or below the value."""
    return reduce(lambda a, b: a + b, [F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0)).cast("int")


def ranked(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(doc_id, size, text_crc32, d0, d1, d2, ...) with shard and slot; d0 and d1 are strings, d2 a number."""
    probabilities = [k / SIDE for k in range(1, SIDE)]
    numbers = rows.agg(F.count("*").alias("n"), F.percentile_approx("d2", probabilities, 100_000).alias("d2")).first()
    n = max(1, numbers["n"])
    cuts = string_cuts(rows, ["d0", "d1"], numbers["n"]) | {"d2": numbers["d2"]}
    # a value that fills several quantiles is one cut, so that equal values share a step
    cell = reduce(lambda a, d: a * SIDE + _steps(F.col(d), sorted(set(cuts[d] or []))), ("d0", "d1", "d2"), F.lit(0)).cast("int")
    rows = rows.withColumn("_cell", cell).withColumn("_hash", F.xxhash64("doc_id", "text_crc32", "size"))
    axes = F.array(*[(F.floor(F.col("_cell") / (SIDE**k)) % SIDE).cast("int") for k in (2, 1, 0)])
    cells = rows.groupBy("_cell").agg(F.count("*").alias("_rows")).withColumn("_curve", hilbert_index(axes))
    # at most SIDE^3 rows from here on, whatever the table
    first = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_at", F.coalesce(F.sum("_rows").over(first), F.lit(0)))
    cells = cells.withColumn("_bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / SLICE))).cast("int")).select("_cell", "_at", "_bits")
    cells = F.broadcast(cells)  # SIDE^3 = 4096 rows at most
    # the leading bits of the hash, as an unsigned number
    slice_ = F.when(F.col("_bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_hash, 64 - _bits)"))
    rows = rows.join(cells, "_cell").withColumn("_slice", slice_)
    slices = rows.groupBy("_cell", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_cell").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_cell").alias("_c"), F.col("_slice").alias("_s"), "_before")
    inside = Window.partitionBy("_cell", "_slice").orderBy("_hash", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_in", F.row_number().over(inside) - 1)
    rows = rows.join(slices, (F.col("_cell") == F.col("_c")) & (F.col("_slice") == F.col("_s")))
    place = F.col("_at") + F.col("_before") + F.col("_in")
    rows = rows.withColumn("_place", place).withColumn("shard", F.expr(f"CAST(_place * {shards}L DIV {n}L AS INT)"))
    return rows.withColumn("slot", F.expr(f"_place - (shard * {n}L + {shards - 1}L) DIV {shards}L"))


def _measured(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    dims = [_code(F.col(c).cast("string")) if c in docs.columns else F.lit("") for c in DIMENSIONS]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        dims[0].alias("d0"), dims[1].alias("d1"), size_of(text).alias("d2"), F.struct("*").alias("_row"),
    )


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text, source, lang)."""
    placed = ranked(_measured(docs).drop("_row"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Parquet files under path/shard=K, rows in the order of the curve, with the columns of docs.

    Where docs has a column `shard`, the folders are named hilbert_shard=K.
    """
    name = "hilbert_shard" if "shard" in docs.columns else "shard"
    placed = ranked(_measured(docs), shards).select("_row.*", F.col("shard").alias(name), F.col("slot").alias("_millrace_slot"))
    spread = placed.repartitionByRange(name, "_millrace_slot").sortWithinPartitions(name, "_millrace_slot")
    spread.drop("_millrace_slot").write.partitionBy(name).parquet(path)
