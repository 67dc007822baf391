"""Exact percentiles of groups of any size, by histograms over the ordered bits of a double.

A double's bits, read as an integer, have the order of the doubles.  `percentiles` counts rows by the leading 16 bits
below what is already known of each wanted rank, for all groups, columns and probabilities at once; the counts say into
which bin each rank falls, and the next round looks only there.  Four rounds know all 64 bits; as soon as no
bin in question holds more than DIRECT rows, the last ones are sorted instead.  No task holds more than a
bin's DIRECT values or 65,536 counts of a group, whatever the group's size.

Groups of at most DIRECT rows are sorted as arrays in the aggregation that is under way anyway (`inline`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, small

DIRECT, DIGIT = 10_000, 16
#: Rows of targets that are broadcast; beyond it they are joined by shuffle.
FEW = 50_000
_LOW, _TOP = 1 << 52, 2047 << 52
Wanted = dict[str, tuple[Column, float]]


def ordered_bits(x: Column) -> Column:
    """A long with the order of the doubles: -0.0 and 0.0 are one, NaN is above infinity; null stays null."""
    size = F.abs(x)
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(F.when(size > 0, size).otherwise(5e-324))).cast("double")))
    # the logarithm may be off by one next to a power of two
    high = F.when((guess < 1023) & (size >= F.pow(F.lit(2.0), guess + 1)), guess + 1).otherwise(guess)
    e = F.when((high > -1022) & (size < F.pow(F.lit(2.0), high)), high - 1).otherwise(high)
    code = (e + 1022).cast("long") * F.lit(_LOW) + (size / F.pow(F.lit(2.0), e) * float(_LOW)).cast("long")
    whole = F.when(F.isnan(x), F.lit(_TOP + 1)).when(size == float("inf"), F.lit(_TOP)).otherwise(code)
    return F.when(x.isNotNull(), F.when((x < 0) & ~F.isnan(x), -whole).otherwise(whole))


def from_bits(code: Column) -> Column:
    """The double of `ordered_bits`."""
    size = F.abs(code)
    e, m = F.shiftright(size, 52), size.bitwiseAND(_LOW - 1).cast("double")
    below = m / float(_LOW) * F.pow(F.lit(2.0), F.lit(-1022.0))
    value = F.when(size > _TOP, float("nan")).when(size == _TOP, float("inf")).when(e == 0, below).otherwise((1 + m / float(_LOW)) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(code < 0, -value).otherwise(value)


def between(low: Column, high: Column, place: Column) -> Column:
    """Linear interpolation at a fractional place between its neighbours' values."""
    return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))


def of_sorted(values: Column, p: float) -> Column:
    """The percentile of a sorted array without nulls; null of an empty one."""
    place = F.lit(p) * (F.size(values) - 1)
    at = lambda k: F.get(values, k.cast("int"))
    return F.when(F.size(values) > 0, between(at(F.floor(place)), at(F.ceil(place)), place))


def inline(wanted: Wanted) -> tuple[dict[str, Column], dict[str, Column]]:
    """(aggregates, columns over them) for groups of at most DIRECT rows: each column of values is sorted once."""
    lists: dict[str, tuple[str, Column]] = {}
    out = {}
    for name, (values, p) in wanted.items():
        held, _ = lists.setdefault(str(values), (f"{name}_sorted", F.array_sort(F.collect_list(values))))
        out[name] = of_sorted(F.col(held), p)
    return dict(lists.values()), out


def largest(rows: DataFrame, keys: Iterable[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _same(a: str, b: str, names: Iterable[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def order_statistics(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """ranks(by, k) with `code`, the k-th smallest (from 0) of values(by, code)."""
    # the sign bit turned, so that digits compare as unsigned numbers
    u = F.col("code").bitwiseXOR(F.lit(-(2**63)))
    found = ranks.select(*by, "k", F.lit(0).cast("long").alias("prefix"), F.col("k").alias("rest"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        known = shift + DIGIT
        prefix = F.lit(0).cast("long") if known == 64 else F.shiftrightunsigned(u, known)
        rows = values.withColumn("prefix", prefix)
        if known < 64:
            rows = rows.alias("v").join(small(found.select(*by, "prefix").distinct(), FEW).alias("f"), _same("v", "f", [*by, "prefix"]), "left_semi")
        digit = F.shiftrightunsigned(u, shift).bitwiseAND(2**DIGIT - 1)
        bins = rows.groupBy(*by, "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("n").over(order))
        inside = _same("b", "f", [*by, "prefix"]) & (F.col("f.rest") < F.col("b.upto")) & (F.col("f.rest") >= F.col("b.upto") - F.col("b.n"))
        next_ = F.shiftleft(F.col("f.prefix"), DIGIT).bitwiseOR(F.col("b.digit"))
        found = bins.alias("b").join(small(found, FEW).alias("f"), inside)
        found = cut(found.select(*[F.col(f"f.{c}").alias(c) for c in by], "f.k", next_.alias("prefix"), (F.col("f.rest") - F.col("b.upto") + F.col("b.n")).alias("rest"), "b.n"))
        if shift and (found.agg(F.max("n")).first()[0] or 0) <= DIRECT:
            rows = values.withColumn("prefix", F.shiftrightunsigned(u, shift)).alias("v").join(small(found.select(*by, "prefix").distinct(), FEW).alias("f"), _same("v", "f", [*by, "prefix"]), "left_semi")
            lists = rows.groupBy(*by, "prefix").agg(F.array_sort(F.collect_list("code")).alias("codes"))
            out = found.alias("f").join(lists.alias("l"), _same("f", "l", [*by, "prefix"]))
            return out.select(*[F.col(f"f.{c}").alias(c) for c in by], "f.k", F.get("l.codes", F.col("f.rest").cast("int")).alias("code"))
        found = found.drop("n")
    return found.select(*by, "k", F.col("prefix").bitwiseXOR(F.lit(-(2**63))).alias("code"))


def percentiles(rows: DataFrame, keys: Iterable[str], wanted: Wanted) -> DataFrame:
    """keys and a column for each wanted (values, probability): the percentile of the values that are not null."""
    keys = list(keys)
    columns: dict[str, tuple[int, Column]] = {}
    of = {name: columns.setdefault(str(v), (len(columns), v))[0] for name, (v, _) in wanted.items()}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), ordered_bits(v.cast("double")).alias("code")) for c, v in columns.values()]))
    long = cut(rows.select(*keys, each.alias("_e")).select(*keys, "_e.col", "_e.code").filter("code IS NOT NULL"))
    by = [*keys, "col"]
    sizes = cut(long.groupBy(*by).agg(F.count("*").alias("n")))
    place = {name: F.lit(p) * (F.col("n") - 1) for name, (_, p) in wanted.items()}
    ends = [F.when(F.col("col") == of[name], f(x).cast("long")) for name, x in place.items() for f in (F.floor, F.ceil)]
    ranks = sizes.select(*by, F.explode(F.array_distinct(F.array_compact(F.array(*ends)))).alias("k"))
    got = order_statistics(long, by, ranks).withColumn("value", from_bits(F.col("code"))).alias("g")
    joined = got.join(sizes.alias("s"), _same("g", "s", by)).select(*[F.col(f"g.{c}").alias(c) for c in by], "g.k", "g.value", "s.n")

    def end(name: str, f) -> Column:
        return F.max(F.when((F.col("col") == of[name]) & (F.col("k") == f(place[name])), F.col("value")))

    parts = joined.groupBy(*keys).agg(*[end(name, f).alias(f"{name}_{i}") for name in wanted for i, f in enumerate((F.floor, F.ceil))], *[F.max(F.when(F.col("col") == of[name], place[name])).alias(f"{name}_at") for name in wanted])
    return parts.select(*keys, *[between(F.col(f"{name}_0"), F.col(f"{name}_1"), F.col(f"{name}_at")).alias(name) for name in wanted])


def numbered(rows: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
    """rows with `name`: the place of each among those of equal, known `within`, in order of `by`, from 0.

    Rows are dealt in ranges of that order, sorted in their range, and counted on from the ranges before: a `within` with very many
    rows is spread over tasks.
    """
    dealt = rows.repartitionByRange(*within, *by).sortWithinPartitions(*within, *by).withColumn("_id", F.monotonically_increasing_id())
    dealt = cut(dealt).withColumn("_range", F.shiftright("_id", 33))
    spans = dealt.groupBy("_range", *within).agg(F.min("_id").alias("_start"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    out = dealt.join(F.broadcast(spans), ["_range", *within])  # a row a range and what it holds
    return out.select(*rows.columns, (F.col("_id") - F.col("_start") + F.col("_before")).alias(name))
