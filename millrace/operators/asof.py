"""As-of join forward: the next event at or after a row's time, among events of the same key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def next_event(rows: DataFrame, events: DataFrame, by: list[str], at: str, when: str, name: str) -> DataFrame:
    """rows with `name`: the least events.`when` that is not before rows.`at`, of equal `by`; null where there is none or
    the row's time is null.

    Rows and events are merged in order of (by, time) and dealt in ranges of that order, so a key that very many of them
    share is spread over tasks.  Within a range the next event is a running minimum from its end backwards; for the
    keys that reach into another range - fewer than there are ranges - the first event of each later range is carried
    over.  No row meets more than one event.
    """
    others = [c for c in rows.columns if c not in (*by, at)]
    kind = events.schema[when].dataType
    own = rows.select(*by, F.col(at).cast(kind).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_e"), F.struct(F.lit(1).alias("_"), F.col(at).alias("_at"), *others).alias("_row"))
    theirs = events.filter(F.col(when).isNotNull()).select(*by, F.col(when).alias("_t")).distinct().select(*by, "_t", F.lit(1).alias("_kind"), F.col("_t").alias("_e"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    merged = own.unionByName(theirs)
    dealt = merged.repartitionByRange(*by, "_t", "_kind", F.xxhash64("_row")).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    back = Window.partitionBy("_range", *by).orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.withColumn("_next", F.min("_e").over(back)).filter("_kind = 0").alias("n")
    crossing = dealt.groupBy(*by).agg(F.min("_range").alias("_lo"), F.max("_range").alias("_hi")).filter("_lo < _hi").select(*by).alias("c")
    spans = dealt.alias("d").join(F.broadcast(crossing), _same("d", "c", by), "left_semi").groupBy("_range", *by).agg(F.min("_e").alias("_head"))
    later = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.min("_head").over(later)).drop("_head").alias("s")  # two rows a range at most
    out = near.join(F.broadcast(carried), _same("n", "s", by) & (F.col("n._range") == F.col("s._range")), "left")
    return out.select(*[F.col(f"n.{b}").alias(b) for b in by], F.col("n._row._at").alias(at), *[F.col(f"n._row.{c}").alias(c) for c in others], F.when(F.col("n._t").isNotNull(), F.coalesce("n._next", "s._carried")).alias(name))
