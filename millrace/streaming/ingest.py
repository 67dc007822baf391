"""Builds as a stream into the store: each micro-batch goes through the idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prepare import RAW_COLUMNS, parse_timestamp
from ..store import Store

RAW_SCHEMA = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)


def ingest_stream(stream: DataFrame, store_path: str, checkpoint: str, source: str = "stream", available_now: bool = True) -> StreamingQuery:
    """A replayed batch adds nothing: its rows are duplicates by then."""

    def batch(rows: DataFrame, number: int) -> None:
        Store(rows.sparkSession, store_path).ingest(rows, f"{source}:{number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """day, group, builds, cost of raw build rows, with a watermark for late ones."""
    at = parse_timestamp(F.col("ts")).getField("at")
    rows = stream.withColumn("_at", at).filter("_at IS NOT NULL").withWatermark("_at", late)
    day = F.window("_at", "1 day")
    return rows.groupBy(day.alias("day"), F.coalesce("group", F.lit("all")).alias("grp")).agg(F.count("*").alias("builds"), F.sum(F.col("cost_usd").try_cast("double")).alias("cost_usd")).select(F.col("day.start").alias("day"), "grp", "builds", "cost_usd")
