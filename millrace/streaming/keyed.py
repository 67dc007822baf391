"""Builds as a stream, classified by keyed state instead of a join with the store.

Each build_id holds the row that was accepted for it, so a micro-batch costs what its own rows cost, however large the
store is.  A query that starts afresh takes the store's builds as its first state.  Rows follow the rules of
`store.classify_ingest`; a micro-batch is one batch to them, in the order of a column, or as they come to the key's task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.prepare import RAW_COLUMNS, blank_to_null
from ..store import REQUIRED, TWIN, Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
_OTHERS = [c for c in RAW_COLUMNS if c != "build_id"]


def _agree(a: str | None, b: str | None) -> bool:
    """As `store.differs` has it: as numbers if both are, else as text."""
    if a is None or b is None:
        return a is b
    try:
        return abs(float(a) - float(b)) <= 1e-9
    except ValueError:
        return a == b


class Classifier(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _TEXT)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.known.update(tuple(initialState[c] for c in RAW_COLUMNS))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # an id's rows of one micro-batch; those without an id have keys of their own
        given = sorted((r.asDict() for r in rows), key=lambda r: (r["_place"] is None, r["_place"] or 0))
        for k, row in enumerate(given):
            status, field = self._judged(row, k)
            if status == "accepted":
                self.known.update(tuple(row[c] for c in RAW_COLUMNS))
            yield Row(**{c: row[c] for c in RAW_COLUMNS}, status=status, field=field)

    def _judged(self, row: dict, k: int) -> tuple[str, str | None]:
        if row["build_id"] is None:
            return "rejected", "build_id"
        if k:
            return "rejected", TWIN
        lacks = [c for c in REQUIRED if row[c] is None]
        if lacks:
            return "rejected", ", ".join(lacks)
        if not self.known.exists():
            return "accepted", None
        old = dict(zip(RAW_COLUMNS, self.known.get()))
        odd = next((c for c in _OTHERS if not _agree(row[c], old[c])), None)
        return ("conflict", odd) if odd else ("duplicate", None)

    def close(self) -> None:
        pass


def classify_stream(stream: DataFrame, store: Store, order: str | None = None) -> DataFrame:
    """The stream's rows (columns of RAW_COLUMNS, absent ones null) with status and field; `order` is a column of whole numbers."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    have = [F.col(f"`{c}`").cast("string") if c in stream.columns else F.lit(None).cast("string") for c in RAW_COLUMNS]
    text = stream.select(*[blank_to_null(F.trim(c) if n == "build_id" else c).alias(n) for c, n in zip(have, RAW_COLUMNS)], (F.col(order).cast("long") if order else F.lit(None).cast("long")).alias("_place"))
    # rows without an id are spread, and kept by nobody
    key = F.coalesce("build_id", F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in RAW_COLUMNS], "_place"), F.lit(1024)).cast("string"))).alias("_key")
    known = store.read("builds").select(*[F.col(f"`{c}`") for c in RAW_COLUMNS]).withColumn("_key", F.col("build_id"))
    out = text.withColumn("_key", key).groupBy("_key")
    return out.transformWithState(Classifier(), f"{_TEXT}, status string, field string", "Append", "None", known.groupBy("_key"))


def ingest_keyed(stream: DataFrame, store_path: str, checkpoint: str, source: str = "stream", available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Append what is new to the store, a report and issues for each micro-batch; one that is done again after a failure adds nothing."""
    store = Store(stream.sparkSession, store_path)

    def commit(rows: DataFrame, number: int) -> None:
        Store(rows.sparkSession, store_path).commit_classified(rows, f"{source}:{number}")

    writer = classify_stream(stream, store, order).writeStream.foreachBatch(commit).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
