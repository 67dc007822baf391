"""Spark helpers shared by the corpus operators: cutting lineage, checked broadcasts, graph components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; without one only local masters get a temporary folder."""
    checkpoint_dir(spark)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many texts in one Arrow batch: a batch is held whole on both sides, and texts may be very long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def bounded_bytes(spark: SparkSession, size: int = 32 << 20) -> None:
    """At most so many bytes in one Arrow batch, where a single row does not exceed them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(name, str(size))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written to `path` and read again.

    Unlike `cut`, the plan forgets its estimated sizes: those of a join are a product, so that in a loop of checkpoints
    their digits grow by the round, until the driver has no memory left.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the cluster delete shuffle files that no frame refers to any more, before the next large shuffle.

    They go when the driver collects the frames that read them, and it may not for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else `df` for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows: the first by a hash of `key`.  Beyond twice that, tasks keep only the share that is needed,
    so that what meets in one task does not grow with their number."""
    order, n = F.xxhash64(key), df.count()
    if n > 2 * rows:
        share = (1.2 * rows + 100) / n
        df = df.filter(order <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63))))
    return df.orderBy(order, *df.columns).limit(rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, label), label the smallest id reachable.

    Minimum-label hooking with pointer jumping, all as joins and map-side combined minima, so that a hub
    with very many links is never one task's group.  Self-loops and repeated edges are harmless; null ends
    are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = rewritten(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/both")
    lab = rewritten(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), f"{folder}/0")
    k = 0
    while True:
        far = lab.select(F.col("id").alias("b"), F.col("label").alias("far"))
        near = both.join(far, "b").groupBy(F.col("a").alias("id")).agg(F.min("far").alias("near"))
        step = lab.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label is itself an id: follow it once
        jump = lab.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = rewritten(step.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), f"{folder}/{k + 1}")
        delete(spark, f"{folder}/{k}")
        k += 1
        moved = new.filter("label <> old").limit(1).count()
        lab = new.select("id", "label")
        if not moved:
            lab = cut(lab)
            delete(spark, folder)
            return lab
