"""The session the engine expects: UTC, AQE."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Rows read back from the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and read again.

    Unlike `cut`, the plan forgets its estimated sizes: those of a join are a product, so in a loop of checkpoints
    their digits would double by the round.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else `df` for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
