"""A write-ahead log as a folder of Parquet batches: append, replay, snapshot, compaction and a streaming fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kgspark.operators.mutate import wal_fold

LOG = "seq long, kind string, key long, payload string"


def append(records: DataFrame, path: str) -> None:
    records.select("seq", "kind", "key", "payload").write.mode("append").parquet(f"{path}/log")


def load(spark: SparkSession, path: str, snapshot: DataFrame | None = None, high_water: int = -1) -> DataFrame:
    """key, seq, payload: a snapshot (same columns) and what the log says after its high-water mark."""
    log = spark.read.schema(LOG).parquet(f"{path}/log").filter(F.col("seq") > high_water)
    if snapshot is not None:
        log = snapshot.select("seq", F.lit("upsert").alias("kind"), "key", "payload").unionByName(log)
    return wal_fold(log)


def snapshot(state: DataFrame, path: str, version: int) -> None:
    """A snapshot under its version; readers take the highest one that has a _SUCCESS file."""
    state.write.mode("overwrite").parquet(f"{path}/snapshot/v={version}")


def stream_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(f"{path}/log")


def fold_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest change of each key: each micro-batch is folded into the version before it and written as its own.

    Versions are named by batch, so a batch that is run again after a failure writes the same version again.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("seq", "kind", "key", "payload")
        if batch_id:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{path}/v={batch_id - 1}").select("seq", "kind", "key", "payload"))
        last = new.groupBy("key").agg(F.max_by(F.struct("seq", "kind", "payload"), "seq").alias("r")).select("key", "r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that ``fold_stream`` wrote."""
    versions = spark.read.parquet(path)
    return versions.join(F.broadcast(versions.agg(F.max("v").alias("v"))), "v").drop("v")
