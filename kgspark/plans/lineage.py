"""Cutting the lineage of intermediate results, and giving executors what tasks need."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a session of one local process (tests); a cluster is refused, since
    its executors would not see each other's files.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kgspark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that later steps read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files give fewer tasks than there are cores; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()
#: Bytes of an Arrow batch where the session leaves Spark's default; a longer row comes alone.
BATCH_BYTES, _DEFAULT_BYTES = 8 << 20, "67108864b"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package (once per application), so that tasks need no installation of it; and bound Arrow
    batches by bytes, so that long texts do not make large ones."""
    if spark.conf.get(_BYTES_SETTING) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES_SETTING, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kgspark-')}/{top.name}", "zip", top.parent, top.name)
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
