"""Shared-folder tables and small helpers for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own where that is unset and all tasks run in this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("provenspark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="provenspark-")
        spark.conf.set("provenspark.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder (in folders by that column, if any) and read again: lineage ends there and any executor can be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark)
        for file in {root + "/" + f.rpartition(root.rpartition("/")[2] + "/")[2].partition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null: empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves that remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def parts(spark: SparkSession) -> int:
    """Shuffle partitions as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _blobs(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], names=batch.schema.names)


def numbers(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table of longs, brought to the driver as packed blocks rather than rows."""
    rows = df.mapInArrow(_blobs, ", ".join(f"`{c}` binary" for c in df.columns)).collect()
    return [np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.int64) for k in range(len(df.columns))]
