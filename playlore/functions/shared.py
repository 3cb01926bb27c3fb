"""Checkpoints and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; on a cluster a folder
    of one machine would lose what the others write, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, path: str, by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to ``path`` and read from there: in folders by ``by``, its files in ranges of ``order``.

    A filter on ``by`` skips folders, one on the first of ``order`` files and row groups.
    """
    if by:
        df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.partitionBy(by).option("compression", "zstd").parquet(path)
    else:
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and the folder's path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = file_system(spark, folder)
    return system.exists(path)
