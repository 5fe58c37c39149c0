"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Into how many tasks rows are dealt, at least, where a task sorts its share.
FINE = 192


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return (path if ":" in path else f"file://{path}").rstrip("/")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` in as many tasks as a shuffle has, by ``key``: rows that take long to compute may
    lie in one row group of a small file, which is one task otherwise. Their number is given,
    so that adaptive execution does not put small partitions together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def finely(df: DataFrame, *key: str) -> DataFrame:
    """As :func:`dealt`, in at least ``FINE`` tasks: what a task sorts in memory is its share
    of the rows, and a session's number of shuffle partitions does not grow with them."""
    return df.repartition(max(FINE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
