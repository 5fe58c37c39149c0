"""What the corpus operators share: the shared folder, written tables, Arrow limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, a temporary one is set; a cluster needs one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return (path if "://" in path or path.startswith("file:") else f"file://{path}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts lineage: what follows survives the loss of the executors that computed it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the Arrow batches sent to Python workers: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """A bounded memo in two generations: when the young one is full, by entries or by the
    length of its keys, it becomes the old one, from which what is still asked for moves
    back. Long keys are not remembered at all."""

    LONG, CHARACTERS = 1024, 1 << 24

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old, self.held = make, size, {}, 0

    def __missing__(self, key):
        length = len(key) if isinstance(key, str | bytes) else 1
        if length > self.LONG:
            return self.make(key)
        if len(self) >= self.size or self.held >= self.CHARACTERS:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += length
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
