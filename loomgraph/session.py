"""Session settings and tables written once to the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC time; what the cluster sets stays as it is."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch for the Python stages of this session.

    Spark's usual 10,000 rows are meant for narrow rows; of whole texts they would fill an executor.
    A smaller setting stays.  Spark reads the setting when a frame runs, after the operator has returned,
    so it can't be put back: operators that call this say so by calling it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows of equal ``keys`` to one partition, for a stage that reads partitions as they come, such as ``mapInArrow``.

    Where a join below has dealt rows by the same columns, Spark drops ``repartition`` by them, and then, as nothing else asks
    for that dealing, may broadcast the join's other side or split its large partitions: a key's rows lie apart.  No join deals
    by this hash of the columns, so the shuffle stays.
    """
    return df.repartition(F.xxhash64(*keys))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


#: Seconds between two collections of garbage at least.
RELEASE_S = 5.0
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of runs that have ended go, if that wasn't done just now.

    Spark deletes them when the driver's garbage is collected.  A driver that only plans makes little garbage, so over many steps
    the files of all of them would lie on the disks at once; what takes long to write is what shuffles much.
    """
    now = time.monotonic()
    if now - _released[0] >= RELEASE_S:
        # Spark's scheduler holds the last job until it has another one.
        spark.range(0, 1, 1, 1).collect()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = now


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, whoever is lost later."""
    return Scratch(df.sparkSession).store(df, label)


class Scratch:
    """Tables that one run writes to the shared folder; ``clear`` and ``keep`` delete those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = os.path.join(shared_dir(self.spark), f"{label}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        release(self.spark)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def clear(self, *frames: DataFrame) -> None:
        """Deletes the tables of ``frames``."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        for table in list(self.tables):
            if any(table[0] is f for f in frames):
                self.tables.remove(table)
                where = hadoop.Path(table[1])
                where.getFileSystem(conf).delete(where, True)

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables of this run but those of ``frames``."""
        self.clear(*(table[0] for table in self.tables if not any(table[0] is f for f in frames)))
