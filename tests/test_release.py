"""Shuffle files of a step go when the step is written."""

import glob
import os
import time

from pyspark.sql import functions as F

from loomgraph import session


def _shuffled(spark):
    folder = os.path.dirname(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    return {f for f in glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data")}


def test_a_stored_step_keeps_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(session, "RELEASE_S", 0.0, raising=False)
    spark.sparkContext._jvm.System.gc()
    rows = spark.range(0, 20_000, 1, 4).withColumn("k", F.col("id") % 997)
    before = _shuffled(spark)
    back = session.stored(rows.repartition(4, "k").groupBy("k").agg(F.max("id").alias("m")), "released")
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    assert back.count() == 997
