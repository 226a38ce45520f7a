"""The status stream against a replay of its machine."""

import random
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from loomgraph.streaming import status


def replay(events):
    run = status.Run()
    for s, p, at in events:
        run.take(s, p, at)
    return run


def test_transitions():
    run = replay([("QUEUED", None, 1), ("CLONING", None, 2), ("QUEUED", None, 3), ("CLONING", 9, 4), ("PARSING", 101, 5), ("WRONG", 1, 6), ("INDEXING", None, 7), ("INDEXING", None, 7), ("SCANNING", None, 8)])
    assert run.values() == ("INDEXING", 65, 7, 4, 5)
    assert run.take("FAILED", None, 9) and not run.take("INDEXING", None, 10) and run.take("QUEUED", None, 11) and run.values()[:2] == ("QUEUED", 0)
    assert all(set(after) <= set(status.STATUSES) for after in status.FOLLOWS.values()) and set(status.FOLLOWS) == set(status.STATUSES)


def test_stream_in_several_triggers(spark, tmp_path):
    """Events in order of time, spread over triggers, with repeats; one run is left waiting and fails by its timer."""
    draw = random.Random(2)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    names = [*status.STATUSES, "WRONG", None]
    rows = [(f"r{draw.randrange(6)}", draw.choice(names), draw.choice([None, 0, 50, 120]), start + timedelta(minutes=i)) for i in range(120)]
    rows += [("waits", "CLONING", None, start + timedelta(minutes=1)), (None, "QUEUED", None, start), ("r0", "QUEUED", None, None)]
    rows.sort(key=lambda r: (r[3] is None, r[3] or start))
    rows += [("late", "QUEUED", None, start + timedelta(days=3)), ("later", "QUEUED", None, start + timedelta(days=3, minutes=1))]
    folder = str(tmp_path / "in")
    parts = [rows[:40], rows[40:80] + rows[70:80], rows[80:-2], rows[-2:-1], rows[-1:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, status.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    told = f"told_{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(status.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = status.statuses(stream).writeStream.format("memory").queryName(told).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.unset(key)
    got = {r["repository_id"]: r for r in status.latest(spark.table(told)).collect()}
    assert set(got) == {f"r{i}" for i in range(6)} | {"waits", "late", "later"}
    assert got["waits"]["status"] == "FAILED" and got["waits"]["progress"] == 100 and got["waits"]["counted"] == 2
    micros = lambda at: int((at - start).total_seconds() * 1e6) + int(start.timestamp() * 1e6)
    for name in (f"r{i}" for i in range(6)):
        own = [r for part in parts for r in part if r[0] == name and r[3] is not None]
        run = replay(sorted(((s, p, micros(at)) for _, s, p, at in own), key=lambda e: (e[2], e[0] or "")))
        if not run.ended:
            run.take("FAILED", None, run.at + 6 * 3_600_000_000)
        assert (got[name]["status"], got[name]["progress"], got[name]["counted"]) == (run.status, run.progress, run.counted), name
    assert spark.table(told).filter(F.col("repository_id") == "r1").count() >= 3
