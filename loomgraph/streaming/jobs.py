"""The job queue as a stream: an input table of jobs, at-least-once handling, and a dead-letter table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.schemas import JOBS
from loomgraph.session import stored

Handler = Callable[[DataFrame], None]
JobHandler = Callable[[dict], None]
#: Calls of a batch's handler, and the share of a batch's jobs that may fail, before the handler counts as down.
MAX_CALLS, OUTAGE = 256, 0.5
QUEUES = ("repo-analysis",)


def publish(spark: SparkSession, path: str, jobs: DataFrame, queue: str = "repo-analysis") -> None:
    """Appends jobs to a queue's input table as JSON lines."""
    if queue not in QUEUES:
        raise ValueError(f"no queue named {queue}")
    jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.mode("append").text(f"{path}/{queue}")


def parsed(messages: DataFrame) -> DataFrame:
    """(value, job): the message and its fields, null where it isn't a job."""
    return messages.select("value", F.from_json("value", JOBS).alias("job"))


def consume(spark: SparkSession, path: str, checkpoint: str, dead_letters: str, handle: Handler, queue: str = "repo-analysis") -> StreamingQuery:
    """Handles what the queue holds once; the checkpoint is the acknowledgement.

    ``handle`` gets a batch's well-formed jobs.  If it fails, the batch is halved by the jobs' hashes, and
    again where a half fails, so a poisoned job costs a number of calls that grows with the logarithm of
    the batch and holds nobody up: those that fail alone, and messages that aren't jobs, go to the
    dead-letter table and aren't tried again.  A batch repeated after a crash overwrites its own
    dead letters, and handlers are expected to upsert by key.  A batch that takes more than ``MAX_CALLS``
    calls ends the stream without being acknowledged: the handler is down, and its jobs come again.
    Many jobs that fail one by one are for ``consume_each``.
    """
    calls = 0

    def settled(jobs: DataFrame, depth: int = 0) -> list[tuple[DataFrame, str]]:
        """What fails of some jobs, and why."""
        nonlocal calls
        if jobs.isEmpty():
            return []
        calls += 1
        if calls > MAX_CALLS:
            raise RuntimeError(f"the handler failed over and over, {MAX_CALLS} calls in one batch")
        try:
            handle(jobs)
            return []
        except Exception as error:
            # Jobs that are the same in all fields fail together.
            if depth == 63 or jobs.select(F.xxhash64(*jobs.columns)).distinct().limit(2).count() == 1:
                return [(jobs, str(error)[:1000])]
        side = F.shiftrightunsigned(F.xxhash64(*jobs.columns), depth).bitwiseAND(1)
        return settled(jobs.filter(side == 0), depth + 1) + settled(jobs.filter(side == 1), depth + 1)

    def batch(frame: DataFrame, number: int) -> None:
        nonlocal calls
        calls = 0
        rows = parsed(frame).persist()
        good = rows.filter("job.repository_id is not null").select("job.*")
        dead = rows.filter("job.repository_id is null").select("value", F.lit("not a job").alias("error"))
        for failed, error in settled(good):
            dead = dead.unionByName(failed.select(F.to_json(F.struct(*failed.columns)).alias("value"), F.lit(error).alias("error")))
        dead.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        rows.unpersist()

    return _started(spark, path, queue, checkpoint, batch)


def _started(spark: SparkSession, path: str, queue: str, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(f"{path}/{queue}")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"{queue}-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def outcomes(messages: DataFrame, handle: JobHandler, tries: int = 3) -> DataFrame:
    """(value, error): what becomes of each message; null if it was handled.

    ``handle`` runs in the tasks, a job at a time; a job that fails is tried ``tries`` times, the others once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            errors: list[str | None] = []
            for job in rows.column("job").to_pylist():
                error = "not a job" if job is None or job["repository_id"] is None else None
                for _ in range(tries if error is None else 0):
                    try:
                        handle(job)
                        error = None
                        break
                    except Exception as failure:
                        error = str(failure)[:1000] or type(failure).__name__
                errors.append(error)
            yield pa.RecordBatch.from_arrays([rows.column("value"), pa.array(errors, pa.string())], names=["value", "error"])

    return parsed(messages).mapInArrow(run, "value string, error string")


def consume_each(spark: SparkSession, path: str, checkpoint: str, dead_letters: str, handle: JobHandler, queue: str = "repo-analysis", tries: int = 3, outage: float = OUTAGE) -> StreamingQuery:
    """Handles each job that the queue holds by itself, in the tasks; a batch costs one pass whatever fails.

    Messages that aren't jobs, and jobs that fail ``tries`` times, go to the dead-letter table.  Where more than
    ``outage`` of a batch's jobs fail, and more than one, the handler counts as down: the stream ends, the batch
    isn't acknowledged, and its jobs come again, as they do after a crash.  Handlers are expected to upsert by key.
    """

    def batch(frame: DataFrame, number: int) -> None:
        letters = f"{dead_letters}/batch={number}"
        # Written whole first, so that no job is handled again when failures are counted.
        told = stored(outcomes(frame, handle, tries), "outcomes")
        count = told.filter("error is null or error <> 'not a job'").agg(F.count("*").alias("n"), F.count("error").alias("failed")).first()
        if count["failed"] > max(1, outage * count["n"]):
            raise RuntimeError(f"{count['failed']} of {count['n']} jobs failed")
        told.filter("error is not null").write.mode("overwrite").parquet(letters)

    return _started(spark, path, queue, checkpoint, batch)
