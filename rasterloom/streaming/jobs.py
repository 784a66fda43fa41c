"""Registration jobs: documents in a landing folder, states in an append-only table, and a stream that follows them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB_SCHEMA = "job_id string, status string, source_path string, reference_path string, message string, updated timestamp"
# Which states may follow a state.
NEXT = {None: ("pending",), "pending": ("running",), "running": ("completed", "failed"), "completed": (), "failed": ()}


def submit(pairs: DataFrame, folder: str) -> None:
    """Appends pending job documents for pairs (source_path, reference_path)."""
    rows = pairs.select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("job_id"), F.lit("pending").alias("status"), "source_path", "reference_path", F.lit(None).cast("string").alias("message"), F.current_timestamp().alias("updated"))
    rows.write.mode("append").json(folder)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(JOB_SCHEMA).json(folder)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each job's last valid state."""
    step = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    rows = spark.read.schema(JOB_SCHEMA).json(folder).withColumn("step", step)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "source_path", "reference_path", "message", "updated"), F.struct("step", "updated")).alias("r")).select("job_id", "r.*")


def transitions(states: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(job_id, status, previous, valid) for each arriving state, in order of time, against the job's state so far; states that may not follow are marked, and don't count.
    Finished jobs are forgotten once the watermark has passed them."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        last = 0
        pdf, out = pd.concat(list(batches)).sort_values("updated", kind="stable"), []  # a job's states of one batch, nulls last
        for status, at in pdf[["status", "updated"]].itertuples(index=False):
            ok = status in NEXT[now]
            out.append((key[0], status, now, ok))
            now, last = status if ok else now, last if pd.isna(at) else max(last, int(at.timestamp() * 1000))
        yield pd.DataFrame(out, columns=["job_id", "status", "previous", "valid"])
        if now is not None:
            state.update((now,))
            if not NEXT[now]:
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    return states.withWatermark("updated", watermark).groupBy("job_id").applyInPandasWithState(follow, "job_id string, status string, previous string, valid boolean", "status string", "append", GroupStateTimeout.EventTimeTimeout)


def process(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame]):
    """A streaming query that runs ``handle`` (pending jobs in, (job_id, status, message) out) on each batch and appends running and final states. A batch that is repeated after
    a failure runs only jobs that have no final state yet."""

    def batch(jobs: DataFrame, _: int) -> None:
        done = latest(spark, folder).where("status in ('completed', 'failed')").select("job_id")
        fresh = jobs.where("status = 'pending'").dropDuplicates(["job_id"]).join(done, "job_id", "left_anti")
        if fresh.isEmpty():
            return
        mark = lambda df, status, message: df.select("job_id", status.alias("status"), "source_path", "reference_path", message.alias("message"), F.current_timestamp().alias("updated"))
        mark(fresh, F.lit("running"), F.lit(None).cast("string")).write.mode("append").json(folder)
        ended = handle(fresh).join(fresh.select("job_id", "source_path", "reference_path"), "job_id")
        mark(ended, F.col("status"), F.col("message")).write.mode("append").json(folder)

    return read_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(states: DataFrame, folder: str) -> DataFrame:
    """The transitions of a finished table of states (job_id, status, updated): written to ``folder`` as documents, streamed once, and read back."""
    spark = states.sparkSession
    rows = states.select("job_id", "status", F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("reference_path"), F.lit(None).cast("string").alias("message"), "updated")
    rows.write.json(f"{folder}/states")
    query = transitions(read_stream(spark, f"{folder}/states"), "3650 days").writeStream.format("parquet").option("path", f"{folder}/moves").option("checkpointLocation", f"{folder}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_id string, status string, previous string, valid boolean").parquet(f"{folder}/moves")
