"""Continuous queries: requests answered as they arrive, hits passed on, floors kept as state."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vectors as fv
from ..operators import search


def source(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A table's files as a stream, `files` at most in a batch."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A table may be one file or a folder of files; either is a folder with a pattern to the stream.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(path)


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own and replaces it when the batch is delivered again, so nothing is doubled."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def answers(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """What table_sink has written."""
    return spark.read.schema(schema).parquet(path).drop("batch")


def answer(requests: DataFrame, vectors: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, default_k: int = 10, deadline: float | None = None) -> StreamingQuery:
    """Each batch of requests(query_id, vector, k) is answered with search.top over static vectors and given to sink, with the batch's number.

    A query that is delivered again in a later batch is answered again: its answer is the same. A batch that takes more
    than `deadline` seconds is cancelled and fails the stream."""

    def batch(df: DataFrame, number: int) -> None:
        good = df.where(F.col("query_id").isNotNull() & fv.is_valid(F.col("vector"), 64))
        k = F.when(F.col("k") >= 1, F.col("k")).otherwise(default_k)
        work = lambda: sink(search.top(vectors, good.groupBy("query_id").agg(F.first("vector").alias("vector"), F.max(k).alias("k"))), number)
        within(df.sparkSession, deadline, work) if deadline else work()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """What work() returns; if it takes longer, the jobs that it started are cancelled and TimeoutError is raised."""
    tag = f"deadline-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        # Work may start another job just then: go on until it has ended.
        while not over.wait(0.2):
            spark.sparkContext.cancelJobsWithTag(tag)

    over = threading.Event()
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} seconds") from e
        raise
    finally:
        over.set()
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def coordinate_answers(updates: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """updates(query_id, min_score, neighborhood_hint) -> (query_id, floor double, hint binary): the answer to a batch of updates of a query.

    floor: the highest finite score so far, null before the first. hint: the last hint received with or after it; empty
    hints are none. Of hints in one batch that of the highest score counts, null scores last, then the larger hint. State
    goes after idle_ms without updates."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        floor, hint = state.get if state.exists else (None, None)
        best = None
        for f in frames:
            for score, h in zip(f["min_score"], f["hint"]):
                score = None if score is None or score != score else float(score)
                if score is not None and (floor is None or score > floor):
                    floor = score
                if h is not None and len(h):
                    place = (score is not None, score or 0.0, bytes(h))
                    best = place if best is None else max(best, place)
        hint = best[2] if best else hint
        state.update((floor, hint))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"query_id": [key[0]], "floor": pd.Series([floor], dtype="float64"), "hint": pd.Series([hint], dtype=object)})

    score = F.when(fv.is_finite(F.col("min_score")), F.col("min_score").cast("double"))
    good = updates.where(F.col("query_id").isNotNull()).select("query_id", score.alias("min_score"), F.col("neighborhood_hint").alias("hint"))
    return good.groupBy("query_id").applyInPandasWithState(step, "query_id string, floor double, hint binary", "floor double, hint binary", "update", GroupStateTimeout.ProcessingTimeTimeout)


def floor_step(idle_ms: int) -> Callable:
    """The state function of floor_state: the highest floor of a query so far, dropped after idle_ms without updates."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else float("-inf")
        now = max([before, *(float(f["min_score"].max()) for f in frames)])
        state.update((now,))
        state.setTimeoutDuration(idle_ms)
        if now > before:
            yield pd.DataFrame({"query_id": [key[0]], "floor": [now]})

    return step


def floor_state(updates: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """updates(query_id, min_score) -> (query_id, floor): a row whenever a batch raises a query's floor; state goes after idle_ms without updates."""
    good = updates.where(F.col("query_id").isNotNull() & fv.is_finite(F.col("min_score"))).select("query_id", F.col("min_score").cast("double").alias("min_score"))
    return good.groupBy("query_id").applyInPandasWithState(floor_step(idle_ms), "query_id string, floor double", "floor double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def floor_maximum(updates: DataFrame) -> DataFrame:
    """(query_id, floor): the running maximum as a streaming aggregate, for output mode complete or update."""
    good = updates.where(F.col("query_id").isNotNull() & fv.is_finite(F.col("min_score")))
    return good.groupBy("query_id").agg(F.max("min_score").alias("floor"))


def windowed_hits(hits: DataFrame, *, late: str = "1 hour", length: str = "10 minutes") -> DataFrame:
    """(begin, query_id, n_hits, best): hits by event time; what arrives later than `late` behind the newest is dropped."""
    timed = hits.where(fv.is_finite(F.col("score"))).withWatermark("emitted_at", late)
    out = timed.groupBy(F.window("emitted_at", length).alias("w"), "query_id").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))
    return out.select(F.col("w.start").alias("begin"), "query_id", "n_hits", "best")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over what is there, writes each batch of its result to a folder in path, and returns the rows: of all
    batches in mode update or append, of the last one in mode complete."""
    # State with a timeout on the clock makes a batch without data whenever it can, so such a run would not end.
    spark, name = df.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    write, last = table_sink(path), [-1]

    def keep(batch: DataFrame, number: int) -> None:
        write(batch, number)
        last[0] = number

    spark.conf.set(name, "false")
    try:
        q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
    finally:
        spark.conf.set(name, before)
    if last[0] < 0:
        return spark.createDataFrame([], df.schema)
    return answers(spark, f"{path}/batch={last[0]}" if mode == "complete" else path, df.schema)
