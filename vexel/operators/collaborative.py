"""Score floors shared between parts of a search: a record under the floor cannot be a hit any more.

A floor of kind "kth" is the k-th best score known so far; it never loses a hit. One of kind "best" is the best score known
so far, which loses hits and exists to compare."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv
from . import search

#: Queries whose floors are exchanged at once: what a task sends, 11 bytes for each hit, stays under a few MB.
EXCHANGE = 20_000


def floors(hits: DataFrame, kind: str = "kth") -> DataFrame:
    """(query_id, floor) of hits with a rank and k: the k-th best score, null without k hits; or the best one."""
    if kind not in ("kth", "best"):
        raise ValueError(f"unknown kind {kind}")
    if kind == "best":
        return hits.groupBy("query_id").agg(F.max("score").alias("floor"))
    return hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("score"))).alias("floor"))


def two_stage(vectors: DataFrame, queries: DataFrame, *, probe: DataFrame | None = None, kind: str = "kth") -> DataFrame:
    """As search.top: a probe of some of the records gives each query's floor, the search of all keeps what reaches it.

    probe: the records to begin with, by default those of the smallest shard id."""
    if probe is None:
        first = vectors.agg(F.min("shard_id")).first()[0]
        probe = vectors.where(F.col("shard_id") == first)
    known = floors(search.top(probe, queries), kind)
    return search.top(vectors, queries.join(known, "query_id", "left"))


def barrier(vectors: DataFrame, queries: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """As search.top: all tasks run at once, exchange the best scores they have for each query, and send on only what reaches
    the k-th best of all. Needs as many free slots as tasks; tasks is cut to the default parallelism."""
    spark = vectors.sparkSession
    slots = max(1, spark.sparkContext.defaultParallelism)
    # A barrier stage may not merge partitions of its input itself, so this is a shuffle and not coalesce().
    rows = vectors.select("shard_id", "parent_id", "global_id", "vector").repartition(min(slots, tasks or slots), "global_id")
    out = None
    for t in search.query_blocks(queries.select("query_id", "vector", "k"), EXCHANGE):
        q, ids, k = search.matrix(t["vector"]), t["query_id"].combine_chunks(), t["k"].to_numpy().astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch], q=q, ids=ids, k=k) -> Iterator[pa.RecordBatch]:
            kept = search.Kept(k, None)
            for b in batches:
                if b.num_rows and len(q):
                    search.scored_into(kept, search.distinct_rows(b, None), q, "cosine", None)
            # All deliveries of a record are in one task, which has each of them once: scores alone tell the k-th best of all.
            r, _, gid, s, shard, parent = kept.cut() or (np.array([], np.int64),) * 6
            mine = np.stack([r.astype(np.int32), np.rint(s * 1e6).astype(np.int32)])
            sent = BarrierTaskContext.get().allGather(base64.b64encode(mine.tobytes()).decode())
            every = np.concatenate([np.frombuffer(base64.b64decode(m), np.int32).reshape(2, -1) for m in sent], axis=1)
            every = every[:, np.lexsort((-every[1], every[0]))]
            begin, end = (np.searchsorted(every[0], np.arange(len(q)), side) for side in ("left", "right"))
            floor = np.full(len(q), -np.inf)
            full = end - begin >= k
            floor[full] = every[1][(begin + k - 1)[full]]
            ok = np.rint(s * 1e6) >= floor[r]
            yield from search.sliced(pa.RecordBatch.from_arrays([ids.take(pa.array(r[ok])), pa.array(shard[ok].astype(np.int32)), pa.array(parent[ok].astype(np.int64)), pa.array(gid[ok].astype(np.int64)), pa.array(s[ok].astype(float)), pa.array(k[r[ok]].astype(np.int32))], names=["query_id", "shard_id", "parent_id", "global_id", "score", "k"]))

        # Each block of queries is ranked before the union: a barrier stage may not hold a union itself.
        part = search.ranked(search.once(rows.mapInArrow(run, search.HITS, barrier=True)), "query_id").where(F.col("rank") <= F.col("k"))
        out = part if out is None else out.unionByName(part)
    return out


def finite(updates: DataFrame) -> DataFrame:
    """Updates whose floor is a finite number and whose query is named: others never raise a floor."""
    return updates.where(F.col("query_id").isNotNull() & fv.is_finite(F.col("min_score")))


def relayed(updates: DataFrame) -> DataFrame:
    """updates(query_id, min_score, received_at, shard_id, sent_at) -> those that raise their query's floor, with floor.

    In order of (received_at, sent_at, shard_id, min_score); an update equal to the floor is not sent on, nor is one that
    is not finite; repeated rows are one update."""
    rows = finite(updates).select("query_id", "min_score", "shard_id", "sent_at", "received_at").distinct()
    w = Window.partitionBy("query_id").orderBy("received_at", "sent_at", "shard_id", "min_score").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("min_score").over(w)
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("min_score") > F.col("before"))).withColumn("floor", F.col("min_score")).drop("before", "min_score")


def final_floors(updates: DataFrame) -> DataFrame:
    """(query_id, floor): the highest finite floor of each query."""
    return finite(updates).groupBy("query_id").agg(F.max("min_score").alias("floor"))


def latest_hints(updates: DataFrame, *, best: bool = False) -> DataFrame:
    """(query_id, hint): the last neighbourhood signature received for each query, or that of the highest floor; null and empty ones do not count."""
    rows = updates.where(F.col("query_id").isNotNull() & (F.octet_length("neighborhood_hint") > 0))
    if best:
        rows = finite(rows)
        order = F.struct("min_score", "received_at", "sent_at", "neighborhood_hint")
    else:
        order = F.struct("received_at", "sent_at", "neighborhood_hint")
    return rows.groupBy("query_id").agg(F.max_by("neighborhood_hint", order).alias("hint"))
