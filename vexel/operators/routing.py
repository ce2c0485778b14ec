"""Search of some shards only, or with other budgets and filters for some: probe and deep phases, centroids, hints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.saved import saved
from . import search


def shard_limited(vectors: DataFrame, queries: DataFrame, members: DataFrame, *, own_shard: int = 0, most: int = -1) -> DataFrame:
    """As search.top on the own shard and those of the first `most` peers in order of host and port; all if most < 0.

    Replicas of a shard are one peer, members of the own shard none."""
    peers = [r[0] for r in members.where(F.col("shard_id") != own_shard).groupBy("shard_id").agg(F.min(F.concat(F.coalesce("host", F.lit("")), F.col("grpc_port").cast("string"))).alias("at")).orderBy("at", "shard_id").select("shard_id").collect()]
    if most < 0 or most >= len(peers):
        return search.top(vectors, queries)
    return search.top(vectors.where(F.col("shard_id").isin([own_shard, *peers[:most]])), queries)


def restricted(vectors: DataFrame, queries: DataFrame, allowed: DataFrame) -> DataFrame:
    """As search.top, of the shards whose (query_id, shard_id) is in allowed only: no other shard is scored for the query."""
    routes_ = allowed.select("query_id", "shard_id").distinct().join(queries.select("query_id", "vector", "k"), "query_id")
    return search.ranked(search.visiting(vectors, routes_).drop("visited"), "query_id").where(F.col("rank") <= F.col("k"))


def two_phase(vectors: DataFrame, queries: DataFrame, *, probe: int = 5, enough: int = 10, confidence: float = 0.95) -> DataFrame:
    """As search.top, with phase: a probe takes `probe` records of each shard; a query with `enough` of them at `confidence`
    is answered by them (phase 1), any other by a full search of the shards that are in the probe's top k (phase 2)."""
    first = search.per_shard(vectors, queries, k=probe).drop("rank")
    certain = F.count_if(F.col("score") >= confidence).over(Window.partitionBy("query_id")) >= enough
    quick = saved(search.ranked(first.withColumn("sure", certain), "query_id").where(F.col("rank") <= F.col("k")))
    unsure = quick.where(~F.col("sure")).select("query_id", "shard_id").distinct()
    slow = restricted(vectors, queries.join(unsure, "query_id", "left_semi"), unsure)
    return quick.where("sure").drop("sure").withColumn("phase", F.lit(1)).unionByName(slow.withColumn("phase", F.lit(2)))


def adaptive(vectors: DataFrame, queries: DataFrame, *, isolated: int = 10, near: float = 0.9) -> DataFrame:
    """As search.top with a budget for each shard: a shard whose best record scores at least `near` may give k records, another `isolated`."""
    hits = search.per_shard(vectors, queries).withColumnRenamed("rank", "shard_rank")
    best = F.max("score").over(Window.partitionBy("query_id", "shard_id"))
    kept = hits.withColumn("best", best).where((F.col("best") >= near) | (F.col("shard_rank") <= isolated)).drop("best", "shard_rank")
    return search.ranked(kept, "query_id").where(F.col("rank") <= F.col("k"))


def early_stop(vectors: DataFrame, queries: DataFrame, *, rounds: int = 3, k: int = 10) -> DataFrame:
    """As search.top with the same k for all, shard after shard in `rounds` groups. From the second round on a shard is
    scored for a query only if, by its centroid and radius, it may hold a record that reaches the k-th score so far; a query
    that no shard can improve is satisfied and costs nothing more."""
    asked = queries.withColumn("k", F.lit(k))
    part = lambda r: vectors.where(F.pmod(F.col("shard_id"), F.lit(rounds)) == r)
    hits = search.top(part(0), asked)
    bounds = shard_bounds(vectors) if rounds > 1 else None
    for r in range(1, rounds):
        hits = saved(hits)
        floor = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("score"))).alias("floor"))
        more = search.candidates(part(r), asked.join(floor, "query_id", "left"), bounds=bounds)
        hits = search.ranked(search.once(hits.drop("rank").unionByName(more)), "query_id").where(F.col("rank") <= k)
    return hits


def shard_bounds(vectors: DataFrame) -> tuple:
    """For search.candidates: the shards in order, and a function of queries that gives the highest score a record of each can have.

    A shard has a row of its centroid and of the smallest cosine of a member to it; these come to the driver."""
    means = listed(mean_centroids(vectors), "shard_id")
    names, c = np.array([m[0] for m in means], np.int64), np.array([m[1] for m in means], np.float64).reshape(len(means), -1)
    c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, at = search.matrix(b.column("vector")), np.searchsorted(names, b.column("shard_id").to_numpy())
            least = np.full(len(names), 2.0)
            np.minimum.at(least, at, np.einsum("ij,ij->i", x, c[at]) / np.sqrt((x * x).sum(1)))
            some = np.nonzero(least < 2)[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int32)), pa.array(least[some])], names=["shard_id", "least"])

    least = dict(vectors.select("shard_id", "vector").mapInArrow(run, "shard_id int, least double").groupBy("shard_id").agg(F.min("least")).collect())
    radius = np.arccos(np.clip([least[n] for n in names.tolist()], -1, 1))

    def most(q: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(q @ c.T / np.sqrt((q * q).sum(1))[:, None], -1, 1)) - radius
        return (1 + np.cos(np.maximum(angle, 0))) / 2 + 1e-6  # scores are rounded

    return names, most


def mean_centroids(vectors: DataFrame, by: str = "shard_id") -> DataFrame:
    """(by, centroid array<double>): the mean vector of each group. Tasks add up their records first.

    A record delivered twice counts once: ids are told apart before, without their vectors where none is repeated."""
    one = vectors.select(by, "global_id", "vector").dropDuplicates(["global_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = search.matrix(b.column("vector"))
            names, at = np.unique(b.column(by).to_numpy(), return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, at, x)
            sums = pa.ListArray.from_arrays(np.arange(0, total.size + 1, x.shape[1], dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at).astype(np.int64)), sums], names=[by, "n", "total"])

    kind = dict(one.dtypes)[by]
    sums = one.select(by, "vector").mapInArrow(run, f"{by} {kind}, n bigint, total array<double>")
    means = sums.select(by, "n", F.posexplode("total").alias("i", "x")).groupBy(by, "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


#: Centroids that may come to the driver.
MOST_CENTROIDS = 100_000


def listed(centroids: DataFrame, by: str) -> list:
    rows = centroids.select(by, "centroid").orderBy(by).limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    return rows


def routes(queries: DataFrame, centroids: DataFrame, *, by: str = "shard_id", probes: int = 2) -> DataFrame:
    """(query_id, by, similarity, turn): the `probes` centroids most similar to each query. Centroids are few and checked to be; they go to the tasks as one array."""
    rows = listed(centroids, by)
    names, c = pa.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    length = np.sqrt((c * c).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows if len(c) else 0, step := max(1, search.CELLS // len(c))):
                part = b.slice(at, step)
                q = search.matrix(part.column("vector"))
                s = np.round(q @ c.T / (np.sqrt((q * q).sum(1))[:, None] * length), 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                turn = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(q))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), names.take(pa.array(order.ravel())), pa.array(s[row, order.ravel()]), pa.array(turn)], names=["query_id", by, "similarity", "turn"])

    kind = dict(centroids.dtypes)[by]
    names = names.cast({"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind])
    return queries.select("query_id", "vector").mapInArrow(run, f"query_id string, {by} {kind}, similarity double, turn int")


def routed(vectors: DataFrame, queries: DataFrame, *, probes: int = 2) -> DataFrame:
    """As search.top on the shards whose mean vectors are most similar to the query."""
    return restricted(vectors, queries, routes(queries, mean_centroids(vectors), probes=probes))


def specific(routes_: DataFrame, gap: float = 0.1) -> DataFrame:
    """(query_id, specific): whether the best centroid is at least `gap` ahead of the next; ambiguous queries go to all shards."""
    two = routes_.groupBy("query_id").agg(F.max(F.when(F.col("turn") == 1, F.col("similarity"))).alias("a"), F.max(F.when(F.col("turn") == 2, F.col("similarity"))).alias("b"))
    return two.select("query_id", F.coalesce(F.col("a") - F.col("b") >= gap, F.lit(True)).alias("specific"))


def kmeans_centroids(vectors: DataFrame, shards: int = 8, seed: int = 42, iterations: int = 10, sample: int = 20_000) -> np.ndarray:
    """[shards, components] centroids of the normalised vectors, fitted on at most `sample` records by a hash of the id."""
    n = vectors.count()
    share = 1.2 * (sample + 100) / max(1, n)
    hashed = F.xxhash64("global_id", F.lit(seed))
    part = vectors if share >= 1 else vectors.where(hashed < int(-(2**63) + share * 2**64))
    x = search.matrix(part.select("global_id", "vector").dropDuplicates(["global_id"]).orderBy(hashed, "global_id").limit(sample).toArrow()["vector"])
    if not len(x):
        return np.zeros((0, 1))
    x = x / np.sqrt((x * x).sum(1))[:, None]
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(shards, len(x)), replace=False)]
    for _ in range(iterations):
        home = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        total, n_own = np.zeros_like(c), np.bincount(home, minlength=len(c))
        np.add.at(total, home, x)
        c[n_own > 0] = total[n_own > 0] / n_own[n_own > 0][:, None]
    return c


def kmeans_shards(vectors: DataFrame, shards: int = 8, seed: int = 42, iterations: int = 10, centroids: np.ndarray | None = None) -> DataFrame:
    """vectors with shard_id replaced by the number of the nearest k-means centroid of the normalised vectors: one pass over all records.

    centroids: those fitted before, else they are fitted now."""
    c = kmeans_centroids(vectors, shards, seed, iterations) if centroids is None else centroids
    half = (c * c).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = search.matrix(b.column("vector"))
            cell = (x / np.sqrt((x * x).sum(1))[:, None] @ c.T - half).argmax(axis=1)
            rest = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cell.astype(np.int32))], names=[*names, "shard_id"])

    names = [n for n in vectors.columns if n != "shard_id"]
    schema = ", ".join([f"`{n}` {t}" for n, t in vectors.dtypes if n != "shard_id"] + ["shard_id int"])
    return vectors.select(*names).mapInArrow(run, schema)


class bypassing:  # noqa: N801
    """For search.per_shard(allow=): records that reach the floor, and those for which near(queries, extra, vectors) holds."""

    def __init__(self, floor: float, near: Callable) -> None:
        self.floor, self.near = floor, near

    def __call__(self, q: np.ndarray, extra: np.ndarray, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s >= self.floor) | self.near(q, extra, x)


def signs_apart(most: int) -> Callable:
    """near: the signature of the record differs from the query's hint in fewer than `most` bits; extra: 1 and -1 for the hint's bits, 0 without a hint."""

    def near(q: np.ndarray, extra: np.ndarray, x: np.ndarray) -> np.ndarray:
        hinted = np.abs(extra).sum(1) > 0
        # whole numbers, so floats are exact: components less twice the bits that differ
        alike = extra.astype(np.float32) @ np.where(x >= 0, np.float32(1), np.float32(-1)).T > x.shape[1] - 2 * most
        alike[~hinted] = False
        return alike

    return near


def beginning_near(size: int, least: float) -> Callable:
    """near: the first `size` components are alike by search's euclidean score."""
    return lambda q, extra, x: search.scores(q[:, :size], x[:, :size], "euclidean") >= least


def bypass(hits: DataFrame, floor: float, near: object) -> DataFrame:
    """Hits that reach the floor, and those for which the hint's predicate holds, marked as such."""
    return hits.withColumn("by_hint", F.col("score") < floor).where((F.col("score") >= floor) | F.coalesce(near, F.lit(False)))
