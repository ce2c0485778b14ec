"""Entry points: search by vectors or texts, comparison of two modes, building a collection."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import collaborative, compare, documents, routing, search
from ..sources import collection
from ..sources.saved import saved

MODES: dict[str, Callable[..., DataFrame]] = {
    "exact": search.top,
    "budgeted": search.budgeted,
    "collaborative": collaborative.two_stage,
    "barrier": collaborative.barrier,
    "two_phase": routing.two_phase,
    "adaptive": routing.adaptive,
    "routed": routing.routed,
    "documents": documents.distinct_documents,
}


def vector_search(vectors: DataFrame, queries: DataFrame, *, k: int | None = None, collaborative: bool = True, mode: str | None = None, shards: list[int] | None = None, per_shard_k: int = -1, chunks: DataFrame | None = None, **options: object) -> DataFrame:
    """The k best records of each query. queries(query_id, vector [, k]); k given here holds for all.

    mode: a name of MODES; by default "collaborative" or "exact". shards: search only these. per_shard_k > 0 limits what a
    shard may give (exact mode). chunks: adds the texts of the hits. ValueError for k < 1 or an unknown mode."""
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.withColumn("k", F.lit(k)) if k is not None else queries
    rows = vectors.where(F.col("shard_id").isin(shards)) if shards is not None else vectors
    name = mode or ("collaborative" if collaborative else "exact")
    if name not in MODES:
        raise ValueError(f"unknown mode {name}")
    if per_shard_k > 0:
        hits = search.ranked(search.per_shard(rows, asked, k=per_shard_k).drop("rank"), "query_id").where(F.col("rank") <= F.col("k"))
    else:
        hits = MODES[name](rows, asked, **options)
    return search.hydrate(hits, chunks) if chunks is not None else hits


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashed words, of length 1 unless there are none."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[row, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(texts: DataFrame, column: str, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Adds vector array<float>: the embedder applied to batches of texts; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = [t for t in s if t is not None and t == t]
            made = iter(embedder(some) if some else ())
            out = pd.Series([None if t is None or t != t else next(made) for t in s], index=s.index, dtype=object)
            yield out

    return texts.withColumn("vector", run(F.col(column)))


def rest_embedder(url: str, post: Callable[[str, list[str]], str]) -> Callable[[list[str]], np.ndarray]:
    """An embedder behind a service that takes a list of texts and answers with a JSON list of vectors, one for each text.

    post(url, texts) does the request and returns the body. ValueError for an answer without a vector for each text."""

    def embed(texts: list[str]) -> np.ndarray:
        made = json.loads(post(url, texts))
        if len(made) < len(texts) or not all(made):
            raise ValueError("no embedding")
        return np.array(made[: len(texts)], np.float32)

    return embed


def defaults(queries: DataFrame, default_k: int) -> DataFrame:
    """queries with k null or < 1 replaced."""
    return queries.withColumn("k", F.when(F.col("k") >= 1, F.col("k")).otherwise(default_k).cast("int"))


def numbered(queries: DataFrame) -> DataFrame:
    """queries with a random query_id where it is null or blank. Written before it is used twice, or ids will differ."""
    return queries.withColumn("query_id", F.when(F.trim("query_id") != "", F.col("query_id")).otherwise(F.uuid()))


def text_search(vectors: DataFrame, texts: DataFrame, *, k: int = 10, prefix: str = "query: ", embedder: Callable[[list[str]], np.ndarray] | None = None, **options: object) -> DataFrame:
    """texts(query_id, text): prefix and embed each text, then search; texts that are null or without any word have no hits."""
    queries = embedded(texts.withColumn("prefixed", ft.prefixed(F.col("text"), prefix)), "prefixed", embedder or hashing_embedder())
    asked = queries.where(F.exists("vector", lambda x: x != 0)).select("query_id", "vector", F.lit(k if k >= 1 else 10).alias("k"))
    return vector_search(vectors, asked, **options)


def visited(vectors: DataFrame, queries: DataFrame, mode: str, **options: object) -> DataFrame:
    """(query_id, visited): how many records a search of this mode scores for each query."""
    if mode == "budgeted":
        # Of each shard the nearest `visits`, or all if it has fewer: so many are scored, whichever they are.
        return search.visits(vectors, queries).groupBy("query_id").agg(F.sum(F.least("visited", F.lit(options["visits"]))).alias("visited"))
    if mode == "routed":
        near = routing.routes(queries, routing.mean_centroids(vectors), **options).select("query_id", "shard_id")
        return search.visits(vectors, queries).join(near, ["query_id", "shard_id"], "left_semi").groupBy("query_id").agg(F.sum("visited").alias("visited"))
    return search.metrics(search.visits(vectors, queries)).select("query_id", F.col("total_visited").alias("visited"))


def measured(vectors: DataFrame, queries: DataFrame, mode: str = "exact", **options: object) -> tuple[DataFrame, DataFrame]:
    """(hits, metrics): the hits of a search, done and saved, and (query_id, total_visited, shards_finished, elapsed_ms).

    elapsed_ms is the wall time of the whole batch of queries, without embedding. Shards without a record are not finished ones."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    began = time.monotonic()
    hits = saved(MODES[mode](vectors, queries, **options))
    took = int((time.monotonic() - began) * 1000)
    shards = search.metrics(search.visits(vectors, queries)).select("query_id", "shards_finished")
    return hits, visited(vectors, queries, mode, **options).withColumnRenamed("visited", "total_visited").join(shards, "query_id").withColumn("elapsed_ms", F.lit(took).cast("bigint"))


def compared(vectors: DataFrame, queries: DataFrame, one: str = "exact", two: str = "collaborative", *, default_k: int = 100, **options: object) -> DataFrame:
    """(query_id, jaccard, recall, visited, visited_other, reduction) of mode `two`, with options, against mode `one`, for every query.

    k null or < 1 counts as default_k. Queries without hits in both are alike: jaccard and recall 1."""
    asked = defaults(queries, default_k)
    a, b = MODES[one](vectors, asked), MODES[two](vectors, asked, **options)
    both = compare.overlap(a, b).join(compare.recall(b, a), "query_id", "full")
    work = visited(vectors, asked, one).join(visited(vectors, asked, two, **options).withColumnRenamed("visited", "visited_other"), "query_id", "full")
    none = lambda name: F.coalesce(name, F.lit(0).cast("bigint"))
    out = asked.select("query_id").join(both, "query_id", "left").join(work, "query_id", "left")
    return out.select("query_id", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.coalesce("recall", F.lit(1.0)).alias("recall"), none("visited").alias("visited"), none("visited_other").alias("visited_other"), compare.visit_reduction(none("visited"), none("visited_other")).alias("reduction"))


def build_collection(vectors: DataFrame, path: str, *, shards: int = 8, chunks: DataFrame | None = None, policy: str = "round_robin") -> None:
    """vectors(vec_id, vector) and optionally chunks(vec_id, chunk), written as one folder for each shard. policy "kmeans" puts near vectors together."""
    rows = vectors.join(chunks, "vec_id", "left") if chunks is not None else vectors.withColumn("chunk", F.lit(None).cast("string"))
    if policy == "kmeans":
        placed = routing.kmeans_shards(rows.withColumn("global_id", F.col("vec_id")), shards)
        fits = (F.col("vec_id") >= 0) & (F.col("vec_id") < 2**31)
        local = F.when(fits, F.col("vec_id").cast("int")).otherwise(F.raise_error(F.lit("local number out of range")).cast("int"))
        placed = placed.withColumn("local_doc", local).withColumn("global_id", fv.global_id(F.col("shard_id"), F.col("local_doc")))
    else:
        placed = collection.assign_shards(rows, "vec_id", shards, policy)
    collection.write_collection(placed, path)
