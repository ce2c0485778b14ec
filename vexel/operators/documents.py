"""Search for documents, of which records are chunks: distinct documents, some chunks of each, all chunks of the winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..sources.saved import saved
from . import search


def distinct_documents(vectors: DataFrame, queries: DataFrame, *, k: int | None = None) -> DataFrame:
    """The best chunk of each of the k best documents of every query: columns as search.top."""
    hits = search.ranked(search.candidates(vectors, queries, by="parent_id", k=k), "query_id", "parent_id").where(F.col("rank") == 1)
    return search.ranked(hits.drop("rank"), "query_id").where(F.col("rank") <= (F.col("k") if k is None else F.lit(k)))


def satisfied_pruning(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """As distinct_documents, in two rounds: records of odd shards take no part in the second one if their document has
    already won with a score as good, nor if they are under the first round's k-th score."""
    first = saved(distinct_documents(vectors.where(F.col("shard_id") % 2 == 0), queries))
    floor = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("score"))).alias("floor"))
    second = search.candidates(vectors.where(F.col("shard_id") % 2 != 0), queries.join(floor, "query_id", "left"), by="parent_id")
    won = first.select("query_id", "parent_id", F.col("score").alias("won"), F.col("global_id").alias("won_id"))
    same = ["query_id", "parent_id"]
    beaten = (F.col("won") > F.col("score")) | ((F.col("won") == F.col("score")) & (F.col("won_id") <= F.col("global_id")))
    rest = second.join(won, same, "left").where(F.col("won").isNull() | ~beaten).drop("won", "won_id")
    every = search.ranked(first.drop("rank").unionByName(rest), "query_id", "parent_id").where(F.col("rank") == 1).drop("rank")
    return search.ranked(every, "query_id").where(F.col("rank") <= F.col("k"))


def winners_chunks(vectors: DataFrame, queries: DataFrame, *, documents: int) -> DataFrame:
    """(query_id, parent_id, doc_rank, global_id, score): every chunk of the best `documents` documents of every query."""
    docs = distinct_documents(vectors, queries, k=documents).select("query_id", "parent_id", F.col("rank").alias("doc_rank"))
    one = vectors.select("parent_id", "global_id", "vector").dropDuplicates(["global_id"])
    pairs = docs.join(one, "parent_id").join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
    return pairs.select("query_id", "parent_id", "doc_rank", "global_id", fv.cosine_score(F.col("asked"), F.col("vector")).alias("score"))


def chunks_per_document(vectors: DataFrame, queries: DataFrame, *, documents: int = 10, most: int = 2) -> DataFrame:
    """winners_chunks with chunk_rank: at most the `most` best chunks of each document."""
    by = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("score"), "global_id")
    return winners_chunks(vectors, queries, documents=documents).withColumn("chunk_rank", F.row_number().over(by)).where(F.col("chunk_rank") <= most)


def enriched(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, *, documents: int = 5) -> DataFrame:
    """(query_id, parent_id, doc_rank, global_id, score, chunk): the winning documents with the texts of all their chunks."""
    return search.hydrate(winners_chunks(vectors, queries, documents=documents), chunks)


def shard_map(vectors: DataFrame) -> DataFrame:
    """(parent_id, shards, n_shards): the sorted shards that hold chunks of each document, as text."""
    found = vectors.groupBy("parent_id").agg(F.array_sort(F.collect_set("shard_id")).alias("s"))
    return found.select("parent_id", F.concat_ws(",", F.transform("s", lambda x: x.cast("string"))).alias("shards"), F.size("s").cast("bigint").alias("n_shards"))
