"""Collections of vectors with texts, requests, and the catalogue of shards, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors

#: Components of the vectors in the tables.
DIM = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, dim: int = DIM) -> DataFrame:
    """(global_id, shard_id, local_doc, parent_id, vector): rows with a valid vector, repeated deliveries included.

    Texts stay behind: they are joined to the few hits. A null parent makes a record a document of its own (a negative id)."""
    rows = table(spark, folder, "index_records").where(F.col("global_id").isNotNull() & vectors.is_valid(F.col("vector"), dim))
    parent = F.coalesce("parent_id", -1 - F.col("global_id"))
    return rows.select("global_id", "shard_id", "local_doc", parent.alias("parent_id"), "vector")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(global_id, chunk): one row for each id, a missing text as an empty one."""
    rows = table(spark, folder, "index_records").where(F.col("global_id").isNotNull())
    return rows.groupBy("global_id").agg(F.coalesce(F.max("chunk"), F.lit("")).alias("chunk"))


def requests(spark: SparkSession, folder: str, default_k: int = 10, dim: int = DIM) -> DataFrame:
    """(query_id, vector, k): one row for each query_id with a valid vector; k null or < 1 counts as default_k."""
    rows = table(spark, folder, "search_request").where(F.col("query_id").isNotNull() & vectors.is_valid(F.col("vector"), dim))
    k = F.when(F.col("k") >= 1, F.col("k")).otherwise(default_k)
    return rows.groupBy("query_id").agg(F.first("vector").alias("vector"), F.max(k).alias("k"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """(member_id, host, address, shard_id, replica_id, collection, grpc_port): missing numbers are 0 or -1, replicas are never negative."""
    m = table(spark, folder, "shard_metadata")
    return m.select(
        F.col("node_id").alias("member_id"),
        F.col("node_host").alias("host"),
        F.col("ip").alias("address"),
        F.coalesce("shard_id", F.lit(0)).alias("shard_id"),
        F.greatest(F.coalesce("replica_id", F.lit(0)), F.lit(0)).alias("replica_id"),
        text.collection(F.col("collection_name")).alias("collection"),
        F.coalesce("grpc_port", F.lit(-1)).alias("grpc_port"),
    )


def cluster_config(spark: SparkSession, path: str) -> DataFrame:
    """(host, ip, shard, role, mem, seed_ip, seed_port) of a cluster's JSON file: one row for each node."""
    schema = "nodes array<struct<host:string,ip:string,shard:int,role:string,mem:string>>, seed_ip string, seed_port int"
    conf = spark.read.schema(schema).json(path, multiLine=True)
    return conf.select(F.explode("nodes").alias("n"), "seed_ip", F.coalesce("seed_port", F.lit(4900)).alias("seed_port")).select("n.*", "seed_ip", "seed_port")


def assign_shards(rows: DataFrame, id_column: str, shards: int = 8, policy: str = "round_robin") -> DataFrame:
    """Adds shard_id, local_doc and global_id. Ids are dense numbers from 0.

    round_robin: shard = id % shards, local = id div shards. hash: shard by a hash of the id, local as for round robin, which
    stays unique within a shard only together with the shard's own numbers, so the id itself is the local number then."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    i = F.col(id_column)
    if policy == "round_robin":
        shard, local = F.pmod(i, F.lit(shards)), F.floor(i / shards)
    elif policy == "hash":
        shard, local = F.pmod(F.xxhash64(i), F.lit(shards)), i
    else:
        raise ValueError(f"unknown policy {policy}")
    # Local numbers have 32 bits of an id: more are an error, not another record's number.
    fits = F.when((local >= 0) & (local < 2**31), local.cast("int")).otherwise(F.raise_error(F.lit("local number out of range")).cast("int"))
    out = rows.withColumn("shard_id", shard.cast("int")).withColumn("local_doc", fits)
    return out.withColumn("global_id", vectors.global_id(F.col("shard_id"), F.col("local_doc")))


def write_collection(rows: DataFrame, path: str, by: str = "shard_id") -> None:
    """One folder for each shard: a later read of some shards touches only theirs."""
    rows.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_vectors(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(vec_id bigint, vector array<float>) of a file or folder: parquet or JSON lines with these columns, or text of one JSON list a line.

    Lines of text are numbered in order of file and line from 0."""
    if kind in ("parquet", "json"):
        rows = spark.read.parquet(path) if kind == "parquet" else spark.read.schema("vec_id bigint, vector array<float>").json(path)
        return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector"))
    if kind != "text":
        raise ValueError(f"unknown kind {kind}")
    lines = spark.read.text(path).select(F.from_json("value", "array<float>").alias("vector"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # Lines are counted by partition and numbered from the sums before it, so no task sees them all.
    placed = lines.withColumn("partition", F.shiftright("at", 33))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("partition").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(sums, "partition").select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("vec_id"), "vector")


def open_shard(spark: SparkSession, path: str, shard: int, by: str = "shard_id") -> DataFrame:
    return spark.read.parquet(path).where(F.col(by) == shard)


def statistics(rows: DataFrame) -> DataFrame:
    """(shard_id, n_rows, n_docs, n_vectors, n_texts, dim): dim is the smallest length of a vector, -1 without any."""
    return rows.groupBy("shard_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("global_id").alias("n_docs"),
        F.count("vector").alias("n_vectors"),
        F.count("chunk").alias("n_texts"),
        F.coalesce(F.min(F.size("vector")), F.lit(-1)).alias("dim"),
    )
