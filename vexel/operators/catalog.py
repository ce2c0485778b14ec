"""Queries over the members of a cluster: filters, one replica for each shard, endpoints, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def in_collection(members: DataFrame, name: str | None) -> DataFrame:
    """All members for a null or blank name, else those of exactly this collection."""
    wanted = (name or "").strip()
    return members if not wanted else members.where(F.col("collection") == wanted)


def others(members: DataFrame, own: str) -> DataFrame:
    """All but the member itself; members without an id stay."""
    return members.where(F.coalesce(F.col("member_id") != own, F.lit(True)))


def one_replica(members: DataFrame) -> DataFrame:
    """The member with the lowest replica for each collection and shard; ties go to the smaller member_id, then address."""
    w = Window.partitionBy("collection", "shard_id").orderBy("replica_id", F.asc_nulls_last("member_id"), F.asc_nulls_last("address"))
    return members.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def endpoints(members: DataFrame, fallback: str | None) -> DataFrame:
    """Adds endpoint_host and endpoint_port: the address's host; the advertised port if positive, else the fallback, else null."""
    return members.withColumn("endpoint_host", text.host(F.col("address"))).withColumn("endpoint_port", text.port(F.col("grpc_port"), fallback))


def in_order(members: DataFrame, most: int = -1) -> DataFrame:
    """The first `most` members in order of host and port as text (all if negative), with position."""
    at = F.concat(F.coalesce("host", F.lit("")), F.col("grpc_port").cast("string"))
    # A cluster's members are few; the window is over all of them.
    out = members.withColumn("position", F.row_number().over(Window.orderBy(at, F.asc_nulls_last("member_id"), "shard_id", "replica_id")))
    return out if most < 0 else out.where(F.col("position") <= most)


def same_members(members: DataFrame) -> DataFrame:
    """(host, grpc_port, shard_id, replica_id, n): members that are equal in all four, nulls being equal to each other, and how many there are."""
    return members.groupBy("host", "grpc_port", "shard_id", "replica_id").agg(F.count("*").alias("n"))
