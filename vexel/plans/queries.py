"""Queries over the tables of a folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import catalog, collaborative, compare, documents, routing, search
from ..sources.collection import assign_shards, chunks, cluster_config, members, open_shard, read_vectors, records, requests, statistics, table
from ..sources.saved import saved, scratch
from ..streaming import live
from . import api

#: Ids above this one are the last elements of a shard's answer.
LAST_ID = 2**63 - 1 - 101
HIT = ("query_id", "global_id", "score", "rank")


def _rq(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return records(spark, d), requests(spark, d)


def knn_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    r, q = _rq(spark, d)
    return search.top(r, q.orderBy("query_id").limit(1), k=10).select(*HIT)


def knn_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(*_rq(spark, d)).select(*HIT)


def knn_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(*_rq(spark, d), metric="dot", k=10).select(*HIT)


def knn_euclidean_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(*_rq(spark, d), metric="euclidean", k=10).select(*HIT)


def global_id_encode(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "index_records").select("global_id", "shard_id", "local_doc").distinct()
    return r.select("global_id", fv.global_id(F.col("shard_id"), F.col("local_doc")).alias("encoded"), fv.shard_of(F.col("global_id")).alias("shard"), fv.local_of(F.col("global_id")).alias("local"))


def shard_assign_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return assign_shards(table(spark, d, "embeddings").select("vec_id"), "vec_id")


def knn_per_shard_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.per_shard(*_rq(spark, d)).select("shard_id", *HIT)


def knn_per_shard_k_merge(spark: SparkSession, d: str) -> DataFrame:
    r, q = _rq(spark, d)
    return api.vector_search(r, q, per_shard_k=3).select(*HIT)


def knn_hydrate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.hydrate(search.top(*_rq(spark, d)), chunks(spark, d)).select(*HIT, "chunk")


def knn_shard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return search.metrics(search.visits(*_rq(spark, d)))


def knn_max_peers(spark: SparkSession, d: str) -> DataFrame:
    return routing.shard_limited(*_rq(spark, d), members(spark, d), own_shard=0, most=3).select(*HIT)


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics(table(spark, d, "index_records"))


def vector_dimension(spark: SparkSession, d: str) -> DataFrame:
    size = F.size("vector")
    r = table(spark, d, "index_records").where(F.col("vector").isNotNull())
    return r.agg(F.coalesce(F.min(size), F.lit(-1)).alias("least"), F.coalesce(F.max(size), F.lit(-1)).alias("most"), F.coalesce(F.mode(size, True), F.lit(-1)).alias("dim"))


def signature_words(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).dropDuplicates(["global_id"])
    w = fv.signature_words(F.col("vector"))
    return r.select("global_id", w[0].alias("w0"), w[1].alias("w1"))


def _hints(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, hint, words, asked): distinct whole hints with the signature words of their query."""
    c = table(spark, d, "coordinate_request").where(F.octet_length("neighborhood_hint") == 8).select("query_id", F.col("neighborhood_hint").alias("hint")).distinct()
    q = requests(spark, d).select("query_id", fv.signature_words(F.col("vector")).alias("asked"))
    return c.withColumn("words", fv.words_of_bytes(F.col("hint"))).join(q, "query_id")


def signature_hamming(spark: SparkSession, d: str) -> DataFrame:
    h = _hints(spark, d)
    return h.select("query_id", F.hex("hint").alias("hint"), fv.hamming(F.col("words"), F.col("asked")).alias("distance"))


def signature_is_near(spark: SparkSession, d: str) -> DataFrame:
    near = fv.is_near(F.col("words"), F.col("asked"), 12)
    return _hints(spark, d).groupBy("query_id").agg(F.count_if(near).alias("n_near"), F.count("*").alias("n_hints"))


def _budgeted(spark: SparkSession, d: str) -> DataFrame:
    return search.budgeted(*_rq(spark, d), visits=20)


def knn_visit_budget(spark: SparkSession, d: str) -> DataFrame:
    return _budgeted(spark, d).select(*HIT)


def compare_jaccard(spark: SparkSession, d: str) -> DataFrame:
    out = compare.overlap(search.top(*_rq(spark, d)), _budgeted(spark, d))
    return out.select("query_id", F.round("jaccard", 6).alias("jaccard"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    out = compare.recall(_budgeted(spark, d), search.top(*_rq(spark, d)))
    return out.select("query_id", F.round("recall", 6).alias("recall"))


def compare_visit_reduction(spark: SparkSession, d: str) -> DataFrame:
    r, q = _rq(spark, d)
    few = search.nearest(r, q, visits=20).groupBy("query_id").agg(F.count("*").alias("budgeted"))
    both = search.metrics(search.visits(r, q)).select("query_id", F.col("total_visited").alias("standard")).join(few, "query_id")
    return both.withColumn("reduction", F.round(compare.visit_reduction(F.col("standard"), F.col("budgeted")), 6))


def knn_floor_two_stage(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.two_stage(*_rq(spark, d)).select(*HIT)


def knn_floor_barrier(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.barrier(*_rq(spark, d)).select(*HIT)


def knn_floor_best(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.two_stage(*_rq(spark, d), kind="best").select(*HIT)


def floor_relay_updates(spark: SparkSession, d: str) -> DataFrame:
    out = collaborative.relayed(table(spark, d, "coordinate_request"))
    return out.select("query_id", "received_at", "sent_at", "shard_id", F.col("floor").cast("double").alias("floor"))


def floor_final(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.final_floors(table(spark, d, "coordinate_request")).select("query_id", F.col("floor").cast("double").alias("floor"))


def hint_latest(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.latest_hints(table(spark, d, "coordinate_request")).select("query_id", F.hex("hint").alias("hint"))


def hint_best(spark: SparkSession, d: str) -> DataFrame:
    return collaborative.latest_hints(table(spark, d, "coordinate_request"), best=True).select("query_id", F.hex("hint").alias("hint"))


def discovery_members(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d)


def discovery_dedupe_replicas(spark: SparkSession, d: str) -> DataFrame:
    return catalog.one_replica(members(spark, d))


def discovery_collection_filter(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    name = m.where("collection <> ''").agg(F.min("collection")).first()[0]
    return catalog.in_collection(m, name)


def discovery_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return catalog.others(m, m.agg(F.min("member_id")).first()[0])


def resolve_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return catalog.endpoints(members(spark, d), " 9000 ")


def peers_in_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.in_order(members(spark, d), 5)


def parse_seeds(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).where(F.col("address").isNotNull())
    listed = m.groupBy("shard_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list("address"))).alias("listed"))
    return listed.select("shard_id", F.explode(ft.seeds(F.col("listed"))).alias("seed")).select("shard_id", "seed", ft.host(F.col("seed")).alias("host")).distinct()


def node_status(spark: SparkSession, d: str) -> DataFrame:
    role = F.coalesce(F.lower(F.trim(F.col("node_role"))), F.lit(""))
    return table(spark, d, "shard_metadata").groupBy(role.alias("node_role")).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("grpc_port") > 0).alias("n_up"))


def knn_distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    return documents.distinct_documents(*_rq(spark, d)).select("parent_id", *HIT)


def knn_satisfied_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return documents.satisfied_pruning(*_rq(spark, d)).select("parent_id", *HIT)


def knn_max_chunks_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunks_per_document(*_rq(spark, d), documents=5, most=2)


def knn_all_chunk_enrich(spark: SparkSession, d: str) -> DataFrame:
    return documents.enriched(*_rq(spark, d), chunks(spark, d), documents=3)


def doc_shard_map(spark: SparkSession, d: str) -> DataFrame:
    return documents.shard_map(records(spark, d))


def knn_two_phase(spark: SparkSession, d: str) -> DataFrame:
    return routing.two_phase(*_rq(spark, d)).select(*HIT, "phase")


def knn_adaptive_budget(spark: SparkSession, d: str) -> DataFrame:
    return routing.adaptive(*_rq(spark, d), isolated=2, near=0.95).select(*HIT)


def knn_early_stop(spark: SparkSession, d: str) -> DataFrame:
    return routing.early_stop(*_rq(spark, d)).select(*HIT)


def knn_routed_centroid(spark: SparkSession, d: str) -> DataFrame:
    return routing.routed(*_rq(spark, d)).select(*HIT)


def route_specificity(spark: SparkSession, d: str) -> DataFrame:
    r, q = _rq(spark, d)
    return routing.specific(routing.routes(q, routing.mean_centroids(r)), 0.01)


def hint_centroid_bypass(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each shard that reach the floor, or are in the shard whose centroid the hint names: all of a shard are hinted or none."""
    r, q = _rq(spark, d)
    best = routing.routes(q, routing.mean_centroids(r), probes=1).select("query_id", F.col("shard_id").alias("hint"))
    out = routing.bypass(search.per_shard(r, q, k=5).join(best, "query_id"), 0.9, F.col("shard_id") == F.col("hint"))
    return out.select("query_id", "global_id", "shard_id", "score", "by_hint")


def _hinted(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "global_id", "shard_id", "score", (F.col("score") < 0.9).alias("by_hint"))


def hint_signature_bypass(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each shard among the records that reach the floor or whose signature is near the query's last hint."""
    r, q = _rq(spark, d)
    hint = collaborative.latest_hints(table(spark, d, "coordinate_request")).select("query_id", fv.signs_of_bytes(F.col("hint"), 64).alias("extra"))
    none = F.array_repeat(F.lit(0.0), 64)
    asked = q.join(hint, "query_id", "left").withColumn("extra", F.coalesce("extra", none).cast("array<float>"))
    return _hinted(search.per_shard(r, asked, k=5, allow=routing.bypassing(0.9, routing.signs_apart(20))))


def hint_sketch16(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each shard among the records that reach the floor or whose first 16 components are near the query's."""
    return _hinted(search.per_shard(*_rq(spark, d), k=5, allow=routing.bypassing(0.9, routing.beginning_near(16, 0.8))))


def knn_ivf_kmeans(spark: SparkSession, d: str) -> DataFrame:
    r, q = _rq(spark, d)
    return routing.routed(saved(routing.kmeans_shards(r)), q, probes=2).select(*HIT)


def response_hits(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_response").where((F.col("global_id") <= LAST_ID) & F.col("query_id").isNotNull() & fv.is_finite(F.col("score")))
    return r.select("query_id", "global_id", F.col("score").cast("double").alias("score")).distinct()


def response_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of each query and shard the latest last element counts, delivered twice or not."""
    r = table(spark, d, "search_response").where((F.col("global_id") > LAST_ID) & F.col("query_id").isNotNull())
    one = r.groupBy("query_id", "global_id").agg(F.max("nodes_visited").alias("visited"), F.max("search_time_ms").alias("ms"))
    return one.groupBy("query_id").agg(F.sum("visited").alias("total_visited"), F.count("*").alias("shards_finished"), F.max("ms").alias("search_time_ms"))


def response_merge(spark: SparkSession, d: str) -> DataFrame:
    return search.merge(response_hits(spark, d).withColumn("k", F.lit(10))).select(*HIT)


def response_running_best(spark: SparkSession, d: str) -> DataFrame:
    """How often a query's best score rose while its hits came in, and the last value."""
    r = table(spark, d, "search_response").where((F.col("global_id") <= LAST_ID) & F.col("query_id").isNotNull() & fv.is_finite(F.col("score")))
    # In order of arrival, the best first of those that arrive at once: one row for each moment, so that ties do not matter.
    moments = r.groupBy("query_id", "received_at").agg(F.max("score").alias("score"))
    before = F.max("score").over(Window.partitionBy("query_id").orderBy("received_at").rowsBetween(Window.unboundedPreceding, -1))
    rose = moments.withColumn("before", before).where(F.col("before").isNull() | (F.col("score") > F.col("before")))
    return rose.groupBy("query_id").agg(F.count("*").alias("n_rises"), F.max("score").cast("double").alias("floor"))


def json_hits(spark: SparkSession, d: str) -> DataFrame:
    return knn_batch_topk(spark, d).select(F.to_json(F.struct("query_id", "global_id", "rank")).alias("body"))


def text_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ft.prefixed(F.col("subject")).alias("prefixed"))


def parse_embeddings_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.to_json(F.array("embedding")).alias("body"))
    parsed = e.select("vec_id", ft.embeddings(F.col("body")).alias("v"))
    return parsed.select("vec_id", F.size("v").alias("n"), F.size(F.col("v")[0]).alias("dim"), F.round(fv.norm(F.col("v")[0]), 5).alias("norm"))


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).dropDuplicates(["global_id"])
    n = fv.l2_normalize(F.col("vector"))
    return r.select("global_id", F.round(n[0], 6).alias("first"), F.round(n[63], 6).alias("last"), F.round(fv.norm(F.col("vector")), 5).alias("norm"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of documents as questions, records as they are embedded by the same stand-in for a model."""
    asked = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "text")
    rows = api.embedded(table(spark, d, "documents").select("doc_id", "subject"), "subject", api.hashing_embedder())
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    vectors = assign_shards(rows.withColumnRenamed("doc_id", "vec_id"), "vec_id").withColumn("parent_id", F.col("vec_id"))
    return api.text_search(vectors, asked, k=5, prefix="", collaborative=False).select(*HIT)


def stream_query_topk(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "answers")
    write = live.table_sink(out)
    q = live.answer(live.source(spark, d, "search_request"), records(spark, d), lambda df, n: write(df.select(*HIT), n), scratch(spark, "state"), deadline=600)
    q.awaitTermination()
    # A request that is delivered again in a later batch has the same answer.
    return live.answers(spark, out, "query_id string, global_id bigint, score double, rank int").distinct()


def stream_floor_max(spark: SparkSession, d: str) -> DataFrame:
    df = live.floor_maximum(live.source(spark, d, "coordinate_request"))
    out = live.run_to_table(df, scratch(spark, "floors"), scratch(spark, "state"), "complete")
    return out.select("query_id", F.col("floor").cast("double").alias("floor"))


def stream_floor_state(spark: SparkSession, d: str) -> DataFrame:
    df = live.floor_state(live.source(spark, d, "coordinate_request"))
    out = live.run_to_table(df, scratch(spark, "states"), scratch(spark, "state"), "update")
    return out.groupBy("query_id").agg(F.max("floor").alias("floor"))


def stream_coordinate(spark: SparkSession, d: str) -> DataFrame:
    """The highest floor that each query was answered with, and whether its answers carried a hint."""
    df = live.coordinate_answers(live.source(spark, d, "coordinate_request"))
    out = live.run_to_table(df, scratch(spark, "coordinate"), scratch(spark, "state"), "update")
    return out.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max(F.col("hint").isNotNull()).alias("hinted"))


def compare_modes(spark: SparkSession, d: str) -> DataFrame:
    """The exact search against one of 20 records in every shard, with the k of a comparison where a request names none."""
    t = table(spark, d, "search_request").where(F.col("query_id").isNotNull() & fv.is_valid(F.col("vector"), 64))
    asked = t.groupBy("query_id").agg(F.first("vector").alias("vector"), F.max("k").alias("k"))
    out = api.compared(records(spark, d), asked, "exact", "budgeted", visits=20)
    return out.select("query_id", F.round("jaccard", 6).alias("jaccard"), F.round("recall", 6).alias("recall"), "visited", "visited_other", F.round("reduction", 6).alias("reduction"))


def compare_collaborative(spark: SparkSession, d: str) -> DataFrame:
    """The exact search against that with floors, which loses nothing."""
    out = api.compared(*_rq(spark, d), "exact", "collaborative")
    return out.select("query_id", F.round("jaccard", 6).alias("jaccard"), F.round("recall", 6).alias("recall"))


def search_measured(spark: SparkSession, d: str) -> DataFrame:
    """What a search with a budget scored and how many shards answered; its wall time is there, though not the same in each run."""
    m = api.measured(*_rq(spark, d), "budgeted", visits=20)[1]
    return m.select("query_id", "total_visited", "shards_finished", (F.col("elapsed_ms") > 0).alias("timed"))


def shard_build_open(spark: SparkSession, d: str) -> DataFrame:
    """A collection of the embeddings, built in folders by shard from files, and one shard of it read back."""
    files, built = scratch(spark, "vectors"), scratch(spark, "collection")
    table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector")).write.parquet(files)
    api.build_collection(read_vectors(spark, files), built, shards=8)
    return open_shard(spark, built, 3).select("vec_id", "shard_id", "local_doc", "global_id", F.round(fv.norm(F.col("vector")), 5).alias("norm"))


def cluster_config_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a cluster's JSON file, written from the catalogue."""
    at = scratch(spark, "cluster")
    node = F.struct(F.col("node_host").alias("host"), "ip", F.col("shard_id").alias("shard"), F.col("node_role").alias("role"), "mem")
    nodes = table(spark, d, "shard_metadata").agg(F.collect_list(node).alias("nodes")).withColumn("seed_ip", F.lit("10.0.0.1"))
    nodes.coalesce(1).write.json(at)
    return cluster_config(spark, at)


def flag_values(spark: SparkSession, d: str) -> DataFrame:
    """Requests by the flag that their text of "collaborative" stands for: everything but false is true."""
    r = table(spark, d, "search_request").select(ft.flag(F.col("collaborative").cast("string")).alias("flag"))
    return r.groupBy("flag").agg(F.count("*").alias("n"))


def request_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The k of each request as a text search and as a comparison take it."""
    t = table(spark, d, "search_request").where(F.col("query_id").isNotNull()).select("query_id", "k")
    out = api.defaults(t.withColumn("asked", F.col("k")), 10).withColumnRenamed("k", "k_text").withColumnRenamed("asked", "k")
    return api.defaults(out, 100).groupBy("query_id").agg(F.max("k_text").alias("k_text"), F.max("k").alias("k_compare"))


def query_ids_made(spark: SparkSession, d: str) -> DataFrame:
    """Random ids for requests without one: how many rows, distinct ids, and ids of the right form there are."""
    made = saved(api.numbered(table(spark, d, "search_request").select(F.lit(None).cast("string").alias("query_id"))))
    form = F.col("query_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return made.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_ids"), F.count_if(form).alias("n_good"))


def metadata_equal(spark: SparkSession, d: str) -> DataFrame:
    return catalog.same_members(members(spark, d))


def embedding_checked(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an embedding service, every seventh of them without a vector: whether they have one, and the length of the first."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, "[]").otherwise(F.to_json(F.array("embedding"))).alias("body"))
    v = e.select("vec_id", ft.embeddings(F.col("body")).alias("v"))
    return v.select("vec_id", ft.has_embedding(F.col("v")).alias("ok"), F.when(ft.has_embedding(F.col("v")), F.size(ft.first_embedding(F.col("v")))).alias("dim"))


def windowed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits by ten minutes of event time, as the streaming aggregate counts them over the stored table."""
    r = table(spark, d, "search_response").where((F.col("global_id") <= LAST_ID) & F.col("query_id").isNotNull())
    out = live.windowed_hits(r)
    return out.select("begin", "query_id", "n_hits", F.col("best").cast("double").alias("best"))


NAMES = """
knn_exact_topk knn_batch_topk knn_dot_topk knn_euclidean_topk global_id_encode shard_assign_round_robin knn_per_shard_topk
knn_per_shard_k_merge knn_hydrate_chunks knn_shard_metrics knn_max_peers index_stats vector_dimension signature_words
signature_hamming signature_is_near knn_visit_budget compare_jaccard recall_at_k compare_visit_reduction knn_floor_two_stage
knn_floor_barrier knn_floor_best floor_relay_updates floor_final hint_latest hint_best discovery_members
discovery_dedupe_replicas discovery_collection_filter discovery_exclude_self resolve_endpoint peers_in_order parse_seeds
node_status knn_distinct_docs knn_satisfied_antijoin knn_max_chunks_per_doc knn_all_chunk_enrich doc_shard_map knn_two_phase
knn_adaptive_budget knn_early_stop knn_routed_centroid route_specificity hint_centroid_bypass hint_signature_bypass
hint_sketch16 knn_ivf_kmeans response_hits response_metrics response_merge response_running_best json_hits text_prefix
parse_embeddings_json normalized_vectors text_search stream_query_topk stream_floor_max stream_floor_state stream_coordinate
compare_modes compare_collaborative search_measured shard_build_open cluster_config_nodes flag_values request_defaults query_ids_made
metadata_equal embedding_checked windowed_hits
""".split()
QUERIES = {name: globals()[name] for name in NAMES}
