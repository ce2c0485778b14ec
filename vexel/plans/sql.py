"""The queries of queries.py as SQL for DuckDB over the same tables, as an independent statement of their results."""

from __future__ import annotations

VALID = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
BASE = f"""
WITH recs AS (SELECT global_id, any_value(shard_id) AS shard_id, any_value(coalesce(parent_id, -1 - global_id)) AS parent_id, any_value(vector::DOUBLE[]) AS v
              FROM index_records WHERE global_id IS NOT NULL AND {VALID} GROUP BY 1),
reqs AS (SELECT query_id, any_value(vector::DOUBLE[]) AS q, max(CASE WHEN k >= 1 THEN k ELSE 10 END) AS k
         FROM search_request WHERE query_id IS NOT NULL AND {VALID} GROUP BY 1),
scored AS (SELECT query_id, k, global_id, shard_id, parent_id, round((1 + list_cosine_similarity(q, v)) / 2, 6) AS score FROM reqs, recs)
"""
TOP = BASE + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id)::INT AS rank FROM scored QUALIFY rank <= k)
"""
SHARDED = BASE + """, sharded AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, global_id)::INT AS shard_rank FROM scored)
"""
HIT = "query_id, global_id, score, rank"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id)::INT AS rank"
SIGN = "len(list_filter(range(1, 65), lambda i: ({a}[i] >= 0) <> ({b}[i] >= 0)))"
BUDGET = BASE + f""", near AS (SELECT query_id, k, global_id, shard_id, {SIGN.format(a="q", b="v")} AS distance, round((1 + list_cosine_similarity(q, v)) / 2, 6) AS score FROM reqs, recs
    QUALIFY row_number() OVER (PARTITION BY query_id, shard_id ORDER BY distance, global_id) <= 20),
few AS (SELECT *, {RANK} FROM near QUALIFY rank <= k),
top AS (SELECT *, {RANK} FROM scored QUALIFY rank <= k)
"""
MEMBERS = """
WITH members AS (SELECT node_id AS member_id, node_host AS host, ip AS address, coalesce(shard_id, 0) AS shard_id, greatest(coalesce(replica_id, 0), 0) AS replica_id,
                 coalesce(trim(collection_name), '') AS collection, coalesce(grpc_port, -1) AS grpc_port FROM shard_metadata)
"""
FINITE = "query_id IS NOT NULL AND isfinite(min_score)"
DOCS = BASE + """, docs AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, global_id) = 1)
"""
CENTROIDS = SHARDED + """, means AS (SELECT shard_id, list(x ORDER BY i) AS centroid FROM (
    SELECT shard_id, i, avg(x) AS x FROM (SELECT shard_id, unnest(v) AS x, unnest(range(64)) AS i FROM recs) GROUP BY ALL) GROUP BY 1),
routes AS (SELECT query_id, shard_id, round(list_cosine_similarity(q, centroid), 6) AS similarity,
           row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, shard_id) AS turn FROM reqs, means)
"""
NEAR5 = ", near5 AS (SELECT * FROM sharded WHERE shard_rank <= 5)"
HITS = "query_id IS NOT NULL AND isfinite(score) AND global_id <= 9223372036854775706"

_exact = TOP + f"SELECT {HIT} FROM top"
_distinct = DOCS + f"SELECT parent_id, query_id, global_id, score, {RANK} FROM docs QUALIFY rank <= k"
_words = "(list_sum(list_transform(range({a}, {b}), lambda i: CASE WHEN v[i + 1] >= 0 THEN (1::BIGINT << (i - {a})) ELSE 0 END)))::BIGINT"
_hints = BASE + f""", hints AS (SELECT DISTINCT query_id, hex(neighborhood_hint) AS hint FROM coordinate_request WHERE octet_length(neighborhood_hint) = 8),
far AS (SELECT query_id, hint, len(list_filter(range(0, 64), lambda i:
    ((('0x' || substr(hint, ((i // 8) * 2 + 1)::INT, 2))::INT >> (i % 8)::INT) & 1 = 1) <> (q[i + 1] >= 0)))::INT AS distance FROM hints JOIN reqs USING (query_id))
"""


def _metric(score: str) -> str:
    return BASE.replace("round((1 + list_cosine_similarity(q, v)) / 2, 6)", score) + f", top AS (SELECT *, {RANK} FROM scored QUALIFY rank <= 10) SELECT {HIT} FROM top"


SQL: dict[str, str] = {
    "knn_exact_topk": TOP + f"SELECT query_id, global_id, score, {RANK} FROM scored WHERE query_id = (SELECT min(query_id) FROM reqs) QUALIFY rank <= 10",
    "knn_batch_topk": _exact,
    "knn_dot_topk": _metric("round((1 + list_inner_product(q, v)) / 2, 6)"),
    "knn_euclidean_topk": _metric("round(1 / (1 + pow(list_distance(q, v), 2)), 6)"),
    "global_id_encode": "SELECT DISTINCT global_id, (shard_id::BIGINT << 32) | local_doc::BIGINT AS encoded, (global_id >> 32)::INT AS shard, (global_id & 4294967295)::INT AS local FROM index_records",
    "shard_assign_round_robin": "SELECT vec_id, (vec_id % 8)::INT AS shard_id, (vec_id // 8)::INT AS local_doc, ((vec_id % 8) << 32) | (vec_id // 8) AS global_id FROM embeddings",
    "knn_per_shard_topk": SHARDED + "SELECT shard_id, query_id, global_id, score, shard_rank AS rank FROM sharded WHERE shard_rank <= k",
    "knn_per_shard_k_merge": SHARDED + f"SELECT query_id, global_id, score, {RANK} FROM sharded WHERE shard_rank <= 3 QUALIFY rank <= k",
    "knn_hydrate_chunks": TOP + f"SELECT {HIT}, coalesce(c.chunk, '') AS chunk FROM top LEFT JOIN (SELECT global_id, max(chunk) AS chunk FROM index_records GROUP BY 1) c USING (global_id)",
    "knn_shard_metrics": BASE + "SELECT query_id, count(*) AS total_visited, count(DISTINCT shard_id) AS shards_finished FROM scored GROUP BY 1",
    "knn_max_peers": MEMBERS.replace("WITH", BASE + ",") + f""", peers AS (SELECT shard_id FROM (SELECT shard_id, min(coalesce(host, '') || grpc_port) AS place FROM members WHERE shard_id <> 0 GROUP BY 1) ORDER BY place, shard_id LIMIT 3)
        SELECT query_id, global_id, score, {RANK} FROM scored WHERE shard_id = 0 OR shard_id IN (SELECT shard_id FROM peers) QUALIFY rank <= k""",
    "index_stats": "SELECT shard_id, count(*) AS n_rows, count(DISTINCT global_id) AS n_docs, count(vector) AS n_vectors, count(chunk) AS n_texts, coalesce(min(len(vector)), -1)::INT AS dim FROM index_records GROUP BY 1",
    "vector_dimension": "SELECT coalesce(min(len(vector)), -1)::INT AS least, coalesce(max(len(vector)), -1)::INT AS most, coalesce(mode(len(vector)), -1)::INT AS dim FROM index_records WHERE vector IS NOT NULL",
    "signature_words": BASE + f"SELECT global_id, {_words.format(a=0, b=32)} AS w0, {_words.format(a=32, b=64)} AS w1 FROM recs",
    "signature_hamming": _hints + "SELECT query_id, hint, distance FROM far",
    "signature_is_near": _hints + "SELECT query_id, count(*) FILTER (distance <= 12) AS n_near, count(*) AS n_hints FROM far GROUP BY 1",
    "knn_visit_budget": BUDGET + f"SELECT {HIT} FROM few",
    "compare_jaccard": BUDGET + "SELECT query_id, round(count(*) FILTER (t.score IS NOT NULL AND f.score IS NOT NULL) / count(*), 6) AS jaccard FROM top t FULL JOIN few f USING (query_id, global_id) GROUP BY 1",
    "recall_at_k": BUDGET + "SELECT query_id, round(count(f.score) / count(*), 6) AS recall FROM top t LEFT JOIN few f USING (query_id, global_id) GROUP BY 1",
    "compare_visit_reduction": BASE + """, sizes AS (SELECT shard_id, count(*) AS n FROM recs GROUP BY 1)
        SELECT query_id, sum(n)::BIGINT AS standard, sum(least(n, 20))::BIGINT AS budgeted, CASE WHEN sum(n) = 0 THEN 0 ELSE round(1 - sum(least(n, 20)) / sum(n), 6) END AS reduction FROM reqs, sizes GROUP BY 1""",
    "knn_floor_two_stage": _exact,
    "knn_floor_barrier": _exact,
    "knn_floor_best": TOP + f"""SELECT {HIT} FROM top WHERE score >= (SELECT max(s.score) FROM scored s WHERE s.query_id = top.query_id AND s.shard_id = (SELECT min(shard_id) FROM recs))""",
    "floor_relay_updates": f"""SELECT query_id, received_at, sent_at, shard_id, min_score::DOUBLE AS floor FROM (
        SELECT *, max(min_score) OVER (PARTITION BY query_id ORDER BY received_at, sent_at, shard_id, min_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT DISTINCT query_id, min_score, shard_id, sent_at, received_at FROM coordinate_request WHERE {FINITE})) WHERE before IS NULL OR min_score > before""",
    "floor_final": f"SELECT query_id, max(min_score)::DOUBLE AS floor FROM coordinate_request WHERE {FINITE} GROUP BY 1",
    "hint_latest": "SELECT query_id, hex(arg_max(neighborhood_hint, (received_at, sent_at, neighborhood_hint))) AS hint FROM coordinate_request WHERE query_id IS NOT NULL AND octet_length(neighborhood_hint) > 0 GROUP BY 1",
    "hint_best": f"SELECT query_id, hex(arg_max(neighborhood_hint, (min_score, received_at, sent_at, neighborhood_hint))) AS hint FROM coordinate_request WHERE {FINITE} AND octet_length(neighborhood_hint) > 0 GROUP BY 1",
    "discovery_members": MEMBERS + "SELECT * FROM members",
    "discovery_dedupe_replicas": MEMBERS + "SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY collection, shard_id ORDER BY replica_id, member_id NULLS LAST, address NULLS LAST) = 1",
    "discovery_collection_filter": MEMBERS + "SELECT * FROM members WHERE collection = (SELECT min(collection) FROM members WHERE collection <> '')",
    "discovery_exclude_self": MEMBERS + "SELECT * FROM members WHERE member_id IS NULL OR member_id <> (SELECT min(member_id) FROM members)",
    "resolve_endpoint": MEMBERS + """SELECT *, CASE WHEN contains(address, ':') THEN split_part(address, ':', 1) ELSE 'localhost' END AS endpoint_host,
        CASE WHEN grpc_port > 0 THEN grpc_port ELSE 9000 END AS endpoint_port FROM members""",
    "peers_in_order": MEMBERS + "SELECT *, row_number() OVER (ORDER BY coalesce(host, '') || grpc_port, member_id NULLS LAST, shard_id, replica_id)::INT AS position FROM members QUALIFY position <= 5",
    "parse_seeds": MEMBERS + "SELECT DISTINCT shard_id, address AS seed, split_part(address, ':', 1) AS host FROM members WHERE contains(address, ':')",
    "node_status": "SELECT coalesce(lower(trim(node_role)), '') AS node_role, count(*) AS n_nodes, count(*) FILTER (grpc_port > 0) AS n_up FROM shard_metadata GROUP BY 1",
    "knn_distinct_docs": _distinct,
    "knn_satisfied_antijoin": _distinct,
    "knn_max_chunks_per_doc": DOCS + f""", won AS (SELECT query_id, parent_id, {RANK.replace("rank", "doc_rank")} FROM docs QUALIFY doc_rank <= 5)
        SELECT query_id, parent_id, doc_rank, global_id, score, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, global_id)::INT AS chunk_rank
        FROM scored JOIN won USING (query_id, parent_id) QUALIFY chunk_rank <= 2""",
    "knn_all_chunk_enrich": DOCS + f""", won AS (SELECT query_id, parent_id, {RANK.replace("rank", "doc_rank")} FROM docs QUALIFY doc_rank <= 3)
        SELECT query_id, parent_id, doc_rank, global_id, score, coalesce(c.chunk, '') AS chunk FROM scored JOIN won USING (query_id, parent_id)
        LEFT JOIN (SELECT global_id, max(chunk) AS chunk FROM index_records GROUP BY 1) c USING (global_id)""",
    "doc_shard_map": BASE + "SELECT parent_id, string_agg(DISTINCT shard_id::VARCHAR, ',' ORDER BY shard_id::VARCHAR) AS shards, count(DISTINCT shard_id) AS n_shards FROM recs GROUP BY 1",
    "knn_two_phase": SHARDED + f""", probe AS (SELECT * FROM sharded WHERE shard_rank <= 5),
        sure AS (SELECT query_id, count(*) FILTER (score >= 0.95) >= 10 AS sure FROM probe GROUP BY 1),
        quick AS (SELECT *, {RANK} FROM probe QUALIFY rank <= k),
        slow AS (SELECT s.*, {RANK} FROM sharded s JOIN sure USING (query_id) WHERE NOT sure AND shard_rank <= k AND (query_id, shard_id) IN (SELECT (query_id, shard_id) FROM quick) QUALIFY rank <= k)
        SELECT {HIT}, 1 AS phase FROM quick JOIN sure USING (query_id) WHERE sure UNION ALL SELECT {HIT}, 2 AS phase FROM slow""",
    "knn_adaptive_budget": SHARDED + f""", kept AS (SELECT *, max(score) OVER (PARTITION BY query_id, shard_id) AS best FROM sharded)
        SELECT query_id, global_id, score, {RANK} FROM kept WHERE shard_rank <= k AND (best >= 0.95 OR shard_rank <= 2) QUALIFY rank <= k""",
    "knn_early_stop": BASE + f"SELECT query_id, global_id, score, {RANK} FROM scored QUALIFY rank <= 10",
    "knn_routed_centroid": CENTROIDS + f"SELECT query_id, global_id, score, {RANK} FROM sharded WHERE (query_id, shard_id) IN (SELECT (query_id, shard_id) FROM routes WHERE turn <= 2) QUALIFY rank <= k",
    "route_specificity": CENTROIDS + "SELECT query_id, coalesce(max(similarity) FILTER (turn = 1) - max(similarity) FILTER (turn = 2) >= 0.01, true) AS specific FROM routes GROUP BY 1",
    "hint_centroid_bypass": CENTROIDS + NEAR5 + """ SELECT query_id, global_id, n.shard_id, score, score < 0.9 AS by_hint FROM near5 n JOIN routes r USING (query_id) WHERE turn = 1 AND (score >= 0.9 OR n.shard_id = r.shard_id)""",
    # The predicate is applied to all records, and the five best of each shard are taken from what it leaves.
    "hint_signature_bypass": BASE + """, hints AS (SELECT query_id, hex(arg_max(neighborhood_hint, (received_at, sent_at, neighborhood_hint))) AS hint FROM coordinate_request WHERE query_id IS NOT NULL AND octet_length(neighborhood_hint) > 0 GROUP BY 1),
        bits AS (SELECT query_id, list_transform(range(0, 64), lambda i: (('0x' || substr(hint, ((i // 8) * 2 + 1)::INT, 2))::INT >> (i % 8)::INT) & 1) AS b FROM hints WHERE length(hint) = 16),
        signs AS (SELECT global_id, list_transform(v, lambda x: (x >= 0)::INT) AS b FROM recs),
        far AS (SELECT s.*, list_sum(list_transform(list_zip(h.b, g.b), lambda p: (p[1] <> p[2])::INT)) AS distance FROM scored s LEFT JOIN bits h USING (query_id) JOIN signs g USING (global_id))
        SELECT query_id, global_id, shard_id, score, score < 0.9 AS by_hint FROM far WHERE score >= 0.9 OR distance < 20
        QUALIFY row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, global_id) <= 5""",
    "hint_sketch16": BASE + """ SELECT query_id, global_id, s.shard_id, score, score < 0.9 AS by_hint FROM scored s JOIN reqs USING (query_id) JOIN recs USING (global_id)
        WHERE score >= 0.9 OR round(1 / (1 + pow(list_distance(q[1:16], v[1:16]), 2)), 6) >= 0.8
        QUALIFY row_number() OVER (PARTITION BY query_id, s.shard_id ORDER BY score DESC, global_id) <= 5""",
    "response_hits": f"SELECT DISTINCT query_id, global_id, score::DOUBLE AS score FROM search_response WHERE {HITS}",
    "response_metrics": """SELECT query_id, sum(visited)::BIGINT AS total_visited, count(*) AS shards_finished, max(ms) AS search_time_ms FROM (
        SELECT query_id, global_id, max(nodes_visited) AS visited, max(search_time_ms) AS ms FROM search_response WHERE query_id IS NOT NULL AND global_id > 9223372036854775706 GROUP BY 1, 2) GROUP BY 1""",
    "response_merge": f"SELECT query_id, global_id, score, {RANK} FROM (SELECT query_id, global_id, max(score)::DOUBLE AS score FROM search_response WHERE {HITS} GROUP BY 1, 2) QUALIFY rank <= 10",
    "response_running_best": f"""SELECT query_id, count(*) AS n_rises, max(score)::DOUBLE AS floor FROM (
        SELECT *, max(score) OVER (PARTITION BY query_id ORDER BY received_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT query_id, received_at, max(score) AS score FROM search_response WHERE {HITS} GROUP BY 1, 2)) WHERE before IS NULL OR score > before GROUP BY 1""",
    "json_hits": TOP + """SELECT '{"query_id":"' || query_id || '","global_id":' || global_id || ',"rank":' || rank || '}' AS body FROM top""",
    "text_prefix": "SELECT doc_id, 'query: ' || subject AS prefixed FROM documents",
    "parse_embeddings_json": "SELECT vec_id, 1 AS n, len(embedding)::INT AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings",
    "normalized_vectors": BASE + """, n AS (SELECT global_id, v, sqrt(list_inner_product(v, v)) AS norm FROM recs)
        SELECT global_id, round(v[1] / norm, 6) AS first, round(v[64] / norm, 6) AS last, round(norm, 5) AS norm FROM n""",
    "stream_query_topk": _exact,
    "stream_floor_max": f"SELECT query_id, max(min_score)::DOUBLE AS floor FROM coordinate_request WHERE {FINITE} GROUP BY 1",
    "stream_floor_state": f"SELECT query_id, max(min_score)::DOUBLE AS floor FROM coordinate_request WHERE {FINITE} GROUP BY 1",
    "stream_coordinate": """SELECT query_id, max(CASE WHEN isfinite(min_score) THEN min_score END)::DOUBLE AS floor, coalesce(max(octet_length(neighborhood_hint)), 0) > 0 AS hinted
        FROM coordinate_request WHERE query_id IS NOT NULL GROUP BY 1""",
    "compare_modes": BUDGET.replace("max(CASE WHEN k >= 1 THEN k ELSE 10 END) AS k", "CASE WHEN max(k) >= 1 THEN max(k) ELSE 100 END AS k") + """, sizes AS (SELECT sum(n)::BIGINT AS visited, sum(least(n, 20))::BIGINT AS other FROM (SELECT count(*) AS n FROM recs GROUP BY shard_id))
        SELECT query_id, round(count(*) FILTER (t.score IS NOT NULL AND f.score IS NOT NULL) / count(*), 6) AS jaccard,
            round(count(*) FILTER (t.score IS NOT NULL AND f.score IS NOT NULL) / count(t.score), 6) AS recall,
            any_value(visited) AS visited, any_value(other) AS visited_other, round(1 - any_value(other) / any_value(visited), 6) AS reduction
        FROM top t FULL JOIN few f USING (query_id, global_id), sizes GROUP BY 1""",
    "compare_collaborative": BASE + "SELECT query_id, 1.0::DOUBLE AS jaccard, 1.0::DOUBLE AS recall FROM reqs",
    "search_measured": BASE + """, sizes AS (SELECT sum(least(n, 20))::BIGINT AS total_visited, count(*) AS shards_finished FROM (SELECT count(*) AS n FROM recs GROUP BY shard_id))
        SELECT query_id, total_visited, shards_finished, true AS timed FROM reqs, sizes""",
    "shard_build_open": """SELECT vec_id, 3 AS shard_id, (vec_id // 8)::INT AS local_doc, (3::BIGINT << 32) | (vec_id // 8) AS global_id,
        round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings WHERE vec_id % 8 = 3""",
    "cluster_config_nodes": "SELECT node_host AS host, ip, shard_id AS shard, node_role AS role, mem, '10.0.0.1' AS seed_ip, 4900 AS seed_port FROM shard_metadata",
    "flag_values": "SELECT coalesce(collaborative, true) AS flag, count(*) AS n FROM search_request GROUP BY 1",
    "request_defaults": """SELECT query_id, max(CASE WHEN k >= 1 THEN k ELSE 10 END)::INT AS k_text, max(CASE WHEN k >= 1 THEN k ELSE 100 END)::INT AS k_compare
        FROM search_request WHERE query_id IS NOT NULL GROUP BY 1""",
    "query_ids_made": "SELECT count(*) AS n, count(*) AS n_ids, count(*) AS n_good FROM search_request",
    "metadata_equal": MEMBERS + "SELECT host, grpc_port, shard_id, replica_id, count(*) AS n FROM members GROUP BY ALL",
    "embedding_checked": "SELECT vec_id, vec_id % 7 <> 0 AS ok, CASE WHEN vec_id % 7 <> 0 THEN len(embedding)::INT END AS dim FROM embeddings",
    "windowed_hits": f"""SELECT time_bucket(INTERVAL 10 MINUTE, emitted_at) AS begin, query_id, count(*) AS n_hits, max(score)::DOUBLE AS best FROM search_response WHERE {HITS} AND emitted_at IS NOT NULL GROUP BY 1, 2""",
}
