"""The pN_ queries over the tables of a folder, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import facility, graph, leak, markov, mixing, omh, radix, spans, topn
from .common import canonical, cut, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "index_records").select(F.col("global_id").alias("id"), "vector")
    requests = read(spark, d, "search_request").select(F.col("query_id").alias("id"), "vector", "k")
    return graph.most_similar(records, requests, floor=0.95).select("query_id", F.col("id").alias("global_id"))



def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "index_records").select(F.col("global_id").alias("id"), "vector")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "index_records").select(F.col("global_id").alias("id"), "chunk", "vector", canonical(F.col("chunk")).alias("canon"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return omh.near_duplicates(chunks(spark, d)).select("id_a", "id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record that has a near duplicate: its group (the smallest id of all that are linked) and its number of links."""
    return omh.near_groups(chunks(spark, d)).withColumnRenamed("id", "global_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = markov.clusters(vectors(spark, d), floor=0.90).where(F.col("whole") & (F.col("size") >= 5))
    return found.select("cluster_id", F.col("id").alias("global_id"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of two records or more: size, most typical members, whether all members are alike and none is like an outsider."""
    found = markov.clusters(vectors(spark, d), floor=0.90).where(F.col("size") >= 2)
    typical = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("typical"), F.col("id").cast("string")))))
    return found.groupBy("cluster_id").agg(F.first("size").alias("size"), F.first("whole").alias("whole"), typical.alias("typical"))


def p3_hint_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of signatures at most 6 of 64 bits apart: each distinct hint counts once; its sign bits are a vector of 1 and -1."""
    hints = read(spark, d, "coordinate_request").where(F.octet_length("neighborhood_hint") == 8).select("neighborhood_hint").distinct()
    found = markov.clusters(cut(signs(hints)), floor=1 - 2 * 6 / 64)
    return found.where(F.col("size") >= 2).select("cluster_id", F.col("id").alias("signature"), "size", "typical")


def signs(hints: DataFrame) -> DataFrame:
    """(neighborhood_hint of 8 bytes) -> (id bigint, vector array<float>): the bytes as a number, the first one highest, and 1 or -1 for each bit i at byte i >> 3, place i & 7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, 8)
                v = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32) * 2 - 1
                yield pa.RecordBatch.from_arrays([pa.array(raw.copy().view(">i8").ravel().astype(np.int64)), pa.ListArray.from_arrays(np.arange(0, v.size + 1, 64, dtype=np.int32), pa.array(v.ravel()))], names=["id", "vector"])

    return hints.select("neighborhood_hint").mapInArrow(run, "id bigint, vector array<float>")


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "index_records").select(F.col("global_id").alias("id"), "vector", "chunk")
    return facility.varied_subset(records, share=0.02).withColumnRenamed("id", "global_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "index_records").select(F.col("global_id").alias("id"), canonical(F.col("chunk")).alias("canon"))
    return radix.collapse(texts).where(F.col("id") != F.col("keep")).select(F.col("keep").alias("keep_id"), F.col("id").alias("dup_id"))


#: Ids above this one mark the end of a shard's answer.
LAST_ID = 2**63 - 1 - 101


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of equal chunks, and the number of its copies."""
    kept = radix.collapse(read(spark, d, "index_records").select(F.col("global_id").alias("id"), canonical(F.col("chunk")).alias("canon")))
    return kept.where(F.col("id") == F.col("keep")).select(F.col("keep").alias("keep_id"), "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "search_response").where(F.col("global_id") <= LAST_ID)
    items = hits.select(F.col("query_id").alias("grp"), F.col("global_id").alias("id"), "score")
    groups = read(spark, d, "search_request").select(F.col("query_id").alias("grp"), F.col("k").alias("n"))
    return topn.top_n(items, groups).select(F.col("grp").alias("query_id"), F.col("id").alias("global_id"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("item"), "text")
    return leak.leaks(texts(spark, d), items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 12 words with at most one word changed, left out or added."""
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("item"), "text")
    return leak.leaks(texts(spark, d), items, edits=1).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits")


def mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.octet_length("text").alias("size"))
    targets = read(spark, d, "mix_targets").select(F.col("plan_id").alias("plan"), F.col("total_ratio").alias("ratio"), "source", F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    return mixing.mix(docs, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d)[1].where("out_of_reach").select(F.col("plan").alias("plan_id"), "source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d)[1].withColumnRenamed("plan", "plan_id")


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """What each plan takes of each document."""
    return mixed(spark, d)[0].select(F.col("plan").alias("plan_id"), "source", F.col("id").alias("doc_id"), "tokens", "times")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document is shared with others."""
    t = texts(spark, d)
    return spans.shares(t, spans.shared_spans(t, span=300)).withColumnRenamed("id", "doc_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy passages: chains of shared seeds with what their gaps and ends align to."""
    return spans.passages(texts(spark, d), span=300).withColumnsRenamed({"id": "doc_id", "other": "other_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(texts(spark, d), span=300)
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))


NAMES = """
p1_found p2_found p2_groups p3_found p3_clusters p3_hint_clusters p4_subset p5_found p5_copies p6_found p7_found p7_near
p8_found p8_report p8_copies p9_found p9_share p9_passages
""".split()
QUERIES = {name: globals()[name] for name in NAMES}
VALID = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
CANON = """list_sort(list_filter(list_transform(string_split(lower(chunk), '|'), lambda f: regexp_replace(f, '[^\\p{L}\\p{N}]+', '', 'g')), lambda f: f <> ''))"""
COPIES = f"""
    WITH one AS (SELECT global_id, any_value({CANON}) AS canon FROM index_records WHERE chunk IS NOT NULL GROUP BY 1),
    kept AS (SELECT *, min(global_id) OVER (PARTITION BY canon) AS keep_id, count(*) OVER (PARTITION BY canon) AS copies FROM one WHERE len(canon) > 0)
"""
GRAMS = """list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i+11], ' '))"""
PAIRS = f"""
        WITH r AS (SELECT global_id AS id, any_value(chunk) AS chunk, any_value(CASE WHEN {VALID} THEN vector::DOUBLE[] END) AS v FROM index_records WHERE global_id IS NOT NULL GROUP BY 1),
        k AS (SELECT *, coalesce(NOT regexp_matches(chunk, '[\\p{{L}}\\p{{N}}]'), true) AS blank, regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{N}}]+') AS w, {CANON} AS canon FROM r),
        t AS (SELECT * FROM k WHERE len(w) >= 10),
        c AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM t) GROUP BY ALL),
        s AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS same FROM c a JOIN c b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
        SELECT s.a AS id_a, s.b AS id_b FROM s JOIN t x ON x.id = s.a JOIN t y ON y.id = s.b WHERE same / (len(x.w) + len(y.w) - same) >= 0.8 AND x.canon <> y.canon
        UNION ALL SELECT a.id, b.id FROM k a JOIN k b ON a.id < b.id WHERE (a.blank OR b.blank) AND a.v IS NOT NULL AND b.v IS NOT NULL AND list_cosine_similarity(a.v, b.v) >= 0.99
"""
SPANS = """
        WITH w AS (SELECT doc_id, unnest(range(0, length(text) - 299)) AS p, text FROM documents WHERE length(text) >= 300),
        h AS (SELECT doc_id, p, md5_number_lower(substr(text, p + 1, 300)) AS h FROM w),
        s AS (SELECT h FROM h GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
        f AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 300 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM h SEMI JOIN s USING (h)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f),
        spans AS (SELECT doc_id, min(p)::INT AS span_start, (max(p) + 300)::INT AS span_end FROM g GROUP BY doc_id, run)
"""
SQL: dict[str, str] = {
    # The exact answer: equal to that of the graph where the graph misses nothing, as on the 0.01 tables.
    "p1_found": f"""
        WITH r AS (SELECT global_id, any_value(vector::DOUBLE[]) AS v FROM index_records WHERE {VALID} GROUP BY 1),
        a AS (SELECT query_id, any_value(vector::DOUBLE[]) AS q, max(CASE WHEN k >= 1 THEN k ELSE 10 END) AS k FROM search_request WHERE query_id IS NOT NULL AND {VALID} GROUP BY 1)
        SELECT query_id, global_id FROM (SELECT query_id, k, global_id, round((1 + list_cosine_similarity(q, v)) / 2, 6) AS score FROM a, r) WHERE score >= 0.95
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) <= k
    """,
    "p3_found": f"""
        WITH r AS (SELECT global_id, any_value(vector::DOUBLE[]) AS v FROM index_records WHERE {VALID} GROUP BY 1),
        n AS (SELECT a.global_id, list(b.global_id ORDER BY b.global_id) AS near FROM r a JOIN r b ON list_cosine_similarity(a.v, b.v) >= 0.9 OR a.global_id = b.global_id GROUP BY 1)
        SELECT min(global_id) OVER (PARTITION BY near) AS cluster_id, global_id FROM n QUALIFY count(*) OVER (PARTITION BY near) = len(near) AND len(near) >= 5
    """,
    "p2_found": PAIRS,
    "p2_groups": f"""
        WITH RECURSIVE pairs AS ({PAIRS}),
        links AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        n AS (SELECT a, count(DISTINCT b) AS links FROM links GROUP BY 1)
        SELECT a AS global_id, min(b) AS group_id, any_value(links) AS links FROM reach JOIN n USING (a) GROUP BY 1
    """,
    "p5_found": COPIES + "SELECT keep_id, global_id AS dup_id FROM kept WHERE global_id <> keep_id",
    "p5_copies": COPIES + "SELECT DISTINCT keep_id, copies FROM kept",
    "p7_found": f"""
        WITH items AS (SELECT item_id, unnest({GRAMS}) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items) WHERE len(w) >= 12),
        docs AS (SELECT doc_id, unnest({GRAMS}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents) WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (g)
    """,
    "p9_found": SPANS + "SELECT * FROM spans",
    "p9_share": SPANS + """, total AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
            CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0 END AS share FROM documents LEFT JOIN total USING (doc_id)""",
    "p8_found": """
        WITH docs AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL),
        good AS (SELECT * FROM docs WHERE source <> ''),
        sizes AS (SELECT source, sum(size) AS size FROM good GROUP BY 1)
        SELECT DISTINCT plan_id, m.source FROM mix_targets m LEFT JOIN sizes s ON s.source = m.source
        WHERE target_share * total_ratio * (SELECT sum(size) FROM good)::DOUBLE > max_repeats * coalesce(s.size, 0)::DOUBLE
    """,
    "p6_found": """
        WITH asked AS (SELECT query_id, max(CASE WHEN k >= 1 THEN k ELSE 10 END) AS n FROM search_request WHERE query_id IS NOT NULL GROUP BY 1),
        hits AS (SELECT query_id, global_id, max(score) AS score FROM search_response
                 WHERE isfinite(score) AND global_id <= 9223372036854775706 GROUP BY 1, 2)
        SELECT query_id, global_id FROM hits JOIN asked USING (query_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) <= max(n) OVER (PARTITION BY query_id)
    """,
}
