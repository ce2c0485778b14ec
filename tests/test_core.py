"""Properties of the search operators on small inputs, against brute force."""

import importlib
import math
import os
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vexel.functions import text as ft
from vexel.functions import vectors as fv
from vexel.operators import catalog, collaborative, compare, documents, routing, search
from vexel.plans import api, queries, sql
from vexel.sources import collection
from vexel.streaming import live

N, DIM = 400, 16
VECTORS = "global_id bigint, shard_id int, local_doc int, parent_id bigint, vector array<float>, extra string"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((N, DIM)).astype(np.float32)
    x[7] = x[8]  # a tie
    rows = [(i, i % 8, i // 8, i // 5, x[i].tolist(), "x") for i in range(N)]
    q = rng.standard_normal((12, DIM)).astype(np.float32)
    q[0] = x[7]
    vectors = spark.createDataFrame(rows + rows[:20], VECTORS).cache()  # some are delivered twice
    asked = spark.createDataFrame([(f"q{i}", q[i].tolist(), [1, 3, 10, 500][i % 4]) for i in range(12)], "query_id string, vector array<float>, k int").cache()
    s = np.round((1 + (q @ x.T.astype(np.float64)) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x.astype(np.float64), axis=1)[None]) / 2, 6)
    exact = {f"q{i}": [int(j) for j in np.lexsort((np.arange(N), -s[i]))][: [1, 3, 10, 500][i % 4]] for i in range(12)}
    return vectors, asked, exact


def ids(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["global_id"])
    return out


def test_exact_search_equals_brute_force(data):
    vectors, asked, exact = data
    assert ids(search.top(vectors, asked)) == exact


def test_result_does_not_depend_on_partitions_or_shards(data):
    vectors, asked, exact = data
    assert ids(search.top(vectors.repartition(7), asked)) == exact
    assert ids(search.top(vectors.withColumn("shard_id", F.col("shard_id") % 3), asked)) == exact


@pytest.mark.parametrize("mode", ["collaborative", "barrier"])
def test_floors_lose_nothing(data, mode):
    vectors, asked, exact = data
    assert ids(api.vector_search(vectors, asked, mode=mode)) == exact


def test_best_floor_only_loses(data):
    vectors, asked, exact = data
    found = ids(collaborative.two_stage(vectors, asked, kind="best"))
    assert all(set(v) <= set(exact[q]) for q, v in found.items())


def test_early_stop_equals_top(data):
    vectors, asked, _ = data
    assert ids(routing.early_stop(vectors, asked, k=6)) == ids(search.top(vectors, asked, k=6))


def test_budget_of_all_is_exact(data):
    vectors, asked, exact = data
    assert ids(search.budgeted(vectors, asked, visits=N)) == exact


def test_documents(data):
    vectors, asked, _ = data
    a = ids(documents.distinct_documents(vectors, asked, k=5))
    order = ids(search.top(vectors, asked, k=N))
    for q, found in a.items():
        seen, want = set(), []
        for i in order[q]:
            if i // 5 not in seen:
                seen.add(i // 5)
                want.append(i)
        assert found == want[:5]
    asked5 = asked.withColumn("k", F.lit(5))
    assert ids(documents.satisfied_pruning(vectors, asked5)) == a
    most = documents.chunks_per_document(vectors, asked, documents=3, most=2).groupBy("query_id", "parent_id").count()
    assert {r["count"] for r in most.collect()} == {2}


def test_per_shard_limit_and_errors(data):
    vectors, asked, _ = data
    assert search.per_shard(vectors, asked, k=2).count() == 12 * 8 * 2
    with pytest.raises(ValueError):
        api.vector_search(vectors, asked, k=0)
    with pytest.raises(ValueError):
        api.vector_search(vectors, asked, mode="none")
    with pytest.raises(ValueError):
        collaborative.floors(vectors, "other")


def test_empty_tables(data, spark):
    vectors, asked, _ = data
    none, nobody = vectors.limit(0), asked.limit(0)
    for df in (search.top(none, asked), search.top(vectors, nobody), search.per_shard(none, asked), documents.distinct_documents(none, asked), search.budgeted(none, asked, visits=3), collaborative.barrier(none, asked)):
        assert df.count() == 0


def test_comparison(data):
    vectors, asked, _ = data
    a, b = search.top(vectors, asked), search.budgeted(vectors, asked, visits=5)
    for r in compare.overlap(a, b).join(compare.recall(b, a), "query_id").collect():
        assert 0 <= r["jaccard"] <= r["recall"] <= 1
    one = asked.limit(1).select(compare.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))), compare.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")), compare.visit_reduction(F.lit(0), F.lit(3)), compare.visit_reduction(F.lit(4), F.lit(1))).first()
    assert list(one) == [0.5, 1.0, 0.0, 0.75]


def test_signatures(spark):
    nan = float("nan")
    rows = [("nan", [nan, -0.0, -1.0, 1.0]), ("odd", [1.0] * 33), ("minus", [-1.0] * 32), ("none", None)]
    out = {r[0]: r[1] for r in spark.createDataFrame(rows, "name string, v array<float>").select("name", fv.signature_words(F.col("v")).alias("w")).collect()}
    assert out == {"nan": [0b1010], "odd": [2**32 - 1, 1], "minus": [0], "none": None}
    bits = spark.createDataFrame([(bytearray([1, 0, 0, 128, 255, 0, 0, 0]),)], "b binary").select(fv.words_of_bytes(F.col("b"))).first()[0]
    assert bits == [1 + (128 << 24), 255]
    far = spark.range(1).select(fv.hamming(F.array(F.lit(5).cast("bigint")), F.array(F.lit(6).cast("bigint"))), fv.is_near(F.array(F.lit(5).cast("bigint")), F.array(F.lit(6).cast("bigint")), 2)).first()
    assert list(far) == [2, True]


def test_fixture_of_the_survey(spark):
    """1,000 vectors and a query from a 48-bit congruential generator; the exact ten best are known."""

    def floats(seed, n):
        s = (seed ^ 0x5DEECE66D) & (2**48 - 1)
        out = np.empty(n, np.float32)
        for i in range(n):
            s = (s * 0x5DEECE66D + 0xB) & (2**48 - 1)
            out[i] = (s >> 24) / 2**24
        return out

    x = floats(42, 128_000).reshape(1000, 128)
    q = floats(99, 128)
    norm = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True, dtype=np.float32))
    rows = [(i, 0, i, i, v.tolist(), "") for i, v in enumerate(norm(x))]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([("q", norm(q).tolist(), 10)], "query_id string, vector array<float>, k int")
    hits = sorted((r["rank"], r["global_id"], r["score"]) for r in search.top(vectors, asked).collect())
    assert [h[1] for h in hits] == [443, 123, 16, 787, 920, 834, 330, 242, 309, 745]
    assert all(math.isclose(a[2], b, abs_tol=2e-6) for a, b in zip(hits, [0.920689, 0.919734, 0.918516, 0.918386, 0.917135]))
    texts = spark.createDataFrame([(i, f"Document {i}") for i in range(700)], "global_id bigint, chunk string")
    got = {r["global_id"]: r["chunk"] for r in search.hydrate(search.top(vectors, asked), texts).collect()}
    assert got[443] == "Document 443" and got[787] == ""


def test_catalogue(spark):
    rows = [("a", "h1", "10.0.0.1:7", 0, 1, "c", 5), ("b", "h0", "10.0.0.2", 0, 0, "c", -1), ("c", "h2", None, 1, 0, "", 9), ("d", None, "x:1", 0, 0, "", 0)]
    m = spark.createDataFrame(rows, "member_id string, host string, address string, shard_id int, replica_id int, collection string, grpc_port int")
    names = lambda df: sorted(r["member_id"] for r in df.collect())
    assert names(catalog.in_collection(m, " c ")) == ["a", "b"] and names(catalog.in_collection(m, "  ")) == list("abcd")
    assert names(catalog.one_replica(m)) == ["b", "c", "d"]
    assert names(catalog.others(m, "a")) == ["b", "c", "d"]
    got = {r["member_id"]: (r["endpoint_host"], r["endpoint_port"]) for r in catalog.endpoints(m, " 12 ").collect()}
    assert got == {"a": ("10.0.0.1", 5), "b": ("localhost", 12), "c": ("localhost", 9), "d": ("x", 12)}
    assert {r["endpoint_port"] for r in catalog.endpoints(m, "bad").where("grpc_port <= 0").collect()} == {None}
    assert names(catalog.in_order(m, 2)) == ["b", "d"]


def test_text(spark):
    one = spark.createDataFrame([("a:1, b  c:2,,", "no", None)], "s string, f string, n string")
    r = one.select(ft.seeds(F.col("s")), ft.seeds(F.col("n")), ft.flag(F.col("f")), ft.flag(F.lit("FALSE")), ft.flag(F.col("n")), ft.collection(F.col("n")), ft.prefixed(F.col("f"))).first()
    assert list(r) == [["a:1", "c:2"], [], True, False, True, "", "query: no"]
    assert one.select(ft.embeddings(F.lit("[[1,2.5],[3,4]]"))).first()[0] == [[1.0, 2.5], [3.0, 4.0]]
    with pytest.raises(Exception):
        spark.createDataFrame([("[[1,",)], "j string").select(ft.embeddings(F.col("j"))).collect()


def test_updates(spark):
    nan, inf = float("nan"), float("inf")
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("q", 0.5, 1), ("q", 0.5, 2), ("q", 0.4, 3), ("q", 0.7, 4), ("q", nan, 5), ("q", -inf, 6), (None, 0.9, 7), ("r", None, 8), ("q", 0.7, 4)]
    u = spark.createDataFrame([(q, s, bytearray([m]), 0, t(m), t(m)) for q, s, m in rows], "query_id string, min_score float, neighborhood_hint binary, shard_id int, sent_at string, received_at string")
    assert sorted(round(r["floor"], 3) for r in collaborative.relayed(u).collect()) == [0.5, 0.7]
    assert [(r[0], round(r[1], 3)) for r in collaborative.final_floors(u).collect()] == [("q", 0.7)]
    assert {r[0]: bytes(r[1]) for r in collaborative.latest_hints(u).collect()} == {"q": b"\x06", "r": b"\x08"}
    assert {r[0]: bytes(r[1]) for r in collaborative.latest_hints(u, best=True).collect()} == {"q": b"\x04"}


def test_collections(spark, data, tmp_path):
    vectors = data[0].select(F.col("global_id").alias("vec_id"), "vector").distinct()
    for policy in ("round_robin", "hash", "kmeans"):
        at = str(tmp_path / policy)
        api.build_collection(vectors, at, shards=4, policy=policy)
        back = spark.read.parquet(at)
        assert back.count() == N and back.select("vec_id").distinct().count() == N
        assert sum(collection.open_shard(spark, at, s).count() for s in range(4)) == N
    with pytest.raises(ValueError):
        collection.assign_shards(vectors, "vec_id", 0)
    (tmp_path / "c.json").write_text('{"nodes": [{"host": "h", "ip": "i", "shard": 1, "role": "seed", "mem": "6g"}], "seed_ip": "i"}')
    assert collection.cluster_config(spark, str(tmp_path / "c.json")).first().asDict() == {"host": "h", "ip": "i", "shard": 1, "role": "seed", "mem": "6g", "seed_ip": "i", "seed_port": 4900}


def test_text_search_finds_itself(spark):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["red apple", "green pear", "blue plum", None])], "vec_id bigint, t string")
    v = api.embedded(rows, "t", api.hashing_embedder()).where("vector IS NOT NULL")
    v = collection.assign_shards(v, "vec_id").withColumn("parent_id", F.col("vec_id"))
    asked = spark.createDataFrame([("a", "green pear"), ("b", None)], "query_id string, text string")
    hits = api.text_search(v, asked, k=1, prefix="", collaborative=False).collect()
    assert [(h["query_id"], h["score"]) for h in hits] == [("a", 1.0)]


def test_names():
    assert set(sql.SQL) <= set(queries.QUERIES)
    # Nothing but the entry point may need the training-data subpackage.
    code = "import sys, vexel.plans.queries, vexel.plans.sql; assert not any(n == 'vexel.llm' or n.startswith('vexel.llm.') for n in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    importlib.import_module("__spark_entry__")


def test_streams(spark):
    from vexel.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = {(r[0], r[1]) for r in QUERIES["floor_final"](spark, folder).collect()}
    assert {(r[0], r[1]) for r in QUERIES["stream_floor_state"](spark, folder).collect()} == want
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(QUERIES["stream_query_topk"](spark, folder)) == key(QUERIES["knn_batch_topk"](spark, folder))


def test_batch_delivered_twice_is_written_once(spark, data, tmp_path):
    vectors, asked, exact = data
    sink = live.table_sink(str(tmp_path / "answers"))
    hits = search.top(vectors, asked)
    sink(hits, 0)
    sink(hits.where("query_id = 'q0'"), 1)
    sink(hits, 0)  # a replay of the first batch
    assert live.answers(spark, str(tmp_path / "answers"), hits.schema).count() == hits.count() + len(exact["q0"])


def test_deadline_and_cancel(spark):
    assert live.within(spark, 60.0, lambda: spark.range(5).count()) == 5
    slow = F.udf(lambda x: __import__("time").sleep(0.5) or x, "bigint")
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        live.within(spark, 1.5, lambda: spark.range(400).select(slow("id")).collect())
    assert time.monotonic() - began < 30
    assert spark.range(3).count() == 3  # the session goes on


def test_answers_with_floor_and_hint(spark, tmp_path):
    rows = [[("q", 0.5, b"a", 0), ("r", None, b"z", 0)], [("q", 0.4, b"b", 1), ("q", 0.9, b"", 1), ("r", -0.5, None, 2)], [(None, 1.0, b"c", 1)]]
    kind = "query_id string, min_score float, neighborhood_hint binary, shard_id int"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = live.run_to_table(live.coordinate_answers(stream), str(tmp_path / "answers"), str(tmp_path / "state"), "update").collect()
    assert {(r["query_id"], round(r["floor"], 3) if r["floor"] is not None else None) for r in out} >= {("q", 0.9), ("r", -0.5)}
    assert {bytes(r["hint"]) for r in out if r["query_id"] == "r"} == {b"z"}
    # no answer is lower than one before, and a late floor of a named query only comes with its shard's hint kept
    assert max(r["floor"] for r in out if r["query_id"] == "q") < 1


def test_windowed_hits(spark, tmp_path):
    rows = [("q", 0.5, "2024-01-01 00:01:00"), ("q", 0.9, "2024-01-01 00:02:00"), ("q", float("nan"), "2024-01-01 00:03:00"), ("q", 0.1, "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "query_id string, score double, emitted_at string").select("query_id", "score", F.col("emitted_at").cast("timestamp").alias("emitted_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, score double, emitted_at timestamp").parquet(str(tmp_path / "in"))
    out = live.run_to_table(live.windowed_hits(stream), str(tmp_path / "windows"), str(tmp_path / "state"), "complete").collect()
    assert sorted((r["begin"].minute, r["n_hits"], r["best"]) for r in out) == [(0, 2, 0.9), (10, 1, 0.1)]


def test_embeddings_are_checked(spark):
    bad = [("a", []), ("b", None), ("c", [[1.0, 2.0]]), ("d", [[]]), ("e", [[3.0], [4.0]])]
    df = spark.createDataFrame(bad, "id string, e array<array<float>>")
    assert {r["id"]: r["ok"] for r in df.select("id", ft.has_embedding(F.col("e")).alias("ok")).collect()} == {"a": False, "b": False, "c": True, "d": False, "e": True}
    assert df.where("id IN ('c', 'e')").select(ft.first_embedding(F.col("e")).alias("v")).collect()[0]["v"] == [1.0, 2.0]
    for i in "abd":
        with pytest.raises(Exception, match="no embedding"):
            df.where(F.col("id") == i).select(ft.first_embedding(F.col("e"))).collect()
    called = []

    def post(url, texts):
        called.append((url, len(texts)))
        return "[" + ",".join("[1.0, 2.0]" for _ in texts) + "]"

    embed = api.rest_embedder("http://host:1/predictions/model", post)
    assert embed(["x", "y"]).tolist() == [[1.0, 2.0], [1.0, 2.0]] and called == [("http://host:1/predictions/model", 2)]
    with pytest.raises(ValueError, match="no embedding"):
        api.rest_embedder("u", lambda u, t: "[]")(["x"])


def test_comparison_of_two_modes(data):
    vectors, asked, exact = data
    rows = {r["query_id"]: r for r in api.compared(vectors, asked, "exact", "budgeted", visits=5).collect()}
    assert len(rows) == 12 and all(r["visited"] == N and r["visited_other"] == 40 and abs(r["reduction"] - 0.9) < 1e-9 for r in rows.values())
    same = api.compared(vectors, asked).collect()
    assert {r["jaccard"] for r in same} == {r["recall"] for r in same} == {1.0}
    assert {r["k"] for r in api.defaults(asked.withColumn("k", F.lit(0)), 100).collect()} == {100}


def test_batches_blocks_and_parts_do_not_change_the_result(spark, data):
    """Many small batches, a grid of blocks of queries and records, and routed parts give what one matrix product gives."""
    vectors, asked, exact = data
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    whole = {by: sorted(tuple(r) for r in f(vectors, asked).select("query_id", "global_id", "score", "rank").collect()) for by, f in (("shard", search.per_shard), ("document", documents.distinct_documents))}
    spark.conf.set(name, "17")
    try:
        one = vectors.coalesce(1)
        assert ids(search.top(one, asked)) == exact
        assert sorted(tuple(r) for r in search.per_shard(one, asked).select("query_id", "global_id", "score", "rank").collect()) == whole["shard"]
        assert sorted(tuple(r) for r in documents.distinct_documents(one, asked).select("query_id", "global_id", "score", "rank").collect()) == whole["document"]
        assert ids(search.budgeted(one, asked, visits=N)) == exact
        # what leaves the task does not grow with the batches
        assert search.candidates(one, asked.withColumn("k", F.lit(3))).count() == 12 * 3
    finally:
        spark.conf.set(name, before)
    grid = search.candidates(vectors, asked, block=5)
    assert ids(search.ranked(search.once(grid), "query_id").where("rank <= k")) == exact
    routes = asked.crossJoin(spark.range(8).select(F.col("id").cast("int").alias("shard_id")))
    assert ids(search.ranked(search.visiting(vectors, routes, part=7, block=5).drop("visited"), "query_id").where("rank <= k")) == exact


def test_routed_search_scores_only_its_shards(data):
    vectors, asked, _ = data
    few = asked.withColumn("shard_id", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
    hits = search.visiting(vectors, few)
    assert hits.select("query_id", "shard_id").distinct().count() == 12 and {r["visited"] for r in hits.collect()} == {N // 8}


def test_shard_bounds_hold(data):
    vectors, asked, _ = data
    near = vectors.withColumn("shard_id", F.when(F.col("vector")[0] > 1, 0).when(F.col("vector")[0] < -1, 1).otherwise(2))
    names, most = routing.shard_bounds(near)
    rows = {}
    for r in search.per_shard(near, asked, k=1).collect():
        rows[r["query_id"], r["shard_id"]] = r["score"]
    for r in asked.collect():
        bound = dict(zip(names.tolist(), most(np.array([r["vector"]]))[0]))
        assert all(rows[r["query_id"], s] <= bound[s] for s in bound)
    assert ids(routing.early_stop(near, asked, k=6)) == ids(search.top(vectors, asked, k=6))


def test_saved_needs_a_shared_folder(spark):
    from vexel.sources import saved

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            saved.base_dir(Session())


def test_hint_rescues_records_beyond_the_best(spark, data):
    """A record near the hint is a hit though more than k better ones of its shard are neither near nor reach the floor."""
    vectors, asked, _ = data
    x = {r["global_id"]: np.array(r["vector"]) for r in vectors.collect()}
    target = {r["query_id"]: r["global_id"] for r in search.per_shard(vectors, asked, k=30).where("shard_id = 2 AND rank = 30").collect()}
    rows = [(q, np.where(x[i] >= 0, 1.0, -1.0).tolist()) for q, i in target.items()]
    hinted = asked.join(spark.createDataFrame(rows, "query_id string, extra array<float>"), "query_id")
    near = routing.bypassing(0.99, routing.signs_apart(1))
    got = {(r["query_id"], r["global_id"]) for r in search.per_shard(vectors, hinted, k=5, allow=near).collect()}
    assert set(target.items()) <= got
    grid = search.candidates(vectors, hinted, by="shard_id", k=5, allow=near, block=5)
    assert {(r["query_id"], r["global_id"]) for r in search.once(grid).collect()} == got
    none = hinted.withColumn("extra", F.array_repeat(F.lit(0.0), DIM).cast("array<float>"))
    assert all(r["score"] >= 0.99 for r in search.per_shard(vectors, none, k=5, allow=near).collect())
    bits = spark.createDataFrame([(bytearray([5, 128]),), (bytearray([1]),), (None,)], "b binary").select(fv.signs_of_bytes(F.col("b"), 16)).collect()
    assert [r[0] for r in bits] == [[1, -1, 1] + [-1] * 12 + [1], None, None]


def test_state_of_an_idle_query_goes():
    class State:
        exists, hasTimedOut, removed = False, False, False

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.ms = ms

        def remove(self):
            self.exists, self.removed = False, True

    state, step = State(), live.floor_step(5_000)
    frame = lambda *v: iter([pd.DataFrame({"min_score": list(v)})])
    assert [f["floor"].tolist() for f in step(("q",), frame(0.5, 0.7), state)] == [[0.7]] and state.ms == 5_000
    assert list(step(("q",), frame(0.6), state)) == []
    state.hasTimedOut = True
    assert list(step(("q",), iter(()), state)) == [] and state.removed
    state.hasTimedOut = False
    assert [f["floor"].tolist() for f in step(("q",), frame(0.1), state)] == [[0.1]]  # a new query


def test_source_takes_few_files_at_once(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"q{n}", float(n))], "query_id string, min_score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "updates.parquet"))
    stream = live.source(spark, str(tmp_path), "updates", files=1)
    live.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("batch=")]) == 3


def test_measured_search(data):
    vectors, asked, exact = data
    hits, metrics = api.measured(vectors, asked)
    assert ids(hits) == exact
    assert {(r["total_visited"], r["shards_finished"]) for r in metrics.collect()} == {(N, 8)} and metrics.first()["elapsed_ms"] > 0
    with pytest.raises(ValueError):
        api.measured(vectors, asked, "none")


def test_float_product_keeps_what_double_keeps():
    rng = np.random.default_rng(5)
    s = rng.standard_normal((30, 1_003)).astype(np.float32)
    k = np.array([1, 3, 10] * 10)
    r, c, low = search.above(s, k, np.full(30, -9, np.float32), 0.0)
    for i in range(30):
        assert set(np.argsort(-s[i])[: k[i]]) <= set(c[r == i]) and (np.sort(s[i])[-k[i]] >= low[i])


def test_many_queries_by_shard_are_one_pass_over_ranged_records(data):
    vectors, asked, _ = data
    plan = search.candidates(vectors, asked, by="shard_id", block=5)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and "FlatMapCoGroups" not in plan


def test_barrier_exchanges_many_queries_at_once():
    assert collaborative.EXCHANGE >= 20_000


def test_budget_counts_visits_without_a_search(data, monkeypatch):
    vectors, asked, _ = data
    monkeypatch.setattr(search, "nearest", None)
    assert {r["visited"] for r in api.visited(vectors, asked, "budgeted", visits=20).collect()} == {160}
