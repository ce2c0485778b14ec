"""The training-data operators against brute force on small inputs, with nulls, repeated rows, ties and empty tables."""

import collections
import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import cells, facility, graph, leak, markov, mixing, omh, radix, spans, topn
from vexel.llm.common import canonical, is_blank, is_valid, unit, words

DIM = 64
WORD = re.compile(r"[^\W_]+")


def dense(seed=3, groups=6, each=8, alone=60):
    """Unit vectors: tight groups and scattered ones."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, DIM))
    x = [unit(m[None] / np.linalg.norm(m) + 0.03 * rng.standard_normal((each, DIM))) for m in middle]
    return np.concatenate([*x, unit(rng.standard_normal((alone, DIM)))])


BAD = [None, [1.0] * 5, [0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [float("inf")] + [1.0] * (DIM - 1), []]


@pytest.fixture(scope="module")
def vectors(spark):
    x = dense()
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, v, "x") for i, v in enumerate(BAD)] + [(None, x[0].tolist(), "x")]
    return x, spark.createDataFrame(rows + rows[:9], "id bigint, vector array<float>, node string").cache()


def test_validity_and_words(spark):
    df = spark.createDataFrame([(v,) for v in BAD] + [([1.0] * DIM,)], "v array<float>")
    assert [r[0] for r in df.select(is_valid(F.col("v"))).collect()] == [False] * 6 + [True]
    t = spark.createDataFrame([("A b|  c!",), ("C|ab",), ("",), (None,), ("É_2 x",)], "t string")
    got = [tuple(r) for r in t.select(canonical(F.col("t")), is_blank(F.col("t")), words(F.col("t"))).collect()]
    assert got == [("ab|c", False, ["a", "b", "c"]), ("ab|c", False, ["c", "ab"]), ("", True, []), ("", True, []), ("é2x", False, ["é", "2", "x"])]


# ---- 1


def test_graph_recall():
    x = unit(np.random.default_rng(0).standard_normal((1500, DIM)) + 2 * np.random.default_rng(1).standard_normal((30, DIM)).repeat(50, axis=0))
    edges, entries = graph.build(x)
    assert (edges >= -1).all() and (edges < len(x)).all()
    q = x[::15]
    r, v, _ = graph.search(x, edges, entries, q, np.full(len(q), 10), None)
    got = collections.defaultdict(set)
    for a, b in zip(r, v):
        got[a].add(b)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & got[i]) / 10 for i, t in enumerate(truth)]) >= 0.95


def test_most_similar(spark, vectors):
    x, df = vectors
    copies = spark.createDataFrame([(500 + i, x[0].tolist(), "x") for i in range(30)], df.schema)  # many equal vectors
    asked = [("a", x[0].tolist(), 5), ("a", x[0].tolist(), 5), ("b", x[9].tolist(), 0), ("c", x[9].tolist(), None), ("d", None, 3), (None, x[1].tolist(), 3), ("e", (-x[60]).tolist(), 3)]
    q = spark.createDataFrame(asked, "id string, vector array<float>, k int")
    rows = graph.most_similar(df.unionByName(copies), q, floor=0.95).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["id"])
    assert got["a"] == [0, 500, 501, 502, 503]
    s = np.round((1 + x.astype(float) @ x[9].astype(float)) / 2, 6)
    near = [int(i) for i in np.lexsort((np.arange(len(s)), -s)) if s[i] >= 0.95][:10]
    assert got["b"] == got["c"] == near and set(got) == {"a", "b", "c"}
    assert graph.most_similar(df.limit(0), q).count() == 0 and graph.most_similar(df, q.limit(0)).count() == 0


def test_cells_split_and_visit():
    c = cells.Cells(np.zeros(2, np.float32), unit(np.array([[1, 0], [0, 1]], np.float32)), np.array([1, 3]))
    near = c.near(np.array([[1, 0.1], [0.1, 1]], np.float32), 2)
    assert near.tolist() == [[0, 1], [1, 0]]
    row, cell, part = cells.expand(near, c.parts)
    assert list(zip(row, cell, part)) == [(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 1, 2), (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 0, 0)]


def test_many_vectors_of_one_direction_tie_by_id(spark, vectors):
    """A third of all records point one way, with other lengths: the k smallest ids are the hits."""
    x, df = vectors
    rng = np.random.default_rng(3)
    rows = [(int(i), (x[5] * s).tolist(), "x") for i, s in zip(rng.permutation(np.arange(2_000, 2_400)), rng.uniform(0.2, 5, 400))]
    q = spark.createDataFrame([("a", x[5].tolist(), 12), ("b", (x[5] * 2).tolist(), 300)], "id string, vector array<float>, k int")
    got = collections.defaultdict(list)
    for r in sorted(graph.most_similar(df.unionByName(spark.createDataFrame(rows, df.schema)), q, floor=0.95).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["id"])
    assert got["a"] == [5, *range(2_000, 2_011)] and got["b"] == [5, *range(2_000, 2_299)]


def test_sample_is_picked_out_in_the_scan(spark):
    df = spark.range(50_000)
    part = cells.sampled(df, 50_000, 4_000, sample=1_000)
    assert 1_000 <= part.count() <= 2_000 and cells.sampled(df, 900, 4_000, sample=1_000) is df
    first = [r[0] for r in df.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(1_000).collect()]
    assert set(first) <= {r[0] for r in part.collect()}


def test_cells_are_fitted_in_two_steps(spark, vectors):
    x, df = vectors
    good = df.where(is_valid(F.col("vector")) & F.col("id").isNotNull())
    c = cells.fit(good, 108, target=4, at_once=5)
    assert 20 <= len(c.centroids) <= 36 and np.allclose(np.linalg.norm(c.centroids, axis=1), 1, atol=1e-5)
    home = c.near(x, 1)[:, 0]
    assert np.bincount(home).max() <= 20 and all(len(set(home[i : i + 8])) <= 3 for i in range(0, 48, 8))


# ---- 2


def multiset(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        out.append(base)
        for kind in range(3):
            t = list(base)
            if kind == 0:
                t[rng.randrange(len(t))] = "other"
            elif kind == 1:
                t.insert(rng.randrange(len(t)), "more")
            else:
                cut = rng.randrange(len(t))
                t = t[cut:] + t[:cut]
            out.append(t)
    return out


def test_near_duplicates(spark):
    texts = edited()
    chunk = [" ".join(t) for t in texts]
    rows = [(i, c, None) for i, c in enumerate(chunk)] + [(900, None, None), (901, "!", None), (902, "too short", None), (None, chunk[0], None), (903, chunk[0].upper(), None)]
    df = spark.createDataFrame(rows + rows[:5], "id bigint, chunk string, vector array<float>").withColumn("canon", canonical(F.col("chunk")))
    got = {(r[0], r[1]): (r[2], r[3]) for r in df.transform(omh.near_duplicates).collect()}
    every = [(i, t) for i, t in enumerate(texts)] + [(903, texts[0])]
    key = lambda t: "".join(t)
    want = {(i, j) for n, (i, a) in enumerate(every) for j, b in every[n + 1 :] if key(a) != key(b) and multiset(a, b) >= 0.8}
    assert set(got) == want
    assert all(abs(s - multiset(texts[i if i < 900 else 0], texts[j if j < 900 else 0])) < 1e-9 and e <= s for (i, j), (s, e) in got.items())
    assert omh.near_duplicates(df.limit(0)).count() == 0


def test_same_words_in_other_fields_are_near_duplicates(spark):
    w = [f"w{i}" for i in range(12)]
    chunk = [" ".join(w), " ".join(w[:2]) + "|" + " ".join(w[2:]), w[0] + "|" + " ".join(w[1:]), " ".join(w).upper()]
    df = spark.createDataFrame([(i, c, None) for i, c in enumerate(chunk)], "id bigint, chunk string, vector array<float>").withColumn("canon", canonical(F.col("chunk")))
    got = omh.near_duplicates(df).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)] and all(r["similarity"] == r["edit"] == 1 for r in got)


def test_equal_vectors_of_blank_records(spark, vectors):
    x, _ = vectors
    rows = [(i, None if i % 5 == 0 else "some text here", v.tolist()) for i, v in enumerate(x)]
    rows += [(700 + i, "  ", (v * 3 + 0.001).tolist()) for i, v in enumerate(x[:20])]
    df = spark.createDataFrame(rows, "id bigint, chunk string, vector array<float>").withColumn("canon", canonical(F.col("chunk")))
    v = {r[0]: np.array(r[2], float) for r in rows}
    blank = {r[0] for r in rows if r[1] is None or not r[1].strip()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = {(a, b) for a in v for b in v if a < b and (a in blank or b in blank) and cos(np.float32(v[a]).astype(float), np.float32(v[b]).astype(float)) >= 0.99}
    assert {(r[0], r[1]) for r in omh.near_duplicates(df).collect()} == want and want


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (p == q))
        got = omh.align(a[None].astype(np.int64), b[None].astype(np.int64), band=12)[0]
        assert got == table[-1, -1]


def test_alignment_of_sorted_words():
    rng = np.random.default_rng(1)
    for n in (12, 40, 90, 700):
        a = [np.sort(rng.choice(2**61, n, replace=False)) for _ in range(20)]
        b = [np.concatenate([x[rng.random(n) < 0.93], rng.integers(0, 2**61, rng.integers(0, n // 16 + 1))]) for x in a]
        b = [rng.permutation(x) for x in b]
        la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        got = omh.align_sorted(omh.padded(np.concatenate(a), la, -1), omh.padded(np.concatenate(b), lb, -2), la, lb, 0.8)
        want = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b)])
        ok = want / (la + lb - want) >= 0.8
        assert (got[ok] == want[ok]).all() and ok.any() and (got <= want).all()


def test_ordered_sketches_keep_the_text_order():
    rng = np.random.default_rng(2)
    words_ = rng.integers(1, 2**60, (200, 30)).astype(np.uint64)
    edited_ = words_.copy()
    edited_[:, 5] = rng.integers(1, 2**60, 200)
    shuffled = rng.permuted(words_, axis=1)
    sizes = np.full(200, 30)
    one, two, three = (omh.sketch(x.ravel(), sizes)[0] for x in (words_, edited_, shuffled))
    same = lambda a, b, part: (a[:, part] == b[:, part]).any(axis=1).mean()
    ordered, unordered = slice(0, omh.ORDERED), slice(omh.ORDERED, None)
    assert same(one, two, ordered) > 0.99 and same(one, three, ordered) < 0.05 and same(one, three, unordered) == 1
    # the same k-mers in another order: the same minima, another sketch
    mers = rng.integers(1, 2**60, (200, 12)).astype(np.uint64)
    n = np.full(200, 12)
    assert (omh.minima(mers.ravel(), n, 2, 5, False) == omh.minima(mers[:, ::-1].ravel(), n, 2, 5, False)).all()
    assert not (omh.minima(mers.ravel(), n, 2, 5, True) == omh.minima(mers[:, ::-1].ravel(), n, 2, 5, True)).any()


def test_pairs_are_decided_by_alignment(spark):
    w = list(range(100, 130))
    rows = [(0, 1, w, w[:14] + [7] + w[15:]), (0, 2, w, w[10:] + w[:10]), (0, 3, w, w[:15] + list(range(500, 515))), (4, 5, list(range(40_000)), list(range(1, 40_001)))]
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, wa array<bigint>, wb array<bigint>")
    got = {r["b"]: (round(r["similarity"], 4), round(r["edit"], 4)) for r in omh.verify(pairs, 0.8).collect()}
    assert got == {1: (round(29 / 31, 4), round(29 / 31, 4)), 2: (1.0, got[2][1]), 5: (round(39_999 / 40_001, 4), round(39_999 / 40_001, 4))} and got[2][1] < 0.8


def test_near_groups_are_those_of_the_pairs(spark, vectors):
    x, _ = vectors
    texts = edited()
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)] + [(300 + i, " ".join(texts[0]).upper(), None) for i in range(5)] + [(320, " ".join(texts[0][:3]) + "|" + " ".join(texts[0][3:]), x[0].tolist())]
    rows += [(400 + i, None if i % 3 == 0 else "short", (v * 1.0).tolist()) for i, v in enumerate(x[:20])] + [(450 + i, None if i % 2 else "short", x[0].tolist()) for i in range(6)]
    df = spark.createDataFrame(rows + rows[:4], "id bigint, chunk string, vector array<float>").withColumn("canon", canonical(F.col("chunk")))
    pairs = {(r[0], r[1]) for r in omh.near_duplicates(df).collect()}
    label, links = {}, collections.Counter()
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    got = {r["id"]: (r["group_id"], r["links"]) for r in omh.near_groups(df).collect()}
    assert got == {i: (label[i], links[i]) for i in label}
    assert omh.near_groups(df.limit(0)).count() == 0


def test_groups(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "id_a bigint, id_b bigint")
    got = {r["id"]: (r["group_id"], r["links"]) for r in omh.groups(pairs).collect()}
    assert got[20] == (0, 1) and got[7] == (0, 2) and got[51] == (50, 1) and len(got) == 23


# ---- 3


def test_clusters(spark, vectors):
    x, df = vectors
    rows = markov.clusters(df, floor=0.90).collect()
    s = x.astype(float) @ x.astype(float).T >= 0.9
    assert len(rows) == len(x) and len({r["id"] for r in rows}) == len(x)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["cluster_id"]].add(r["id"])
    for c, m in by.items():
        assert c == min(m)
        whole = all(set(np.nonzero(s[i])[0]) == m for i in m)
        assert {r["whole"] for r in rows if r["cluster_id"] == c} == {whole}
        assert sum(r["typical"] for r in rows if r["cluster_id"] == c) == min(3, len(m))
    assert sorted(len(m) for m in by.values())[-6:] == [8] * 6
    assert markov.clusters(df.limit(0), floor=0.9).count() == 0


def test_cluster_with_a_neighbour_outside_is_not_whole(spark):
    rng = np.random.default_rng(0)
    base = unit(rng.standard_normal((1, DIM)))
    near = unit(base + 0.01 * rng.standard_normal((6, DIM)))
    side = unit(rng.standard_normal((1, DIM)))
    side = unit(side - (side @ base.T) * base)
    bridge = unit(base * np.cos(0.44) + side * np.sin(0.44))  # within the floor of some members only
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([near, bridge]))], "id bigint, vector array<float>")
    s = np.concatenate([near, bridge]).astype(float)
    alike = s @ s.T >= 0.9
    rows = {r["id"]: r for r in markov.clusters(df, floor=0.9).collect()}
    assert all(r["whole"] == all(set(np.nonzero(alike[i])[0]) == {j for j, o in rows.items() if o["cluster_id"] == r["cluster_id"]} for i in [k for k, o in rows.items() if o["cluster_id"] == r["cluster_id"]]) for r in rows.values())


def test_parts_of_a_cell_are_linked(spark, vectors, monkeypatch):
    x, df = vectors
    fitted = cells.fit
    monkeypatch.setattr(cells, "fit", lambda v, rows, **k: fitted(v, rows, cap=30, **k))
    rows = markov.clusters(df, floor=0.90).collect()
    sizes = collections.Counter(r["cluster_id"] for r in rows if r["id"] < 48)
    assert sizes == dict.fromkeys(range(0, 48, 8), 8)
    assert all(r["whole"] for r in rows if r["id"] < 48)  # also where a part holds one member only


def test_group_over_many_cells_is_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    group = unit(unit(rng.standard_normal((1, DIM))) + 0.02 * rng.standard_normal((120, DIM)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([group, unit(rng.standard_normal((60, DIM)))]))], "id bigint, vector array<float>")
    fitted = cells.fit
    monkeypatch.setattr(cells, "fit", lambda v, rows, **k: fitted(v, rows, target=15, **k))
    rows = [r for r in markov.clusters(df, floor=0.90).collect() if r["id"] < 120]
    assert {(r["cluster_id"], r["size"], r["whole"]) for r in rows} == {(0, 120, True)} and len(rows) == 120


def test_flow_keeps_records_near_many_landmarks(spark):
    edges = spark.createDataFrame([(i, 1000 + j, 0.95) for i in range(30) for j in range(60)] + [(1000 + j, 1000 + j, 1.0) for j in range(60)], "id bigint, landmark bigint, weight double")
    near = spark.createDataFrame([(1000 + i, 1000 + j) for i in range(60) for j in range(60) if i != j], "id bigint, landmark bigint")
    m = markov.flow(markov.start(edges, markov.assigned(edges), near))
    assert len({r["cluster"] for r in markov.attracted(m).where("id < 30").collect()}) == 1


def test_rounds_of_flow_decide_the_clusters(spark):
    """Two dense groups and a record between them that is near some of both: the flow parts them, without its rounds there are no groups."""
    rng = np.random.default_rng(2)
    a, side = unit(rng.standard_normal((2, DIM)))
    side = unit((side - (side @ a) * a)[None])[0]
    turned = lambda angle: np.cos(angle) * a + np.sin(angle) * side
    x = np.concatenate([unit(turned(0)[None] + 0.012 * rng.standard_normal((9, DIM))), unit(turned(0.80)[None] + 0.012 * rng.standard_normal((9, DIM))), turned(0.40)[None]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(x))], "id bigint, vector array<float>")
    s = unit(x).astype(float) @ unit(x).astype(float).T >= 0.9
    assert not s[:9, 9:18].any() and s[18, :9].any() and s[18, 9:18].any()
    edges = spark.createDataFrame([(i, i // 9 * 9, 0.95 if i % 9 else 1.0) for i in range(18)] + [(18, 0, 0.92), (18, 9, 0.91)], "id bigint, landmark bigint, weight double")
    own, none = markov.assigned(edges), spark.createDataFrame([], "id bigint, landmark bigint")
    groups = lambda n: {r["id"]: r["cluster"] for r in markov.attracted(markov.flow(markov.start(edges, own, none), rounds=n)).collect()}
    assert groups(40) == {i: i // 9 * 9 for i in range(18)} | {18: 0}
    assert groups(0) != groups(40) and len(set(groups(0).values())) > 2
    rows = markov.clusters(df, floor=0.9).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["cluster_id"]].add(r["id"])
    assert set(range(18)) <= set().union(*by.values()) and not any({0, 9} <= m for m in by.values())
    assert len(markov.clusters(df, floor=0.9, rounds=0).select("cluster_id").distinct().collect()) > len(by)


# ---- 4


def test_varied_subset(spark, vectors):
    x, df = vectors
    records = df.withColumn("chunk", F.when(F.col("id") % 3 == 0, F.md5(F.col("id").cast("string"))))
    got = [r["id"] for r in facility.varied_subset(records, count=20).collect()]
    assert len(got) == len(set(got)) == 20
    groups = collections.Counter(i // 8 for i in got if i < 48)
    assert len(groups) == 6 and max(groups.values()) <= 2  # every dense group has one, none has many
    assert facility.varied_subset(records.limit(0), share=0.5).count() == 0
    assert facility.varied_subset(records, count=10_000).count() == records.where("id IS NOT NULL").select("id").distinct().count()


def test_large_group_gets_no_more_than_its_share(spark):
    """A dense group of many more records than a task orders at once has a few picks only, the others go to scattered records."""
    rng = np.random.default_rng(4)
    group = unit(unit(rng.standard_normal((1, DIM))) + 0.02 * rng.standard_normal((600, DIM)))
    x = np.concatenate([group, unit(rng.standard_normal((200, DIM)))])
    records = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "id bigint, vector array<float>, chunk string")
    got = [r["id"] for r in facility.varied_subset(records, count=60, part=100, coarse=40).collect()]
    assert len(set(got)) == 60 and 1 <= sum(i < 600 for i in got) <= 6


def test_lazy_greedy_equals_greedy():
    rng = np.random.default_rng(0)
    s = rng.random((40, 40)).astype(np.float32)
    s = np.maximum(s, s.T)
    np.fill_diagonal(s, 1)
    w = rng.integers(1, 5, 40).astype(np.float32)
    best, want = np.zeros(40, np.float32), []
    for _ in range(10):
        gain = np.maximum(s - best, 0) @ w
        gain[want] = -1
        want.append(int(gain.argmax()))
        best = np.maximum(best, s[want[-1]])
    assert facility.greedy(s, w, 10, np.arange(40))[0] == want


def test_largest(spark):
    df = spark.createDataFrame([(i, float(i // 10)) for i in range(200)], "id bigint, gain double")
    got = {r[0] for r in facility.largest(df, 25, bins=4).collect()}
    assert len(got) == 25 and set(range(180, 200)) <= got <= set(range(170, 200))


# ---- 5


def test_trie():
    t = radix.Trie()
    keys = [b"abc", b"ab", b"abd", b"", b"x", b"abc", b"ab", b"abcd"]
    slots = [t.slot(k) for k in keys]
    assert [slots[i] == slots[j] for i in range(8) for j in range(8)] == [keys[i] == keys[j] for i in range(8) for j in range(8)]


@pytest.mark.parametrize("limit", [{"fits": 5}, {"most": 6_000}])
def test_texts_with_a_long_common_beginning_are_split(spark, limit):
    texts = ["licence " * 40 + str(i % 30) for i in range(90)] + ["licence " * 40] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, canon string")
    partial = df.select("id", F.encode("canon", "UTF-8").alias("key"), F.md5("canon").alias("code"))
    sizes = [(r["n"], r["bytes"], r["texts"]) for r in radix.buckets(partial, **limit).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes"), F.count_distinct("key").alias("texts")).collect()]
    assert all(t == 1 or (n <= limit.get("fits", 99) and b <= limit.get("most", 10**6)) for n, b, t in sizes) and len(sizes) > 1
    got = {r["id"]: (r["keep"], r["copies"]) for r in radix.collapse(df, **limit).collect()}
    assert got == {i: (i % 30, 3) for i in range(90)} | {i: (90, 3) for i in range(90, 93)}


@pytest.mark.parametrize("fits", [2, 50, 20_000])
def test_collapse(spark, fits):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["long" * 5 + str(i % 3) for i in range(30)] + ["hot"] * 200
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(9000, None, 1), (9001, "", 1), (None, "ab", 1)]
    df = spark.createDataFrame(rows + rows[:50], "id bigint, canon string, bucket int")
    got = {r["id"]: (r["keep"], r["copies"]) for r in radix.collapse(df, fits=fits).collect()}
    by = collections.defaultdict(list)
    for i, t in enumerate(texts):
        by[t].append(i)
    assert got == {i: (by[t][0], len(by[t])) for i, t in enumerate(texts)}
    assert radix.collapse(df.limit(0)).count() == 0


# ---- 6


def test_loser_tree():
    rng = random.Random(0)
    for runs in (1, 2, 3, 7, 16):
        data = [sorted(rng.randint(0, 50) for _ in range(rng.randint(1, 30))) for _ in range(runs)]
        tree, at, out = topn.LoserTree([d[0] for d in data]), [0] * runs, []
        while tree.heads[tree.top] is not None:
            r = tree.top
            out.append(tree.heads[r])
            at[r] += 1
            tree.heads[r] = data[r][at[r]] if at[r] < len(data[r]) else None
            tree.replay()
        assert out == list(heapq.merge(*data))


@pytest.mark.parametrize("fan", [1_024, 2])
def test_top_n(spark, fan):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", "x"]), rng.randint(0, 60), rng.choice([0.5, 0.25, rng.random()])) for _ in range(3000)]
    rows += [("a", None, 1.0), (None, 1, 1.0), ("a", 1, float("nan")), ("a", 2, float("inf")), ("a", 3, None)]
    items = spark.createDataFrame([(*r, 1) for r in rows], "grp string, id bigint, score double, run int").repartition(7)
    groups = spark.createDataFrame([("a", 5), ("a", 5), ("b", None), ("hot", 0), ("none", 3), (None, 4)], "grp string, n int")
    got = sorted((r["grp"], r["rank"], r["id"], r["score"]) for r in topn.top_n(items, groups, fan=fan).collect())
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and np.isfinite(s):
            best[g, i] = max(best.get((g, i), -1), s)
    want = []
    for g, n in (("a", 5), ("b", 10), ("hot", 10)):
        order = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        want += [(g, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == sorted(want)
    assert topn.top_n(items.limit(0), groups).count() == 0 and topn.top_n(items, groups.limit(0)).count() == 0


# ---- 7


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_word_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (200, 6)), rng.integers(0, 3, (200, 6))
    got = leak.distance(a, b, 2)
    assert got.tolist() == [min(3, edit_distance(x, y)) for x, y in zip(a.tolist(), b.tolist())]


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [rng.choice(vocabulary) for _ in range(22)]) for i in range(25)]
    docs = []
    for d in range(120):
        t = [rng.choice(vocabulary) for _ in range(40)]
        _, w = rng.choice(items)
        at = rng.randrange(10)
        passage = w[at : at + 12]
        if d % 3 == 1:
            passage[5] = "changed"
        t[10:10] = passage
        docs.append((d, "  ".join(x.upper() if d % 2 else x + "," for x in t)))
    texts = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(500, None, 1), (501, "", 1), (None, docs[0][1], 1)] + [(d, t, 1) for d, t in docs[:5]], "id bigint, text string, item int")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "few words")], "item bigint, text string")

    def brute(edits):
        out = {}
        for d, t in docs:
            w = WORD.findall(t.lower())
            for i, v in items:
                far = min((edit_distance(w[p : p + 12], v[q : q + 12]) for p in range(8, 13) for q in range(len(v) - 11)), default=99)
                if far <= edits:
                    out[d, i] = far
        return out

    assert {(r["id"], r["item"]) for r in leak.leaks(texts, asked).collect()} == {k for k, v in brute(0).items() if v == 0}
    assert {(r["id"], r["item"]) for r in leak.leaks(texts, asked, at_once=4).collect()} == {k for k, v in brute(0).items() if v == 0}
    near = {(r["id"], r["item"]): r["edits"] for r in leak.leaks(texts, asked, edits=1).collect()}
    want = brute(1)
    assert set(near) <= set(want) | set(near) and len(set(near) & set(want)) >= 0.97 * len(want)
    assert leak.leaks(texts.limit(0), asked).count() == 0 and leak.leaks(texts, asked.limit(0)).count() == 0


def test_leaks_with_words_added_and_left_out(spark):
    rng = random.Random(5)
    items = [(i, [f"v{rng.randrange(300)}" for _ in range(20)]) for i in range(20)]
    docs = []
    for d in range(90):
        w = list(items[d % 20][1])
        at = rng.randrange(9, 11) if d % 3 else rng.randrange(1, 11)
        if d % 3 == 0:
            w = w[4:16]
            del w[at]
        elif d % 3 == 1:
            w.insert(at, "added")
        else:
            del w[at]
        docs.append((d, ["x"] * 5 * (d % 2) + w + ["y"] * 5 * (d % 2)))
    windows = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    want = {}
    for d, t in docs:
        i, w = items[d % 20]
        want[d, i] = min(edit_distance(a, b) for n in (11, 12, 13) for a in windows(t, n) for b in windows(w, 12))
    assert set(want.values()) == {1}
    texts = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "id bigint, text string")
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item bigint, text string")
    got = {(r["id"], r["item"]): r["edits"] for r in leak.leaks(texts, asked, edits=1).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and set(got.values()) == {1}
    old, new = np.array([[1, 2, 3, 4]] * 3), np.array([[1, 2, 4, 5, 6], [1, 2, 9, 3, 4], [1, 2, 3, 4, 4]])
    assert leak.distance(new, old, 1).tolist() == [2, 1, 1] and leak.distance(old, new, 1).tolist() == [2, 1, 1]


def test_samples_of_walks_part_and_find_windows():
    """No key takes a large share of random windows, and repetitions find windows one edit away."""
    rng = np.random.default_rng(0)
    a = rng.integers(1, 5_000, (4_000, 12))
    every = np.arange(len(a))
    changed = a.copy()
    changed[every, rng.integers(0, 12, len(a))] = 9_999
    shorter = np.array([np.delete(w, rng.integers(0, 12)) for w in a])
    longer = np.array([np.insert(w, rng.integers(0, 13), 9_999) for w in a])
    found = {n: np.zeros(len(a), bool) for n in ("changed", "shorter", "longer")}
    for r in range(leak.repetitions(1, 0.99)):
        k = leak.keys(a, r, 12)
        assert np.unique(k, return_counts=True)[1].max() <= 0.01 * len(a)
        for n, b in (("changed", changed), ("shorter", shorter), ("longer", longer)):
            found[n] |= k == leak.keys(b, r, 12)
    assert all(f.mean() >= 0.99 for f in found.values())


# ---- 8


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != list(range(1000))


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([" Big", "big", "big ", "MID", "small"]) if i % 9 else "small", rng.randint(0, 3000), "x") for i in range(900)]
    rows += [(2000, None, 5, "x"), (2001, "  ", 5, "x"), (2002, "big", None, "x"), (None, "big", 7, "x")]
    docs = spark.createDataFrame(rows + rows[:10], "id bigint, source string, size bigint, plan string")
    targets = [(1, 0.5, "big", 0.5, 1), (1, 0.5, "mid", 0.3, 2), (1, 0.5, "small", 0.2, 1), (2, 2.0, "mid", 0.9, 3), (2, 2.0, "none", 0.1, 3), (None, 1.0, "big", 1.0, 1)]
    t = spark.createDataFrame(targets, "plan int, ratio double, source string, share double, repeats int")
    copies, report = mixing.mix(docs, t, block=256)
    size = collections.Counter()
    for i, s, n, _ in rows:
        if i is not None and s and s.strip() and n is not None:
            size[s.strip().lower()] += n
    total = sum(size.values())
    got = {(r["plan"], r["source"]): r for r in report.collect()}
    assert len(got) == 5
    for plan, ratio, source, share, repeats in targets[:-1]:
        r = got[plan, source]
        want = share * ratio * total
        assert r["out_of_reach"] == (want > repeats * size[source]) and r["available"] == repeats * size[source]
        assert abs(r["reached"] - min(want, repeats * size[source])) <= 512
    assert abs(sum(r["reached_share"] for (p, _), r in got.items() if p == 1) - 1) < 1e-9
    assert max(r["times"] for r in copies.where("plan = 2").collect()) <= 3
    by = {i: n for i, _, n, _ in rows}
    assert all(r["tokens"] <= r["times"] * by[r["id"]] for r in copies.collect())
    empty, none = mixing.mix(docs.limit(0), t)
    assert empty.count() == 0 and none.count() == 5 and mixing.mix(docs, t.limit(0))[1].count() == 0


def test_shards_use_up_the_slots():
    slots = np.array([1000, 3, 0, 77_777], np.int64)
    shards = 77
    first, n = zip(*(mixing.shard_counts(slots, shards, i, [1, 2]) for i in range(shards)))
    assert (np.sum(n, axis=0) == slots).all()
    assert (np.array(first)[1:] == np.cumsum(n, axis=0)[:-1]).all()
    assert {int(x.sum()) for x in n} <= {int(slots.sum()) // shards, int(slots.sum()) // shards + 1}


def test_out_of_reach_is_what_was_drawn(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", 100 + i) for i in range(200)], "id bigint, source string, size bigint")
    t = spark.createDataFrame([(1, 1.0, "a", 0.5, 3), (1, 1.0, "b", 0.5, 1), (2, 1.0, "c", 1.0, 2), (3, 0.2, "a", 1.0, 0)], "plan int, ratio double, source string, share double, repeats int")
    flags = lambda: {(r["plan"], r["source"]): r["out_of_reach"] for r in mixing.mix(docs, t, block=64)[1].collect()}
    assert flags() == {(1, "a"): False, (1, "b"): True, (2, "c"): True, (3, "a"): True}
    monkeypatch.setattr(mixing, "plan_sources", lambda *a: {})  # nothing is drawn
    assert flags()[1, "b"] is False


# ---- 9


def brute_spans(docs, k):
    where = collections.defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - k + 1):
            where[t[i : i + k]].add(d)
    out = set()
    for d, t in docs:
        mark = [False] * len(t)
        for i in range(len(t) - k + 1):
            if len(where[t[i : i + k]]) > 1:
                mark[i : i + k] = [True] * k
        i = 0
        while i < len(t):
            if mark[i]:
                j = i
                while j < len(t) and mark[j]:
                    j += 1
                out.add((d, i, j))
                i = j
            else:
                i += 1
    return out


def test_shared_spans(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common = [text(n) for n in (60, 75, 29, 30, 31, 200)]
    docs = []
    for d in range(80):
        t = text(rng.randint(0, 80))
        for c in rng.sample(common, rng.randint(0, 3)):
            a = rng.randint(0, 10)
            t += c[a:] + text(rng.randint(0, 20))
        docs.append((d, t))
    docs += [(100, docs[0][1] + "z"), (101, "aa" * 50), (102, "aa" * 40), (103, common[5]), (104, common[5][40:])]
    rows = [(d, t, 1) for d, t in docs] + [(200, None, 1), (201, "", 1), (None, docs[0][1], 1)]
    df = spark.createDataFrame(rows + rows[:7], "id bigint, text string, seed int")
    got = {(r["id"], r["start"], r["end"]) for r in spans.shared_spans(df, span=30).collect()}
    assert got == brute_spans(docs, 30)
    share = {r["id"]: r for r in spans.shares(df, spans.shared_spans(df, span=30)).collect()}
    assert share[103]["share"] == 1.0 and share[200]["share"] == 0.0 and share[201]["n_chars"] == 0
    assert spans.shared_spans(df.limit(0), span=30).count() == 0
    whole = [r for r in spans.passages(df, span=30).collect() if r["id"] == 104]
    assert max(r["end"] - r["start"] for r in whole) == 160 and all(0 < r["identity"] <= 1 for r in whole)


def test_chain_takes_ordered_matches():
    x, y = np.array([0, 10, 20, 30]), np.array([100, 110, 5, 130])
    root, score = spans.chain(x, y, 10)
    assert root[0] == root[1] == root[3] and root[2] == 2 and score[3] > score[1] > score[0]


def test_spans_come_from_chains(spark):
    """With each match left alone nothing is found; a lone common seed is no span."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long, short = text(120), text(12)
    docs = [(0, text(40) + long + text(30)), (1, text(10) + long), (2, text(50) + short + text(50)), (3, short + text(80))]
    df = spark.createDataFrame(docs, "id bigint, text string")
    assert {(r["id"], r["start"], r["end"]) for r in spans.shared_spans(df, span=30).collect()} == brute_spans(docs, 30) != set()
    good, k = df.select("id", "text"), 6
    found = spans.run_matches(good, spans.runs(good, spans.common_seeds(spans.seeds(good, 15, k, 30)), 30, k), 30)
    assert spans.aligned(good, spans.chains(found, k), 30, k).count() > 0 == spans.aligned(good, spans.chains(found, k, link=lambda x, y, k, gap: (np.arange(len(x)), np.full(len(x), float(k)))), 30, k).count()
    lone = spark.createDataFrame([(0, 1, 5, 70)], found.schema)
    assert spans.chains(lone, k).count() == 0
    kept = spans.chains(spark.createDataFrame([(0, 1, i, i) for i in range(0, 90, 9)], "id bigint, other bigint, pos int, other_pos int"), 6).collect()
    assert len(kept) == 1 and kept[0]["seeds"] == 10 and [tuple(d) for d in kept[0]["diagonals"]] == [(0, 87, 0)]


def test_window_that_many_texts_have_in_other_surroundings(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    window = text(30)
    docs = [(d, text(rng.randint(5, 40)) + window + text(rng.randint(5, 40))) for d in range(60)]
    df = spark.createDataFrame(docs, "id bigint, text string")
    assert {(r["id"], r["start"], r["end"]) for r in spans.shared_spans(df, span=30).collect()} == brute_spans(docs, 30)


def test_passage_over_edits(spark):
    """One character in every 60 differs: no 300 characters agree, but the passage is found as one."""
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    base = text(1200)
    other = "".join("#" if i % 60 == 30 else c for i, c in enumerate(base))
    df = spark.createDataFrame([(0, text(100) + base), (1, other + text(50))], "id bigint, text string")
    assert spans.shared_spans(df).count() == 0
    got = [r for r in spans.passages(df).collect() if r["id"] == 1]
    assert max(r["end"] - r["start"] for r in got) >= 1100 and max(r["identity"] for r in got) > 0.95


def test_passages_of_all_texts_and_places(spark, monkeypatch):
    """A passage is reported for each two texts and for each place, whichever text has its seeds first; places of a seed meet in a grid."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    one, two = text(400), text(400)
    docs = [(0, one + text(50)), (1, text(60) + two), (2, text(20) + one + two + text(30)), (3, one + two), (4, text(70) + one + text(500) + one)]
    docs += [(5, text(10) + one[:200] + "#" + one[201:]), (5, two + text(80)), (6, text(600)), (7, None), (None, one)]
    df = spark.createDataFrame(docs + docs[:2], "id bigint, text string")
    for places in (2, 1000):
        monkeypatch.setattr(spans, "PLACES", places)
        got = [tuple(r) for r in spans.passages(df).collect()]
        place = {(a, b, s, e, os, oe) for a, b, s, e, os, oe, *_ in got}
        assert len(place) == len(got) and place == {(b, a, os, oe, s, e) for a, b, s, e, os, oe in place}
        size = collections.Counter((a, b) for a, b, s, e, *_ in got if e - s >= 390)
        ones, twos = {0, 2, 3, 4, 5}, {1, 2, 3, 5}
        assert set(size) == {(a, b) for has in (ones, twos) for a in has for b in has if a != b}
        assert size[0, 4] == size[4, 2] == 2 and [(s, e) for a, b, s, e, *_ in got if (a, b) == (2, 3)] == [(20, 820)]


def test_passages_hold_what_two_texts_share(spark):
    """What two texts share as it is lies in one of their passages, in texts that repeat themselves, too, and where no more than a span agrees."""
    rng = random.Random(13)
    text = lambda n, of="abcdefgh": "".join(rng.choice(of) for _ in range(n))
    common = [text(n) for n in (30, 30, 31, 33, 40, 90)]
    docs = [(d, "".join(text(rng.randint(0, 30)) + rng.choice(common) for _ in range(rng.randint(1, 4))) + text(rng.randint(0, 20))) for d in range(30)]
    docs += [(100, "ab" * 40), (101, text(9) + "ab" * 30), (102, "a" * 50), (103, "a" * 40 + text(20))]
    for span in (30, 10):
        got = collections.defaultdict(list)
        for r in spans.passages(spark.createDataFrame(docs, "id bigint, text string"), span=span).collect():
            got[r["id"], r["other"]].append((r["start"], r["end"]))
        pairs = [(a, b) for a in docs for b in docs if a[0] < b[0]]
        if span == 10:
            pairs = pairs[::5]
        for a, b in pairs:
            for windows, i, j in ((a[1], a[0], b[0]), (b[1], b[0], a[0])):
                rest = b[1] if i == a[0] else a[1]
                for p in range(len(windows) - span + 1):
                    if windows[p : p + span] in rest:
                        assert any(s <= p and p + span <= e for s, e in got[i, j])


def test_passage_aside_of_better_matches(spark):
    """A match off the diagonal that scores a little more doesn't hide the passage."""
    x, y = np.array([554, 590, 590, 690, 690, 728]), np.array([808, 784, 944, 784, 944, 982])
    assert [0, 4, 5] in [at.tolist() for at, _, _ in spans.candidates(x, y, 30, 160)]
    root, score = spans.paths(np.array([0, 40, 40]), np.array([0, 40, 200]), 30)
    assert root.tolist() == [0, 0, 2] and score[2] == 30


def test_common_subsequence():
    rng = random.Random(14)

    def brute(a, b):
        last = [0] * (len(b) + 1)
        for c in a:
            now = [0]
            for j, d in enumerate(b):
                now.append(max(now[-1], last[j + 1], last[j] + (c == d)))
            last = now
        return last[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) for _ in "ab")
        assert spans.common(a, b) == brute(a, b)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    a, b, c = text(200, "abcd"), text(300, "efgh"), text(300, "ijkl")  # what is added and left out is more than any band holds
    assert spans.common("x" + b + a + "y", "x" + a + c + "y") == 202
    a, b = text(150, "abcd") + text(300, "efgh"), text(200, "abcd") + text(250, "efgh")
    assert spans.common(a, b) == brute(a, b)


def test_group_in_many_cells_is_found(spark):
    """A dense group that is parted among dozens of cells, as groups are where there are many rows: a query finds its best in cells beyond the nearest."""
    rng = np.random.default_rng(11)
    g = unit(rng.standard_normal((1, 64)))
    near = lambda n: unit(g + 0.03 * rng.standard_normal((n, 64)))
    x = np.concatenate([near(3_000), unit(rng.standard_normal((3_000, 64)))])
    y = near(60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    q = spark.createDataFrame([(str(i), v.tolist(), 10) for i, v in enumerate(y)], "id string, vector array<float>, k int")
    s = np.round((1 + y.astype(float) @ x.astype(float).T) / 2, 6)
    true = {(str(i), int(j)) for i in range(60) for j in np.lexsort((np.arange(len(x)), -s[i]))[:10] if s[i, j] >= 0.95}
    got = {(r["query_id"], r["id"]) for r in graph.most_similar(df, q, floor=0.95, target=100).collect()}
    assert len(true) > 500 and len(true & got) >= 0.99 * len(true) and len(got - true) <= 0.01 * len(true)


def test_scan_of_a_shard_keeps_the_best():
    rng = np.random.default_rng(12)
    x, q, k = unit(rng.standard_normal((300, 64))), unit(rng.standard_normal((20, 64))), np.arange(1, 21)
    for floor in (None, 0.1):
        r, c = graph.scored(x, q, k, floor)
        for i, s in enumerate(q @ x.T):
            best = [j for j in np.argsort(-s)[: k[i]] if floor is None or s[j] >= floor]
            assert set(best) <= set(c[r == i])
