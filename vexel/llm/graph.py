"""Most similar vectors through a robust-pruned directed graph for each shard.

A shard is a part of a cell (see cells.py). Its graph is built by inserting vectors in growing batches: a greedy beam
search over the graph so far proposes neighbours, relaxed distance pruning keeps at most `degree` of them in differing
directions, reverse edges are added and overfull lists pruned again. A query walks the graph of each shard it is routed
to with a beam of the `beam` best vectors seen, opening a few of them at a time, until all are opened. All steps run on
arrays over many queries at once. Distances are 1 - cosine. Shards of further cells that are nearly as near to a query are
scored as a whole for it, which costs a fraction of a walk as they are small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as routing
from .common import cosine, is_valid, mix64, unit, vectors_of

#: Edges of a vector, beam of insertions and narrow beam of queries, relaxation of pruning, vectors opened at once, entry points.
DEGREE, BEAM, SEEK, ALPHA, OPEN, ENTRIES = 48, 64, 40, 1.2, 4, 256
#: Queries that walk at once: bounds the tables of seen vectors.
BLOCK = 512
#: Hits whose members are scored at once.
EXPANDED = 500_000
#: Vectors that a shard should hold; one with more than twice as many is split.
SHARD = 2_500
#: A query visits cells whose similarity is so much under the best one's, too, and no more cells than this in all.
MARGIN, MOST = 0.07, 32


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int, entries: np.ndarray, width: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
    """ids and similarities [queries, beam], best first; -1 and -inf where fewer were reached."""
    out_i, out_s = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        n = len(q)
        seen = np.zeros((n, len(x)), bool)
        slot = np.empty((n, len(x)), np.int16)
        seen[:, entries] = True
        s0 = q @ x[entries].T
        first = np.argsort(-s0, axis=1)[:, :beam]
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        ids[:, : first.shape[1]] = entries[first]
        sims[:, : first.shape[1]] = np.take_along_axis(s0, first, axis=1)
        opened = np.zeros((n, beam), bool)
        live = np.arange(n)
        while len(live):
            closed = ~opened[live] & (ids[live] >= 0)
            turn = closed & (np.cumsum(closed, axis=1) <= width)
            some = turn.any(axis=1)
            live, turn = live[some], turn[some]
            if not len(live):
                break
            opened[live] |= turn
            r, c = np.nonzero(turn)
            k = np.cumsum(turn, axis=1)[r, c] - 1
            cand = np.full((len(live), width, edges.shape[1]), -1, np.int32)
            cand[r, k] = edges[ids[live[r], c]]
            cand = cand.reshape(len(live), -1)
            r, c = np.nonzero(cand >= 0)
            v = cand[r, c]
            new = ~seen[live[r], v]
            r, c, v = r[new], c[new], v[new]
            slot[live[r], v] = c
            one = slot[live[r], v] == c  # a vector proposed twice in one step counts once
            r, c, v = r[one], c[one], v[one]
            seen[live[r], v] = True
            s = np.einsum("ij,ij->i", q[live[r]], x[v])
            better = s > sims[live[r], -1]
            r, v, s = r[better], v[better], s[better]
            if not len(r):
                continue
            # the new ones of each row side by side, then one sort with the beam
            count = np.bincount(r, minlength=len(live))
            pos = np.arange(len(r)) - (np.cumsum(count) - count)[r]
            width_now = int(count.max())
            all_s = np.full((len(live), beam + width_now), -np.inf, np.float32)
            all_i = np.full((len(live), beam + width_now), -1, np.int32)
            all_o = np.zeros((len(live), beam + width_now), bool)
            all_s[:, :beam], all_i[:, :beam], all_o[:, :beam] = sims[live], ids[live], opened[live]
            all_s[r, beam + pos], all_i[r, beam + pos] = s, v
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], opened[live] = (np.take_along_axis(a, order, axis=1) for a in (all_s, all_i, all_o))
        out_i[at : at + n], out_s[at : at + n] = ids, sims
    return out_i, out_s


def robust_prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """[rows, degree] of candidates sorted best first: keep one, drop those that are `alpha` times nearer to it than to the row."""
    rows, m = cand.shape
    d = 1 - sims
    v = x[np.maximum(cand, 0)]
    between = alpha * (1 - np.matmul(v, v.transpose(0, 2, 1)))
    alive = cand >= 0
    count = np.zeros(rows, np.int32)
    out = np.full((rows, degree), -1, np.int32)
    for j in range(m):
        keep = np.nonzero(alive[:, j] & (count < degree))[0]
        if not len(keep):
            continue
        out[keep, count[keep]] = cand[keep, j]
        count[keep] += 1
        alive[keep, j + 1 :] &= between[keep, j, j + 1 :] > d[keep, j + 1 :]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph of unit vectors x: edges [rows, degree] (-1: none) and the entry points of searches."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    done = min(n, 2 * degree)
    if n <= 1:
        return edges, order[:1]
    s = x[order[:done]] @ x[order[:done]].T
    np.fill_diagonal(s, -np.inf)
    first = np.argsort(-s, axis=1)[:, : done - 1]
    edges[order[:done]] = robust_prune(x, order[first], np.take_along_axis(s, first, axis=1), degree, alpha)
    entries = order[: min(n, ENTRIES)]
    while done < n:
        batch = order[done : done + min(done, BLOCK)]
        ids, sims = beam_search(x, edges, x[batch], beam, entries[: min(done, len(entries))])
        ids[ids == batch[:, None]] = -1
        edges[batch] = robust_prune(x, ids, sims, degree, alpha)
        r, c = np.nonzero(edges[batch] >= 0)
        to, start = edges[batch][r, c], batch[r]
        sort = np.lexsort((-np.einsum("ij,ij->i", x[to], x[start]), to))
        to, start = to[sort], start[sort]
        node, begin, count = np.unique(to, return_index=True, return_counts=True)
        pos = np.arange(len(to)) - np.repeat(begin, count)
        fits = pos < degree  # the nearest first; no more new edges than a list holds at once
        owner = np.repeat(np.arange(len(node)), count)[fits]
        cand = np.full((len(node), 2 * degree), -1, np.int32)
        cand[:, :degree] = edges[node]
        cand[owner, degree + pos[fits]] = start[fits]
        used = (cand >= 0).sum(axis=1)
        left = np.argsort(cand < 0, axis=1, kind="stable")
        cand = np.take_along_axis(cand, left, axis=1)
        easy = used <= degree
        edges[node[easy]] = cand[easy, :degree]
        if not easy.all():
            hard, full = node[~easy], cand[~easy]
            s = np.matmul(x[np.maximum(full, 0)], x[hard][:, :, None])[:, :, 0]
            s[full < 0] = -np.inf
            best = np.argsort(-s, axis=1)
            edges[hard] = robust_prune(x, np.take_along_axis(full, best, axis=1), np.take_along_axis(s, best, axis=1), degree, alpha)
        done += len(batch)
    return edges, entries


def search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, k: np.ndarray, floor: float | None, beam: int = SEEK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity): for each unit query its k best (k an array); with a floor those under it are left out.

    The beam holds 1.5 k + 24 vectors at least. Where a floor is given, a narrow beam comes first, and only queries
    whose whole beam is over the floor, which thus may lie in a dense group, go on with the wide one."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = np.arange(len(q))
    if floor is not None:
        ids, sims = beam_search(x, edges, q, beam, entries)
        wide = sims[:, -1] >= floor
        r, c = np.nonzero((sims >= floor) & (ids >= 0) & ~wide[:, None])
        out.append((r, ids[r, c], sims[r, c]))
        todo = np.nonzero(wide)[0]
    size = np.minimum(len(x), np.maximum(5 * beam if floor is not None else 2 * beam, (1.5 * k[todo]).astype(np.int64) + 24))
    size = np.minimum(len(x), 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for wide_beam in np.unique(size):
        own = todo[size == wide_beam]
        ids, sims = beam_search(x, edges, q[own], int(wide_beam), entries)
        r, c = np.nonzero((ids >= 0) & (sims >= (floor if floor is not None else -np.inf)) & (np.arange(wide_beam) < k[own][:, None] + 24))
        out.append((own[r], ids[r, c], sims[r, c]))
    return tuple(np.concatenate(a) for a in zip(*out))  # type: ignore[return-value]


SCORED = "id string, node bigint, score double"


def search_shards(key: tuple, data: pa.Table, queries: pa.Table, floor: float | None) -> pa.Table:
    """Builds the graph of one shard and walks it for the queries routed here. Scores are (1 + cosine) / 2 in double, rounded to 6."""
    empty = pa.table({"id": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not data.num_rows or not queries.num_rows:
        return empty
    order = np.argsort(data["id"].to_numpy())
    data = data.take(pa.array(order))
    raw, raw_q, ids = vectors_of(data["vector"]), vectors_of(queries["vector"]), data["id"].to_numpy()
    x, q, k = unit(raw), unit(raw_q), queries["k"].to_numpy()
    first, members, begin = directions(x)
    low = None if floor is None else 2 * floor - 1 - 1e-4
    whole = queries["other"].to_numpy() > 0 if "other" in queries.column_names else np.zeros(len(q), bool)
    walk, scan = np.nonzero(~whole)[0], np.nonzero(whole)[0]
    found = [(np.array([], np.int64), np.array([], np.int64))]
    if len(walk):
        edges, entries = build(x[first])
        r, v, _ = search(x[first], edges, entries, q[walk], k[walk], low)
        found.append((walk[r], v))
    if len(scan):
        r, v = scored(x[first], q[scan], k[scan], low)
        found.append((scan[r], v))
    r, v = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(r, kind="stable")
    r, v = r[order], v[order]
    count = np.diff(begin)[v]
    total, at = np.cumsum(count), 0
    out: list[tuple[np.ndarray, ...]] = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
    while at < len(r):  # some queries at once: all members of their nodes are scored, and the k best are kept
        stop = int(np.searchsorted(total, total[at] - count[at] + EXPANDED, "right"))
        stop = len(r) if stop >= len(r) else max(int(np.searchsorted(r, r[stop], "left")), int(np.searchsorted(r, r[at], "right")))
        n = count[at:stop]
        query = np.repeat(r[at:stop], n)
        row = members[np.repeat(begin[v[at:stop]], n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)]
        score = np.round((1 + np.minimum(1.0, cosine(raw_q[query], raw[row]))) / 2, 6)
        if floor is not None:
            ok = score >= floor
            query, row, score = query[ok], row[ok], score[ok]
        best = np.lexsort((ids[row], -score, query))
        query, row, score = query[best], row[best], score[best]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        out.append(tuple(c[place < k[query]] for c in (query, row, score)))
        at = stop
    r, v, score = (np.concatenate(c) for c in zip(*out))
    return pa.table({"id": queries["id"].take(pa.array(r)).cast(pa.string()), "node": pa.array(ids[v]), "score": pa.array(score)})


def scored(x: np.ndarray, q: np.ndarray, k: np.ndarray, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row): what may be among the k best of each unit query of all unit rows; with a floor those under it are left out."""
    out = []
    step = max(1, 8 * EXPANDED // len(x))
    for at in range(0, len(q), step):
        s, own = q[at : at + step] @ x.T, k[at : at + step]
        low = np.full(len(s), -np.inf if floor is None else floor, np.float32)
        many = np.nonzero((s >= low[:, None]).sum(1) > own)[0]
        for n in np.unique(own[many]):
            of = many[own[many] == n]
            low[of] = np.maximum(low[of], np.partition(s[of], len(x) - n, axis=1)[:, len(x) - n] - 1e-5)  # scores are rounded
        r, c = np.nonzero(s >= low[:, None])
        out.append((r + at, c))
    return tuple(np.concatenate(a) for a in zip(*out))  # type: ignore[return-value]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of (nearly) the same direction are one node of the graph: (a row of each node, rows by node, where each node's rows begin)."""
    key = np.ascontiguousarray(np.rint(x * 4_096).astype(np.int16)).view([("", np.int16)] * x.shape[1]).ravel()
    _, first, node, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, np.argsort(node, kind="stable"), np.concatenate([[0], np.cumsum(count)])


def most_similar(records: DataFrame, queries: DataFrame, *, floor: float | None = None, probes: int = 3, default_k: int = 10, target: int = SHARD) -> DataFrame:
    """records(id bigint, vector), queries(id string, vector, k int) -> (query_id string, id bigint, score double, rank int).

    For each query id with a valid vector the k best distinct record ids by (score descending, id ascending), where score
    is (1 + cosine) / 2 in double, rounded to 6; only scores >= floor if one is given. Approximate: a query visits the
    shards of its `probes` nearest cells, and of those within MARGIN of the nearest. k null or < 1 counts as default_k. Null ids and invalid vectors (null, wrong
    length, not finite, all zero) take no part on either side; a repeated id counts once. Equal vectors, and within a shard
    those of one direction, are one node of the graph and are expanded after the search, so their ties are exact. Empty tables give no rows. Further columns are ignored.
    """
    rows = records.where(F.col("id").isNotNull() & is_valid(F.col("vector"))).select("id", "vector")
    asked = queries.where(F.col("id").isNotNull() & is_valid(F.col("vector"))).groupBy("id").agg(F.min_by(F.struct("vector", "k"), F.struct(F.xxhash64("vector"), "k")).alias("x"))
    asked = asked.select("id", F.col("x.vector").alias("vector"), F.when(F.col("x.k") >= 1, F.col("x.k")).otherwise(default_k).alias("k"))
    cells = routing.fit(rows, records.count(), target=target, cap=2 * target)
    # Equal vectors, known by 128 bits of hash: the smallest id stands for all; salted first, as one vector may have a large
    # share of all rows. Vectors themselves are shuffled only for the ids that stand for themselves.
    keyed = rows.select("id", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
    salted = keyed.groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt")).agg(F.min("id").alias("id"))
    standing = salted.groupBy("h1", "h2").agg(F.min("id").alias("node"))
    nodes = rows.join(standing.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"])

    def group(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        return search_shards(key, data, queries, floor)

    at = ["cell", "part"]
    hits = routing.home(nodes, cells).groupBy(*at).cogroup(routing.visit(asked, cells, probes, "k int", margin=MARGIN, most=MOST).groupBy(*at)).applyInArrow(group, SCORED)
    # Copies of a node: no more of them can be hits than the largest k, so each node's list stays short.
    most = F.coalesce(F.lit(asked.agg(F.max("k")).first()[0]), F.lit(1))
    by_node = Window.partitionBy("node").orderBy("id")
    pairs = keyed.join(standing, ["h1", "h2"]).where(F.col("id") != F.col("node")).select("node", "id").distinct()
    copies = pairs.withColumn("n", F.row_number().over(by_node)).where(F.col("n") < most).groupBy("node").agg(F.collect_list("id").alias("others"))
    full = hits.select(F.col("id").alias("query_id"), "node", "score").join(copies, "node", "left")
    full = full.select("query_id", "score", F.explode(F.concat(F.array("node"), F.coalesce("others", F.array().cast("array<bigint>")))).alias("id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = full.withColumn("rank", F.row_number().over(best)).join(asked.select(F.col("id").alias("query_id"), "k"), "query_id")
    return ranked.where(F.col("rank") <= F.col("k")).select("query_id", "id", "score", "rank")
