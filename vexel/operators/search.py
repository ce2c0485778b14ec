"""Exact search: every request against every record, block by block.

Requests are sent to the tasks, at most QUERIES of them; each task scores its records with one matrix product and keeps the k
best of each request, shard or document over all its records, so only those are shuffled. More requests meet the records in a
grid of blocks of both. A window over the partial results gives the final ones. visiting() scores only the shards that each
request is routed to. Scores are reckoned in double and rounded to 6 decimals; ties go to the smaller global_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Requests sent to the tasks at once: about 5 MB of 64 components each.
QUERIES = 20_000
#: Scores reckoned at once in a task, and records that a task scores together where they are grouped.
CELLS, PART = 4_000_000, 50_000
#: Pairs of a query and a record scored in double together, and groups whose bounds a task remembers.
PAIRS, BOUNDS = 50_000, 256
HITS = "query_id string, shard_id int, parent_id bigint, global_id bigint, score double, k int"
METRICS = ("cosine", "dot", "euclidean")


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """[queries, rows] scores, rounded to 6 decimals."""
    s = q @ x.T
    if metric == "cosine":
        s /= np.sqrt((q * q).sum(1))[:, None]
        s /= np.sqrt((x * x).sum(1))[None]
    if metric == "euclidean":
        return np.round(1 / (1 + np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * s)), 6)
    return np.round((1 + s) / 2, 6)


def best(s: np.ndarray, k: np.ndarray, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k[row] largest values of each row and all that equal the last of them, not under its floor."""
    out = []
    for n in np.unique(k):
        own = np.nonzero(k == n)[0]
        part = s[own]
        keep = part >= np.partition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n][:, None] if n < part.shape[1] else np.ones(part.shape, bool)
        if floor is not None:
            keep &= part >= floor[own][:, None]
        r, c = np.nonzero(keep & np.isfinite(part))
        out.append((own[r], c))
    return tuple(np.concatenate(a) for a in zip(*out))  # type: ignore[return-value]


def above(s: np.ndarray, k: np.ndarray, low: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, low): the values of each row that reach its bound, low or, where higher, one less by `slack` than the k[row]-th largest, or than a bit less.

    Columns are taken together at first, and the k-th largest of their maxima is no larger than that of all; no full sort is needed."""
    n = s.shape[1]
    size = next((g for g in (16, 8, 4, 2) if n // g >= 2 * int(k.max())), 1)
    wide = n // size
    most = s[:, : wide * size].reshape(len(s), size, wide).max(axis=1) if size > 1 else s
    many = np.nonzero((most >= low[:, None]).sum(axis=1) > 1.5 * k)[0]
    low = low.copy()
    for m in np.unique(k[many]):
        own = many[k[many] == m]
        low[own] = np.maximum(low[own], np.partition(most[own], wide - m, axis=1)[:, wide - m] - np.float32(slack))
    r, c = np.nonzero(most >= low[:, None])
    if size > 1:
        c = c[:, None] + np.arange(size) * wide
        i, j = np.nonzero(s[r[:, None], c] >= low[r][:, None])
        r, c = r[i], c[i, j]
        r2, c2 = np.nonzero(s[:, wide * size :] >= low[:, None])
        r, c = np.concatenate([r, r2]), np.concatenate([c, c2 + wide * size])
    return r, c, low


def pair_cosines(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, length_q: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of query r[i] and record c[i], in double."""
    out = np.empty(len(r))
    for at in range(0, len(r), PAIRS):
        i, j = r[at : at + PAIRS], c[at : at + PAIRS]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", q[i], x[j]) / (length_q[i] * length[j])
    return out


def distinct_rows(b: pa.RecordBatch, by: str | None) -> pa.RecordBatch:
    """In order of (by, global_id), each id once: a record delivered twice must not take two of the k places."""
    ids = b.column("global_id").to_numpy()
    _, first = np.unique(ids, return_index=True)
    return b.take(pa.array(first if by is None else first[np.lexsort((ids[first], b.column(by).to_numpy()[first]))]))


def query_blocks(queries: DataFrame, size: int = QUERIES) -> Iterator[pa.Table]:
    """The queries in tables of about `size` rows at most."""
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        yield (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()


class Kept:
    """The best hits so far of each query, or of each query and shard, or the best record of each of the best documents of a query.

    Hits are added as arrays, batch by batch, and cut to the best whenever they have doubled, so no more of them are held,
    and leave the task, than the result may need, however many batches there are. Those of one batch are few already."""

    NAMES = ("row", "group", "global_id", "score")

    def __init__(self, limit: np.ndarray, by: str | None) -> None:
        self.limit, self.by = limit, by
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.next, self.batches = 0, 100_000, 0
        self.floor = np.full(len(limit), -np.inf)
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, group: int) -> np.ndarray:
        """For each query what above() has found out about a group so far, to be changed in place; not kept for too many groups."""
        known = self.bounds.get(group)
        if known is None:
            known = np.full(len(self.limit), -1e9, np.float32)
            if len(self.bounds) < BOUNDS:
                self.bounds[group] = known
        return known

    def batch(self) -> None:
        """Another batch begins."""
        self.batches += 1
        if self.batches > 1 and self.size >= self.next:
            self.cut()
            self.next = max(100_000, 2 * self.size)

    def add(self, *columns: np.ndarray) -> None:
        """row (of the query), group, global_id, score and any others; a higher score is better."""
        self.held.append(columns)
        self.size += len(columns[0])

    def rest(self) -> tuple[np.ndarray, ...]:
        return self.cut() if self.batches > 1 else tuple(np.concatenate(x) for x in zip(*self.held))

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return ()
        c = tuple(np.concatenate(x) for x in zip(*self.held))
        row, group, gid, score = c[:4]
        if self.by == "parent_id":  # a document's best record first, then the best documents
            order = np.lexsort((gid, -score, group, row))
            same = (row[order][1:] == row[order][:-1]) & (group[order][1:] == group[order][:-1])
            order = order[np.concatenate([[True], ~same])]
            order = order[np.lexsort((gid[order], -score[order], row[order]))]
            key = row[order]
        else:
            order = np.lexsort((gid, -score, group, row)) if self.by else np.lexsort((gid, -score, row))
            r, g, i = row[order], group[order], gid[order]
            # a record delivered twice has the same score, so its rows stand side by side
            once_ = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])])
            order = order[once_]
            key = row[order] if not self.by else np.cumsum(np.concatenate([[0], (row[order][1:] != row[order][:-1]) | (group[order][1:] != group[order][:-1])]))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
        place = np.arange(len(key)) - begin
        most = self.limit[row[order]]
        if self.by != "shard_id":
            last = place == most - 1
            self.floor[row[order][last]] = score[order][last]
        order = order[place < most]
        c = tuple(x[order] for x in c)
        self.held, self.size = [c], len(order)
        return c


def segments(group: np.ndarray | None, n: int) -> list[tuple[int, int]]:
    edge = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0].tolist() if group is not None else [0]
    return list(zip(edge, [*edge[1:], n]))


def scored_into(kept: Kept, b: pa.RecordBatch, q: np.ndarray, metric: str, floor: np.ndarray | None, bounds: tuple | None = None, allow: Callable | None = None, extra: np.ndarray | None = None) -> None:
    """Scores a batch of distinct rows, in order of kept.by, for all queries, and adds what may be among the best.

    allow(queries, their extra values, vectors, scores) -> which [queries, rows] may be hits at all.
    bounds(shard numbers in order, function of queries -> the highest score that a record of each shard can have): a shard
    whose bound is under a query's floor is not scored for it."""
    kept.batch()
    x, by = matrix(b.column("vector")), kept.by
    gid, shard, parent = (b.column(n).to_numpy(zero_copy_only=False) for n in ("global_id", "shard_id", "parent_id"))
    group = b.column(by).to_numpy() if by else (shard if bounds else None)
    parts = segments(group, len(x))
    if metric == "cosine" and bounds is None and by != "parent_id" and (allow is None or hasattr(allow, "near")):
        cosines_into(kept, x, q, gid, shard, parent, parts, floor, allow, extra)
        return
    step = max(1, CELLS // len(x))
    for at in range(0, len(q), step):
        end = min(at + step, len(q))
        low = kept.floor[at:end] if floor is None else np.maximum(kept.floor[at:end], floor[at:end])
        if by == "parent_id":
            s = scores(q[at:end], x, metric)
            edge = np.array([e0 for e0, _ in parts])
            r, g = best(np.maximum.reduceat(s, edge, axis=1), kept.limit[at:end], low)
            size = np.diff(np.append(edge, len(x)))
            c = np.empty(len(r), np.int64)
            for n in np.unique(size[g]):  # the first of the best records: the smallest id
                own = np.nonzero(size[g] == n)[0]
                c[own] = edge[g[own]] + s[r[own][:, None], edge[g[own]][:, None] + np.arange(n)].argmax(axis=1)
            kept.add(r + at, parent[c], gid[c], s[r, c], shard[c], parent[c])
            continue
        whole = scores(q[at:end], x, metric) if bounds is None else None
        if allow is not None:
            whole = np.where(allow(q[at:end], extra[at:end] if extra is not None else None, x, whole), whole, -np.inf)
        most = bounds[1](q[at:end]) if bounds else None
        for e0, e1 in parts:
            own = np.arange(end - at) if bounds is None else np.nonzero(most[:, np.searchsorted(bounds[0], group[e0])] >= low)[0]
            if not len(own):
                continue
            s = whole[:, e0:e1] if bounds is None else scores(q[at:end][own], x[e0:e1], metric)
            r, c = best(s, kept.limit[at:end][own], low[own])
            kept.add(own[r] + at, shard[e0:e1][c] if by else np.zeros(len(r), np.int64), gid[e0:e1][c], s[r, c], shard[e0:e1][c], parent[e0:e1][c])


def cosines_into(kept: Kept, x: np.ndarray, q: np.ndarray, gid: np.ndarray, shard: np.ndarray, parent: np.ndarray, parts: list, floor: np.ndarray | None, allow: Callable | None, extra: np.ndarray | None) -> None:
    """As scored_into() for cosines. The matrix product is one of floats; what may be among the best by it, with a slack for
    its error and for rounding, is scored in double. allow: with its .floor and .near (queries, extra, vectors)."""
    length, length_q = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    # The error of a product of unit vectors in floats is under components * 2 ** -24, and a bit for theirs; rounding may move 2e-6.
    slack = 4e-6 + 2 * (x.shape[1] + 8) * 2.0**-24
    x1, q1 = ((v / np.maximum(n, 1e-300)[:, None]).astype(np.float32) for v, n in ((x, length), (q, length_q)))
    bad = ~(np.isfinite(length) & (length > 0))
    step = max(1, CELLS // len(x))
    for at in range(0, len(q), step):
        end = min(at + step, len(q))
        s = q1[at:end] @ x1.T
        s[:, bad] = -np.inf
        if allow is not None:
            near = allow.near(q[at:end], extra[at:end] if extra is not None else None, x)
            s[~(near | (s >= np.float32(2 * allow.floor - 1 - slack)))] = -np.inf
        known = kept.floor[at:end] if floor is None else np.maximum(kept.floor[at:end], floor[at:end])
        for e0, e1 in parts:
            bound = kept.bound(int(shard[e0]) if kept.by else 0)
            low = np.maximum(np.maximum(bound[at:end], -3), 2 * known - 1 - slack).astype(np.float32)
            r, c, bound[at:end] = above(s[:, e0:e1], kept.limit[at:end], low, slack)
            c += e0
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round((1 + pair_cosines(q[at:end], x, r, c, length_q[at:end], length)) / 2, 6)
            ok = (score >= known[r]) & np.isfinite(score)
            if allow is not None:
                ok &= (score >= allow.floor) | near[r, c]
            r, c, score = r[ok], c[ok], score[ok]
            kept.add(r + at, shard[c] if kept.by else np.zeros(len(r), np.int64), gid[c], score, shard[c], parent[c])


def hits_of(kept: Kept, ids: pa.Array, own_k: np.ndarray) -> pa.RecordBatch:
    """HITS of what was kept."""
    c = kept.rest() or (np.array([], np.int64),) * 6
    r = c[0].astype(np.int64)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int64)), pa.array(c[2].astype(np.int64)), pa.array(c[3].astype(float)), pa.array(own_k[r].astype(np.int32))], names=["query_id", "shard_id", "parent_id", "global_id", "score", "k"])


def floors_of(t: pa.Table) -> np.ndarray | None:
    return np.nan_to_num(t["floor"].to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf) if "floor" in t.column_names else None


def candidates(vectors: DataFrame, queries: DataFrame, *, by: str | None = None, metric: str = "cosine", k: int | None = None, bounds: tuple | None = None, allow: Callable | None = None, block: int = QUERIES) -> DataFrame:
    """HITS: of each task's records the k best for each query, or for each query and shard (by="shard_id"); or the best
    record of each of the k best documents (by="parent_id"). queries(query_id, vector, k [, floor double] [, extra
    array<float> of one length]). bounds and allow (not both, nor allow by document): see scored_into(). With more than `block` queries, blocks of queries and of records meet in a grid."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    columns = ["query_id", "vector", "k", *(c for c in ("floor", "extra") if c in queries.columns)]
    asked, rows = queries.select(*columns), vectors.select("shard_id", "parent_id", "global_id", "vector")
    blocks = max(1, -(-asked.count() // block))

    def keep(t: pa.Table) -> tuple:
        own_k = t["k"].to_numpy().astype(np.int64)
        ids = t["query_id"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        extra = matrix(t["extra"]) if "extra" in columns else None
        return matrix(t["vector"]), ids, own_k, own_k if k is None else np.full(len(own_k), k), floors_of(t), extra

    def by_task(t: pa.Table, rows: DataFrame) -> DataFrame:
        q, ids, own_k, limit, floor, extra = keep(t)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Kept(limit, by)
            for b in batches:
                if b.num_rows and len(q):
                    scored_into(kept, distinct_rows(b, by or ("shard_id" if bounds else None)), q, metric, floor, bounds, allow, extra)
            yield from sliced(hits_of(kept, ids, own_k))

        return rows.mapInArrow(run, HITS)

    if blocks == 1:
        return by_query(by_task(asked.toArrow(), rows))
    if by == "shard_id":
        # Records are ranged by shard: a task has those of few shards, and sends on the best of these only.
        rows = rows.repartitionByRange(2 * vectors.sparkSession.sparkContext.defaultParallelism, "shard_id", "global_id")
        return by_query(reduce(DataFrame.unionByName, [by_task(t, rows) for t in query_blocks(asked, block)]))

    parts = max(1, -(-vectors.count() // PART))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", place("global_id", parts)).withColumn("block", every(blocks))
    right = asked.withColumn("block", place("query_id", blocks)).withColumn("part", every(parts))

    def pair(key: tuple, data: pa.Table, t: pa.Table) -> pa.Table:
        q, ids, own_k, limit, floor, extra = keep(t)
        kept = Kept(limit, by)
        if data.num_rows and len(q):
            scored_into(kept, distinct_rows(one_batch(data), by or ("shard_id" if bounds else None)), q, metric, floor, bounds, allow, extra)
        return pa.Table.from_batches([hits_of(kept, ids, own_k)])

    return by_query(left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(pair, HITS))


def by_query(hits: DataFrame) -> DataFrame:
    """Partial hits in partitions by query: telling repeated ids apart and ranking, by shard or over all, need no other shuffle."""
    return hits.repartition("query_id")


def one_batch(t: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns], names=t.column_names)


def sliced(b: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def visiting(vectors: DataFrame, routes: DataFrame, *, part: int = PART, block: int = QUERIES) -> DataFrame:
    """HITS and visited bigint: of each shard that a query is routed to its k best records; no other shard is scored.

    routes(query_id, vector, k, shard_id). Shards of more than `part` records, and of more than `block` queries, are cut
    into parts that all meet; visited: the records of the part that were scored for the query (on each of its rows)."""
    count = lambda df, size, name: df.groupBy("shard_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name))
    sizes = count(vectors, part, "parts").join(count(routes, block, "blocks"), "shard_id")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.select("shard_id", "parent_id", "global_id", "vector").join(sizes, "shard_id").withColumn("part", place("global_id", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    right = routes.select("shard_id", "query_id", "vector", "k").join(sizes, "shard_id").withColumn("block", place("query_id", "blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    at = ["shard_id", "part", "block"]

    def pair(key: tuple, data: pa.Table, t: pa.Table) -> pa.Table:
        own_k = t["k"].to_numpy().astype(np.int64) if t.num_rows else np.array([], np.int64)
        kept = Kept(own_k, None)
        n = 0
        if data.num_rows and t.num_rows:
            b = distinct_rows(one_batch(data.select(["shard_id", "parent_id", "global_id", "vector"])), None)
            n = b.num_rows
            scored_into(kept, b, matrix(t["vector"]), "cosine", None)
        hits = hits_of(kept, t["query_id"].combine_chunks() if t.num_rows else pa.array([], pa.string()), own_k)
        return pa.Table.from_batches([hits]).append_column("visited", pa.array(np.full(hits.num_rows, n, np.int64)))

    return by_query(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(pair, HITS + ", visited bigint"))


def ranked(hits: DataFrame, *keys: str) -> DataFrame:
    """Adds rank: by score descending, then global_id, within keys."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "global_id")))


def once(hits: DataFrame) -> DataFrame:
    """One row for each query and record, though the record was delivered twice."""
    return hits.dropDuplicates(["query_id", "global_id"])


def per_shard(vectors: DataFrame, queries: DataFrame, *, k: int | None = None, metric: str = "cosine", allow: Callable | None = None) -> DataFrame:
    """HITS and rank: the k best of every query in every shard; k null: each query's own. allow: see scored_into().

    Here as in all of this module: null or invalid vectors are taken to be filtered out before, a record delivered twice counts once, equal scores go to
    the smaller global_id, queries with fewer hits than k have all of them, empty tables give no rows."""
    found = ranked(once(candidates(vectors, queries, by="shard_id", metric=metric, k=k, allow=allow)), "query_id", "shard_id")
    return found.where(F.col("rank") <= (F.col("k") if k is None else F.lit(k)))


def top(vectors: DataFrame, queries: DataFrame, *, metric: str = "cosine", k: int | None = None) -> DataFrame:
    """HITS and rank: the k best records of every query over all shards."""
    found = ranked(once(candidates(vectors, queries, metric=metric, k=k)), "query_id")
    return found.where(F.col("rank") <= (F.col("k") if k is None else F.lit(k)))


def merge(hits: DataFrame) -> DataFrame:
    """The k best of each query among hits of several shards or deliveries; of rows with the same id the best score counts."""
    one = hits.groupBy("query_id", "global_id").agg(F.max("score").alias("score"), F.max("k").alias("k"))
    return ranked(one, "query_id").where(F.col("rank") <= F.col("k"))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds the text of each hit, empty if it has none: joined after the top k is known."""
    return hits.join(chunks, "global_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))


def visits(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, shard_id, visited): the records that an exact search scores, by shard; counts are joined, records are not."""
    sizes = vectors.groupBy("shard_id").agg(F.count_distinct("global_id").alias("visited")).orderBy("shard_id").collect()  # a row for each shard
    listed = [F.struct(F.lit(r[0]).cast("int").alias("shard_id"), F.lit(r[1]).cast("bigint").alias("visited")) for r in sizes]
    if not listed:
        return queries.select("query_id", F.lit(0).alias("shard_id"), F.lit(0).cast("bigint").alias("visited")).limit(0)
    return queries.select("query_id", F.explode(F.array(*listed)).alias("s")).select("query_id", "s.*")


def metrics(visited: DataFrame) -> DataFrame:
    """(query_id, total_visited, shards_finished)."""
    return visited.groupBy("query_id").agg(F.sum("visited").alias("total_visited"), F.count_distinct("shard_id").alias("shards_finished"))


def nearest(vectors: DataFrame, queries: DataFrame, *, visits: int) -> DataFrame:
    """HITS and distance int: in every shard the `visits` records whose signatures differ least from the query's, with their scores.

    Ties of the signature distance go to the smaller global_id. A task compares signatures, and scores only the records
    that are among its own nearest. Records are ranged by shard, so a task has those of few shards and sends on the nearest of these only."""
    out = None
    rows = vectors.select("shard_id", "parent_id", "global_id", "vector").repartitionByRange(2 * vectors.sparkSession.sparkContext.defaultParallelism, "shard_id", "global_id")
    for t in query_blocks(queries.select("query_id", "vector", "k")):
        q, ids, own_k = matrix(t["vector"]), t["query_id"].combine_chunks(), t["k"].to_numpy().astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch], q=q, ids=ids, own_k=own_k) -> Iterator[pa.RecordBatch]:
            signs_q = np.where(q >= 0, 1, -1).astype(np.float32)
            length_q = np.sqrt((q * q).sum(1))
            kept = Kept(np.full(len(q), visits), "shard_id")
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                kept.batch()
                b = distinct_rows(b, "shard_id")
                x, group = matrix(b.column("vector")), b.column("shard_id").to_numpy()
                gid, parent = b.column("global_id").to_numpy(), b.column("parent_id").to_numpy()
                signs, length = np.where(x >= 0, 1, -1).astype(np.float32), np.sqrt((x * x).sum(1))
                step = max(1, CELLS // len(x))
                for at in range(0, len(q), step):
                    near = signs_q[at : at + step] @ signs.T  # components less twice the distance
                    for e0, e1 in segments(group, len(x)):
                        bound = kept.bound(int(group[e0]))[at : at + step]
                        r, c, bound[:] = above(near[:, e0:e1], kept.limit[at : at + step], bound, 0)
                        value, c = near[r, c + e0], c + e0
                        kept.add(r + at, group[c], gid[c], value, group[c], parent[c], pair_cosines(q, x, r + at, c, length_q, length))
            c = kept.rest() or (np.array([], np.int64),) * 7
            r = c[0].astype(np.int64)
            far = ((q.shape[1] - c[3]) / 2).astype(np.int32)
            names = ["query_id", "shard_id", "parent_id", "global_id", "score", "k", "distance"]
            yield from sliced(pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int64)), pa.array(c[2].astype(np.int64)), pa.array(np.round((1 + c[6].astype(float)) / 2, 6)), pa.array(own_k[r].astype(np.int32)), pa.array(far)], names=names))

        part = rows.mapInArrow(run, HITS + ", distance int")
        out = part if out is None else out.unionByName(part)
    turn = Window.partitionBy("query_id", "shard_id").orderBy("distance", "global_id")
    return once(by_query(out)).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= visits).drop("turn")


def budgeted(vectors: DataFrame, queries: DataFrame, *, visits: int, k: int | None = None) -> DataFrame:
    """Approximate search: of the `visits` records of every shard that are nearest by signature the k best. Columns as top(), and distance int."""
    return ranked(nearest(vectors, queries, visits=visits), "query_id").where(F.col("rank") <= (F.col("k") if k is None else F.lit(k)))
