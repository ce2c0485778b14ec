"""Similarity clusters by Markov clustering of a sparse similarity graph.

Graph: every record is linked to the landmarks within the similarity floor that it meets in the cells it visits. The
landmarks of a part of a cell are picked greedily from its data rows alone, so that each of them is a landmark or near one
and all queries of the cell, however they are split, meet the same landmarks; a dense group of m records costs about m edges
for each part instead of m * m. Landmarks with records of their own then visit more cells, to meet the other landmarks there.
The first pass also counts each record's neighbours exactly and sums their hashes, which later tells whether a cluster is
complete and closed.

Clustering: a record stays where it is (a loop) with the weight of all its edges and otherwise goes to a landmark near it, in
proportion to the records that the landmark has. A landmark stands for its records: it stays in proportion to their number,
goes to a landmark near it in proportion to the number there, and to one that only some of its records are near in
proportion to these. A round squares the matrix by a join on the shared index, raises entries to the power `inflation`, and
then, not before, drops those under `prune` unless they are among the column's largest, so that a column never holds more
than 1 / prune entries and never runs empty. Rounds go on until the flow has settled. Then the largest entry of a column
names its attractor, and columns with the same attractor are a cluster; members with the strongest flow represent it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as routing
from .common import by_group, cut, is_valid, mix64, unit, vectors_of

LINKS = "id bigint, landmark bigint, weight double, degree bigint, mark bigint, own bigint"
#: Bits of a record's mark: sums over 30 million neighbours stay within a bigint.
MARK_BITS = 38
#: Queries compared at once.
BLOCK = 1_024


def near_pairs(q: np.ndarray, x: np.ndarray, raw_q: np.ndarray, raw: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) with cosine >= floor; what lies within 1e-5 of the floor is reckoned again in double."""
    s = q @ x.T
    flat = np.flatnonzero(s >= floor - 1e-5)
    r, c = flat // len(x), flat % len(x)
    v = s.ravel()[flat].astype(np.float64)
    close = np.abs(v - floor) <= 1e-5
    if close.any():
        a, b = raw_q[r[close]].astype(np.float64), raw[c[close]].astype(np.float64)
        v[close] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        ok = v >= floor
        r, c, v = r[ok], c[ok], v[ok]
    return r, c, v


def mark_of(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def once(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(t["id"].to_numpy(), return_index=True)
    return ids, vectors_of(t["vector"])[at] if len(ids) else np.empty((0, 1), np.float32)


def landmarks(ids: np.ndarray, x: np.ndarray, floor: float) -> np.ndarray:
    """Rows such that every row is one or within the floor of one: greedy, by a hash of the id. They depend on the rows alone."""
    left = np.argsort(mix64(ids, 2))
    chosen: list[np.ndarray] = []
    while len(left):
        block, rest = left[:256], left[256:]
        near = x[block] @ x[block].T >= floor
        free, pick = np.ones(len(block), bool), []
        for i in range(len(block)):
            if free[i]:
                pick.append(i)
                free &= ~near[i]
        chosen.append(block[pick])
        left = rest[~(x[rest] @ x[block[pick]].T >= floor).any(axis=1)]
    return np.concatenate(chosen) if chosen else np.array([], np.int64)


def link_part(data: pa.Table, queries: pa.Table, floor: float, edges: bool = True) -> pa.Table:
    """For each query of a part: number and hash sum of the others near it here (landmark null), and its edges to landmarks if wanted."""
    ids, raw = once(data)
    qids, raw_q = once(queries)
    rows: list[tuple[np.ndarray, ...]] = []
    if len(ids) and len(qids):
        x, q = unit(raw), unit(raw_q)
        marks = mark_of(ids)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), BLOCK):
            r, c, v = near_pairs(q[at : at + BLOCK], x, raw_q[at : at + BLOCK], raw, floor)
            other = ids[c] != qids[r + at]  # the record itself is counted in clusters(), wherever its home is
            r, c = r[other], c[other]
            n = np.bincount(r, minlength=min(BLOCK, len(q) - at))
            some = np.nonzero(n)[0]
            begin = np.cumsum(n) - n
            total = np.concatenate([[0], np.cumsum(marks[c])])
            found.append((some + at, n[some], total[begin[some] + n[some]] - total[begin[some]]))
        for f in found:
            rows.append((qids[f[0]], np.full(len(f[0]), -1), np.zeros(len(f[0])), f[1], f[2], mark_of(qids[f[0]])))
        pick = landmarks(ids, x, floor) if edges else []
        for at in range(0, len(q), BLOCK) if edges else ():
            r, c, v = near_pairs(q[at : at + BLOCK], x[pick], raw_q[at : at + BLOCK], raw[pick], floor)
            keep = qids[r + at] != ids[pick[c]]
            rows.append((qids[r + at][keep], pick[c][keep], v[keep], *[np.zeros(keep.sum(), np.int64)] * 3))
            met = np.unique(pick[c][keep])
            rows.append((ids[met], met, np.ones(len(met)), *[np.zeros(len(met), np.int64)] * 3))  # a landmark is near itself
    id_, lm, w, deg, mark, own = (np.concatenate(a) if rows else np.array([], float) for a in (zip(*rows) if rows else [[]] * 6))
    none = lm < 0
    return pa.table({"id": pa.array(id_.astype(np.int64)), "landmark": pa.array(ids[np.where(none, 0, lm).astype(np.int64)] if len(lm) else np.array([], np.int64), mask=none), "weight": pa.array(w.astype(float)), "degree": pa.array(deg.astype(np.int64)), "mark": pa.array(mark.astype(np.int64)), "own": pa.array(own.astype(np.int64))})


def links(rows: DataFrame, cells: routing.Cells, *, floor: float, probes: int = 2) -> DataFrame:
    """rows(id bigint, vector), all valid -> LINKS, written to the checkpoint folder. A repeated id counts once."""
    at = ["cell", "part", "other"]

    def group(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        return link_part(data, queries, floor)

    return cut(routing.home(rows, cells, spread=True).groupBy(*at).cogroup(routing.visit(rows, cells, probes, spread=True).groupBy(*at)).applyInArrow(group, LINKS))


def rest(rows: DataFrame, member: DataFrame, cells: routing.Cells, *, floor: float, probes: int = 2) -> DataFrame:
    """Statistics of each member(id, cluster) in the home cells of its cluster that it has not visited: LINKS without edges."""
    at = ["cell", "part", "other"]

    def group(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        return link_part(data, queries, floor, edges=False)

    place = member.join(routing.places(rows, cells, probes).dropDuplicates(["id"]), "id")
    homes = place.select("cluster", F.element_at("visits", 1).alias("cell")).distinct()
    todo = place.join(homes, "cluster").where(~F.array_contains("visits", F.col("cell"))).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    queries = rows.join(todo, "id").select("id", "vector", F.explode("cells").alias("at"))
    return routing.home(rows, cells, spread=True).groupBy(*at).cogroup(routing.visit(queries, cells, 0, spread=True).groupBy(*at)).applyInArrow(group, LINKS)


def landmark_pairs(rows: DataFrame, sizes: DataFrame, cells: routing.Cells, *, floor: float, probes: int) -> DataFrame:
    """sizes(landmark, size) -> (id, landmark): pairs of different landmarks within the floor, in the `probes` nearest cells of each."""
    own = rows.join(sizes.select(F.col("landmark").alias("id")), "id", "left_semi")
    at = ["cell", "part", "other"]

    def group(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        ids, raw = once(data)
        qids, raw_q = once(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], np.int64),) * 2]
        for i in range(0, len(qids), BLOCK) if len(ids) else ():
            r, c, _ = near_pairs(unit(raw_q[i : i + BLOCK]), unit(raw), raw_q[i : i + BLOCK], raw, floor)
            found.append((qids[r + i], ids[c]))
        a, b = (np.concatenate(z) for z in zip(*found))
        return pa.table({"id": a[a != b], "landmark": b[a != b]})

    near = routing.home(own, cells, spread=True).groupBy(*at).cogroup(routing.visit(own, cells, probes, spread=True).groupBy(*at)).applyInArrow(group, "id bigint, landmark bigint")
    return near.unionByName(near.select(F.col("landmark").alias("id"), F.col("id").alias("landmark"))).distinct()


def assigned(edges: DataFrame) -> DataFrame:
    """edges(id, landmark, weight), with a landmark's edge to itself -> (id, own): the landmark nearest to each record."""
    return edges.groupBy("id").agg(F.max_by("landmark", F.struct("weight", -F.col("landmark"))).alias("own"))


def start(edges: DataFrame, own: DataFrame, near: DataFrame) -> DataFrame:
    """The first matrix (col, row, value) of records and landmarks: see above.

    edges(id, landmark, weight), own(id, own): the landmark of each record, near(id, landmark): landmarks within the floor of each other."""
    size = own.groupBy(F.col("own").alias("row")).agg(F.count("*").alias("size"))
    used = edges.select("id", F.col("landmark").alias("row")).distinct().join(size, "row")
    # Records that are no landmark with records of its own.
    plain = used.join(size.select(F.col("row").alias("id")), "id", "left_anti").select(F.col("id").alias("col"), "row", F.col("size").cast("double").alias("w"))
    loops = plain.groupBy("col").agg(F.sum("w").alias("w")).select("col", F.col("col").alias("row"), "w")
    # Landmarks: the records of one that are near another, or all of the other where the landmarks themselves are near.
    some = used.join(own, "id").where(F.col("own") != F.col("row")).groupBy("own", "row").agg(F.count("*").alias("n"))
    cross = some.select(F.col("own").alias("col"), "row", "n").unionByName(some.select(F.col("row").alias("col"), F.col("own").alias("row"), "n")).groupBy("col", "row").agg(F.sum("n").alias("n"))
    sizes = lambda name: size.select(F.col("row").alias(name), F.col("size").alias(f"{name}_size"))
    close = near.select(F.col("id").alias("col"), F.col("landmark").alias("row"), F.lit(True).alias("near"))
    between = cross.join(close, ["col", "row"], "full").join(sizes("col"), "col").join(sizes("row"), "row")
    between = between.select("col", "row", F.when(F.col("near"), F.col("row_size").cast("double")).otherwise(F.least(F.col("row_size"), F.col("n") / F.col("col_size"))).alias("w"))
    stay = size.select(F.col("row").alias("col"), "row", F.col("size").cast("double").alias("w"))
    return plain.unionByName(loops).unionByName(between).unionByName(stay).withColumnRenamed("w", "value")


def flow(matrix: DataFrame, *, inflation: float = 2.0, prune: float = 0.02, rounds: int = 100, settled: float = 1e-3) -> DataFrame:
    """(col, row, value) -> the flow matrix after Markov clustering: (col, row, value), the values of a column adding up to 1.

    Ends when every column is within `settled` of even flow between its attractors (largest entry minus sum of squares).
    Raises if that is not so after `rounds`; with 0 rounds it only brings columns to a sum of 1."""

    def columns(df: DataFrame, inflation: float, prune: float) -> DataFrame:
        """(col, row, value) -> (col, row, value, chaos): equal rows of a column added up, inflated, pruned, of sum 1. A column goes to one task: it is short."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in by_group(batches, "col"):
                yield new_columns(*(t[n].to_numpy() for n in ("col", "row", "value")), inflation, prune)

        return df.select("col", "row", "value").repartition("col").sortWithinPartitions("col").mapInArrow(run, "col bigint, row bigint, value double, chaos double")

    m = cut(columns(matrix, 1.0, 0.0).drop("chaos"))
    for _ in range(rounds):
        via = m.select(F.col("col").alias("via"), F.col("row").alias("to"), F.col("value").alias("w"))
        step = m.withColumnRenamed("row", "via").join(via, "via").select("col", F.col("to").alias("row"), (F.col("value") * F.col("w")).alias("value"))
        m = cut(columns(step, inflation, prune))
        chaos = m.agg(F.max("chaos")).first()[0]
        m = m.drop("chaos")
        if chaos is None or chaos < settled:
            return m
    if rounds:
        raise RuntimeError(f"the flow has not settled after {rounds} rounds")
    return m


def new_columns(col: np.ndarray, row: np.ndarray, value: np.ndarray, inflation: float, prune: float) -> pa.RecordBatch:
    """See flow(). Where all entries of a column are small, the largest stay; of equal ones those of smaller rows."""
    order = np.lexsort((row, col))
    col, row, value = col[order], row[order], value[order]
    first = np.nonzero(np.concatenate([[True], (col[1:] != col[:-1]) | (row[1:] != row[:-1])]))[0]
    col, row, value = col[first], row[first], np.add.reduceat(value, first) ** inflation
    begin = np.nonzero(np.concatenate([[True], col[1:] != col[:-1]]))[0]
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(col))))
    value /= np.add.reduceat(value, begin)[of]
    if prune:
        order = np.lexsort((row, -value, of))
        col, row, value = col[order], row[order], value[order]
        keep = (np.arange(len(of)) - begin[of] < round(1 / prune)) & (value >= np.minimum(prune, value[begin] / 2)[of])
        col, row, value, of = col[keep], row[keep], value[keep], of[keep]
        begin = np.searchsorted(of, np.arange(len(begin)))
        value /= np.add.reduceat(value, begin)[of]
    chaos = np.maximum.reduceat(value, begin) - np.add.reduceat(value * value, begin)
    return pa.RecordBatch.from_arrays([pa.array(col), pa.array(row), pa.array(value), pa.array(chaos[of])], names=["col", "row", "value", "chaos"])


def attracted(matrix: DataFrame) -> DataFrame:
    """(id, cluster): the attractor of each column, which is the row of its largest entry (the smaller row of equal ones), or that row's own."""
    first = matrix.groupBy("col").agg(F.max_by("row", F.struct("value", -F.col("row"))).alias("row"))
    again = first.select(F.col("col").alias("row"), F.col("row").alias("cluster"))
    return first.join(again, "row", "left").select(F.col("col").alias("id"), F.coalesce("cluster", "row").alias("cluster"))


def clusters(vectors: DataFrame, *, floor: float, inflation: float = 2.0, typical: int = 3, probes: int = 2, far: int = 16, rounds: int = 100) -> DataFrame:
    """vectors(id bigint, vector) -> (cluster_id bigint, id bigint, size bigint, inflow double, typical boolean, whole boolean).

    One row for each valid vector; null ids and invalid vectors have none, repeated ids have one. cluster_id is the
    smallest id of the cluster; records near no other are clusters of size 1. inflow: the flow that the record receives
    from all members, a landmark's shared out by nearness to it; typical: it is among the `typical` strongest of its
    cluster (ties by id). whole: every two members
    are within the floor of each other and no member is within it of a record outside, checked on neighbour counts: of each
    member in all cells that it visits and in all cells where members of its cluster are at home. Only a record outside in
    a cell that the member neither visits nor finds its cluster in goes unseen. Records visit `probes` cells, landmarks `far`.
    Empty tables give no rows; further columns are ignored."""
    rows = vectors.where(F.col("id").isNotNull() & is_valid(F.col("vector"))).select("id", "vector")
    cells = routing.fit(rows, rows.count())
    found = links(rows, cells, floor=floor, probes=probes)
    edges = found.where(F.col("landmark").isNotNull()).select("id", "landmark", "weight")
    own = cut(assigned(edges))
    landmark = own.select(F.col("own").alias("landmark")).distinct()
    near = landmark_pairs(rows, landmark, cells, floor=floor, probes=far)
    matrix = flow(start(edges, own, near), inflation=inflation, rounds=rounds)
    member = cut(attracted(matrix))
    received = matrix.join(own.groupBy(F.col("own").alias("col")).agg(F.count("*").alias("n")), "col", "left").groupBy(F.col("row").alias("own")).agg(F.sum(F.col("value") * F.coalesce("n", F.lit(1))).alias("all"))
    inflow = edges.join(own, "id").where(F.col("landmark") == F.col("own")).select("id", "own", "weight").distinct().join(received, "own").select("id", (F.col("all") * F.col("weight")).alias("inflow")).groupBy("id").agg(F.max("inflow").alias("inflow"))
    counts = found.where(F.col("landmark").isNull())
    if len(cells.centroids) > probes:
        counts = counts.unionByName(rest(rows, member, cells, floor=floor, probes=probes))
    stats = counts.groupBy("id").agg((F.sum("degree") + 1).alias("degree"), (F.sum("mark") + F.max("own")).alias("mark"), F.max("own").alias("own"))
    full = cut(stats.join(member, "id", "full").join(inflow, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")))
    # Complete and closed: all members have as many neighbours as the cluster has members, and these are the members.
    by = full.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"), F.sum("own").alias("all"), F.min("degree").alias("d0"), F.max("degree").alias("d1"), F.min("mark").alias("m0"), F.max("mark").alias("m1"))
    whole = (F.col("d0") == F.col("size")) & (F.col("d1") == F.col("size")) & (F.col("m0") == F.col("all")) & (F.col("m1") == F.col("all"))
    by = by.select("cluster", "cluster_id", "size", F.coalesce(whole, F.lit(False)).alias("whole"))
    strongest = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("inflow"), "id")
    top = full.select("cluster", "id", "inflow").withColumn("n", F.row_number().over(strongest)).where(F.col("n") <= typical).select("id", F.lit(True).alias("typical"))
    big = full.join(by, "cluster").join(top, "id", "left").select("cluster_id", "id", "size", F.coalesce("inflow", F.lit(0.0)).alias("inflow"), F.coalesce("typical", F.lit(False)).alias("typical"), "whole")
    alone = rows.select("id").distinct().join(full.select("id"), "id", "left_anti")
    return big.unionByName(alone.select(F.col("id").alias("cluster_id"), "id", F.lit(1).cast("bigint").alias("size"), F.lit(1.0).alias("inflow"), F.lit(True).alias("typical"), F.lit(True).alias("whole")))
