"""Routing of vectors to cells: neighbours meet in one task without comparing everything with everything.

Centroids are fitted on a bounded sample; every row is assigned. A data row lives in the cell of its nearest centroid, a
query visits its `probes` nearest cells, and with a margin further ones that are nearly as near: more cells than a few may
share a dense group, and the more of them the more rows the collection has. A cell that would hold more than `cap` rows is split into parts by a hash of the
id; a query visits all parts, so a dense cell loses nothing and no task gets more than about `cap` data rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_of, mix64, unit, vectors_of

#: Rows of the sample that the centroids are fitted on, and rows for each centroid where these are more than SAMPLE.
SAMPLE, EACH = 20_000, 20
#: Data rows that a cell should hold, and the most that one part of it may.
TARGET, CAP = 4_000, 12_000
#: Centroids that are fitted together; more are fitted in two steps, each centroid of the first divided again.
AT_ONCE = 1_024
#: No more centroids than this (65 million rows), so that what is sent to the tasks stays under 5 MB, and the sample under 84 MB;
#: beyond it, cells are split into parts.
MOST_CELLS = 16_384
#: Similarities to centroids that are reckoned at once.
BLOCK = 4_000_000


@dataclass
class Cells:
    mean: np.ndarray
    centroids: np.ndarray
    parts: np.ndarray

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """[rows, probes] nearest cells, nearest first."""
        if len(self.centroids) == 1:
            return np.zeros((len(x), 1), np.int64)
        step = max(1, BLOCK // len(self.centroids))
        if len(x) > step:
            return np.concatenate([self.near(x[at : at + step], probes) for at in range(0, len(x), step)])
        sims = unit(unit(x) - self.mean) @ self.centroids.T
        probes = min(probes, sims.shape[1])
        if probes == 1:
            return sims.argmax(axis=1)[:, None]
        top = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable"), axis=1)

    def near_within(self, x: np.ndarray, probes: int, margin: float, most: int) -> np.ndarray:
        """[rows, most at most] nearest cells, nearest first: the first `probes` and further ones whose similarity is within `margin` of the best; -1 for others."""
        near = self.near(x, max(most, probes))
        v = unit(unit(x) - self.mean)
        step = max(1, BLOCK // max(1, near.shape[1] * v.shape[1]))
        for at in range(0, len(x) if near.shape[1] > probes else 0, step):
            own = near[at : at + step]
            sims = np.einsum("ij,ikj->ik", v[at : at + step], self.centroids[own])
            far = sims < sims[:, :1] - margin
            far[:, :probes] = False
            own[far] = -1
        return near


def lloyd(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """n centroids of the unit vectors x by spherical k-means from n of them."""
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds if n > 1 else 1):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        some = np.bincount(home, minlength=n) > 0
        c[some] = unit(total[some])
    return c


def cells_of(rows: int, target: int) -> int:
    return int(np.clip(-(-rows // target), 1, MOST_CELLS))


def sampled(table: DataFrame, rows: int, target: int, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The rows of table(id, ...) from which fit() takes its sample: some more than it takes, by a hash of the id.

    They are picked out in the scan, so no task looks at a share of all rows to find the sample."""
    share = 1.2 * (max(sample, EACH * cells_of(rows, target)) + 100) / max(rows, 1)
    return table if share >= 1 else table.where(F.xxhash64("id", F.lit(seed)) < int(-(2**63) + share * 2**64))


def fit(vectors: DataFrame, rows: int, *, target: int = TARGET, cap: int = CAP, sample: int = SAMPLE, rounds: int = 8, seed: int = 7, at_once: int = AT_ONCE) -> Cells:
    """Spherical k-means on at most max(sample, EACH * centroids) rows of vectors(id, vector), chosen by a hash of the id. rows: of the whole collection."""
    n = cells_of(rows, target)
    part = sampled(vectors, rows, target, sample, seed).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(sample, EACH * n)).select("vector").toArrow()["vector"]
    if not len(part):
        return Cells(np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.ones(1, np.int64))
    x = unit(vectors_of(part))
    mean = x.mean(axis=0)
    x = unit(x - mean)
    n = min(n, len(x))
    rng = np.random.default_rng(seed)
    if n <= at_once:
        c = lloyd(x, n, rounds, rng)
    else:
        first = lloyd(x, int(np.ceil(np.sqrt(n))), rounds, rng)
        home = (x @ first.T).argmax(axis=1)
        own = [x[home == i] for i in range(len(first))]
        c = np.concatenate([lloyd(v, min(len(v), max(1, round(n * len(v) / len(x)))), rounds, rng) for v in own if len(v)])
    count = np.bincount(Cells(np.zeros_like(mean), c, np.ones(len(c), np.int64)).near(x, 1)[:, 0], minlength=len(c))
    return Cells(mean, c, np.maximum(1, np.ceil(count / len(x) * rows * 1.1 / cap)).astype(np.int64))


def expand(near: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For [rows, probes] cells, -1 for none: (row, cell, part) for every part of every visited cell."""
    n = np.where(near >= 0, parts[near], 0).ravel()
    row = np.repeat(np.repeat(np.arange(len(near)), near.shape[1]), n)
    cell = np.repeat(near.ravel(), n)
    return row, cell, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def home(vectors: DataFrame, cells: Cells, extra: str = "", spread: bool = False) -> DataFrame:
    """vectors(id bigint, vector, ...) -> (cell int, part int, other int, id, vector binary, ...): one row each.

    extra: schema of further columns to carry. spread: repeat a row for each part of the queries of its cell (column other)."""
    names = [x.split()[0] for x in extra.split(",") if x.strip()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column("vector"))
            cell = cells.near(x, 1)[:, 0]
            part = (mix64(b.column("id").to_numpy()) % cells.parts[cell].astype(np.uint64)).astype(np.int64)
            times = cells.parts[cell] if spread else np.ones(len(cell), np.int64)
            row = np.repeat(np.arange(len(cell)), times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            rest = [b.column(n).take(pa.array(row)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(cell[row], pa.int32()), pa.array(part[row], pa.int32()), pa.array(other, pa.int32()), b.column("id").take(pa.array(row)), binary_of(x[row]), *rest], names=["cell", "part", "other", "id", "vector", *names])

    return vectors.select("id", "vector", *names).mapInArrow(place, "cell int, part int, other int, id bigint, vector binary" + (", " + extra if extra else ""))


def places(vectors: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """vectors(id bigint, vector) -> (id, visits array<int>): the `probes` nearest cells, the home cell first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = cells.near(vectors_of(b.column("vector")), probes)
            offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, pa.array(near.ravel(), pa.int32()))], names=["id", "visits"])

    return vectors.select("id", "vector").mapInArrow(place, "id bigint, visits array<int>")


def visit(queries: DataFrame, cells: Cells, probes: int, extra: str = "", spread: bool = False, margin: float | None = None, most: int = 0) -> DataFrame:
    """queries(id, vector, ...) -> (cell, part, other, id, vector binary, ...): a row for each part of the `probes` nearest cells.

    margin: of further cells, too, up to `most` in all, as near_within() finds them; column other is 1 for these (not with spread).
    spread: queries are split into as many parts as the cell (column other), to go with home(spread=True). With 0 probes a
    query visits the one cell named in its column `at`."""
    names = [x.split()[0] for x in extra.split(",") if x.strip()]
    kind = dict(queries.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column("vector"))
            near = cells.near_within(x, probes, margin, most) if margin is not None else cells.near(x, probes) if probes else b.column("at").to_numpy()[:, None]
            row, cell, part = expand(near, cells.parts)
            if spread:
                other = (mix64(b.column("id").to_numpy(), 1)[row] % cells.parts[cell].astype(np.uint64)).astype(np.int64)
            else:
                turn = np.repeat(np.tile(np.arange(near.shape[1]), len(near)), np.where(near >= 0, cells.parts[near], 0).ravel())
                other = ((turn >= probes) & (margin is not None)).astype(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(other, pa.int32()), b.column("id").take(take), binary_of(x[row]), *[b.column(n).take(take) for n in names]], names=["cell", "part", "other", "id", "vector", *names])

    return queries.select("id", "vector", *names, *([] if probes else ["at"])).mapInArrow(place, f"cell int, part int, other int, id {kind}, vector binary" + (", " + extra if extra else ""))
