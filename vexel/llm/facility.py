"""A varied subset: two rounds of lazy greedy maximisation of a facility-location objective.

Two records are as alike as their vectors or their texts are, whichever is more; likeness counts from 0 at `low` to 1 at
`high`, so once a group of similar records has a representative, more of them add next to nothing. Round one: each part of
a cell nominates candidates greedily, each with the number of records it serves best. Round two: one greedy pass over all
candidates, weighted by what they serve. More candidates than a task holds are merged and reduced first: cells of similar
candidates are ordered by a greedy pass each, those that add next to nothing to the others hand over what they serve, and
new cells are fitted to the rest, until one cell is left or nothing is handed over any more; then candidates of different
cells have nothing in common, and the largest gains are what one pass over all would pick."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as routing
from .common import DIM, binary_of, cut, is_valid, mix64, unit, vectors_of, words

#: Likeness of vectors and of texts that counts nothing, and that counts full.
LOW, HIGH = 0.6, 0.9
TEXT_LOW, TEXT_HIGH = 0.5, 0.85
#: Candidates that a part nominates, as a multiple of its share of the subset; records of a part; candidates of a coarse cell.
OVER, PART, COARSE = 8.0, 3_000, 3_000
#: A candidate that adds less than this share of what it serves hands it over; reducing ends where fewer than SLOW of them do.
ADDS, SLOW = 0.2, 0.01


def features(records: DataFrame) -> DataFrame:
    """records(id, vector, chunk) -> (id, vector array<float>): the unit vector, then a hashed bag of words of length 1; zeros for what is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            out = np.zeros((b.num_rows, 2 * DIM), np.float32)
            has = b.column("vector").is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                out[has, :DIM] = unit(vectors_of(b.column("vector").drop_null()))
            column = b.column("words")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            if len(known) > 1_000_000:
                known.clear()
            h = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in names], np.uint64)[flat.indices.to_numpy()]
            row = np.repeat(np.arange(len(sizes)), sizes)
            for seed in (1, 2, 3, 4):  # four signed places for each word
                m = mix64(h, seed)
                np.add.at(out, (row, DIM + (m % np.uint64(DIM)).astype(np.int64)), np.where(m >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.float32))
            some = (out[:, DIM:] != 0).any(axis=1)
            out[some, DIM:] = unit(out[some, DIM:])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 2 * DIM, dtype=np.int32)), pa.array(out.ravel()))], names=["id", "vector"])

    return records.select("id", F.when(is_valid(F.col("vector")), F.col("vector")).alias("vector"), words(F.col("chunk")).alias("words")).mapInArrow(run, "id bigint, vector array<float>")


def likeness(x: np.ndarray) -> np.ndarray:
    """[rows, rows] of features: 1 on the diagonal."""
    scale = lambda s, low, high: np.clip((s - low) / (high - low), 0, 1)
    s = np.maximum(scale(x[:, :DIM] @ x[:, :DIM].T, LOW, HIGH), scale(x[:, DIM:] @ x[:, DIM:].T, TEXT_LOW, TEXT_HIGH))
    np.fill_diagonal(s, 1)
    return s


def greedy(s: np.ndarray, weight: np.ndarray, picks: int, tie: np.ndarray) -> tuple[list[int], list[float]]:
    """Lazy greedy: the rows that add most to sum(weight * best likeness to a pick), and what each added. Ties go to the smaller `tie`."""
    best = np.zeros(len(s), np.float32)
    heap = [(-g, int(t), i) for i, (g, t) in enumerate(zip((s @ weight).tolist(), tie.tolist()))]
    heapq.heapify(heap)
    chosen, gains = [], []
    while heap and len(chosen) < picks:
        _, t, i = heapq.heappop(heap)
        gain = float(np.maximum(s[i] - best, 0) @ weight)
        if heap and (-gain, t) > heap[0][:2]:
            heapq.heappush(heap, (-gain, t, i))  # no longer the best: a bound for later
            continue
        chosen.append(i)
        gains.append(gain)
        np.maximum(best, s[i], out=best)
    return chosen, gains


def largest(df: DataFrame, count: int, bins: int = 4_096) -> DataFrame:
    """`count` rows of (id, gain) with the largest gains; gains within 1 % of each other count as equal and go by a hash of the id.

    Only counts of at most `bins` bins come to the driver; what is ranked in one task is about 1 / bins of the equal gains."""
    level = F.floor(F.log2(F.greatest(F.col("gain"), F.lit(1e-6))) * 64).cast("int")
    kept = df.select("id", level.alias("level"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(bins)).cast("int").alias("bin"))

    def crossing(column: str, rows: DataFrame, left: int, down: bool) -> tuple[int | None, int]:
        """The value at which `left` rows are reached, and how many are still wanted among its rows."""
        for value, n in sorted(((r[0], r[1]) for r in rows.groupBy(column).count().collect()), reverse=down):
            if n >= left:
                return value, left
            left -= n
        return None, 0

    at, left = crossing("level", kept, count, True)
    if at is None:
        return kept.select("id")
    tied = kept.where(F.col("level") == at)
    bin_, left = crossing("bin", tied, left, False)
    last = tied.where(F.col("bin") == bin_).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(left)
    return kept.where(F.col("level") > at).unionByName(tied.where(F.col("bin") < bin_)).unionByName(last).select("id")


def varied_subset(records: DataFrame, *, share: float | None = None, count: int | None = None, part: int = PART, coarse: int = COARSE) -> DataFrame:
    """records(id bigint, vector, chunk) -> (id): `count` ids, or ceil(share * number of distinct ids), that cover the variety.

    Null ids take no part; of rows with the same id one counts. Records with neither a valid vector nor words are like no
    other record and gain as much as any record that stands alone; equal gains go by a hash of the id. More ids than there are
    gives all; an empty table gives no rows. Further columns are ignored."""
    good = records.where(F.col("id").isNotNull())
    one = features(good.dropDuplicates(["id"]))
    total = records.where(F.col("id").isNotNull()).select("id").distinct().count()
    want = min(total, count if count is not None else int(np.ceil(total * (share or 0))))
    if not want:
        return records.select("id").limit(0)
    ratio = want / total
    fine = routing.fit(features(routing.sampled(good, total, part).dropDuplicates(["id"])), total, target=part, cap=part)

    def nominate(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy())
        ids, x = t["id"].to_numpy()[order], vectors_of(t["vector"])[order]
        s = likeness(x)
        picks = min(len(x), int(np.ceil(len(x) * ratio * OVER)) + 2)
        chosen, gains = greedy(s, np.ones(len(x), np.float32), picks, mix64(ids, 5) >> np.uint64(12))
        if want < total:
            chosen = [c for i, (c, g) in enumerate(zip(chosen, gains)) if g >= ADDS or i < int(np.ceil(len(x) * ratio))]
        serves = s[chosen]
        served = np.bincount(serves.argmax(axis=0)[serves.max(axis=0) > 0], minlength=len(chosen))
        return pa.table({"id": ids[chosen], "weight": np.maximum(served, 1).astype(np.float64), "vector": binary_of(x[chosen])})

    def order(t: pa.Table) -> pa.Table:
        by = np.argsort(t["id"].to_numpy())
        ids, x, w = t["id"].to_numpy()[by], vectors_of(t["vector"])[by], t["weight"].to_numpy()[by].astype(np.float32)
        s = likeness(x)
        chosen, gains = greedy(s, w, len(x), mix64(ids, 5) >> np.uint64(12))
        gains = np.array(gains, np.float64)
        stays = gains >= ADDS * w[chosen]
        stays[:1] = True
        serves = s[np.array(chosen)[stays]]
        weight = np.where(stays, 0.0, w[chosen]).astype(np.float64)
        weight[stays] = np.bincount(serves.argmax(axis=0), weights=w, minlength=len(serves))
        return pa.table({"id": ids[chosen], "weight": weight, "gain": gains, "stays": stays, "vector": binary_of(x[chosen])})

    left = cut(routing.home(one, fine).groupBy("cell", "part").applyInArrow(nominate, "id bigint, weight double, vector binary"))
    n, given, level = left.count(), None, 0
    while True:
        cells = routing.fit(left, n, target=coarse, cap=coarse, seed=7 + level)
        ranked = cut(routing.home(left, cells, "weight double").groupBy("cell", "part").applyInArrow(order, "id bigint, weight double, gain double, stays boolean, vector binary"))
        left, before = ranked.where("stays"), n
        n = left.count()
        out = ranked.where("NOT stays").select("id", "gain")
        given = out if given is None else given.unionByName(out)
        level += 1
        if cells.parts.sum() == 1 or (before - n) < SLOW * before:
            break
    return largest(left.select("id", "gain").unionByName(given), want)
