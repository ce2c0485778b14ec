"""The N best items of every group: sorted runs, merged by a loser tree that leaves a group after N items.

Each task sorts what it reads into runs by (group, score descending, id), drops repeated items and, as nothing beyond the
largest N of all groups can be wanted, what a run holds beyond it: of a group with a third of all rows, N rows of a run
remain. Runs are stored bucketed by a hash of the group, in order. Each bucket merges its runs with a loser tree; after
the N items of a group each run seeks to its next group. More than FAN tasks' runs are merged in levels, so no merge gets
more than N rows of a group from FAN tasks' runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a run, tasks whose runs are merged at once, and buckets of groups.
RUN, FAN, BUCKETS = 500_000, 1_024, 4_096


class LoserTree:
    """Merges sorted runs: `top` is the run with the smallest head; after its head changed, `replay` finds the next one."""

    def __init__(self, heads: list) -> None:
        self.heads = heads
        self.size = max(1, len(heads))
        self.tree = [-1] * self.size
        self.top = -1
        for run in range(len(heads)):
            self._play(run, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, run: int, building: bool = False) -> None:
        winner, at = run, (run + self.size) // 2
        while at > 0:
            other = self.tree[at]
            if building and other < 0:
                self.tree[at] = winner
                return
            if other >= 0 and self._beats(other, winner):
                self.tree[at], winner = winner, other
            at //= 2
        self.top = winner

    def replay(self) -> None:
        self._play(self.top)


def merge_runs(groups: np.ndarray, n: np.ndarray, ids: np.ndarray, scores: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Row numbers of the n best distinct ids of every group, in order of (group, score descending, id).

    groups: numbers that sort like the groups. Rows of a run stand together, sorted by (group, score descending, id)."""
    if not len(groups):
        return np.array([], np.int64)
    first = np.nonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))[0]
    ends = np.concatenate([first[1:], [len(runs)]]).tolist()
    # where the next group starts, for seeking
    change = np.concatenate([(groups[1:] != groups[:-1]) | (runs[1:] != runs[:-1]), [True]])
    at_change = np.nonzero(change)[0] + 1
    following = at_change[np.searchsorted(at_change, np.arange(len(groups)), side="right")].tolist()
    keys = list(zip(groups.tolist(), (-scores).tolist(), ids.tolist()))
    limit = n.tolist()
    pos = first.tolist()
    tree = LoserTree([keys[p] for p in pos])
    out: list[int] = []
    group, taken, seen = None, 0, set()
    while True:
        run = tree.top
        key = tree.heads[run]
        if key is None:
            return np.array(out, np.int64)
        p = pos[run]
        if key[0] != group:
            group, taken = key[0], 0
            seen.clear()
        if taken >= limit[p]:
            p = following[p]
        else:
            if key[2] not in seen:
                seen.add(key[2])
                out.append(p)
                taken += 1
            p += 1
        pos[run] = p
        tree.heads[run] = keys[p] if p < ends[run] else None
        tree.replay()


def write_runs(items: DataFrame, most: int, run: int = RUN) -> DataFrame:
    """items(grp, id, score) -> (grp, id, score, run): rows of each run in order, each id once in a group, at most `most` of a group."""

    def cut_run(t: pa.Table, name: int) -> pa.RecordBatch:
        t = t.sort_by([("grp", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        code, ids = t["grp"].combine_chunks().dictionary_encode().indices.to_numpy(), t["id"].to_numpy()
        order = np.lexsort((np.arange(len(ids)), ids, code))
        again = np.zeros(len(ids), bool)  # the best row of an id comes first
        again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
        t, code = t.filter(pa.array(~again)), code[~again]
        start = np.concatenate([[True], code[1:] != code[:-1]])
        rank = np.arange(len(code)) - np.maximum.accumulate(np.where(start, np.arange(len(code)), 0))
        t = t.filter(pa.array(rank < most)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("grp", "id", "score")), pa.array(np.full(t.num_rows, name))], names=["grp", "id", "score", "run"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, rows, k = TaskContext.get().partitionId() << 20, [], 0, 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run:
                yield cut_run(pa.Table.from_batches(held), first + k)
                held, rows, k = [], 0, k + 1
        if rows:
            yield cut_run(pa.Table.from_batches(held), first + k)

    return items.select("grp", "id", "score").mapInArrow(make, "grp string, id bigint, score double, run bigint")


def merge(runs: DataFrame, limits: DataFrame | None, most: int) -> DataFrame:
    """runs(grp, id, score, run) -> (grp, id, score, rank): merges the runs of each bucket of groups.

    limits(grp, n): groups that it does not name are left out; None: the limit of every group is `most`."""
    rows = runs.select("grp", "id", "score", "run", F.lit(None).cast("int").alias("n"))
    limited = limits is not None
    if limited:
        none = lambda kind: F.lit(None).cast(kind)
        rows = rows.unionByName(limits.select("grp", none("bigint").alias("id"), none("double").alias("score"), F.lit(-1).cast("bigint").alias("run"), "n"))

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks()
        named = t["n"].is_valid() if limited else None
        if named is not None:
            asked, t = t.filter(named), t.filter(pc.and_(pc.invert(named), pc.is_in(t["grp"], t.filter(named)["grp"])))
        if not t.num_rows:
            return None
        t = t.combine_chunks()
        names = pc.unique(t["grp"]).sort()
        number = pc.index_in(t["grp"], names).to_numpy()
        n = np.full(len(names), most, np.int64)
        if named is not None:
            own = pc.index_in(asked["grp"], names)
            ok = own.is_valid()
            n[own.filter(ok).to_numpy()] = asked["n"].filter(ok).to_numpy()
        chosen = merge_runs(number, n[number], t["id"].to_numpy(), t["score"].to_numpy(), t["run"].to_numpy())
        code = number[chosen]
        start = np.concatenate([[True], code[1:] != code[:-1]])
        rank = np.arange(len(code)) - np.maximum.accumulate(np.where(start, np.arange(len(code)), 0)) + 1
        t = t.take(pa.array(chosen)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("grp", "id", "score")), pa.array(rank, pa.int32())], names=["grp", "id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            edges = [0, *(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1).tolist(), len(bucket)]
            for x, y in zip(edges, edges[1:]):
                if bucket[x] != now and held:
                    if (out := merged(held)) is not None:
                        yield out
                    held = []
                now = bucket[x]
                held.append(b.slice(x, y - x))
        if held and (out := merged(held)) is not None:
            yield out

    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(BUCKETS)).cast("int"))
    stored = keyed.repartition("bucket").sortWithinPartitions("bucket", "run", "grp", F.desc("score"), "id")
    return stored.mapInArrow(run, "grp string, id bigint, score double, rank int")


def top_n(items: DataFrame, groups: DataFrame, *, default_n: int = 10, fan: int = FAN) -> DataFrame:
    """items(grp string, id bigint, score double), groups(grp string, n int) -> (grp, id, score, rank int).

    For every group of `groups` its n best distinct ids by (score descending, id ascending); of rows with the same id the
    highest score counts. n null or < 1 counts as default_n; of several n of a group the largest counts. Items with a
    null group, null id, or a null, NaN or infinite score, and items of other groups, take no part; groups without items
    have no rows. Empty tables give no rows; further columns are ignored."""
    asked = groups.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.max(F.when(F.col("n") >= 1, F.col("n")).otherwise(default_n)).cast("int").alias("n"))
    good = items.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    good = good.select("grp", "id", F.col("score").cast("double").alias("score"))
    most = asked.agg(F.max("n")).first()[0] or 1
    runs, parts = write_runs(good, most), good.rdd.getNumPartitions()
    while parts > fan:
        # Too many runs for one merge: those of `fan` tasks first, apart by the number of the task.
        parts = -(-parts // fan)
        lane = F.floor(F.shiftright("run", 20) / fan).cast("bigint")
        first = merge(runs.withColumn("grp", F.concat(lane.cast("string"), F.lit(":"), "grp")), None, most)
        name = F.split("grp", ":", 2)
        runs = first.select(name[1].alias("grp"), "id", "score", F.shiftleft(name[0].cast("bigint"), 20).alias("run"))
    return merge(runs, asked, most)
