"""Mixing sources to target weights, in blocks of tokens.

The texts of a source, in an order drawn by a hash, are one stream of tokens, cut into blocks of fixed length. Prefix sums
are taken within hash buckets and over the buckets' totals, so no task sees a whole source. A plan's output is a number of
shards; the counts of its sources in each shard are multinomial given the totals, so these are exact; they are drawn by the
tasks, halving the shards again and again. The slots of a source run through pseudorandom permutations of its block numbers, one for
each repetition, so a block is used at most as often as the plan allows. Slots are joined with blocks by number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64

#: Tokens of a block, slots of an output shard, shards that a row of the plan stands for, buckets of a source for prefix sums.
BLOCK, SLOTS, GROUP, BUCKETS = 4_096, 1_024, 16, 256
#: Rows that the table of targets may have: it is planned on the driver.
MOST_TARGETS = 100_000


def clean_source(source: F.Column) -> F.Column:
    """Trimmed and lower-cased; null where nothing is left."""
    name = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(n) for each seed: a four-round Feistel network, walked on until the number is under n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix64(right + (seed[todo].astype(np.uint64) << np.uint64(8)), r) & mask[todo])
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def pieces(docs: DataFrame, block: int) -> DataFrame:
    """docs(id, source, size) -> (id, source, block bigint, tokens bigint): what of each document lies in which block of its source."""
    placed = docs.where(F.col("size") > 0).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("total").over(before(Window.partitionBy("source").orderBy("bucket"))), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("size").over(before(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("id", F.lit(1)), "id"))), F.lit(0))
    at = placed.withColumn("own", own).join(sums, ["source", "bucket"]).withColumn("begin", F.col("first") + F.col("own"))
    last = (F.col("begin") + F.col("size") - 1)
    spread = at.select("id", "source", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.floor(last / block))).alias("block"))
    tokens = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    return spread.select("id", "source", "block", tokens.alias("tokens"))


def plan_sources(rows: list[dict], block: int, seed: int) -> dict[int, dict]:
    """For each plan its sources with something to draw: names, blocks, slots to fill, seeds; and the number of output shards."""
    out: dict[int, dict] = {}
    for plan in sorted({r["plan"] for r in rows}):
        own = sorted((r for r in rows if r["plan"] == plan and r["size"] > 0 and r["want"] > 0), key=lambda r: r["source"])
        blocks = np.array([-(-r["size"] // block) for r in own], np.int64)
        # A source that cannot give what is asked gives all its blocks as often as it may.
        full = np.array([r["repeats"] for r in own], np.int64) * blocks
        left = np.where([r["want"] > r["cap"] for r in own], full, np.minimum(np.rint([r["want"] / (r["size"] / b) for r, b in zip(own, blocks)]), full)).astype(np.int64)
        if left.sum():
            seeds = mix64(np.array([seed * 1_000_003 + plan * 1_009 + s for s in range(len(own))])) >> np.uint64(34)
            out[plan] = {"names": [r["source"] for r in own], "blocks": blocks, "slots": left, "seeds": seeds.astype(np.int64), "shards": int(-(-left.sum() // SLOTS))}
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of each source in one output shard.

    Shards are halved again and again; the counts of a left half are drawn given those of both, by a generator that the
    half's place seeds. So each shard finds its own counts, and all together use up the slots."""
    first, low, high = np.zeros_like(slots), 0, shards
    total = int(slots.sum())
    edge = lambda i: total * i // shards
    while high - low > 1:
        middle = (low + high) // 2
        # numpy's "marginals" method takes any size
        left = np.random.default_rng([*seed, low, high]).multivariate_hypergeometric(slots, edge(middle) - edge(low), method="marginals")
        if shard < middle:
            slots, high = left, middle
        else:
            first, slots, low = first + left, slots - left, middle
    return first, slots


def draw(spark: SparkSession, plans: dict[int, dict], seed: int) -> DataFrame:
    """(plan, source, block, slot): the blocks that the output shards of each plan are filled with, drawn shard by shard by the tasks."""
    shards = spark.createDataFrame([(p, v["shards"]) for p, v in plans.items()], "plan int, shards bigint")
    # Shards are dealt out in groups of up to GROUP, so that the rows spread over the tasks before they are expanded.
    groups = shards.select("plan", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1, F.lit(GROUP).cast("bigint"))).alias("begin"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for plan, begin in zip(b.column("plan").to_pylist(), b.column("begin").to_pylist()):
                v = plans[plan]
                for shard in range(begin, min(begin + GROUP, v["shards"])):
                    first, n = shard_counts(v["slots"], v["shards"], shard, [seed, plan])
                    row = np.repeat(np.arange(len(n)), n)  # about SLOTS rows
                    slot = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    blocks = v["blocks"][row]
                    at = permute(slot % blocks, blocks, v["seeds"][row] + (slot // blocks) * 7_919)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), plan, np.int32)), pa.array(v["names"]).cast(pa.string()).take(pa.array(row)), pa.array(at), pa.array(slot)], names=["plan", "source", "block", "slot"])

    return groups.repartition(F.xxhash64("plan", "begin")).mapInArrow(fill, "plan int, source string, block bigint, slot bigint")


def mix(docs: DataFrame, targets: DataFrame, *, block: int = BLOCK, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """docs(id bigint, source string, size bigint), targets(plan int, ratio double, source string, share double, repeats int).

    Returns (copies, report). A document takes part if id, clean source and size are not null; repeated rows of an id
    count once. total is the size of all of them. copies(plan, source, id, tokens bigint, times int): what each plan takes
    of a document, times being the most that any of its tokens is repeated. report(plan, source, target_share, wanted
    double, available bigint, reached bigint, reached_share double, out_of_reach boolean): one row for each distinct
    target; wanted = share * ratio * total, available = repeats * size of the source (0 without documents). A source that
    is asked for more gives all it may; out_of_reach says of the blocks drawn that they are all of these and still too few. Shares are of what the plan reached. Sizes are met to within
    half a block for each source. Targets with a null plan or source take no part; a null share or ratio counts as 0, null or negative
    repeats as 0. Empty tables give empty results; further columns are ignored."""
    spark = docs.sparkSession
    good = docs.select("id", clean_source(F.col("source")).alias("source"), F.col("size").cast("bigint").alias("size")).where("id IS NOT NULL AND source IS NOT NULL AND size IS NOT NULL")
    good = good.groupBy("id").agg(F.min(F.struct("source", "size")).alias("x")).select("id", "x.*")
    asked = targets.where(F.col("plan").isNotNull() & F.col("source").isNotNull()).select("plan", "source", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(0)).alias("repeats")).distinct()
    sizes = good.groupBy("source").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    sized = asked.join(sizes, "source", "left").withColumn("total", F.lit(total)).withColumn("size", F.coalesce("size", F.lit(0)))
    sized = sized.withColumn("want", F.col("share") * F.col("ratio") * F.col("total")).withColumn("cap", F.col("repeats").cast("bigint") * F.col("size"))
    rows = [r.asDict() for r in sized.limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    drawn = draw(spark, plan_sources(rows, block, seed), seed)
    used = drawn.groupBy("plan", "source", "block").agg(F.count("*").alias("times"))
    # Both sides grow with the data: neither is ever broadcast.
    taken = pieces(good, block).join(used.hint("merge"), ["source", "block"])
    copies = taken.groupBy("plan", "source", "id").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").cast("int").alias("times"))
    reached = copies.groupBy("plan", "source").agg(F.sum("tokens").alias("reached"))
    report = sized.join(reached, ["plan", "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    whole = F.sum("reached").over(Window.partitionBy("plan"))
    report = report.select("plan", "source", F.col("share").alias("target_share"), F.col("want").alias("wanted"), F.col("cap").alias("available"), "reached", F.when(whole > 0, F.col("reached") / whole).otherwise(0.0).alias("reached_share"), ((F.col("reached") >= F.col("cap")) & (F.col("want") > F.col("reached"))).alias("out_of_reach"))
    return copies, report
