"""Texts equal but for their format: recursive radix partitioning on canonical bytes, then counting in tries.

Canonical texts are counted first by text and a salt, so that a text with a large share of all rows becomes a few rows.
Buckets are prefixes of the canonical bytes. A level counts the rows and bytes under each prefix; what is under a small enough
prefix is a bucket, the rest is split by as many further bytes again, until each bucket fits or holds one text only. A bucket goes into a path-compressed trie
whose terminal nodes count copies and hold the smallest id."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Distinct salted texts that a bucket may hold, and bytes of these; bytes of the first level, and parts that the copies of one text fall into.
FITS, BYTES, STEP, SALTS = 20_000, 64_000_000, 2, 16


class Trie:
    """A path-compressed trie. A node is [terminal, edges]: terminal is a slot or -1, edges map a first byte to (label, node)."""

    def __init__(self) -> None:
        self.root: list = [-1, {}]
        self.slots = 0

    def slot(self, key: bytes) -> int:
        """The number of the terminal node for key, made if it is new."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node[1].get(key[at])
            if edge is None:
                leaf = [-1, {}]
                node[1][key[at]] = (key[at:], leaf)
                node, at = leaf, end
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n, most = 1, min(len(label), end - at)
            while n < most and label[n] == key[at + n]:
                n += 1
            middle = [-1, {label[n]: (label[n:], child)}]
            node[1][key[at]] = (label[:n], middle)
            node, at = middle, at + n
        if node[0] < 0:
            node[0] = self.slots
            self.slots += 1
        return node[0]


def count_bucket(t: pa.Table) -> pa.Table:
    """(key binary, id, n, salt) of one bucket -> (code, salt, keep, copies)."""
    trie = Trie()
    slots = [trie.slot(k) for k in t["key"].to_pylist()]
    ids, counts = t["id"].to_pylist(), t["n"].to_pylist()
    keep: list[int] = [0] * trie.slots
    copies = [0] * trie.slots
    for s, i, n in zip(slots, ids, counts):
        keep[s] = i if not copies[s] else min(keep[s], i)
        copies[s] += n
    return pa.table({"code": t["code"], "salt": t["salt"], "keep": pa.array([keep[s] for s in slots], pa.int64()), "copies": pa.array([copies[s] for s in slots], pa.int64())})


def buckets(partial: DataFrame, fits: int = FITS, most: int = BYTES, step: int = STEP) -> DataFrame:
    """partial(key binary, code string, ...) with a column bucket binary added: the shortest prefix under which at most `fits` rows of `most` bytes lie.

    A text that ends before the prefix is complete is its own bucket under that prefix. Prefixes double from level to level,
    so there are no more levels than bits in the length of the longest beginning that too many texts share."""
    todo, done, length = partial, None, step
    while True:
        prefix = F.substring("key", 1, length)
        sizes = todo.groupBy(prefix.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("key").cast("bigint")).alias("bytes"), F.min("code").alias("low"), F.max("code").alias("high"))
        large = cut(sizes.where(((F.col("rows") > fits) | (F.col("bytes") > most)) & (F.col("low") != F.col("high"))).select(F.col("bucket").alias("large")))
        if not large.limit(1).count():
            last = todo.withColumn("bucket", prefix)
            return last if done is None else done.unionByName(last)
        split = cut(todo.withColumn("bucket", prefix).join(large, F.col("bucket") == F.col("large"), "left"))
        fit = split.where(F.col("large").isNull()).drop("large")
        done = fit if done is None else done.unionByName(fit)
        todo = split.where(F.col("large").isNotNull()).drop("large", "bucket")
        length *= 2


def collapse(texts: DataFrame, *, fits: int = FITS, most: int = BYTES, step: int = STEP, salts: int = SALTS) -> DataFrame:
    """texts(id bigint, canon string) -> (id bigint, keep bigint, copies bigint), one row for each id with a text.

    canon is the canonical text; null and "" (blank) take no part, nor do null ids. Rows of an id count once. keep is the
    smallest id among equal texts, copies their number of ids, itself included. An empty table gives no rows; further
    columns are ignored. Ids are joined to the counts on (hash of text, salt): of a text with very many copies each join
    key has a share."""
    rows = texts.where(F.col("id").isNotNull() & F.col("canon").isNotNull() & (F.col("canon") != "")).select("id", F.encode("canon", "UTF-8").alias("key")).distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    partial = rows.groupBy("key", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    partial = cut(partial.withColumn("code", code("key")))
    placed = buckets(partial, fits, most, step)
    counted = placed.groupBy("bucket").applyInArrow(count_bucket, "code string, salt int, keep bigint, copies bigint")
    return rows.select("id", "salt", code("key").alias("code")).join(counted, ["code", "salt"]).select("id", "keep", "copies")


def code(key: str) -> F.Column:
    """128 bits that stand for a text in the join: equal texts have equal ones."""
    return F.md5(key)
