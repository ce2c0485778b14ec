"""Passages of evaluation texts in a corpus, whole or with small edits.

Items are cut into windows of as many words as a passage, texts also into those shorter or longer by up to the edits allowed,
as words left out or added make them. A random walk over a window (CGK) writes one word at each
of three times as many steps and moves on or stays by a random bit of step and word; equal windows give equal walks, and
windows few edits apart give walks that differ in few steps. Repeated samples of the steps are hashed; windows that agree
in one sample are candidates, verified by their exact edit distance in words. The number of repetitions follows from the
recall wanted; without edits one is enough for all.

Evaluation items are sent to the tasks in blocks of at most ITEMS, one pass over the corpus for each block; the corpus is
never shuffled. A window with more words unknown to the items than edits allowed cannot match and is not walked."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

ITEMS = 20_000
#: Steps in one sample, and the share of them that one edit leaves alike: chosen so that the repetitions that follow reach the
#: recall asked for in simulations of 20,000 windows of 12 words (13 repetitions: 0.997 of changed words, 0.994 of those left out).
SAMPLE, ALIKE = 4, 0.74
#: Pairs of windows that are verified at once.
PAIRS = 200_000
#: Words of the documents handled at once.
BLOCK = 400_000
WORD = re.compile(r"[^\W_]+")
FOUND = "id bigint, item bigint, edits int, windows int"


def repetitions(edits: int, recall: float) -> int:
    """How many samples find a window `edits` away with the given probability."""
    hit = ALIKE ** (edits * SAMPLE)
    return 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def walk(windows: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The first steps of the CGK embedding of [rows, words] numbers: [rows, steps], -1 after the end of a window."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -1, windows.dtype)], axis=1)
    at = np.zeros(rows, np.int64)
    every = np.arange(rows)
    out = np.empty((rows, steps), np.int64)
    for step in range(steps):
        word = padded[every, at]
        out[:, step] = word
        move = mix64(word.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(step), seed) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), n)
    return out


def keys(windows: np.ndarray, repetition: int, size: int) -> np.ndarray:
    """One hash for each window: of SAMPLE steps of a walk that is drawn for the repetition.

    A walk of 3 * size steps has passed the last word after some 2 * size; steps are drawn from the first 4 / 3 * size, one
    from each quarter of these, where nearly all walks are still under way."""
    quarter = max(1, size * 4 // 3 // SAMPLE)
    steps = np.arange(SAMPLE) * quarter + np.random.default_rng(repetition).integers(0, quarter, SAMPLE)
    path = walk(windows, repetition, int(steps[-1]) + 1)
    out = np.zeros(len(windows), np.uint64)
    for s in steps:
        out = mix64(out ^ path[:, s].astype(np.uint64), int(s))
    return out


def distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance in words of [rows, n] and [rows, m] windows pairwise, within a band of `most` >= |n - m|; most + 1 where it is more."""
    rows, n = a.shape
    m = b.shape[1]
    big = most + 1
    last = np.tile(np.abs(np.arange(-most, most + 1)), (rows, 1))
    last[:, :most] = big  # columns before the start
    for i in range(n):
        now = np.full((rows, 2 * most + 1), big, np.int64)
        for d in range(2 * most + 1):
            j = i + d - most  # the column compared; its cell is j + 1
            if j < -1 or j >= m:
                continue
            best = np.full(rows, i + 1, np.int64) if j == -1 else last[:, d] + (a[:, i] != b[:, j])
            if j >= 0 and d + 1 <= 2 * most:
                best = np.minimum(best, last[:, d + 1] + 1)
            if j >= 0 and d >= 1:
                best = np.minimum(best, now[:, d - 1] + 1)
            now[:, d] = np.minimum(best, big)
        last = now
    return last[:, m - n + most]


def item_windows(items: list[tuple[int, str]], size: int) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word from 1, distinct windows [rows, size], items of all windows one after the other, ends of each window's items)."""
    known: dict[str, int] = {}
    windows: list[list[int]] = []
    owner: list[int] = []
    for item, text in items:
        w = [known.setdefault(x, len(known) + 1) for x in WORD.findall(text.lower())]
        for i in range(len(w) - size + 1):
            windows.append(w[i : i + size])
            owner.append(item)
    one, kind = np.unique(np.array(windows, np.int64).reshape(-1, size), axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    return known, one, np.array(owner, np.int64)[order], np.cumsum(np.bincount(kind.ravel(), minlength=len(one)))


def search_block(texts: DataFrame, items: list[tuple[int, str]], size: int, edits: int, recall: float) -> DataFrame:
    known, windows, owner, owners = item_windows(items, size)
    times = repetitions(edits, recall)
    index = []
    for r in range(times):
        k = keys(windows, r, size)
        order = np.argsort(k, kind="stable")
        index.append((k[order], order))

    def near(flat: np.ndarray, sizes: np.ndarray, total: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
        """(document, item, edits) for each pair of a document window of `length` words and a near item window."""
        start = np.arange(max(0, len(flat) - length + 1))
        end = np.repeat(np.cumsum(sizes), sizes)[: len(start)]
        # Where words are left out, that many edits are spent.
        known_least = length - edits + max(0, size - length)
        start = start[(start + length <= end) & (total[np.minimum(start + length, len(flat))] - total[start] >= known_least)]
        if not len(start):
            return None
        own = flat[start[:, None] + np.arange(length)]
        hits = [(np.array([], np.int64),) * 2]
        for r, (sorted_keys, order) in enumerate(index):
            k = keys(own, r, size)
            low, high = np.searchsorted(sorted_keys, k, "left"), np.searchsorted(sorted_keys, k, "right")
            some = np.nonzero(high > low)[0]
            n = high[some] - low[some]
            end, at = np.cumsum(n), 0
            while at < len(some):  # a key that many windows have is verified piece by piece
                stop = max(at + 1, int(np.searchsorted(end, end[at] - n[at] + PAIRS, "right")))
                times = n[at:stop]
                row = np.repeat(some[at:stop], times)
                window = order[np.repeat(low[some[at:stop]], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
                far = distance(own[row], windows[window], edits) if edits else (own[row] != windows[window]).any(axis=1).astype(np.int64)
                ok = far <= edits
                hits.append((row[ok] * np.int64(len(windows)) + window[ok], far[ok]))
                at = stop
        pair, first = np.unique(np.concatenate([h[0] for h in hits]), return_index=True)
        far = np.concatenate([h[1] for h in hits])[first]
        row, window = pair // max(1, len(windows)), pair % max(1, len(windows))
        n = np.diff(owners, prepend=0)[window]
        at = np.repeat(owners[window] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.searchsorted(np.cumsum(sizes), start[row], side="right"), n), owner[at], np.repeat(far, n)

    def block(ids: list[int], held: list[list[int]]) -> pa.RecordBatch | None:
        sizes = np.array([len(h) for h in held])
        flat = np.fromiter((w for h in held for w in h), np.int64, int(sizes.sum()))
        total = np.concatenate([[0], np.cumsum(flat > 0)])
        found = [f for length in range(max(1, size - edits), size + edits + 1) if (f := near(flat, sizes, total, length)) is not None]
        if not found:
            return None
        doc, item, far = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((far, item, doc))
        doc, item, far = doc[order], item[order], far[order]
        first = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))[0] if len(doc) else np.array([], np.int64)
        count = np.diff(np.append(first, len(doc)))
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc[first]]), pa.array(item[first]), pa.array(far[first].astype(np.int32)), pa.array(count.astype(np.int32))], names=["id", "item", "edits", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.get
        for b in batches:
            ids: list[int] = []
            held: list[list[int]] = []
            n = 0
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                w = [get(x, 0) for x in WORD.findall(t.lower())]
                if len(w) < max(1, size - edits):
                    continue
                ids.append(i)
                held.append(w)
                n += len(w)
                if n >= BLOCK:
                    if (out := block(ids, held)) is not None:
                        yield out
                    ids, held, n = [], [], 0
            if held and (out := block(ids, held)) is not None:
                yield out

    return texts.mapInArrow(run, FOUND)


def leaks(texts: DataFrame, items: DataFrame, *, size: int = 12, edits: int = 0, recall: float = 0.99, at_once: int = ITEMS) -> DataFrame:
    """texts(id bigint, text string), items(item bigint, text string) -> (id, item, edits int, windows int).

    A row for each text and item such that some size - edits to size + edits consecutive words of the text are within `edits`
    word edits of `size` consecutive words of the item; edits: of the nearest such windows, windows: how many pairs of windows there are.
    With edits = 0 all are found, otherwise a window with the full number of edits is found with probability `recall`.
    Words are runs of letters or digits of the lower-cased text. Null ids and texts and items of fewer words take no part;
    repeated rows give one row, with the windows of one of them. Empty tables give no rows; further columns are ignored."""
    good = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    asked = items.where(F.col("item").isNotNull() & F.col("text").isNotNull()).select("item", "text").distinct()
    blocks = max(1, -(-asked.count() // at_once))
    out = None
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        found = search_block(good, sorted(rows), size, edits, recall)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("id", "item").agg(F.min("edits").alias("edits"), F.max("windows").alias("windows"))
