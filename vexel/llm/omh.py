"""Near-duplicate texts by Order MinHash, and almost equal vectors of records without a text.

Each of ORDERED hash functions picks the smallest occurrence-labelled k-mers of a text (k words; the second "a b" differs from
the first) and keeps them in text order: the sketch is their sequence, so texts that agree in it are near in edit distance.
Reordering breaks this order, but is to be found, too: UNORDERED sketches of the smallest labelled words, without order,
bring such texts together. Buckets are joined on their keys; inside the join a
64-bit sketch of one-bit minima drops pairs that are far from similar, so a bucket emits only likely pairs.

Candidates are decided by a banded alignment of their words: in text order first, whose common subsequence proves pairs that
were edited; what this doesn't prove is aligned again in the order of the word hashes, where reordered texts stand side by
side and the common subsequence is all that they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as routing
from .common import cut, is_blank, is_valid, mix64, unit, vectors_of, words
from .markov import near_pairs, once

#: Sketches, and minima of each: of k-mers of two words in text order, and of single words. Two texts at 0.8 by changed words
#: agree in a share 0.64 of their k-mers and share an ordered sketch with probability 0.998; any at 0.8 an unordered one with 0.9998.
ORDERED, KMERS, UNORDERED, MERS = 12, 2, 16, 4
#: Of 64 one-bit minima a pair at 0.8 differs in 6.4 on average; 18 is 4.8 standard deviations more.
MOST_BITS = 18
BAND = 8
#: Words of one side that are aligned at once.
CELLS = 100_000


def labelled(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Token hashes with the number of the occurrence within the text mixed in."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, doc))
    t, d = tokens[order], doc[order]
    start = np.ones(len(t), bool)
    start[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(t)), 0))
    out = np.empty_like(tokens)
    out[order] = mix64(t ^ (np.arange(len(t)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def grams(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labelled hashes of the k-mers of two words of each text, in text order: one less than words."""
    end = np.cumsum(sizes) - 1
    with np.errstate(over="ignore"):
        both = mix64(tokens[:-1] * np.uint64(31) + tokens[1:])
    return labelled(np.delete(both, end[:-1]), sizes - 1)


def minima(tokens: np.ndarray, sizes: np.ndarray, count: int, seed: int, ordered: bool) -> np.ndarray:
    """For each text one hash of its `count` smallest tokens under a hash function: in text order, or smallest first."""
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = mix64(tokens, seed)
    low, place = np.empty((count, len(sizes)), np.uint64), np.empty((count, len(sizes)), np.int64)
    for i in range(count):
        low[i] = np.minimum.reduceat(h, begin)
        at = np.nonzero(h == low[i][doc])[0]
        place[i, doc[at]] = at
        h[at] = np.uint64(2**64 - 1)
    if ordered:
        low = np.take_along_axis(low, np.argsort(place, axis=0), axis=0)
    key = np.full(len(sizes), seed, np.uint64)
    for i in range(count):
        key = mix64(key ^ low[i], i)
    return key


def sketch(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys [texts, ORDERED + UNORDERED], bits [texts]) of word hashes; every text has at least MERS words."""
    mers, own = grams(tokens, sizes), labelled(tokens, sizes)
    keys = [minima(mers, sizes - 1, KMERS, 1_000 + s, True) for s in range(ORDERED)] + [minima(own, sizes, MERS, 10 + s, False) for s in range(UNORDERED)]
    begin = np.cumsum(sizes) - sizes
    bits = np.zeros(len(sizes), np.uint64)
    for s in range(64):
        bits |= (np.minimum.reduceat(mix64(own, s + 100), begin) >> np.uint64(17) & np.uint64(1)) << np.uint64(s)
    return np.stack(keys, axis=1), bits


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of (node, words) that has rows, with its word hashes and numbers of words."""
    known: dict[str, int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column("words")
        flat = column.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        if len(known) > 1_000_000:
            known.clear()
        every = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in names], np.uint64)
        yield b, every[flat.indices.to_numpy()], np.diff(column.offsets.to_numpy())


def sketched(texts: DataFrame) -> DataFrame:
    """texts(node bigint, words array<string>) -> (node, n int, key bigint, bits bigint): a row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, tokens, sizes in hashed(batches):
            keys, bits = sketch(tokens, sizes)
            times = keys.shape[1]
            node = np.repeat(b.column("node").to_numpy(), times)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(sizes, times).astype(np.int32)), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(bits, times).view(np.int64))], names=["node", "n", "key", "bits"])

    return texts.select("node", "words").mapInArrow(run, "node bigint, n int, key bigint, bits bigint")


def tokens_of(texts: DataFrame) -> DataFrame:
    """texts(node bigint, words array<string>) -> (node, w array<bigint>): labelled word hashes in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, tokens, sizes in hashed(batches):
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            own = (labelled(tokens, sizes) >> np.uint64(2)).view(np.int64)  # over 0, so that padding differs from all
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(own))], names=["node", "w"])

    return texts.select("node", "words").mapInArrow(run, "node bigint, w array<bigint>")


def align(a: np.ndarray, b: np.ndarray, band: int = BAND) -> np.ndarray:
    """Longest common subsequence within `band` cells of the diagonal, for rows of words padded at the end with values that match nothing."""
    rows, n = a.shape
    width = 2 * band + 1
    wide = np.full((rows, b.shape[1] + n + 2 * width), -2, b.dtype)
    wide[:, band : band + b.shape[1]] = b
    last = np.zeros((rows, width + 1), np.int32)  # last[:, d] is the cell of the row before at column i - 1 - band + d
    for i in range(n):
        match = wide[:, i : i + width] == a[:, i : i + 1]
        now = np.zeros_like(last)
        now[:, :width] = np.maximum(last[:, :width] + match, last[:, 1 : width + 1])
        now[:, :width] = np.maximum.accumulate(now[:, :width], axis=1)
        last = now
    return last.max(axis=1)


def padded(flat: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """[rows, longest] of values that stand one row after the other."""
    out = np.full((len(sizes), int(sizes.max(initial=1))), fill, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def align_sorted(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, threshold: float) -> np.ndarray:
    """What rows of words (padded with -1, -2) share, by aligning them in the order of the words' hashes; exact for pairs at `threshold`.

    Short rows are aligned as a whole: similar ones stay within a band of the differences they may have. Long ones are cut
    at the same hashes into stretches of some 48 words, each aligned in full."""
    longest = int(max(la.max(initial=1), lb.max(initial=1)))
    if longest <= 64:
        top = np.iinfo(np.int64).max
        x, y = np.sort(np.where(a < 0, top, a), axis=1), np.sort(np.where(b < 0, top - 1, b), axis=1)
        return align(x, y, int(np.ceil(longest * (1 - threshold) / threshold)) + 1)
    parts = 1 << int(np.ceil(np.log2(longest / 48)))

    def cut_up(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(x >= 0)
        v = x[row, col]
        place = row * parts + (v >> np.int64(62 - parts.bit_length() + 1))
        order = np.lexsort((v, place))
        return v[order], np.bincount(place, minlength=len(x) * parts)

    (va, na), (vb, nb) = cut_up(a), cut_up(b)
    x, y = padded(va, na, -1), padded(vb, nb, -2)
    return align(x, y, max(x.shape[1], y.shape[1])).reshape(-1, parts).sum(axis=1)


def shared_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many labelled words both rows have."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(axis=1)


def verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b, wa, wb: arrays of labelled word hashes in text order) -> (a, b, similarity double, edit double).

    Kept is what one of the two alignments shows to reach the threshold."""

    def decide(t: pa.RecordBatch) -> pa.RecordBatch:
        (a, la), (b, lb) = ((padded(t.column(n).flatten().to_numpy(), sizes := np.diff(t.column(n).offsets.to_numpy()), fill), sizes) for n, fill in (("wa", -1), ("wb", -2)))
        lcs = align(a, b).astype(np.int64)
        edit = lcs / (la + lb - lcs)
        ok = edit >= threshold
        rest = np.nonzero(~ok)[0]
        common = align_sorted(a[rest], b[rest], la[rest], lb[rest], threshold).astype(np.int64) if len(rest) else rest
        ok[rest] = common / (la[rest] + lb[rest] - common) >= threshold
        same = shared_words(a[ok], b[ok])
        return pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok)), pa.array(same / (la[ok] + lb[ok] - same)), pa.array(edit[ok])], names=["a", "b", "similarity", "edit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            # Pairs of like length together, as all are padded to the longest; no more than CELLS words at once.
            longest = np.maximum(*(np.diff(whole.column(n).offsets.to_numpy()) for n in ("wa", "wb")))
            order = np.argsort(longest, kind="stable")
            size, at = longest[order], 0
            while at < len(order):
                take = max(1, int(np.searchsorted(size[at:] * np.arange(1, len(order) - at + 1), CELLS)))
                take = min(take, max(1, int(np.searchsorted(size[at:], 2 * size[at] + 16))))
                yield decide(whole.take(pa.array(order[at : at + take])))
                at += take

    return pairs.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint, similarity double, edit double")


def similar_texts(nodes: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """nodes(node bigint, words array<string> of at least MERS words) -> (a, b, similarity, edit), a < b, similarity >= threshold.

    similarity: shared words over all words, counted with repetition. edit: the same for words in common order (a banded
    alignment), at most similarity. One row for each pair of nodes; groups of copies should be one node before."""
    kept = sketched(nodes)
    one, two = kept.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), "key"), kept.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), "key")
    near = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) <= MOST_BITS
    sizes = (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & near & sizes).select("a", "b").distinct()
    tokens = tokens_of(nodes)
    full = pairs.join(tokens.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a").join(tokens.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b")
    return verify(full, threshold)


def equal_vectors(records: DataFrame, *, floor: float = 0.99, probes: int = 2) -> DataFrame:
    """records(id, vector, blank boolean) -> (a, b), a < b: pairs of valid vectors with cosine >= floor of which one is blank at least."""
    rows = records.where(F.col("id").isNotNull() & is_valid(F.col("vector"))).select("id", "vector", "blank")
    cells = routing.fit(rows, rows.count())
    at = ["cell", "part", "other"]

    def group(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        ids, raw = once(data)
        qids, raw_q = once(queries)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if len(ids) and len(qids):
            x, q = unit(raw), unit(raw_q)
            for i in range(0, len(q), 1_024):
                r, c, _ = near_pairs(q[i : i + 1_024], x, raw_q[i : i + 1_024], raw, floor)
                one, two = qids[r + i], ids[c]
                out.append((np.minimum(one, two)[one != two], np.maximum(one, two)[one != two]))
        a, b = (np.concatenate(z) for z in zip(*out)) if out else (np.array([], np.int64),) * 2
        return pa.table({"a": a, "b": b})

    near = routing.home(rows, cells, spread=True).groupBy(*at).cogroup(routing.visit(rows.where("blank"), cells, probes, spread=True).groupBy(*at)).applyInArrow(group, "a bigint, b bigint")
    return near.distinct()


def near_duplicates(records: DataFrame, *, threshold: float = 0.8, floor: float = 0.99, least_words: int = 10) -> DataFrame:
    """records(id bigint, chunk string, vector array<float>, canon string) -> (id_a, id_b, similarity, edit), id_a < id_b.

    Two kinds of pairs. Texts of at least `least_words` words each, not equal in canon, whose words counted with
    repetition agree in a share of at least `threshold`. And records of which one at least has a blank chunk, both with
    valid vectors, whose cosine is at least `floor` (similarity and edit are null). A repeated id counts once (rows of an
    id are taken to agree), null ids and null or short texts take no part; ids of equal texts are expanded, so each pair
    of ids has its row. Empty tables give no rows; further columns are ignored."""
    rows = records.where(F.col("id").isNotNull())
    member, pairs = text_classes(rows, threshold, least_words)
    # Nodes with the same words in another order have different node hashes and are found as pairs of similarity 1.
    left = member.select(F.col("node").alias("a"), F.col("id").alias("i"), F.col("canon").alias("ci"))
    right = member.select(F.col("node").alias("b"), F.col("id").alias("j"), F.col("canon").alias("cj"))
    found = pairs.join(left, "a").join(right, "b").where(F.col("ci") != F.col("cj"))
    one, two = left.withColumnRenamed("a", "node"), right.withColumnRenamed("b", "node")
    within = canons_apart(member).join(one, ["node", "ci"]).join(two, ["node", "cj"]).where(F.col("i") != F.col("j"))
    found = found.select("i", "j", "similarity", "edit").unionByName(within.select("i", "j", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("edit")))
    by_text = found.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "similarity", "edit")
    by_vector = equal_vectors(rows.select("id", "vector", is_blank(F.col("chunk")).alias("blank")), floor=floor)
    none = F.lit(None).cast("double")
    return by_text.unionByName(by_vector.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), none.alias("similarity"), none.alias("edit")))


def text_classes(rows: DataFrame, threshold: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, node, canon) of the ids with enough words, and near pairs (a, b, similarity, edit) of nodes.

    A node stands for all texts of the same words in the same order; canon is a hash of the canonical text."""
    texts = rows.select("id", F.col("canon"), words(F.col("chunk")).alias("words")).where(F.size("words") >= least_words)
    keyed = texts.select("id", "canon", "words", F.xxhash64("words").alias("node"))
    nodes = keyed.groupBy("node").agg(F.first("words").alias("words"))
    member = cut(keyed.select("id", "node", F.xxhash64("canon").alias("canon")).distinct())
    return member, similar_texts(nodes, threshold=threshold)


def canons_apart(member: DataFrame) -> DataFrame:
    """(node, ci, cj): texts of one node whose canon differs, as where only their fields are parted otherwise."""
    kinds = member.groupBy("node").agg(F.collect_set("canon").alias("canons")).where(F.size("canons") > 1)
    return kinds.select("node", F.explode("canons").alias("ci"), "canons").select("node", "ci", F.explode("canons").alias("cj")).where(F.col("ci") < F.col("cj"))


def near_groups(records: DataFrame, *, threshold: float = 0.8, floor: float = 0.99, least_words: int = 10) -> DataFrame:
    """records as in near_duplicates -> (id, group_id, links): the group and the number of near duplicates of each id that has one.

    group_id is the smallest id of all that are linked, directly or through others. Ids of equal texts, and of equal
    vectors, are classes: pairs are made between classes only, and ids take their class's links. Nulls, repeated ids and
    empty tables as in near_duplicates."""
    rows = records.where(F.col("id").isNotNull())
    member, pairs = text_classes(rows, threshold, least_words)
    classes = cut(member.groupBy("node", "canon").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    side = lambda x, y: classes.select(F.col("node").alias(x), F.col("canon").alias(f"c{x}"), F.col("rep").alias(y), F.col("size").alias(f"n{y}"))
    apart = pairs.join(side("a", "i"), "a").join(side("b", "j"), "b").where(F.col("ca") != F.col("cb")).select("i", "j", "ni", "nj")
    within = canons_apart(member).withColumnsRenamed({"node": "a", "ci": "ca", "cj": "cb"}).withColumn("b", F.col("a")).join(side("a", "i"), ["a", "ca"]).join(side("b", "j"), ["b", "cb"]).select("i", "j", "ni", "nj")
    linked = cut(apart.unionByName(within))
    text_links = linked.select(F.col("i").alias("rep"), F.col("nj").alias("links")).unionByName(linked.select(F.col("j").alias("rep"), F.col("ni").alias("links"))).groupBy("rep").agg(F.sum("links").alias("links"))
    by_text = member.join(classes.select("node", "canon", "rep"), ["node", "canon"]).join(text_links, "rep").select("id", "rep", "links")
    # Vectors: a class is all ids of one vector; a blank id is linked to all of a near class and its own, another to the blank ones.
    vectors = rows.where(is_valid(F.col("vector"))).groupBy("id").agg(F.min(F.struct("vector", is_blank(F.col("chunk")).alias("blank"))).alias("x")).select("id", "x.*")
    keyed = cut(vectors.select("id", "blank", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")))
    kinds = cut(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.count_if("blank").alias("blanks")))
    standing = vectors.select("id", "vector").join(kinds.select(F.col("rep").alias("id"), (F.col("blanks") > 0).alias("blank")), "id")
    near = cut(equal_vectors(standing, floor=floor))
    number = lambda x: kinds.select(F.col("rep").alias(x), F.col("size").alias(f"s{x}"), F.col("blanks").alias(f"b{x}"))
    both = near.join(number("a"), "a").join(number("b"), "b")
    links = both.select(F.col("a").alias("rep"), F.col("sb").alias("s"), F.col("bb").alias("b")).unionByName(both.select(F.col("b").alias("rep"), F.col("sa").alias("s"), F.col("ba").alias("b")))
    links = links.unionByName(kinds.select("rep", F.col("size").alias("s"), F.col("blanks").alias("b"))).groupBy("rep").agg(F.sum("s").alias("s"), F.sum("b").alias("b"))
    own = keyed.join(kinds.select("h1", "h2", "rep"), ["h1", "h2"]).join(links, "rep")
    by_vector = own.select("id", "rep", F.when(F.col("blank"), F.col("s") - 1).otherwise(F.col("b")).alias("links")).where("links > 0")
    # An id with both kinds of links joins its text class and its vector class.
    every = cut(by_text.select("id", F.col("rep").alias("text"), F.col("links").alias("t")).join(by_vector.select("id", F.col("rep").alias("vector"), F.col("links").alias("v")), "id", "full"))
    at = F.struct(F.col("text").isNull().cast("int").alias("kind"), F.coalesce("text", "vector").alias("rep"))
    code = lambda kind, rep: F.xxhash64(F.lit(kind), rep)
    edges = linked.select(code(0, F.col("i")).alias("id_a"), code(0, F.col("j")).alias("id_b")).unionByName(near.select(code(1, F.col("a")).alias("id_a"), code(1, F.col("b")).alias("id_b")))
    edges = edges.unionByName(every.where("text IS NOT NULL AND vector IS NOT NULL").select(code(0, F.col("text")).alias("id_a"), code(1, F.col("vector")).alias("id_b")).distinct())
    joined = groups(edges.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))
    placed = every.withColumn("at", code_of(at)).join(joined.select(F.col("id").alias("at"), "group_id"), "at", "left").withColumn("group", F.coalesce("group_id", "at"))
    first = placed.groupBy("group").agg(F.min("id").alias("group_id"))
    return placed.drop("group_id").join(first, "group").select("id", "group_id", (F.coalesce("t", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("links"))


def code_of(at: F.Column) -> F.Column:
    """The number of a class in the graph of classes: of its kind (0 text, 1 vector) and smallest id."""
    return F.xxhash64(at["kind"], at["rep"])


def groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """pairs(id_a, id_b) -> (id, group_id, links): connected records get the smallest id among them.

    Each round a record takes the smallest label among its own, its neighbours' and that label's label, so chains shrink
    fast; it ends when no label changes. Labels are written to the checkpoint folder each round."""
    one = cut(pairs.select("id_a", "id_b").distinct())
    both = one.unionByName(one.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    links = both.groupBy("id_a").agg(F.count_distinct("id_b").alias("links"), F.least(F.min("id_b"), F.first("id_a")).alias("label"))
    label = cut(links.select(F.col("id_a").alias("id"), "links", "label"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("id_b"), F.col("label").alias("l")), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("l").alias("l"))
        step = label.join(near, "id").withColumn("new", F.least("label", "l"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, "new", "left").select("id", "links", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        moved = step.where(F.col("new") < F.col("label")).limit(1).count()
        label = step.select("id", "links", F.col("new").alias("label"))
        if not moved:
            return label.select("id", F.col("label").alias("group_id"), "links")
    raise RuntimeError(f"labels still change after {rounds} rounds")
