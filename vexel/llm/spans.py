"""Long spans shared between texts: k-mer seeds, collinear chains, exact or fuzzy passages.

Seeds are minimizers: of every half a span the k-mer with the smallest hash is one, so a window of `span` characters has the
seed of its first and that of its second half, whatever stands around it. Windows that follow each other with the same two
seeds are a run. Seeds found in one text only are dropped first, then runs of which a seed was dropped.

Each run gets a partner text: the first (for that one the last) of the texts with an equal run; where no text has one, the
first and last of those that have one of its windows, looked up by hash. Partners are proposals of two seeds each, linear in
the runs however common a run is. The matches of two texts are chained in order under a gap cost with a Fenwick tree; a chain
has to score more than a lone seed can. Chains are aligned: both texts are laid side by side along each diagonal of a chain
and as far beyond its seeds as a window reaches. What is equal there for at least `span` characters is shared (exact spans).
No pairs of texts are made but those of a run and its partner.

Passages name both texts, so there each place of a seed meets all places of it in other texts, and the gaps are aligned, too."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, cut, mix64, release

#: Length of a seed as a share of the span, and the least score of a chain in seeds: the two seeds of a window, at most four
#: seeds apart, score 1.7, a lone one scores 1.
KMER_SHARE, LEAST = 1 / 5, 1.5
#: The same for fuzzy passages, whose seeds have to fit between edits (but not under 8 characters).
FUZZY_SHARE = 1 / 10
#: Places of one seed that meet each other in one task; those of more common seeds meet in a grid.
PLACES = 1_000
#: Characters that are hashed at once.
BLOCK = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
#: Score of a chain: characters of its seeds less this much for each character that is skipped.
GAP = 0.05

RUNS = "id bigint, a int, b int, p0 int, p1 int, link bigint, code bigint"
CHAINS = "id bigint, other bigint, start int, end int, other_start int, other_end int, seeds int, score double, diagonals array<struct<start:int,end:int,shift:int>>"


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hasher:
    """Hashes of stretches of a text: prefix sums of code points times powers of an odd base, modulo 2**64."""

    def __init__(self) -> None:
        self.n = 0

    def read(self, codes: np.ndarray) -> None:
        n = len(codes)
        with np.errstate(over="ignore"):
            if n > self.n:
                self.n = n
                ones = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
                self.power, self.back = ones(BASE), ones(pow(BASE, -1, 2**64))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) of the text read last."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def kmers(self, codes: np.ndarray, k: int) -> np.ndarray:
        self.read(codes)
        with np.errstate(over="ignore"):
            return mix64((self.sums[k:] - self.sums[:-k]) * self.back[: len(codes) - k + 1])


def least_places(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each position the place of the smallest of the next w hashes, the leftmost of equal ones."""
    n = len(hashes)
    if n < w:
        return np.array([], np.int64)
    bits = max(20, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    v = (hashes & ~low) | np.arange(n, dtype=np.uint64)  # the leftmost of equal ones is the smallest
    whole = -(-n // w) * w
    padded = np.full(whole, 2**64 - 1, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def minimizers(hashes: np.ndarray, ends: np.ndarray, span: int, k: int) -> np.ndarray:
    """Positions of the seeds. hashes: of the k-mer at each position of joined texts; ends: of the text at each position."""
    at = least_places(hashes, span - k + 1)
    return np.unique(at[np.arange(len(at)) + span <= ends[: len(at)]])


def seeds(texts: DataFrame, span: int, k: int, least: int) -> DataFrame:
    """texts(id bigint, text string) -> (id, pos int, seed bigint): of every `span` characters one. Texts shorter than least have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def block(ids: list[int], held: list[str]) -> pa.RecordBatch:
            codes = codes_of("".join(held))
            sizes = np.array([len(t) for t in held])
            start = np.cumsum(sizes) - sizes
            h = hasher.kmers(codes, k)
            at = minimizers(h, np.repeat(start + sizes, sizes)[: len(h)], span, k)
            doc = np.searchsorted(start, at, side="right") - 1
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array((at - start[doc]).astype(np.int32)), pa.array(h[at].view(np.int64))], names=["id", "pos", "seed"])

        ids: list[int] = []
        held: list[str] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if len(t) < least:
                    continue
                ids.append(i)
                held.append(t)
                size += len(t)
                if size >= BLOCK:
                    yield block(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield block(ids, held)

    return texts.where(F.length("text") >= least).select("id", "text").mapInArrow(run, "id bigint, pos int, seed bigint")


def common_seeds(found: DataFrame) -> DataFrame:
    """Those of (id, pos, seed) whose seed at least two texts have."""
    shared = found.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") != F.col("high")).select("seed")
    return found.join(shared, "seed", "left_semi")


def runs(texts: DataFrame, found: DataFrame, span: int, k: int) -> DataFrame:
    """texts of `span` characters or more and their common seeds -> RUNS: windows p0 to p1 of a text that have the seeds at a and b in their halves.

    link stands for what lies between and under the two seeds, code for the windows as a whole and where the seeds are in them."""
    half = span // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i, text, places in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                codes = codes_of(text)
                n = len(codes) - span + 1
                at = least_places(hasher.kmers(codes, k), half - k + 1)
                a, b = at[:n], at[half : half + n]
                good = np.zeros(len(codes), bool)
                good[places] = True
                some = np.nonzero(good[a] & good[b])[0]
                if not len(some):
                    continue
                a, b = a[some], b[some]
                cut = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (some[1:] != some[:-1] + 1)])
                first = np.nonzero(cut)[0]
                last = np.append(first[1:], len(some)) - 1
                a, b, p0, p1 = a[first], b[first], some[first], some[last]
                link = hasher.stretch(a, b + k)
                code = mix64(mix64(hasher.stretch(p0, p1 + span) ^ (a - p0).astype(np.uint64)) ^ (b - p0).astype(np.uint64), 1)
                out.append((np.full(len(a), i, np.int64), a.astype(np.int32), b.astype(np.int32), p0.astype(np.int32), p1.astype(np.int32), link.view(np.int64), code.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "a", "b", "p0", "p1", "link", "code"])

    # The list of a text's seeds is no longer than the text.
    places = found.groupBy("id").agg(F.collect_set("pos").alias("places"))
    return texts.join(places, "id").select("id", "text", "places").mapInArrow(run, RUNS)


def windows(texts: DataFrame, kinds: DataFrame, span: int) -> DataFrame:
    """kinds(id, a, p0, p1, code) -> (code, window): the hash of each of their windows and of where the seed is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for text, listed in zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist()):
                codes = codes_of(text)
                hasher.read(codes)
                for r in listed:
                    p = np.arange(r["p0"], min(r["p1"], len(codes) - span) + 1)
                    if not len(p):
                        continue
                    window = mix64(hasher.stretch(p, p + span) ^ (r["a"] - p).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), r["code"], np.int64)), pa.array(window.view(np.int64))], names=["code", "window"])

    by_text = kinds.groupBy("id").agg(F.collect_list(F.struct("a", "p0", "p1", "code")).alias("kinds"))
    return texts.join(by_text, "id").select("text", "kinds").mapInArrow(run, "code bigint, window bigint")


def run_matches(texts: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """RUNS -> (id, other, pos, other_pos): the two seeds of each run and where they are in the run's partners."""
    place = F.struct("id", "a", "b", "p0", "p1")
    classes = cut(found.groupBy("code").agg(F.first("link").alias("link"), F.min(place).alias("first"), F.max(place).alias("last")))
    alone = F.col("first.id") == F.col("last.id")
    # Runs that no other text has as a whole; their windows are looked up among all runs with the same stretch between seeds.
    links = classes.groupBy("link").agg(F.min("first.id").alias("low"), F.max("last.id").alias("high"), F.max(alone).alias("open")).where(F.col("open") & (F.col("low") != F.col("high")))
    near = classes.join(links.select("link"), "link", "left_semi")
    ends = near.select("code", "link", F.col("first.id").alias("d0"), F.col("first.a").alias("a0"), F.col("last.id").alias("d1"), F.col("last.a").alias("a1"))
    found_windows = windows(texts, near.select("first.id", "first.a", "first.p0", "first.p1", "code"), span).join(ends, "code").withColumn("d0a", F.struct("d0", "a0")).withColumn("d1a", F.struct("d1", "a1"))
    # A window that a great many texts have is one row here and joined back to its runs, which are never gathered.
    shared = found_windows.groupBy("link", "window").agg(F.min("d0a").alias("low"), F.max("d1a").alias("high")).where(F.col("low.d0") != F.col("high.d1"))
    pairs = found_windows.where(F.col("d0") == F.col("d1")).select("link", "window", "code", "d0").join(shared, ["link", "window"])
    other = F.when(F.col("d0") == F.col("low.d0"), F.struct(F.col("high.d1").alias("other"), F.col("high.a1").alias("at"))).otherwise(F.struct(F.col("low.d0").alias("other"), F.col("low.a0").alias("at")))
    by_window = pairs.select("code", other.alias("x")).select("code", "x.other", "x.at").distinct()
    whole = classes.where(~alone).select("code", F.array(F.struct(F.col("first.id").alias("other"), F.col("first.a").alias("at")), F.struct(F.col("last.id").alias("other"), F.col("last.a").alias("at"))).alias("ends"))
    one = found.join(whole, "code").withColumn("x", F.when(F.col("id") == F.col("ends")[0]["other"], F.col("ends")[1]).otherwise(F.col("ends")[0])).select("id", "a", "b", "x.other", "x.at")
    every = one.unionByName(found.join(by_window, "code").select("id", "a", "b", "other", "at"))
    two = F.array(F.struct(F.col("a").alias("pos"), F.col("at").alias("other_pos")), F.struct(F.col("b").alias("pos"), (F.col("at") + F.col("b") - F.col("a")).alias("other_pos")))
    return every.select("id", "other", F.explode(two).alias("m")).select("id", "other", "m.pos", "m.other_pos")


def seed_matches(found: DataFrame) -> DataFrame:
    """(id, pos, seed) -> (id, other, pos, other_pos): all places of a seed in two different texts, once for each two texts (id < other)."""
    often = found.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where(F.col("low") != F.col("high"))
    found = found.join(often.select("seed", F.ceil(F.col("n") / PLACES).alias("parts")), "seed").withColumn("own", F.pmod(F.xxhash64("id", "pos"), "parts"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    one = found.select("seed", "id", "pos", F.col("own").alias("row"), every.alias("column"))
    two = found.select("seed", F.col("id").alias("other"), F.col("pos").alias("other_pos"), every.alias("row"), F.col("own").alias("column"))
    return one.join(two, ["seed", "row", "column"]).where(F.col("id") < F.col("other")).select("id", "other", "pos", "other_pos")


def links(x: np.ndarray, y: np.ndarray, k: int, gap: float = GAP) -> tuple[list[int], list[float]]:
    """For matches sorted by (x, y): (the match before it or -1, score) of the best chain that ends in each.

    A chain is ordered in x and y. Its score is what its k-mers cover less `gap` for each character skipped in either text.
    A predecessor either ends before both sides of the match, so that the best one has the largest score + gap * (x + y), a
    prefix maximum in y; or it is the one before on the same diagonal, which may overlap."""
    n = len(x)
    xs, ys = x.tolist(), y.tolist()
    places = sorted(set(ys))
    rank = {v: i + 1 for i, v in enumerate(places)}
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(rank) + 1)
    previous, score = [-1] * n, [float(k)] * n
    line: dict[int, int] = {}
    ready = 0
    for i in range(n):
        xi, yi = xs[i], ys[i]
        while xs[ready] + k <= xi:
            value, at = (score[ready] + gap * (xs[ready] + ys[ready]), ready), rank[ys[ready]]
            while at < len(tree):
                if tree[at] < value:
                    tree[at] = value
                at += at & -at
            ready += 1
        best, at = (-np.inf, -1), bisect_right(places, yi - k)
        while at > 0:
            if best < tree[at]:
                best = tree[at]
            at -= at & -at
        after, j = best[0] - gap * (xi + yi - 2 * k) + k, best[1]
        before = line.get(xi - yi)
        if before is not None:
            step = xi - xs[before]
            along = score[before] + min(step, k) - 2 * gap * max(0, step - k)
            if along >= after:
                after, j = along, before
        if j >= 0 and after > k:
            previous[i], score[i] = j, after
        line[xi - yi] = i
    return previous, score


def chain(x: np.ndarray, y: np.ndarray, k: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """For matches sorted by (x, y): (root, score) of the best chain that ends in each."""
    previous, score = links(x, y, k, gap)
    root = list(range(len(previous)))
    for i, j in enumerate(previous):
        if j >= 0:
            root[i] = root[j]
    return np.array(root), np.array(score)


def paths(x: np.ndarray, y: np.ndarray, k: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """As chain, but where chains part (a passage that a text has twice) the best keeps what they share and each other one starts anew."""
    previous, score = links(x, y, k, gap)
    root, own = [-1] * len(previous), list(score)
    inner = set(previous)
    for end in sorted((i for i in range(len(previous)) if i not in inner), key=lambda i: -score[i]):
        path = []
        while end >= 0 and root[end] < 0:
            path.append(end)
            end = previous[end]
        for i in path:
            root[i], own[i] = path[-1], score[i] - score[path[-1]] + k
    return np.array(root), np.array(own)


def chains(found: DataFrame, k: int, *, least: float = LEAST, gap: float = GAP, link: Callable = chain) -> DataFrame:
    """(id, other, pos, other_pos) -> CHAINS: the collinear chains of each text with its partners that score `least` seeds or more.

    diagonals: from the first to the end of the last seed of the chain that is `shift` further on in the text than in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "id"):
            c = {n: t[n].to_numpy() for n in t.column_names}
            fresh = np.concatenate([[True], (c["id"][1:] != c["id"][:-1]) | (c["other"][1:] != c["other"][:-1]) | (c["pos"][1:] != c["pos"][:-1]) | (c["other_pos"][1:] != c["other_pos"][:-1])])
            c = {n: v[fresh] for n, v in c.items()}  # a match that both of two runs have is one
            edge = np.nonzero(np.concatenate([[True], (c["id"][1:] != c["id"][:-1]) | (c["other"][1:] != c["other"][:-1])]))[0].tolist()
            out: list[dict] = []
            for a, b in zip(edge, [*edge[1:], len(c["id"])]):
                x, y = c["pos"][a:b], c["other_pos"][a:b]
                root, score = link(x, y, k, gap)
                for r in np.unique(root):
                    at = np.nonzero(root == r)[0]
                    if score[at].max() < least * k:
                        continue
                    shift = x[at] - y[at]
                    lines = [{"start": int(x[at][own].min()), "end": int(x[at][own].max()) + k, "shift": int(d)} for d in np.unique(shift) for own in [shift == d]]
                    out.append({"id": int(c["id"][a]), "other": int(c["other"][a]), "start": int(x[at].min()), "end": int(x[at].max()) + k, "other_start": int(y[at].min()), "other_end": int(y[at].max()) + k, "seeds": len(at), "score": float(score[at].max()), "diagonals": lines})
            if out:
                line = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("shift", pa.int32())]))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64(), line]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip([x.split()[0] for x in CHAINS.split(", ")], kinds))))

    return found.select("id", "other", "pos", "other_pos").repartition("id").sortWithinPartitions("id", "other", "pos", "other_pos").mapInArrow(run, CHAINS)


def equal_runs(a: str, b: str, least: int) -> list[tuple[int, int]]:
    """[start, end) of what is equal, character by character, for at least `least` characters."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return [(0, n)] if n >= least else []
    same = codes_of(a[:n]) == codes_of(b[:n])
    edge = np.nonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))[0].reshape(-1, 2)
    return [(int(s), int(e)) for s, e in edge if e - s >= least]


def aligned(texts: DataFrame, found: DataFrame, span: int, k: int) -> DataFrame:
    """CHAINS -> (id, start int, end int): stretches of at least `span` characters that are equal along a diagonal of a chain."""
    line = found.select("id", "other", F.explode("diagonals").alias("d")).select("id", "other", "d.shift", (F.col("d.start") - (span - k)).alias("start"), (F.col("d.end") + (span - k)).alias("end"))
    line = line.withColumn("start", F.greatest("start", "shift", F.lit(0)))
    own = line.join(texts, "id").select("id", "other", "start", (F.col("start") - F.col("shift")).alias("at"), F.expr("substring(text, start + 1, end - start)").alias("piece"))
    # All joins take the texts as they are, by id, so that they are shuffled once.
    both = own.withColumnRenamed("id", "own").join(texts, F.col("other") == F.col("id"))
    both = both.select(F.col("own").alias("id"), "start", "piece", F.expr("substring(text, at + 1, length(piece))").alias("other_piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, at + s, at + e) for i, at, a, b in zip(*(batch.column(n).to_pylist() for n in ("id", "start", "piece", "other_piece"))) for s, e in equal_runs(a, b, span)]
            if out:
                i, s, e = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "start", "end"])

    return both.mapInArrow(run, "id bigint, start int, end int")


def shared_spans(texts: DataFrame, *, span: int = 300) -> DataFrame:
    """texts(id bigint, text string) -> (id, start int, end int): maximal runs of characters that lie in a shared substring.

    A substring of `span` characters (code points, 10 at least) is shared if a text with another id has it too. start counts
    from 0, end is exclusive. Null ids and texts, and texts shorter than span, take no part; a repeated row counts once, different texts
    of one id count as one text each that are not compared with each other. An empty table gives no rows; further columns
    are ignored."""
    if span < 10:
        raise ValueError("span must be 10 at least")
    good = texts.where(F.col("id").isNotNull() & (F.length("text") >= span)).select("id", "text")
    k = int(span * KMER_SHARE)
    found = cut(runs(good, common_seeds(seeds(good, span // 2, k, span)), span, k))
    release(texts.sparkSession)  # of the seeds and the texts that met them
    return merged(aligned(good, chains(run_matches(good, found, span), k), span, k))


def merged(spans: DataFrame) -> DataFrame:
    """(id, start, end): the union of the intervals of each id as maximal runs; those that touch are one."""
    one = spans.groupBy("id", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("id").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = one.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("id", "run").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end")).drop("run")


def shares(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_chars, shared_chars, share) for every text: how much of it lies in spans. Null texts count as empty, share 0."""
    total = spans.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
    size = texts.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0))
    return size.join(total, "id", "left").select("id", F.col("n_chars").cast("bigint").alias("n_chars"), shared.cast("bigint").alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))


PASSAGES = "id bigint, other bigint, start int, end int, other_start int, other_end int, seeds int, score double, identity double"


def extend(a: str, b: str, most: int) -> int:
    """Length of the common beginning of a and b, up to `most`."""
    n = min(len(a), len(b), most)
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two stretches of characters.

    One bit for each character of a; a row of the table is the bits at which it grows, the next one comes of an addition."""
    head = extend(a, b, len(a))
    a, b = a[head:], b[head:]
    tail = extend(a[::-1], b[::-1], len(a))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        same = row & places.get(c, 0)
        row = (row + same | row - same) & whole
    return head + tail + len(a) - row.bit_count()


def groups(values: np.ndarray) -> list[np.ndarray]:
    """The places of each value, in order."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.nonzero(np.diff(values[order]))[0] + 1)


def candidates(x: np.ndarray, y: np.ndarray, k: int, reach: int) -> Iterator[tuple[np.ndarray, float, bool]]:
    """(matches, score, extra) of the paths of two texts, and of each diagonal for itself if it isn't just one path; these are extra.

    A path takes the better match before it, even one that is off the diagonal by chance: the passage may get lost with that.
    Those that reach over less than `reach` count if further matches are on the diagonal of an end."""
    root, score = paths(x, y, k)
    size = np.bincount(root)
    least = min(LEAST * k, reach)
    low, high = x.copy(), x.copy()
    lines = groups(x - y)
    for on in lines:
        low[on], high[on] = x[on[0]], x[on[-1]]

    def taken(at: np.ndarray, value: np.ndarray) -> bool:
        first, last = at[0], at[-1]
        wide = min(x[last] - x[first], y[last] - y[first]) + k >= reach
        return value.max() >= least and (wide or low[first] < x[first] or high[last] > x[last])

    for at in groups(root):
        if taken(at, score[at]):
            yield at, score[at].max(), False
    for on in lines:
        if (root[on] != root[on[0]]).any() or size[root[on[0]]] > len(on):
            own, value = paths(x[on], y[on], k)
            for at in groups(own):
                if taken(on[at], value[at]):
                    yield on[at], value[at].max(), True


CANDIDATES = "start int, end int, other_start int, other_end int, seeds int, score double, extra boolean"


def passage_chains(found: DataFrame, span: int, window: int, k: int) -> DataFrame:
    """Matches of seeds, one in each `window` characters -> (id, other, chains array<CANDIDATES>): the chains of two texts that may be passages.

    Beyond the outermost match of a diagonal no more than window - k characters agree, else they held a further one. So two
    texts whose matches reach over less than span - 2 * (window - k) characters have no passage; nor has such a chain that no
    other match continues."""
    reach = span - 2 * (window - k)
    kinds = [pa.int32()] * 5 + [pa.float64(), pa.bool_()]
    chain_type = pa.struct([(c.split()[0], kind) for c, kind in zip(CANDIDATES.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "pair"):
            i, j, x, y = (t[n].to_numpy() for n in ("id", "other", "pos", "other_pos"))
            edge = np.nonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[0]
            ends = np.append(edge[1:], len(i))
            wide = lambda v: np.maximum.reduceat(v, edge) + k - np.minimum.reduceat(v, edge) >= reach
            some = np.nonzero(wide(x) & wide(y))[0]
            at: list[int] = []
            sizes: list[int] = []
            out: list[tuple] = []
            for a, b in zip(edge[some].tolist(), ends[some].tolist()):
                xs, ys = x[a:b], y[a:b]
                own = [(xs[m[0]], xs[m[-1]] + k, ys[m[0]], ys[m[-1]] + k, len(m), score, extra) for m, score, extra in candidates(xs, ys, k, reach)]
                if own:
                    at.append(a)
                    sizes.append(len(own))
                    out += own
            if out:
                flat = pa.StructArray.from_arrays([pa.array(np.array(c), kind) for c, kind in zip(zip(*out), kinds)], fields=list(chain_type))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(j[at]), lists], names=["id", "other", "chains"])

    by_pair = found.repartition("id", "other").withColumn("pair", F.xxhash64("id", "other")).sortWithinPartitions("pair", "id", "other", "pos", "other_pos")
    return by_pair.mapInArrow(run, f"id bigint, other bigint, chains array<struct<{CANDIDATES.replace(' ', ':').replace(',:', ',')}>>")


def extended(s: str, t: str, chains: list[dict], span: int) -> list[dict]:
    """The chains with what is equal before and after them, if that makes `span` characters; extra ones that others hold are left out."""
    out: list[dict] = []
    for r in sorted(chains, key=lambda r: r["extra"]):
        back = extend(s[: r["start"]][::-1], t[: r["other_start"]][::-1], len(s))
        ahead = extend(s[r["end"] :], t[r["other_end"] :], len(s))
        r = r | {"start": r["start"] - back, "other_start": r["other_start"] - back, "end": r["end"] + ahead, "other_end": r["other_end"] + ahead}
        if min(r["end"] - r["start"], r["other_end"] - r["other_start"]) < span:
            continue
        if r["extra"] and any(o["start"] <= r["start"] and r["end"] <= o["end"] and o["other_start"] <= r["other_start"] and r["other_end"] <= o["other_end"] for o in out):
            continue
        out.append(r)
    return out


def passages(texts: DataFrame, *, span: int = 300) -> DataFrame:
    """texts(id bigint, text string) -> PASSAGES: the chains of seeds that two texts share, extended as far as both agree.

    A chain that, with what is equal before and after it, spans at least `span` characters in both texts is one passage; its seeds
    are short, so it goes on over edits that leave a seed between them. identity is the share of characters in common order
    over the longer side. All places of a seed are matched with all others, so a passage is reported for each two texts that
    have it, once from either side, and for each place where a text has it: m * (m - 1) rows where m texts have it once. Nulls,
    short texts, several texts of one id and empty tables as in shared_spans. `span` characters that two texts share as they are
    always lie in one of their passages; with edits, seeds have to be left between them."""
    if span < 10:
        raise ValueError("span must be 10 at least")
    # A text is known by its own key: an id may have several.
    good = texts.where(F.col("id").isNotNull() & (F.length("text") >= span)).select("id", "text").distinct().withColumn("key", F.xxhash64("id", "text"))
    k = max(8, int(span * FUZZY_SHARE))
    window = max(k, span // 3)
    found = passage_chains(seed_matches(seeds(good.select(F.col("key").alias("id"), "text"), window, k, span)), span, window, k)
    found = found.withColumnsRenamed({"id": "key", "other": "other_key"})
    full = found.join(good, "key").join(good.select(F.col("key").alias("other_key"), F.col("id").alias("other"), F.col("text").alias("other_text")), "other_key").where(F.col("id") != F.col("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PASSAGES.split(", ")]
        swapped = {"id": "other", "other": "id", "start": "other_start", "end": "other_end", "other_start": "start", "other_end": "end"}
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for row in b.to_pylist():
                s, t = row["text"], row["other_text"]
                for r in extended(s, t, row["chains"], span):
                    x, y = s[r["start"] : r["end"]], t[r["other_start"] : r["other_end"]]
                    r |= {"id": row["id"], "other": row["other"], "identity": common(x, y) / max(len(x), len(y))}
                    out += [{n: r[n] for n in names}, {n: r[swapped.get(n, n)] for n in names}]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(names, kinds))))

    return full.select("id", "other", "chains", "text", "other_text").mapInArrow(run, PASSAGES)
