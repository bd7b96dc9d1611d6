"""N-gram Jaccard join by signature trees, and the connected components of its links.

Two documents link when DEN * overlap >= NUM * union of their shingle sets. The steps:

1. Texts with equal shingle sets form a class with a key of its own; doc_id plays no part until the
   end, so neither null ids nor ids that come twice lose a link.
2. Blocks: under one global order of the shingles, two linked sets share a shingle among their first
   n - ceil(t n) + 1 ones. The order puts frequent shingles last (a bounded table of them, from local
   counts; any order is right), so passages that many documents share make no large blocks. A token's
   rows are split by size: bands of doubling sizes, in which a set of the next lower band takes part
   as a guest if it is large enough. Of blocks with the same sets only one is kept.
3. Signature trees give all pairs of a block: sets at the bottom, above them nodes with the OR of
   their members' shingle bitmaps, the size range, the least bit count and the components below. A
   dual traversal of tree pairs drops node pairs whose largest possible overlap is too small, down to
   pairs of sets. The trees of all blocks of a batch are traversed together. A block of more than
   CHUNK rows is dealt into chunks with a tree each, and each pair of chunks is a task's work of its own.
4. Pairs come in three steps, each with the components of the links found so far, as a block whose
   sets are all of one component is done and trees skip pairs within one: first each set of a block is
   held against one of them, the set with the largest share of its tokens in blocks, which among edited
   copies of a text is the least edited one; then the trees give BEST partners for each set, those with
   the largest possible similarity; then, in the blocks where a set had more partners than that, all
   that is left. So a group of k near copies costs a few k pairs.
5. What the trees give is verified on the full sets, and all links together give the components.

Groupings by token, class, pivot or component are joins of two written tables (which Spark splits
where a key is hot) or sums that are made in each task first. What any bound cannot tell apart, sets
of one block just below the threshold, is compared pair by pair on bitmaps, spread over chunk pairs.

Defined results: a null text or one without words has an empty set, n_shingles 0, and its own doc_id
as component; below K words the whole sequence is one shingle; repeated rows are kept as they are; a
row takes the component of its text, whatever its doc_id: with a null one too, and with one that
comes with other texts (which makes no link between the texts); a component has the smallest doc_id
of its rows, null if they have none; other columns are ignored; an empty table gives no rows. Shingles are 64-bit hashes: that any
two given shingles are confused has a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.llm.components import components
from quantloom.llm.streams import run_bounds, whole_runs
from quantloom.session import dropped, saved, ship

K, NUM, DEN = 4, 85, 100
#: Shingles with this local count are candidates for the table of frequent ones, which holds so many at most.
HOT_FROM, MOST_HOT = 6, 1 << 19
FLUSH, MOST_IDS = 1 << 21, 1 << 19
#: Bits of a bitmap for each shingle of the largest set of a band, in blocks up to SMALL rows and in larger ones.
COARSE, FINE, SMALL = 1, 4, 64
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Children of a tree's node, most rows of a tree, node pairs that are held at once, 64-bit words of bitmaps compared at once.
FANOUT, CHUNK, FRONTIER, COMPARED = 4, 512, 1 << 15, 1 << 19
#: Partners of a set that the trees give at first.
BEST = 2


def prefix_length(n, num: int = NUM, den: int = DEN):
    return n - (num * n + den - 1) // den + 1


def sets_of(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    for _, _, data, off in W.blocks(column):
        h, _, _, first = W.words(data, off, lower=True)
        yield W.gram_sets(h, first, k)


def _local_counts(k: int):
    """(shingle, documents) counted over runs of documents of a task, from two documents on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

        for b in batches:
            for sets in sets_of(b.column(0), k):
                held += sets
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts; MOST_HOT of them at most, which bounds the broadcast."""
    n = docs.select("text").mapInArrow(_local_counts(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    n = saved(n, "frequent")
    level = F.floor(F.log2("n") * 4).cast("int")
    room, least = MOST_HOT, None
    for r in sorted(n.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    rows = n.where(level >= least if least is not None else F.lit(False)).select("token", "n").toArrow()
    dropped(n)
    t, c = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


def band_of(n: int) -> int:
    return int(n).bit_length() - 1


def width(band: int, per_shingle: int) -> int:
    """Bits of the bitmaps of a band's trees."""
    return min(MOST_BITS, max(LEAST_BITS, per_shingle << (band + 1)))


def bitmap(s: np.ndarray, per_shingle: int) -> bytes:
    """At the width of the next higher band, where the set may be a guest; folded in half for its own."""
    m = width(band_of(len(s)) + 1, per_shingle)
    bits = np.zeros(m, np.uint8)
    bits[(s >> np.uint64(7)).astype(np.int64) & (m - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _signatures(k: int, num: int, den: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = hot.value
        for b in batches:
            n, f1, f2, prefix = [], [], [], []
            for sets in sets_of(b.column(3), k):
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        f1.append(0)
                        f2.append(0)
                        prefix.append(s.view(np.int64))
                        continue
                    f1.append(int(W.mix(s).sum().view(np.int64)))
                    f2.append(int(W.mix(s ^ np.uint64(W.BASE)).sum().view(np.int64)))
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        hit = often[at] == s
                        last = at[hit]
                        s_ordered = np.concatenate([s[~hit], often[last[np.lexsort((last, count[last]))]]])
                    else:
                        s_ordered = s
                    prefix.append(s_ordered[: prefix_length(len(s), num, den)].view(np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, prefix)]).astype(np.int32), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], ["doc_id", "t1", "t2", "n", "f1", "f2", "prefix"])

    return run


SIGNATURE = "doc_id long, t1 long, t2 long, n long, f1 long, f2 long, prefix array<long>"


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of more words as ones of `words` words: bit positions modulo the width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), bits.shape[1] // words, words), axis=1) if bits.shape[1] > words else bits


def possible(common, pop_a, pop_b, most_a, most_b) -> np.ndarray:
    """The largest possible overlap of sets of two nodes.

    A member of size `most` at most has pop - common shingles at least that the other side lacks, as
    each bit outside the other side's bitmap stands for one.
    """
    return np.minimum(most_a - np.maximum(pop_a - common, 0), most_b - np.maximum(pop_b - common, 0))


class Forest:
    """The signature trees of many blocks of one bitmap width; rows come sorted by block.

    levels[0] are the rows, the last level has a node for each block. Of a level: first child of each
    node (and the end), bitmap, least and largest size, least bit count, least and largest component,
    largest room, least and largest side, whether a row of the block's own band is below, and whether
    the block holds two chunks, of which only pairs across count. room is the size less the token's
    position in the global order: a pair has no more in common than the smaller room in the block of
    its first common token, and is sure to be found there.
    """

    def __init__(self, block: np.ndarray, bits: np.ndarray, n, comp, room, side, home, split):
        self.rows = order = np.lexsort((n, comp, side, block))
        block, bits, n, comp, room, side, home, split = (x[order] for x in (block, bits, n, comp, room, side, home, split))
        pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(None, bits, n, n, pop, comp, comp, room, side, side, home, split)]
        while len(block) > len(run_bounds(block)) - 1:
            edge = run_bounds(block)
            place = np.arange(len(block)) - np.repeat(edge[:-1], np.diff(edge))
            at = np.flatnonzero(place % FANOUT == 0)
            _, bits, low, high, pop, c0, c1, room, s0, s1, home, split = self.levels[-1]
            lo, hi = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.append(at, len(block)), np.bitwise_or.reduceat(bits, at, axis=0), lo(low, at), hi(high, at), lo(pop, at), lo(c0, at), hi(c1, at), hi(room, at), lo(s0, at), hi(s1, at), hi(home, at), split[at]))
            block = block[at]

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Dual traversal of each tree with itself: pairs of rows, by their places in the given order, and their possible similarity."""
        roots = np.arange(len(self.levels[-1][1]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONTIER:
                stack += [(level, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
                continue
            at = np.flatnonzero(self._near(level, i, j, num, den))
            i, j = i[at], j[at]
            over, total = self._overlap(level, i, j)
            at = np.flatnonzero((i == j) | ((num + den) * over >= num * total))
            i, j = i[at], j[at]
            if level == 0:
                yield self.rows[i], self.rows[j], over[at] / (total[at] - over[at])
            elif len(i):
                i, j = self._below(level, i, j)
                stack.append((level - 1, i, j))

    def _near(self, level: int, i, j, num: int, den: int) -> np.ndarray:
        """By sizes, rooms, components, sides and bands."""
        _, _, low, high, _, c0, c1, room, s0, s1, home, split = self.levels[level]
        ok = (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])
        ok &= (num + den) * np.minimum(room[i], room[j]) >= num * (low[i] + low[j])
        ok &= (c0[i] != c1[j]) | (c1[i] != c0[j])
        ok &= ~split[i] | (s0[i] != s1[j]) | (s1[i] != s0[j])
        return ok & (home[i] | home[j])

    def _overlap(self, level: int, i, j) -> tuple[np.ndarray, np.ndarray]:
        """The largest possible overlap by bitmaps, and the least sum of sizes."""
        _, bits, low, high, pop, *_ = self.levels[level]
        common = np.zeros(len(i), np.int64)
        step = max(16, COMPARED // bits.shape[1])
        for k in range(0, len(i), step):
            common[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1)
        return possible(common, pop[i], pop[j], high[i], high[j]), low[i] + low[j]

    def _below(self, level: int, i, j) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of the node pairs, each once."""
        first = self.levels[level][0]
        a, b = first[i + 1] - first[i], first[j + 1] - first[j]
        of = np.repeat(np.arange(len(i)), a * b)
        place = np.arange(len(of)) - np.repeat(np.cumsum(a * b) - a * b, a * b)
        x, y = first[i[of]] + place // b[of], first[j[of]] + place % b[of]
        ok = (i[of] != j[of]) | (x < y if level == 1 else x <= y)
        return x[ok], y[ok]


def _tree_pairs(num: int, den: int, best: int | None):
    """Rows of blocks, sorted by block -> pairs (a, b) of sets that may link.

    With `best`, for each row of a block so many, and a row (null, null, key) for each block where one had more.
    """

    def of(b: pa.RecordBatch, more: list[np.ndarray]) -> Iterator[np.ndarray]:
        block, rep, n, room, comp, side, home, split, words, key = (b.column(k).to_numpy(zero_copy_only=False) for k in range(10))
        bits = b.column(10).to_pylist()
        size = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        for kind in np.unique(words):
            at = np.flatnonzero(words == kind)
            table = np.empty((len(at), kind), np.uint64)
            for s in np.unique(size[at]):
                rows = np.flatnonzero(size[at] == s)
                table[rows] = folded(np.frombuffer(b"".join(bits[k] for k in at[rows]), np.uint64).reshape(len(rows), -1), int(kind))
            forest = Forest(block[at], table, n[at], comp[at], room[at], side[at], home[at], split[at])
            found = forest.pairs(num, den)
            if best is not None:
                *top, cut = most_similar(found, best)
                more.append(np.unique(key[at[cut]]))
                found = [(*top, None)]
            for i, j, _ in found:
                yield np.stack([np.minimum(rep[at[i]], rep[at[j]]), np.maximum(rep[at[i]], rep[at[j]])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, more = [], 0, []
        for b in whole_runs(batches):
            for p in of(b, more):
                held.append(p)
                size += len(p)
                if size >= FLUSH:
                    yield _pair_batch(held)
                    held, size = [], 0
            if sum(map(len, more)) >= FLUSH:
                yield _key_batch(more)
                more = []
        if size:
            yield _pair_batch(held)
        if more:
            yield _key_batch(more)

    return run


def most_similar(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs with similarities: for each row the `best` most similar ones, and the rows that had more. Not more than FLUSH pairs and the best are held."""
    i = j = np.zeros(0, np.int64)
    s = np.zeros(0)
    held, size, cut = [], 0, [i]

    def merged():
        a, b, v = (np.concatenate(x) for x in zip((i, j, s), *held, strict=True))
        row, other, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
        order = np.lexsort((other, -value, row))
        row, other, value = row[order], other[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < best
        cut.append(np.unique(row[~keep]))
        row, other, value = row[keep], other[keep], value[keep]
        a, b = np.minimum(row, other), np.maximum(row, other)
        _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
        return a[once], b[once], value[once]

    # A pair stays if it is among the best of either row, so a row may hold more than `best` between the rounds.
    for p in found:
        held.append(p)
        size += len(p[0])
        if size >= FLUSH:
            i, j, s = merged()
            held, size = [], 0
    i, j, s = merged() if held else (i, j, s)
    return i, j, np.concatenate(cut)


def _pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate(held)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != p[:-1]).any(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(p[keep, 0]), pa.array(p[keep, 1]), pa.nulls(int(keep.sum()), pa.int64())], ["a", "b", "key"])


def _key_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    key = np.unique(np.concatenate(held))
    return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64()), pa.array(key)], ["a", "b", "key"])


def _may_link(num: int, den: int):
    """Rows (a, b, n of a, bitmap of a, n of b, bitmap of b) -> the pairs (a, b) whose bound reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            good = np.zeros(len(n), bool)
            kinds = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            for p, q in np.unique(kinds, axis=0):
                at = np.flatnonzero((kinds[:, 0] == p) & (kinds[:, 1] == q))
                least = int(min(p, q)) // 8
                u, v = (folded(np.frombuffer(b"".join(side[k] for k in at), np.uint64).reshape(len(at), -1), least) for side in (x, y))
                common, pop_u, pop_v = (np.bitwise_count(w).sum(axis=1, dtype=np.int64) for w in (u & v, u, v))
                good[at] = (num + den) * possible(common, pop_u, pop_v, n[at], m[at]) >= num * (n[at] + m[at])
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _as_sets(k: int):
    """(rep, text) -> the sets with their bitmaps. Of neighbours with one rep the first counts, which drops the copies of a text in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.int64(-1)
        for b in batches:
            if not len(b):
                continue
            rep = b.column(0).to_numpy()
            new = rep != np.concatenate(([last], rep[:-1]))
            last = rep[-1]
            b = b.filter(pa.array(new))
            n, grams, bits, fine = [], [], [], []
            for some in sets_of(b.column(1), k):
                for s in some:
                    n.append(len(s))
                    grams.append(W.packed(s))
                    bits.append(bitmap(s, COARSE))
                    fine.append(bitmap(s, FINE))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (grams, bits, fine))], ["rep", "n", "grams", "bits", "fine"])

    return run


def _verify(num: int, den: int):
    """Rows (a, b, set of a, set of b) -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                good[k] = den * common >= num * (len(s) + len(t) - common)
            kept = batch.select([0, 1]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns, ["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on the full sets, as edges (u, v). Hot sets should stand in b.

    Up to MOST_IDS pairs, and keys, are broadcast, so that one side of the pairs travels and only the
    sets of the other that are in pairs; more are joined.
    """
    ids = saved(pairs.select(F.col("b").alias("rep")).distinct(), "ids")
    few = lambda t: F.broadcast(t) if t.count() <= MOST_IDS else t.hint("merge")
    own = sets.select(F.col("rep").alias("a"), F.col("grams").alias("own")).join(few(pairs), "a")
    other = sets.select("rep", "grams").join(few(ids), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("grams").alias("other"))
    out = saved(own.join(other.hint("merge"), "b").select("a", "b", "own", "other").mapInArrow(_verify(num, den), "u long, v long").distinct(), "links")
    dropped(ids)
    return out


def _blocks(classes: DataFrame, num: int, den: int) -> DataFrame:
    """token, band, rep, n, pos, home of the rows of all blocks that can hold a link, and alone: the share of the set's tokens that no block has.

    Of blocks with the same sets, as near copies have by the dozen, the one of the first token in the global order stands
    for all: it is the first common token of every pair in them that shares none before.
    """
    tokens = classes.select(F.posexplode("prefix").alias("pos", "token"), "rep", "n")
    often = saved(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    band = F.length(F.bin("n")) - 1
    above = F.expr("shiftleft(1L, CAST(length(bin(n)) AS INT))")
    in_bands = F.when(den * F.col("n") >= num * above, F.array(band, band + 1)).otherwise(F.array(band))
    rows = tokens.join(often, "token").select("token", "rep", "n", F.col("pos").cast("long").alias("pos"), F.explode(in_bands).alias("band"))
    rows = saved(rows.withColumn("home", F.col("band") == band), "rows")
    # Some row stands so early that it can be the smaller one of a pair at its first common token.
    early = (num + den) * (F.col("n") - F.col("pos")) >= 2 * num * F.col("n")
    stats = rows.groupBy("token", "band").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(early).alias("early"), F.max("home").alias("own"), F.min("pos").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2"))
    lead = F.min("first").over(Window.partitionBy("band", "c", "x1", "x2")) == F.col("first")
    stats = saved(stats.where(f"c > 1 AND early AND own AND (c > 2 OR {den} * low >= {num} * high)").select("token", "band", lead.alias("lead")), "stats")
    kept = saved(rows.join(stats, ["token", "band"]), "kept")
    prefix = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
    alone = saved(kept.where("home").groupBy("rep", "n").agg(F.count("*").alias("m")).select("rep", (1 - F.col("m") / prefix).alias("alone")), "alone")
    out = saved(kept.where("lead").drop("lead").join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(1.0))), "blocks")
    for t in (often, rows, stats, kept, alone):
        dropped(t)
    return out


def _chunked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (token, band, rep, n, pos, home, comp, c) of blocks with their bitmaps, as rows of trees: large blocks as pairs of chunks."""
    per = F.when(F.col("c") > SMALL, FINE).otherwise(COARSE)
    words = F.expr(f"CAST(least({MOST_BITS}, greatest({LEAST_BITS}, CASE WHEN c > {SMALL} THEN {FINE} ELSE {COARSE} END * shiftleft(1L, band + 1))) / 64 AS INT)")
    chunks = F.ceil(F.col("c") / CHUNK)
    rows = rows.withColumns({"chunk": F.pmod(F.xxhash64("rep"), chunks), "other": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    rows = rows.withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other")})
    rows = rows.withColumns({"block": F.xxhash64("token", "band", "x", "y"), "split": F.col("x") != F.col("y"), "side": (F.col("chunk") != F.col("x")).cast("int"), "words": words, "kind": per})
    rows = rows.join(sets.select("rep", "bits", "fine").hint("merge"), "rep")
    bits = F.when(F.col("kind") == FINE, F.col("fine")).otherwise(F.col("bits"))
    rows = rows.select("block", "rep", "n", (F.col("n") - F.col("pos")).alias("room"), "comp", "side", "home", "split", "words", F.xxhash64("token", "band").alias("key"), bits.alias("bits"))
    return rows.repartition("block").sortWithinPartitions("block")


def _open(marked: DataFrame, *more) -> DataFrame:
    """token, band and more of the blocks with sets of different components; written, so that Spark splits joins with it."""
    found = marked.groupBy("token", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *more).where("x <> y").drop("x", "y")
    return saved(found, "open")


def _pivot_pairs(marked: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of each set and the pivot b of its blocks, where their bitmaps let them link."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pivot = F.min(F.struct("alone", F.xxhash64("rep").alias("order"), "rep"))["rep"]
    pairs = marked.join(_open(marked, pivot.alias("b")), ["token", "band"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    pairs = pairs.join(one, "a").join(two, "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    return pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_may_link(num, den), "a long, b long")


def _tree_step(marked: DataFrame, sets: DataFrame, num: int, den: int, best: int | None) -> DataFrame:
    """(a, b, key) as of _tree_pairs, each once."""
    rows = _chunked(marked.join(_open(marked, F.count("*").alias("c")), ["token", "band"]), sets)
    return saved(rows.mapInArrow(_tree_pairs(num, den, best), "a long, b long, key long").distinct(), "pairs")


def classified(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t1, t2, n, f1, f2) of docs, and classes (f1, f2, n, component, least, n_links).

    t1 and t2 are hashes of the text, component is a key of the class's component, least the smallest
    doc_id in it; rows with an empty set are in no class.
    """
    if not den <= 2 * num <= 2 * den:
        raise ValueError("the threshold must be from one half to one, as sets of one band meet those of the next only")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    hot = spark.sparkContext.broadcast(frequent(docs, k))
    wide = saved(texts.mapInArrow(_signatures(k, num, den, hot), SIGNATURE), "signatures")
    classes = wide.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("t1", "t2")).alias("t"), F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"))
    with_prefix = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sig = saved(wide.drop("prefix"), "rows")
    dropped(wide)
    blocks = _blocks(with_prefix, num, den)
    classes = saved(with_prefix.drop("prefix"), "classes")
    dropped(with_prefix)
    wanted = saved(blocks.select("rep").distinct().join(classes, "rep").select("rep", "t.t1", "t.t2"), "wanted")
    # Up to MOST_IDS keys pick out their texts before these travel. The join must sort, as _as_sets drops neighbouring copies.
    used = texts.join(F.broadcast(wanted.select("t1", "t2")), ["t1", "t2"], "left_semi") if wanted.count() <= MOST_IDS else texts
    sets = used.join(wanted.hint("merge"), ["t1", "t2"]).select("rep", "text").mapInArrow(_as_sets(k), "rep long, n long, grams binary, bits binary, fine binary")
    sets = saved(sets, "sets")
    dropped(wanted)
    def with_components(links: DataFrame) -> DataFrame:
        comp = components(links).select(F.col("node").alias("rep"), "component")
        return saved(blocks.join(comp, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"), "marked")

    pairs = saved(_pivot_pairs(blocks.withColumn("comp", F.col("rep")), sets, num, den), "pairs")
    links = _links(pairs, sets, num, den)
    marked = with_components(links)
    best = _tree_step(marked, sets, num, den, BEST)
    links = links.unionByName(_links(best.where("a IS NOT NULL").select("a", "b"), sets, num, den))
    dropped(pairs)
    dropped(marked)
    marked = with_components(links)
    again = best.where("key IS NOT NULL").select("key")
    rest = marked.withColumn("key", F.xxhash64("token", "band")).join(again.hint("merge"), "key", "left_semi").drop("key")
    rest = saved(rest, "rest")
    pairs = _tree_step(rest, sets, num, den, None)
    links = links.unionByName(_links(pairs.select("a", "b"), sets, num, den))
    for t in (marked, best, rest, pairs):
        dropped(t)
    dropped(blocks)
    dropped(sets)
    comp = components(links).withColumnRenamed("node", "rep")
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    of = classes.select("f1", "f2", "n", "rep", "least").join(comp, "rep", "left").join(degree, "rep", "left")
    of = saved(of.select("f1", "f2", "n", "least", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "of-class")
    low = saved(of.groupBy("component").agg(F.min("least").alias("low")), "lows")
    return sig, of.join(low, "component").select("f1", "f2", "n", "component", F.col("low").alias("least"), "n_links")


def join(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs.

    n_links counts the verified links that its class was joined by: enough of them to connect the
    component, not all that exist inside it.
    """
    sig, classes = classified(docs, k, num, den)
    out = sig.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of docs for each component, with all its columns: that with the smallest doc_id, a null one last.

    Of different texts under that id the one with the smaller hash stays, of wholly repeated rows any.
    Rows with an empty set have no duplicates and all stay.
    """
    sig, classes = classified(docs, k, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2")
    kept = sig.select("doc_id", "t1", "t2", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).groupBy("component").agg(F.min(order).alias("o"))
    names = [f"kept_{x}" + "_" * sum(c.lower().startswith("kept_") for c in docs.columns) for x in ("none", "id", "t1", "t2")]
    kept = saved(kept.select(*(F.col(f"o.{x}").alias(n) for x, n in zip(("none", "id", "t1", "t2"), names, strict=True))), "kept")
    own = docs["doc_id"].cast("long")
    key = {names[0]: own.isNull(), names[1]: F.coalesce(own, F.lit(0)), names[2]: F.xxhash64(docs["text"]), names[3]: F.xxhash64(F.lit(1), docs["text"])}
    has_words = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = docs.where(has_words).withColumns(key).join(kept.hint("merge"), names, "left_semi").dropDuplicates(names)
    return chosen.select(docs.columns).unionByName(docs.where(~has_words))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
