"""Near-duplicates by SimHash fingerprints, found by anchor-point covering.

A fingerprint has 64 bits; a bit is 1 if more than half of the XXH64 values of the text's shingles
have it. Fingerprints that differ in at most THRESHOLD bits link. The steps:

1. Rows with one fingerprint are one node, so copies cost one node whatever their number.
2. Anchors are the words of a covering code: a product of perfect cyclic codes over stretches of the
   fingerprint (FACTORS, two Golay codes of radius 3 and one Hamming code of radius 1). Every
   fingerprint has one nearest anchor, its home, in each stretch.
3. A fingerprint is copied to the anchors within covering radius plus threshold at which a link can be
   found: those that are home of some point within the threshold. The threshold is shared among the
   stretches, so a copy that has used up two bits in the first stretch has one left for the others.
   Two linked fingerprints always meet at the home of either. The copies of a syndrome are the same up to
   a shift by the home, so they come from a table.
4. Copies are dealt by the anchor of the first stretch (of the first two above MANY fingerprints) and met
   within the task at the anchors of the next one: those at home there against all copies, by exact
   distance. An anchor with more than HOMES at home has these dealt into parts, to each of which its copies
   go. The copies stream past in bounded blocks.
5. A task gives out only the links that connect something not yet connected there, so a group of k near
   copies costs k links an anchor and not k^2. Components of all links give the result.

Defined results: a null or empty text, or one without words, has the fingerprint zero, which links like any
other; below three words the whole sequence is the one shingle; repeated rows are returned each; a null
doc_id is kept and is no component's smallest id, unless all ids of a component are null; an empty table
gives no rows; other columns are ignored. A text is taken in stretches of STRETCH bytes, so memory does
not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.llm.components import components
from quantloom.session import dropped, saved, ship

SHINGLE, SEED, BITS, THRESHOLD = 3, 42, 64, 3
STRETCH, HOMES, MANY = 1 << 22, 1 << 16, 1 << 28
#: (length, generator polynomial, covering radius) of each stretch's perfect cyclic code, from the low bits up.
FACTORS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))
#: Copies, or pairs, that a task works on at once.
AT_ONCE = 1 << 20


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all k-word shingles in order, and the n + 1 shingle offsets of the texts; texts below k words have none."""
    import xxhash

    # Words joined by one space each, in one buffer.
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inside = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    joined[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = data[inside]
    n = np.diff(first)
    per = np.maximum(n - k + 1, 0)
    bound = np.concatenate(([0], np.cumsum(per)))
    head = np.arange(bound[-1]) + np.repeat(first[:-1] - bound[:-1], per)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    stop = (at + size)[head + k - 1]
    values = [digest(view[a:b], SEED) for a, b in zip(at[head].tolist(), stop.tolist(), strict=True)]
    return np.array(values, np.uint64), bound


def _ones(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of each text's values have each bit."""
    out = np.zeros((len(bound) - 1, BITS), np.int64)
    full = np.flatnonzero(np.diff(bound))
    if len(full):
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[full] = np.add.reduceat(bits, bound[full], axis=0, dtype=np.int64)
    return out


def _fingerprint(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _whole(text: bytes) -> np.uint64:
    """XXH64 of a text's words, joined by one space."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(b" ".join(text.translate(W.LOWER.tobytes()).split()), SEED))


def _long_text(data: np.ndarray, k: int, stretch: int) -> tuple[np.ndarray, int]:
    """(ones, shingles) of one text, taken in stretches that repeat the last k - 1 words of the one before."""
    ones, n, begin, size = np.zeros(BITS, np.int64), 0, 0, len(data)
    while begin < size:
        end = begin + stretch
        while end < size and not (space := np.flatnonzero(W.SPACE[data[end : end + stretch]])).size:
            end += stretch
        end = min(end + int(space[0]), size) if end < size else size
        part = W.LOWER[data[begin:end]]
        _, a, b, first = W.words(part, np.array([0, len(part)]), False)
        if len(a) < k and end < size:
            stretch *= 2  # hardly any words: take a longer one
            continue
        values, bound = _digests(part, a, b, first, k)
        ones += _ones(values, bound)[0]
        n += len(values)
        begin = begin + int(a[len(a) - k + 1]) if end < size else size
    return ones, n


def _fingerprints(k: int, stretch: int):
    """(doc_id, text) -> (doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            out = []
            for i, j, data, off in W.blocks(b.column(1)):
                if j == i + 1 and off[1] > stretch:
                    ones, n = _long_text(data, k, stretch)
                    ones, n = ones[None], np.array([n])
                else:
                    low = W.LOWER[data]
                    _, start, end, first = W.words(low, off, False)
                    values, bound = _digests(low, start, end, first, k)
                    ones, n = _ones(values, bound), np.diff(bound)
                for t in np.flatnonzero(n == 0):
                    text = data[off[t] : off[t + 1]].tobytes()
                    if text.split():
                        ones[t], n[t] = _ones(np.array([_whole(text)]), np.array([0, 1]))[0], 1
                out.append(_fingerprint(ones, n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fp"])

    return run


@cache
def code(length: int, generator: int, radius: int, most: int = THRESHOLD) -> tuple[np.ndarray, ...]:
    """(remainder of each byte at each byte place, error pattern of each syndrome, offsets, shifts) of a perfect code.

    shifts[offsets[s, w]:offsets[s, w + 1]] are the code words that lead from the home of a word with
    syndrome s to the other homes of points w bits away from it, and of none nearer.
    """
    check = generator.bit_length() - 1

    def remainder(word: int) -> int:
        for bit in range(length - 1, check - 1, -1):
            if word >> bit & 1:
                word ^= generator << (bit - check)
        return word

    by_byte = np.array([[remainder(byte << 8 * place & (1 << length) - 1) for byte in range(256)] for place in range(3)], np.uint32)
    pattern = np.zeros(1 << check, np.uint32)
    near = [np.array([sum(1 << x for x in bits) for bits in combinations(range(length), w)], np.uint32) for w in range(most + 1)]
    for w in range(radius + 1):
        pattern[syndrome(near[w], by_byte)] = near[w]
    offsets, shifts = np.zeros((1 << check, most + 2), np.int64), []
    total = 0
    for s, error in enumerate(pattern):
        seen = np.zeros(0, np.uint32)
        for w, flips in enumerate(near):
            point = error ^ flips
            home = np.setdiff1d(point ^ pattern[syndrome(point, by_byte)], seen)
            seen = np.concatenate([seen, home])
            shifts.append(home)
            offsets[s, w] = total
            total += len(home)
        offsets[s, most + 1] = total
    return by_byte, pattern, offsets, np.concatenate(shifts)


def syndrome(word: np.ndarray, by_byte: np.ndarray) -> np.ndarray:
    return by_byte[0][word & 255] ^ by_byte[1][word >> 8 & 255] ^ by_byte[2][word >> 16 & 255]


def _stretch(fp: np.ndarray, at: int) -> np.ndarray:
    length, below = FACTORS[at][0], sum(f[0] for f in FACTORS[:at])
    return (fp >> np.uint64(below) & np.uint64((1 << length) - 1)).astype(np.uint32)


def homes(fp: np.ndarray, factors: range) -> np.ndarray:
    """The nearest anchor of each fingerprint in the given stretches, as one number."""
    out = np.zeros(len(fp), np.int64)
    for at in factors:
        by_byte, pattern, _, _ = code(*FACTORS[at])
        word = _stretch(fp, at)
        out = out << FACTORS[at][0] | (word ^ pattern[syndrome(word, by_byte)]).astype(np.int64)
    return out


def reached(fp: np.ndarray, used: np.ndarray, factors: range, most: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, used): the anchors of the given stretches that are home to points within most - used bits of each fingerprint."""
    row, anchor = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for at in factors:
        by_byte, pattern, offsets, shifts = code(*FACTORS[at])
        word = _stretch(fp, at)[row]
        s = syndrome(word, by_byte)
        low, high = offsets[s, 0], offsets[s, most - used + 1]
        n = high - low
        pick = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        spent = np.repeat(used, n) + (pick[:, None] >= np.repeat(offsets[s, 1 : most + 1], n, axis=0)).sum(axis=1)
        home = np.repeat(word ^ pattern[s], n) ^ shifts[pick]
        row, anchor, used = np.repeat(row, n), np.repeat(anchor, n) << FACTORS[at][0] | home.astype(np.int64), spent
    return row, anchor, used


def _dealt(factors: int, parts: dict[int, int]):
    """fp -> (deal, kind, fps, used): those at home (kind 0) and the copies (kind 1) of each anchor, packed."""

    def packed(anchor: np.ndarray, part: np.ndarray, kind: int, fp: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
        deal = W.mix(anchor.view(np.uint64) * np.uint64(W.BASE) + part.astype(np.uint64)).view(np.int64)
        order = np.argsort(deal, kind="stable")
        deal, fp, used = deal[order], fp[order], used[order].astype(np.uint8)
        edge = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1], [True])))
        offsets = edge.astype(np.int32)
        columns = [pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((offsets * x.itemsize).tobytes()), pa.py_buffer(np.ascontiguousarray(x))]) for x in (fp, used)]
        return pa.RecordBatch.from_arrays([pa.array(deal[edge[:-1]]), pa.array(np.full(len(edge) - 1, kind, np.int32)), *columns], ["deal", "kind", "fps", "used"])

    hot = np.array(sorted(parts), np.int64)
    hot_parts = np.array([parts[int(x)] for x in hot], np.int64)

    def parts_of(anchor: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.ones(len(anchor), np.int64)
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        return np.where(hot[at] == anchor, hot_parts[at], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            fp = b.column(0).to_numpy().view(np.uint64)
            none = np.zeros(len(fp), np.int64)
            home = homes(fp, range(factors))
            yield packed(home, (W.mix(fp) >> np.uint64(1)).astype(np.int64) % parts_of(home), 0, fp, none)
            row, anchor, used = reached(fp, none, range(factors))
            n = parts_of(anchor)
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield packed(np.repeat(anchor, n), part, 1, fp[np.repeat(row, n)], np.repeat(used, n))

    return run


class Met:
    """Those at home at one anchor, and how they are connected so far."""

    def __init__(self, fp: np.ndarray, rest: range):
        self.rest, cell = rest, homes(fp, rest)
        order = np.lexsort((fp, cell))
        self.fp, self.cell = fp[order], cell[order]
        self.root = np.arange(len(fp))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            x = self.root[x] = self.root[self.root[x]]
        return x

    def links(self, fp: np.ndarray, used: np.ndarray) -> list[tuple[int, int]]:
        """(copy, one at home) that connect the copies with those at home, and these with each other."""
        row, cell, _ = reached(fp, used, self.rest)
        low, high = np.searchsorted(self.cell, cell, "left"), np.searchsorted(self.cell, cell, "right")
        full = np.flatnonzero(high > low)
        row, low, n = row[full], low[full], (high - low)[full]
        total, out, i = np.cumsum(n), [], 0
        while i < len(n):
            done = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
            size = n[i:j]
            home = np.arange(size.sum()) + np.repeat(low[i:j] - (np.cumsum(size) - size), size)
            own = np.repeat(row[i:j], size)
            near = np.bitwise_count(fp[own] ^ self.fp[home]) <= THRESHOLD
            out += self.connected(fp, own[near], home[near])
            i = j
        return out

    def connected(self, fp: np.ndarray, own: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        self.root = self.root[self.root]
        same = fp[own] == self.fp[home]
        # A fingerprint at home here meets itself; where nothing else is near it, that tells nothing.
        pair = np.unique(own.astype(np.int64) * len(self.fp) + np.where(same, home, self.root[home]))
        out, last, mine = [], -1, -1
        itself = dict(zip(own[same].tolist(), home[same].tolist(), strict=True))
        for x in pair.tolist():
            g, r = divmod(x, len(self.fp))
            r = self.find(r)
            if g != last:
                last, mine = g, self.find(itself[g]) if g in itself else -1
            if r != mine:
                out.append((int(fp[g]), int(self.fp[r])))
                if mine >= 0:
                    self.root[r] = self.find(mine)
                mine = self.find(r)
        return out


def _met(factors: int):
    """Rows (deal, kind, fps, used) sorted by deal and kind -> links (u, v) that connect what is linked."""
    rest = range(factors, factors + 1)

    def given(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pair = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met, held = None, None, 0
        at_home, fps, used = [], [], []

        def flushed() -> list[tuple[int, int]]:
            nonlocal met, held
            if not held:
                return []
            if met is None:
                met = Met(np.frombuffer(b"".join(at_home), np.uint64), rest)
            found = met.links(np.frombuffer(b"".join(fps), np.uint64), np.frombuffer(b"".join(used), np.uint8).astype(np.int64))
            fps.clear()
            used.clear()
            held = 0
            return found

        for b in batches:
            found = []
            for deal, kind, f, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if deal != key:
                    found += flushed()
                    key, met = deal, None
                    at_home.clear()
                if kind == 0:
                    at_home.append(f)
                elif at_home:  # else nothing is at home here
                    fps.append(f)
                    used.append(u)
                    held += len(u)
                    if held >= AT_ONCE // 16:
                        found += flushed()
            yield given(found)
        yield given(flushed())

    return run


def links(nodes: DataFrame, many: int = MANY, at_home: int = HOMES) -> DataFrame:
    """(u, v) of the distinct fingerprints in nodes (fp): enough pairs to connect all that are within THRESHOLD."""
    n = nodes.count()
    factors = 1 if n <= many else 2
    counted = nodes.mapInArrow(_counted(factors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    # At most one in HOMES of the fingerprints' number.
    parts = {r["anchor"]: -(-r["n"] // at_home) for r in counted.where(F.col("n") > at_home).collect()}
    copies = nodes.mapInArrow(_dealt(factors, parts), "deal long, kind int, fps binary, used binary")
    met = copies.repartition("deal").sortWithinPartitions("deal", "kind").mapInArrow(_met(factors), "u long, v long")
    return saved(met, "links")


def _counted(factors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, n = np.unique(homes(b.column(0).to_numpy().view(np.uint64), range(factors)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def join(docs: DataFrame, k: int = SHINGLE, stretch: int = STRETCH, many: int = MANY, at_home: int = HOMES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    ship(docs.sparkSession)
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(k, stretch), "doc_id long, fp long"), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select("fp"), many, at_home)
    comp = components(found).select(F.col("node").alias("fp"), "component")
    of = saved(nodes.join(comp, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "of")
    low = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = saved(of.join(low, "component").select("fp", "component_id"), "of")
    dropped(found)
    dropped(nodes)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
