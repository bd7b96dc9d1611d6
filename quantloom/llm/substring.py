"""Substring dedup: remove every word that a repeated window of WINDOW words covers.

Fixed-block anchors: each text is cut into non-overlapping reference blocks of BLOCK words, where
2 * BLOCK - 1 <= WINDOW, so every window holds exactly one whole reference block of its own text.
1. The blocks are indexed and every rolling BLOCK-word window of every text probes the index. Probes
   travel as 32-bit remainders within hash partitions, without a location: only a block that occurs
   at two places or more is of use, and the block knows where it is.
2. Hits are extended: of the windows around repeated blocks, the full hashes are counted; those that
   start at two places or more are kept, and consecutive ones merge into maximal exact repeats.
3. The words under these repeats go.
No pairs of occurrences are made. A task first counts what it holds itself (FLUSH words at a time): a
block or window found there twice is known to be repeated, keeps its places to itself, and goes out as
two probes. So a passage that half of all texts share costs a hash partition a few bytes a batch, not
its number of occurrences; places are dealt out by text.

Defined results: a null or empty text has no words and stays as it is; windows of one document count
as well as those of others, and repeated rows are occurrences like any other; texts below WINDOW
words lose nothing; other columns are ignored; an empty table gives no rows. Words are bytes outside space and 0x09-0x0D; windows
are compared by 64-bit hashes, of which any two given different ones agree with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import words as W
from quantloom.session import dropped, saved, ship

WINDOW, BLOCK = 35, 18
#: Bytes of text for each hash partition (there are as many as shuffle partitions at least), and the most partitions; words that a task gathers before it emits rows.
PART_BYTES, MOST_PARTS, FLUSH = 16 << 20, 1 << 16, 1 << 21
#: Keys of texts that are broadcast at most.
MOST_KEYS = 1 << 19


def parts_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MOST_PARTS, max(1 + size // PART_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def dealt(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts equal parts together, the parts that occur, and their bounds."""
    order = np.argsort(p, kind="stable")
    return order, *bounds(p[order])


def bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted parts: those that occur, and where each begins, with the end."""
    edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, np.int64)
    return p[edge[:-1]].astype(np.int32) if len(p) else np.zeros(0, np.int32), edge


def counted(h: np.ndarray, parts: int, kind) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which hashes occur twice in h; and the parts, with the hashes to tell each: once, or twice if they occur more often.

    Sorted hashes are sorted by part too.
    """
    s = np.sort(h)
    first = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    second = ~first
    second[1:] &= first[:-1]
    again = s[second]
    told = s[first | second]
    part, edge = bounds(part_of(told, parts))
    twice = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h if len(again) else np.zeros(len(h), bool)
    return twice, part, slices(told.astype(kind), edge)


def by_text(ids: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """A part or bucket of n for each text."""
    return part_of(W.mix(ids.view(np.uint64) ^ W.mix(marks.view(np.uint64))), n)


def packs(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part that occurs, with the values of its places packed."""
    order, part, edge = dealt(part)
    return pa.RecordBatch.from_arrays([pa.array(part), *(slices(v[order], edge) for v in columns.values())], ["part", *columns])


def whole(b: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    """b with the columns of the schema that it lacks as nulls."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) if c in b.schema.names else pa.nulls(len(b), pa.binary()) for c in names], names)


def slices(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """values[edge[k]:edge[k + 1]] as binary values, without a copy for each."""
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Gather:
    """Collects word hashes and row keys of whole texts until there are enough to emit."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.h, self.first, self.ids, self.marks, self.n = [], [np.zeros(1, np.int64)], [], [], 0

    def add(self, h, first, ids, marks) -> None:
        self.h.append(h)
        self.first.append(first[1:] + self.n)
        self.ids.append(ids)
        self.marks.append(marks)
        self.n += len(h)

    def all(self):
        return (np.concatenate(x) for x in (self.h, self.first, self.ids, self.marks))


def keys(b: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pc.fill_null(b.column(k).slice(i, j - i), -1).to_numpy(zero_copy_only=False) for k in (0, 1))


#: probes: hashes; values, ids, marks, places: of what occurs once in its batch; sure_…: of what is known to be repeated.
PROBE_SCHEMA = "part int, probes binary, values binary, ids binary, marks binary, places binary, sure_ids binary, sure_marks binary, sure_places binary"


def told(h: np.ndarray, chosen: np.ndarray, ids: np.ndarray, marks: np.ndarray, places: np.ndarray, parts: int, kind) -> Iterator[pa.RecordBatch]:
    """What a batch tells the parts: of its hashes h, and of the chosen ones whose places are wanted. kind: of the hashes on their way."""
    twice, part, probes = counted(h, parts, kind)
    yield whole(pa.RecordBatch.from_arrays([pa.array(part), probes], ["part", "probes"]), PROBE_SCHEMA)
    sure = twice[chosen]
    value = h[chosen]
    columns = {"ids": ids, "marks": marks, "places": places.astype(np.uint32)}
    one = {k: v[~sure] for k, v in columns.items()}
    yield whole(packs(part_of(value[~sure], parts), values=value[~sure].astype(kind), **one), PROBE_SCHEMA)
    i, m, p = (v[sure] for v in columns.values())
    order = np.lexsort((p, m, i))
    i, m, p = i[order], m[order], p[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1])
    i, m, p = i[new], m[new], p[new]
    yield whole(packs(by_text(i, m, parts), sure_ids=i, sure_marks=m, sure_places=p), PROBE_SCHEMA)


def repeated(t: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one hash partition: (ids, marks, places) of what is found at two places or more."""
    probes, values = np.sort(joined(t, "probes", kind)), joined(t, "values", kind)
    hit = np.searchsorted(probes, values, "right") - np.searchsorted(probes, values) > 1
    return tuple(np.concatenate([joined(t, c, of)[hit], joined(t, f"sure_{c}", of)]) for c, of in (("ids", np.int64), ("marks", np.int64), ("places", np.uint32)))


def joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in t.column(name) if x.is_valid)])


def _probes(parts: int, block: int):
    """Every rolling window of `block` words probes, every reference block is chosen."""

    def rows(g: Gather) -> Iterator[pa.RecordBatch]:
        h, first, ids, marks = g.all()
        w, at = W.windows(h, first, block)
        text = np.repeat(np.arange(len(ids)), np.diff(first))[at]
        number, off = np.divmod(at - first[text], block)
        chosen = np.flatnonzero(off == 0)
        yield from told(w, chosen, ids[text[chosen]], marks[text[chosen]], number[chosen], parts, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gather()
        for b in batches:
            for i, j, data, off in W.blocks(b.column(2)):
                h, _, _, first = W.words(data, off, lower=False)
                g.add(h, first, *keys(b, i, j))
                if g.n >= FLUSH:
                    yield from rows(g)
                    g.clear()
        if g.n:
            yield from rows(g)

    return run


def _repeated_blocks(t: pa.Table) -> pa.Table:
    """One hash partition: the reference blocks that are found at two places or more."""
    ids, marks, numbers = repeated(t, np.uint32)
    return pa.table({"doc_id": ids, "mark": marks, "number": numbers.astype(np.int32)})


def _candidates(parts: int, window: int, block: int):
    """Windows around repeated blocks."""

    def rows(g: Gather, wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, first, ids, marks = g.all()
        w, at = W.windows(h, first, window)
        text = np.repeat(np.arange(len(ids)), np.diff(first))[at]
        start = at - first[text]
        # Window `start` holds the whole block number ceil(start / block).
        per = np.diff(first) // block + 2
        base = np.concatenate(([0], np.cumsum(per)))
        flag = np.zeros(base[-1], bool)
        for k, numbers in enumerate(wanted):
            flag[base[k] + numbers] = True
        sel = np.flatnonzero(flag[base[text] + (start + block - 1) // block])
        yield from told(w[sel], np.arange(len(sel)), ids[text[sel]], marks[text[sel]], start[sel], parts, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, wanted = Gather(), []
        for b in batches:
            numbers = b.column(3)
            for i, j, data, off in W.blocks(b.column(2)):
                h, _, _, first = W.words(data, off, lower=False)
                g.add(h, first, *keys(b, i, j))
                wanted += [numbers[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for k in range(i, j)]
                if g.n >= FLUSH:
                    yield from rows(g, wanted)
                    g.clear()
                    wanted = []
        if g.n:
            yield from rows(g, wanted)

    return run


FOUND_SCHEMA = "bucket int, ids binary, marks binary, starts binary"


def _repeated_windows(buckets: int):
    """One hash partition: the windows whose hash is found at two places or more, packed by buckets of texts."""

    def run(t: pa.Table) -> pa.Table:
        ids, marks, starts = repeated(t, np.uint64)
        order, bucket, edge = dealt(by_text(ids, marks, buckets))
        return pa.table({"bucket": bucket, "ids": slices(ids[order], edge), "marks": slices(marks[order], edge), "starts": slices(starts[order], edge)})

    return run


def _by_text(t: pa.Table) -> pa.Table:
    """One bucket of texts: of each text, where its repeated windows start."""
    ids, marks, starts = joined(t, "ids", np.int64), joined(t, "marks", np.int64), joined(t, "starts", np.uint32)
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order]
    edge = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]), [True])))
    return pa.table({"doc_id": ids[edge[:-1]], "mark": marks[edge[:-1]], "starts": slices(starts, edge)})


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, mark (hash of the text), starts (packed word positions) of the texts with repeated windows."""
    if not (0 < block and 2 * block - 1 <= window):
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    parts = parts_for(docs)
    probes = rows.where("text IS NOT NULL").mapInArrow(_probes(parts, block), PROBE_SCHEMA)
    hits = probes.groupBy("part").applyInArrow(_repeated_blocks, "doc_id long, mark long, number int")
    hits = saved(hits.groupBy("doc_id", "mark").agg(F.collect_set("number").alias("numbers")), "blocks")
    keyed = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    # Up to MOST_KEYS texts are picked out before they travel.
    few = hits.count() <= MOST_KEYS
    near = keyed.join(F.broadcast(hits.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi") if few else keyed
    near = near.join(hits.hint("merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "numbers")
    found = near.mapInArrow(_candidates(parts, window, block), PROBE_SCHEMA).groupBy("part").applyInArrow(_repeated_windows(parts), FOUND_SCHEMA)
    found = saved(found.groupBy("bucket").applyInArrow(_by_text, "doc_id long, mark long, starts binary"), "windows")
    dropped(hits)
    return found


def _starts(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint32).astype(np.int64) if value.is_valid else np.zeros(0, np.int64)


def _with_repeats(docs: DataFrame, window: int, block: int) -> DataFrame:
    """docs with one more column at the end: packed starts, null where nothing is repeated."""
    name = "starts"
    while any(c.lower().endswith(name) for c in docs.columns):
        name = f"_{name}"
    keys = [f"id_{name}", f"mark_{name}"]
    found = repeats(docs, window, block).select(F.col("doc_id").alias(keys[0]), F.col("mark").alias(keys[1]), F.col("starts").alias(name))
    rows = docs.withColumns({keys[0]: F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)), keys[1]: F.xxhash64(docs["text"])})
    if found.count() > MOST_KEYS:
        return rows.join(found.hint("merge"), keys, "left").drop(*keys)
    # Up to MOST_KEYS texts with repeats are picked out, and the others don't travel.
    few = F.broadcast(found.select(keys))
    some = rows.join(few, keys, "left_semi").join(found.hint("merge"), keys)
    none = rows.join(few, keys, "left_anti").withColumn(name, F.lit(None).cast("binary"))
    return some.select(*docs.columns, name).unionByName(none.select(*docs.columns, name))


def digests(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, value in zip(b.column(1), b.column(2), strict=True):
                w = (text.as_py() or "").encode().split()
                gone = 0
                starts = _starts(value)
                n_words.append(len(w))
                if len(starts):
                    mask = covered(len(w), starts, window)
                    gone = int(mask.sum())
                    w = [w[k] for k in np.flatnonzero(~mask)]
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_repeats(docs.select("doc_id", "text"), window, block)
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, starts: np.ndarray, window: int) -> str:
    """The text without the words under repeated windows; the white space between kept words of one stretch stays."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, start, end, _ = W.words(raw, np.array([0, len(raw)]), lower=False)
    mask = covered(len(start), starts, window)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], mask, [True]))))
    return b"\n".join(raw[start[i] : end[j - 1]].tobytes() for i, j in zip(edge[::2], edge[1::2], strict=True)).decode()


def remove(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with the repeated passages cut from text, and n_chars (where there is one) set anew; no row goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, starts = b.column(at).to_pylist(), b.column(b.num_columns - 1)
            for k in np.flatnonzero(np.asarray(starts.is_valid())):
                texts[k] = cut_text(texts[k], _starts(starts[int(k)]), window)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    out = _with_repeats(docs, window, block).mapInArrow(run, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
