"""Phrase collocations by merged count-min sketches, an exact count of what survives them, scores and subsumption.

All counts are per language. The steps:

1. Each batch of text counts its words and word pairs into sparse count-min sketches of DEPTH rows; the
   sketches are merged shard by shard in Spark. A merged cell is never below the count of an n-gram in
   it, so an n-gram with a cell below `least` is rare. Only one bit a cell is kept of the merged sketch.
2. A second sketch takes the n-grams of 3 and more words whose pairs all survived the first, and marks the words
   of surviving pairs, the only ones whose counts a score can need.
3. The second pass over the texts counts, exactly and by the phrase itself, the n-grams that survive with
   all n-grams in them. Nothing frequent is lost, and what was let through in error drops out here. A batch
   sends its counts in one packed block for each of many parts of the phrases, and the blocks of a part are summed.
4. Each candidate is cut behind each of its words; the parts are as frequent as the candidate at least, so
   they are in the exact table. The lowest score counts.
5. A candidate is dropped if a longer one that holds it is as frequent as `share` percent of it. A phrase in
   between is at least as frequent as the longer one, so phrases of one word more tell it all.

The sketch has a cell for every CELL_BYTES bytes of text, MOST_CELLS at most: that bounds the bits sent to
each executor (DEPTH x 16 MB each for words, pairs, longer ones and words of pairs). Beyond some 8 GB of text the cells fill up and
more n-grams survive in error, so the exact count shuffles more; its result is the same.

Defined results: a null text counts as empty, a null lang as `und`; repeated rows count each; doc_id
plays no part; other columns are ignored; an empty table gives no rows. Texts are taken in stretches of
STRETCH bytes that end where no phrase goes on, so one very long text needs no more memory than many short
ones, unless it has no such place. Different words in one batch are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.session import dropped, saved, ship

LONGEST, LEAST, SHARE, WANTED = 5, 100, 100, 2000
DEPTH, CELL_BYTES, LEAST_CELLS, MOST_CELLS, SHARD = 2, 64, 1 << 16, 1 << 27, 1 << 16
STRETCH = 1 << 22
#: Parts of the phrases for each shard of a sketch, and the counts that a sum of blocks holds before it sums them.
PARTS_A_SHARD, HELD = 4, 1 << 20
#: Bytes between the words of a piece, and those that end a piece.
BETWEEN = np.zeros(256, bool)
BETWEEN[[9, 32]] = True
ENDS = np.zeros(256, bool)
ENDS[[10, 11, 12, 13, *b".,;:!?"]] = True
WORDS, PAIRS, LONGER, IN_PAIRS = range(4)


def stretches(texts: pa.Array, langs: pa.Array, most: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(lower-cased bytes, word starts, word ends, piece offsets, language number of each word, languages) of whole pieces, about `most` bytes at once."""
    data, off = W.utf8(texts)
    coded = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    names, of_text = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    i = 0
    while i < len(data):
        j = min(i + most, len(data))
        if j < len(data):
            text = int(off[np.searchsorted(off, j, "right") - 1])
            ends = np.flatnonzero(ENDS[data[max(i, text) : j]])
            if len(ends):
                j = max(i, text) + int(ends[-1]) + 1
            elif text > i:
                j = text
            else:  # no such place yet: on to the next
                stop = int(off[np.searchsorted(off, j, "right")])
                ends = np.flatnonzero(ENDS[data[j:stop]])
                j = j + int(ends[0]) + 1 if len(ends) else stop
        part = W.LOWER[data[i:j]]
        gap = ENDS[part]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~(gap | BETWEEN[part])
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = off[(off > i) & (off < j)] - i
        begins[cut] |= inside[1:-1][cut]
        ends[cut - 1] |= inside[1:-1][cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(start):
            text = np.searchsorted(off, start + i, "right") - 1
            piece = np.cumsum(gap)[start] + text
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True])))
            yield part, start, end, first, of_text[text], names
        i = j


def salts(names: list[str]) -> np.ndarray:
    """A hash of each language."""
    return np.array([int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def grams(part: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, lang: np.ndarray, names: list[str], longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, first word) of all n-grams of 1 to `longest` words; the language is part of the hash."""
    h = W.mix(W.word_hashes(part, start, end) ^ salts(names)[lang])
    return [W.windows(h, first, k) for k in range(1, longest + 1)]


def cells(h: np.ndarray, kind: int, row: int, n_cells: int) -> np.ndarray:
    """The cell of each hash in a row of a kind's sketch."""
    mixed = W.mix(h + np.uint64((kind * DEPTH + row + 1) * W.GRAM_BASE % (1 << 64)))
    return (mixed >> np.uint64(64 - n_cells.bit_length() + 1)).astype(np.int64)


class Kept:
    """The bits of the merged sketches: whether an n-gram may be frequent."""

    def __init__(self, bits: dict[int, bytes], n_cells: int):
        self.bits, self.n_cells = {k: np.frombuffer(v, np.uint8) for k, v in bits.items()}, n_cells

    def may(self, h: np.ndarray, kind: int) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(DEPTH):
            cell = cells(h, kind, row, self.n_cells)
            out &= (self.bits[kind * DEPTH + row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out


def surviving(found: list[tuple[np.ndarray, np.ndarray]], kept: Kept, longest: int, longer: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the n-grams, those that may be frequent by the sketches of words and pairs and, if `longer`, of longer ones, with all n-grams in them."""
    n, out = len(found[0][0]), []
    fine = np.zeros(n + 1, bool)
    for k, (h, at) in enumerate(found[:longest], 1):
        good = kept.may(h, min(k - 1, LONGER)) if k <= 2 or longer else np.ones(len(h), bool)
        if k > 1:
            good &= fine[at] & fine[at + 1]
        h, at = h[good], at[good]
        fine = np.zeros(n + 1, bool)
        fine[at] = True
        out.append((h, at))
    return out


def _sketched(longest: int, least: int, n_cells: int, kept, stretch: int):
    """(text, lang) -> packed counts (part, offsets, counts) of the cells of words and pairs, or with the first sketch's bits of longer n-grams.

    A cell counts up to `least` a batch, which changes no comparison with it.
    """
    kinds = (WORDS, PAIRS) if kept is None else (LONGER, IN_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if kept is None else Kept(kept.value, n_cells)
        for b in batches:
            for s in stretches(b.column(0), b.column(1), stretch):
                found = grams(*s, longest=2 if bits is None else longest)
                of_kind = [x[0] for x in found]
                if bits is not None:
                    left = surviving(found, bits, longest, False)
                    at = left[1][1]
                    of_kind = [np.concatenate([x[0] for x in left[2:]] or [found[0][0][:0]]), found[0][0][np.concatenate([at, at + 1])]]
                for kind, h in zip(kinds, of_kind, strict=True):
                    for row in range(DEPTH):
                        cell, n = np.unique(cells(h, kind, row, n_cells), return_counts=True)
                        n = np.full(len(n), least) if kind == IN_PAIRS else n  # a mark, no count
                        part = (cell // SHARD).astype(np.int64)
                        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
                        own = [_packed(x, edge) for x in ((cell % SHARD).astype("<u2"), np.minimum(n, least).astype("<u2"))]
                        yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]] + ((kind * DEPTH + row) << 40)), *own], ["part", "offsets", "counts"])

    return run


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _merged(least: int, size: int):
    """Counts sorted by part -> (part, bits): which cells of the part reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(size, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for b in batches:
            for part, offsets, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if part != key:
                    if key is not None:
                        yield bits()
                    key = part
                    total[:] = 0
                total[np.frombuffer(offsets.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<u2")
        if key is not None:
            yield bits()

    return run


def sketch(rows: DataFrame, longest: int, least: int, n_cells: int, kept, stretch: int) -> dict[int, bytes]:
    """The bits of the merged sketches, by kind and row: DEPTH x n_cells / 8 bytes for each kind."""
    counts = rows.mapInArrow(_sketched(longest, least, n_cells, kept, stretch), "part long, offsets binary, counts binary")
    size = min(SHARD, n_cells)
    merged = saved(counts.repartition("part").sortWithinPartitions("part").mapInArrow(_merged(least, size), "part long, bits binary"), "sketch")
    kinds = (WORDS, PAIRS) if kept is None else (LONGER, IN_PAIRS)
    out = {kind * DEPTH + row: bytearray(n_cells // 8) for kind in kinds for row in range(DEPTH)}
    for r in merged.toLocalIterator():
        at = (r["part"] & (1 << 40) - 1) * size // 8
        out[r["part"] >> 40][at : at + size // 8] = r["bits"]
    dropped(merged)
    return {k: bytes(v) for k, v in out.items()}


def _counted(longest: int, n_cells: int, kept, stretch: int, parts: int):
    """(text, lang) -> (part, block): of each stretch, the surviving n-grams of each part with their counts, as _packed_counts; k = 0 has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Kept(kept.value, n_cells)
        for b in batches:
            for part, start, end, first, lang, names in stretches(b.column(0), b.column(1), stretch):
                data, languages = part.tobytes(), pa.array(names, pa.string())
                words = np.bincount(lang, minlength=len(names))
                of = [(salts(names) % np.uint64(parts)).astype(np.int64)]
                tables = [pa.table([languages, pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(words.astype(np.int64))], COUNTED)]
                for k, (h, at) in enumerate(surviving(grams(part, start, end, first, lang, names, longest), bits, longest, True), 1):
                    if k == 1:
                        needed = bits.may(h, IN_PAIRS)
                        h, at = h[needed], at[needed]
                    h, one, n = np.unique(h, return_index=True, return_counts=True)
                    at = at[one]
                    spans = [zip(start[at + x].tolist(), end[at + x].tolist(), strict=True) for x in range(k)]
                    phrases = [b" ".join(data[x:y] for x, y in phrase) for phrase in zip(*spans, strict=True)]
                    of.append((W.mix(h + np.uint64(k)) % np.uint64(parts)).astype(np.int64))
                    tables.append(pa.table([languages.take(pa.array(lang[at])), pa.array(np.full(len(at), k, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], COUNTED))
                of = np.concatenate(of)
                order = np.argsort(of, kind="stable")
                table, of = pa.concat_tables(tables).take(pa.array(order)), of[order]
                edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
                blocks = [_packed_counts(table.slice(i, j - i)) for i, j in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(of[edge[:-1]]), pa.array(blocks, pa.binary())], ["part", "block"])

    return run


COUNTED = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _packed_counts(table: pa.Table) -> bytes:
    """A table of COUNTED as one compressed block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _summed(least: int):
    """Blocks sorted by part -> the counts of COUNTED, of phrases that reach `least`."""

    def total(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([("n", "sum")])
        return out.select(["lang", "k", "phrase", "n_sum"]).rename_columns(COUNTED.names)

    def frequent(tables: list[pa.Table]) -> list[pa.RecordBatch]:
        out = total(tables)
        return out.filter(pc.or_(pc.greater_equal(out["n"], least), pc.equal(out["k"], 0))).cast(COUNTED).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows, most = None, [], 0, HELD
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != key:
                    yield from frequent(held) if held else []
                    key, held, rows, most = part, [], 0, HELD
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                rows += len(held[-1])
                if rows > most:
                    held = [total(held).cast(COUNTED)]
                    rows, most = len(held[0]), max(HELD, 2 * len(held[0]))
        yield from frequent(held) if held else []

    return run


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cell_bytes: int = CELL_BYTES, stretch: int = STRETCH) -> DataFrame:
    """lang, k, phrase, n: every phrase of 1 to `longest` words that occurs `least` times or more, and the number of words as k = 0."""
    if longest < 2 or not 1 <= least < 1 << 16:
        raise ValueError("phrases have two words at least, and least must fit 16 bits")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // cell_bytes).bit_length()))
    sent = spark.sparkContext.broadcast(bits := sketch(rows, longest, least, n_cells, None, stretch))
    both = spark.sparkContext.broadcast(bits | sketch(rows, longest, least, n_cells, sent, stretch))
    sent.destroy()
    blocks = rows.mapInArrow(_counted(longest, n_cells, both, stretch, n_cells // SHARD * PARTS_A_SHARD or 1), "part long, block binary")
    out = saved(blocks.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(least), "lang string, k int, phrase string, n long"), "phrases")
    both.destroy()
    return out


def scored(table: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every phrase of two words and more: that of its lowest-scoring cut, the first of several."""
    # Written apart, so that Spark sees how few rows there are.
    total = saved(table.where("k = 0").select("lang", F.col("n").alias("total")), "totals")
    phrases = table.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ").alias("tail"))
    heads, tails = (table.where("k > 0").select("lang", F.col("phrase").alias(part), F.col("n").alias(x)) for part, x in (("head", "l"), ("tail", "r")))
    cuts = saved(cuts.join(heads, ["lang", "head"]).drop("head"), "cuts").join(tails, ["lang", "tail"]).drop("tail")
    cuts = cuts.join(total, "lang")
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "total", "l", "r")}
    cuts = cuts.withColumns({"over": (F.lit(1000).cast("decimal(4,0)") * wide["a"]).cast("decimal(19,0)") * wide["total"], "under": wide["l"] * wide["r"]})
    best = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "k", "a", "total")).alias("x"))
    return best.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")


def subsumed(table: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of the phrases that lie in a longer one with 100 * f(longer) >= share * f(phrase)."""
    longer = table.where("k > 2").select("lang", "k", F.col("n").alias("f"), F.split("phrase", " ").alias("words"))
    ends = F.array(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.lit(2), F.col("k") - 1))
    inner = longer.select("lang", "f", F.explode(ends).alias("words")).groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("f").alias("f"))
    return inner.join(table.where("k > 1").select("lang", "phrase", "n"), ["lang", "phrase"]).where(F.col("f") * 100 >= F.col("n") * share).select("lang", "phrase")


def mined(docs: DataFrame, wanted: int = WANTED, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, cell_bytes: int = CELL_BYTES, stretch: int = STRETCH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `wanted` first phrases that none subsumes."""
    table = counts(docs, longest, least, cell_bytes, stretch)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    left = scored(table).join(subsumed(table, share), ["lang", "phrase"], "left_anti")
    return left.withColumn("rank", rank).where(F.col("rank") <= wanted).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS ps FROM texts),
pieces AS (SELECT d, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS pn FROM cut),
split AS (SELECT d, lang, pn, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
w AS (SELECT d, lang, pn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY d, pn ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY 1, 3
 UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY 1, 3),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, u.i AS cut, array_to_string(ws[1:u.i], ' ') AS h, array_to_string(ws[u.i + 1:], ' ') AS t FROM c, (SELECT unnest([1, 2, 3, 4]) AS i) u WHERE u.i < c.k),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
 FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.h JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.t JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= {SHARE} * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {WANTED}
"""
