"""Alignment of two tokenizers' tokens, once for each distinct segment of the texts.

A is a byte-level BPE, B a piece BPE with byte fallback. The steps:

1. A text, with a space before it, is cut before runs of white space where neither tokenizer can merge across.
   A's splitting pattern ends a word before white space whatever follows, and a symbol that B could merge
   across a cut would be a piece of its vocabulary; `breaks` verifies on both vocabularies before which
   characters that holds. So a text's tokens are those of its segments, one after another.
2. Texts of about BUNDLE bytes make a bundle, which numbers its distinct segments; a document becomes their
   numbers. Segments are dealt by a hash into shards of about SHARD_BYTES of text, and a bundle asks each shard for
   those of its segments in one packed row. A shard tokenises and aligns each of its distinct segments once in
   the whole corpus and replies to every bundle.
3. Bundles put documents together from replies. This happens twice: first a bundle tells in how many of its
   documents each pair of ids is linked; these counts are summed in shards of A ids, which know each id's highest
   count and answer the bundles; then segments get their sums over links, and documents the sums over segments.

Segments are aligned by the byte offsets where tokens of both end; tokens link where their byte ranges overlap.
B never makes a text longer, so a document's bytes differ from its tokens' just where those of a segment do;
such a document has no tokens, and no pair of it counts.

Defined results: a null or empty text has no tokens; repeated rows are documents each; a null doc_id is kept;
other columns are ignored; an empty table gives no rows. A very long text is a bundle of its own and read as it
is cut; its numbers, four bytes a segment, are held by one task.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.bpe import byte_alphabet
from quantloom.llm.packing import tokenizer_path
from quantloom.session import saved, ship

BUNDLE, LONG_TEXT = 1 << 24, 1 << 22
LEAST_SHARDS, SHARD_BYTES = 64, 1 << 24
#: White space of Unicode and three characters that some tables count as such: no cut behind one of these.
SPACES = r"\s\u180e\u200b\ufeff"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeezed(data) -> bytes:
    """Packed values as they travel: bytes, or the bytes of an array."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def spread(data: bytes, kind=None):
    """What was squeezed, as bytes or as an array."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def two_by_two(links: np.ndarray) -> np.ndarray:
    """Links with all A ids before all B ids, which squeezes better."""
    return np.concatenate([links >> 32, links & 0xFFFFFFFF]).astype(np.uint32)


def one_by_one(parts: np.ndarray) -> np.ndarray:
    n = len(parts) // 2
    return parts[:n].astype(np.int64) << 32 | parts[n:]


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and where a text may be cut."""

    def __init__(self, a_json: str, a_ranks: str, b_model: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_json, self.slow = a_json, None
        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        with open(a_json) as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: k for k, c in enumerate(byte_alphabet())}
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.space_id = self.b.piece_to_id("▁")
        of_b = [self.b_bytes[i].decode() for i in self.b_bytes if not self.b.is_byte(i)]
        self.breaks = breaks([t.decode(errors="replace") for t in self.a_bytes.values()], of_b)
        self.segments = segments(self.breaks)

    def encode_a(self, text: str) -> list[int]:
        """Ids of A, special strings being plain text."""
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:  # its regex engine gives up on some very long runs
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.a_json)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of B for segments, which bring their own white space.

        B adds a space: it takes the place of a first space, and is a token of its own before other breaks.
        """
        out = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [[self.space_id] if t == " " else ids if t[0] == " " else ids[1:] for t, ids in zip(texts, out, strict=True)]


def breaks(a: list[str], b: list[str]) -> str:
    """The white space before which a text may be cut: no token of A or B has it behind something else than white space, nor one of B at all behind its beginning, other than a space behind spaces."""
    found = ""
    for c in " \n\t\r":
        held = [t for t in (*a, *b) if re.search(rf"[^{SPACES}]{re.escape(c)}", t)]
        if not held and (c == " " or not any(c in t[1:] for t in b)):
            found += c
    return found


def segments(cuts: str) -> re.Pattern:
    """The segments of a text, in order and without gaps: each ends before white space that begins with one of the cuts, behind other characters."""
    if not cuts:
        return re.compile(r"(?s).+")
    ends = re.escape(cuts)
    word, other = rf"[^{SPACES}]+", rf"(?:(?![{ends}])[{SPACES}])[{SPACES}]*"
    return re.compile(rf"[{SPACES}]*{word}(?:{other}{word})*(?:{other})?|[{SPACES}]+")


@cache
def tokenizers(a_json: str, a_ranks: str, b_model: str) -> Tokenizers:
    """One of each a process."""
    return Tokenizers(a_json, a_ranks, b_model)


class Numbers(dict):
    """Numbers of things as they first come."""

    def __missing__(self, key: str) -> int:
        self[key] = len(self)
        return len(self) - 1


def _bundled(paths: tuple[str, str, str], size: int, shards: int):
    """(doc_id, text) -> a bundle's distinct segments by shard, numbered from `start` in this order, and its documents as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = tokenizers(*paths).segments
        bundle, numbers, held, ids, seqs = TaskContext.get().partitionId() << 32, Numbers(), 0, [], []

        def given() -> Iterator[pa.RecordBatch]:
            texts = [t.encode() for t in numbers]
            shard = np.array([zlib.crc32(t) for t in texts], np.int64) % shards
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            texts, shard = [texts[k] for k in order.tolist()], shard[order]
            sizes = np.array([len(t) for t in texts], np.uint32)
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
            n = len(edge) - 1
            blocks = [squeezed(b"".join(texts[i:j])) for i, j in zip(edge, edge[1:], strict=False)]
            lengths = [squeezed(sizes[i:j]) for i, j in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bundle)), pa.array(shard[edge[:-1]]), pa.array(edge[:-1]), pa.nulls(n, pa.int64()), pa.array(blocks, pa.binary()), pa.array(lengths, pa.binary()), pa.nulls(n, pa.binary())], ASKED)
            for i in range(0, len(ids), 1 << 10):
                part = [squeezed(place[np.frombuffer(x, np.uint32)]) for x in seqs[i : i + (1 << 10)]]
                n = len(part)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bundle)), none, none, pa.array(ids[i : i + n], pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(part, pa.binary())], ASKED)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                if held and held + len(text) > size:
                    yield from given()
                    bundle, numbers, held, ids, seqs = bundle + 1, Numbers(), 0, [], []
                held += len(text) + 1
                found = () if not text else pattern.findall(" " + text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(" " + text))
                ids.append(doc_id)
                seqs.append(array("I", map(numbers.__getitem__, found)).tobytes())
        if ids:
            yield from given()

    return run


ASKED = ["bundle", "shard", "start", "doc_id", "texts", "sizes", "seq"]


def aligned(tok: Tokenizers, segs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(COUNTS, bytes of the groups and whether it is bad of each segment, links of all, groups of each)."""
    a, b, bad = [], [], []
    texts = [x.decode() for x in segs]
    for raw, x, y in zip(segs, map(tok.encode_a, texts), tok.encode_b(texts), strict=True):
        wrong = b"".join([tok.a_bytes.get(i, b"") for i in x]) != raw or b"".join([tok.b_bytes[i] for i in y]) != raw
        bad.append(wrong)
        a.append([] if wrong else x)
        b.append([] if wrong else y)
    n_a, n_b = (np.array([len(x) for x in of], np.int64) for of in (a, b))
    flat_a, flat_b = (np.array([i for x in of for i in x], np.int64) for of in (a, b))
    ends_a, ends_b = (np.cumsum(np.array([len(t[i]) for x in of for i in x], np.int64)) for of, t in ((a, tok.a_bytes), (b, tok.b_bytes)))
    # Segments lie one behind another, with as many bytes in A as in B, so their ends are common ends.
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    edge_a, edge_b = (np.searchsorted(e, common, "right") for e in (ends_a, ends_b))
    low = np.searchsorted(ends_b, np.concatenate(([0], ends_a[:-1])) if len(ends_a) else ends_a, "right")
    n_links = np.searchsorted(ends_b, ends_a, "left") - low + 1
    to = np.arange(n_links.sum()) + np.repeat(low - (np.cumsum(n_links) - n_links), n_links)
    links = np.repeat(flat_a, n_links) << 32 | flat_b[to]
    bound_a = np.concatenate(([0], np.cumsum(n_a)))
    bound_g = np.searchsorted(edge_a, bound_a, "right")  # groups that have ended by then
    text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    heads_a, heads_b = [0, *edge_a.tolist()], [0, *edge_b.tolist()]
    groups = [",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in zip(heads_a, heads_a[1:], heads_b, heads_b[1:], strict=False)]
    joined = [";".join(groups[i:j]).encode() for i, j in itertools.pairwise(bound_g.tolist())]
    bound_l = np.concatenate(([0], np.cumsum(n_links)))[bound_a]
    counts = np.stack([n_a, n_b, np.diff(bound_g), np.diff(bound_l), np.array([len(x) for x in joined], np.int64), np.array(bad, np.int64)]).astype(np.uint32)
    return counts, links, joined


#: Segments that a task tokenises at once.
AT_ONCE = 1 << 13


def _aligned(paths: tuple[str, str, str]):
    """What bundles ask (bundle, shard, start, texts, sizes), sorted by shard -> replies (bundle, start, counts, links, groups) in the order of what was asked."""

    def replies(tok: Tokenizers, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, own = Numbers(), []
        for _, _, texts, sizes in asked:
            texts, ends = spread(texts), np.cumsum(spread(sizes, np.uint32).astype(np.int64)).tolist()
            own.append(np.fromiter(map(numbers.__getitem__, [texts[i:j] for i, j in zip([0, *ends], ends, strict=False)]), np.int64, len(ends)))
        segs = list(numbers)
        parts = [aligned(tok, segs[i : i + AT_ONCE]) for i in range(0, len(segs), AT_ONCE)]
        counts, links = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        groups = [g for p in parts for g in p[2]]
        first = np.concatenate(([0], np.cumsum(counts[3].astype(np.int64))))
        for (bundle, start, _, _), at in zip(asked, own, strict=True):
            n = counts[3][at].astype(np.int64)
            linked = links[np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)]
            yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([start]), *(pa.array([squeezed(x)], pa.binary()) for x in (counts[:, at], two_by_two(linked), b"".join([groups[k] for k in at.tolist()])))], REPLIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, key, asked = tokenizers(*paths), None, []
        for b in batches:
            for bundle, shard, start, texts, sizes in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if shard != key:
                    yield from replies(tok, asked) if asked else ()
                    key, asked = shard, []
                asked.append((bundle, start, texts, sizes))
        yield from replies(tok, asked) if asked else ()

    return run


REPLIES = ["bundle", "start", "counts", "links", "groups"]
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SUMS = [*COUNTS, "n_best", "count_sum"]


class Segments:
    """A bundle's segments by number, put together from its replies and the answers on its pairs."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.answers: list[tuple] = []

    def take(self, kind: int, start, counts, links, groups, n, best) -> None:
        if kind == 0:
            self.parts.append((start, counts, links, groups))
        else:
            self.answers.append((links, n, best))

    def settle(self, whole: bool) -> None:
        """whole: with the texts of groups, and the sums over links."""
        self.parts.sort(key=lambda p: p[0])
        counts = np.concatenate([spread(p[1], np.uint32).reshape(6, -1) for p in self.parts], axis=1).astype(np.int64) if self.parts else np.zeros((6, 0), np.int64)
        self.links = np.concatenate([one_by_one(spread(p[2], np.uint32)) for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.bad, self.bound = counts[5] > 0, np.concatenate(([0], np.cumsum(counts[3])))
        if whole:
            ends = np.cumsum(counts[4]).tolist()
            text = b"".join([spread(p[3]) for p in self.parts])
            self.groups = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            pair, n, best = (np.concatenate([spread(x[k], kind) for x in self.answers]) if self.answers else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, np.uint8)))
            order = np.argsort(pair)
            pair, n, best = pair[order], n[order], best[order]
            at = np.minimum(np.searchsorted(pair, self.links), max(len(pair) - 1, 0))
            # A pair that only documents without tokens hold is in no answer, and its segments in no sum.
            there = pair[at] == self.links if len(pair) else np.zeros(len(self.links), bool)
            over = [np.concatenate(([0], np.cumsum(np.where(there, x[at] if len(pair) else 0, 0), dtype=np.int64))) for x in (best, n)]
            self.sums = np.concatenate([counts[:4], np.stack([x[self.bound[1:]] - x[self.bound[:-1]] for x in over])])
        self.parts, self.answers = [], []


def _in_bundles(whole: bool, document, end=None):
    """Walks rows (bundle, kind, start, doc_id, counts, links, groups, n, best, seq) sorted by bundle and kind: document(segments, documents) and then end(segments, bundle) give out batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segs, settled = None, Segments(), False
        for b in batches:
            bundle, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (bundle[1:] != bundle[:-1]) | (kind[1:] != kind[:-1]), [True]))) if len(b) else []
            for i, j in zip(edge, edge[1:], strict=False):
                if bundle[i] != key:
                    if settled and end is not None:
                        yield from end(segs, key)
                    key, segs, settled = bundle[i], Segments(), False
                part = b.slice(i, j - i)
                if kind[i] < 2:
                    for row in zip(*(part.column(c).to_pylist() for c in ("kind", "start", "counts", "links", "groups", "n", "best")), strict=True):
                        segs.take(*row)
                else:
                    if not settled:
                        segs.settle(whole)
                        settled, segs.found = True, []
                    yield from document(segs, part)
        if settled and end is not None:
            yield from end(segs, key)

    return run


def _held(shards: int):
    """Bundles -> (part, bundle, links, n): how many of a bundle's documents hold each pair linked, packed by the shard of its A id."""

    def document(segs: Segments, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for seq in rows.column("seq"):
            own = np.unique(spread(seq.as_py(), np.uint32))
            if len(own) and not segs.bad[own].any():
                n = segs.bound[own + 1] - segs.bound[own]
                segs.found.append(np.unique(segs.links[np.arange(n.sum()) + np.repeat(segs.bound[own] - (np.cumsum(n) - n), n)]))
                if sum(map(len, segs.found[-64:])) and len(segs.found) >= 4096:
                    segs.found = [_tallied(segs.found)]
        return iter(())

    def end(segs: Segments, bundle: int) -> Iterator[pa.RecordBatch]:
        if segs.found:
            pair, n = _tallied(segs.found)
            part = (pair >> 32) % shards
            order = np.argsort(part, kind="stable")
            pair, n, part = pair[order], n[order], part[order]
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            k = len(edge) - 1
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(np.full(k, bundle)), *(pa.array([squeezed(x[i:j]) for i, j in zip(edge, edge[1:], strict=False)], pa.binary()) for x in (pair, n))], ["part", "bundle", "links", "n"])

    return _in_bundles(False, document, end)


def _tallied(found: list) -> tuple[np.ndarray, np.ndarray]:
    """(pair, n) of arrays of pairs, each for one document, and of such tallies."""
    pair = np.concatenate([x[0] if isinstance(x, tuple) else x for x in found])
    n = np.concatenate([x[1] if isinstance(x, tuple) else np.ones(len(x), np.int64) for x in found])
    pair, at = np.unique(pair, return_inverse=True)
    return pair, np.bincount(at, n, len(pair)).astype(np.int64)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bundle, links, n) sorted by part, each with all pairs of its A ids -> (bundle, links, n, best) for each bundle that asked, and for bundle -1 of all pairs."""

    def answers(asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = [spread(x[1], np.int64) for x in asked]
        pair, n = _tallied([(x, spread(a[2], np.int64)) for x, a in zip(own, asked, strict=True)])
        a = pair >> 32
        edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        best = (n == np.repeat(np.maximum.reduceat(n, edge), np.diff(np.append(edge, len(a))))).astype(np.uint8)
        for bundle, at in [(-1, slice(None)), *((x[0], np.searchsorted(pair, y)) for x, y in zip(asked, own, strict=True))]:
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), *(pa.array([squeezed(x[at])], pa.binary()) for x in (pair, n, best))], ["bundle", "links", "n", "best"])

    key, asked = None, []
    for b in batches:
        for part, bundle, links, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if part != key:
                yield from answers(asked) if asked else ()
                key, asked = part, []
            asked.append((bundle, links, n))
    yield from answers(asked) if asked else ()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for links, n, best in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            pair = spread(links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(spread(n, np.int64)), pa.array(spread(best, np.uint8) > 0)], ["a", "b", "n", "best"])


def _composed(segs: Segments, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out, digests = np.zeros((len(SUMS), len(rows)), np.int64), []
    for k, seq in enumerate(rows.column("seq")):
        own = spread(seq.as_py(), np.uint32)
        if not len(own) or segs.bad[own].any():
            digests.append("")
            continue
        digest = hashlib.sha256()
        for i in range(0, len(own), 1 << 16):
            part = own[i : i + (1 << 16)]
            out[:, k] += segs.sums[:, part].sum(axis=1)
            digest.update((b";" if i else b"") + b";".join([segs.groups[x] for x in part.tolist()]))
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, out), pa.array(digests, pa.string())], ["doc_id", *SUMS, "groups_sha256"])


KINDS = {"start": "long", "doc_id": "long", "counts": "binary", "links": "binary", "groups": "binary", "n": "binary", "best": "binary", "seq": "binary"}


def _together(**kinds: DataFrame) -> DataFrame:
    """Replies (kind 0), answers (1) and documents (2), each bundle in one task in this order."""
    out = None
    for kind, df in ((0, kinds["replies"]), (1, kinds.get("answers")), (2, kinds["docs"])):
        if df is not None:
            rows = df.select("bundle", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in KINDS.items()))
            out = rows if out is None else out.unionByName(rows)
    return out.repartition("bundle").sortWithinPartitions("bundle", "kind")


def aligned_documents(docs: DataFrame, a_json: str | None = None, a_ranks: str | None = None, b_model: str | None = None, bundle: int = BUNDLE) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id and the sums and digest of every row of docs; a, b, n, best of all linked ids of the corpus."""
    ship(docs.sparkSession)
    paths = (a_json or tokenizer_path("byte_bpe_50k.json"), a_ranks or tokenizer_path("byte_bpe_50k.tiktoken"), b_model or tokenizer_path("piece_bpe_32k.model"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(LEAST_SHARDS, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    bundles = saved(rows.mapInArrow(_bundled(paths, bundle, shards), "bundle long, shard long, start long, doc_id long, texts binary, sizes binary, seq binary"), "bundles", "zstd")
    asked, of_doc = bundles.where("shard IS NOT NULL").select(*ASKED[:3], "texts", "sizes"), bundles.where("shard IS NULL").select("bundle", "doc_id", "seq")
    replies = saved(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_aligned(paths), "bundle long, start long, counts binary, links binary, groups binary"), "replies", "zstd")
    held = _together(replies=replies.drop("groups"), docs=of_doc).mapInArrow(_held(shards), "part long, bundle long, links binary, n binary")
    answers = saved(held.repartition("part").sortWithinPartitions("part").mapInArrow(_answered, "bundle long, links binary, n binary, best binary"), "answers", "zstd")
    pairs = answers.where("bundle = -1").select("links", "n", "best").mapInArrow(_listed, "a long, b long, n long, best boolean")
    return _together(replies=replies, answers=answers.where("bundle >= 0"), docs=of_doc).mapInArrow(_in_bundles(True, _composed), DOCUMENT), pairs


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
