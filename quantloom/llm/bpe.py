"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Whether a token is final depends only on a bounded stretch of text behind it. That sufficient
lookahead follows from the merge list: a change at the end of the known text moves a token boundary
to its left only through merges of rising rank, each of whose right parts begins with the left part
of the one before; the longest such chain, in symbols, bounds how far it gets. A token that ends
further than that from the end of what is known is emitted, and its symbols are forgotten. So what is
held beside the text itself does not grow with it: a text is taken in stretches of about STRETCH
characters, cut before white space (or inside a word longer than that, which the transducer reads as it
goes), and the ids of a stretch are hashed, decoded and let go before the next. Decoding turns ids into
bytes and bytes into text with an incremental state machine, and holds no more than an unfinished
character.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded each; other
columns are ignored; an empty table gives no rows. Strings of added tokens inside a text become those tokens, as the tokenizers
library has it by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quantloom.session import ship

#: White space of Unicode, which the splitting pattern leaves out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a text may be cut.
BREAK = re.compile(r"[\t\n\r ]")
CACHE_WORDS, LONG_WORD = 1 << 18, 256
STRETCH, IDS_AT_ONCE = 1 << 16, 1 << 16
_coders: dict[str, Coder] = {}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
    """How many symbols before the end of the known text a token boundary may still change.

    reach[t] is the longest chain so far whose last merge has t on its left. A later merge (l, r)
    prolongs every chain whose last left part is a beginning of r.
    """
    size = lambda t: len(t.removesuffix(suffix)) if suffix and t != suffix else len(t)
    reach: dict[str, int] = {}
    longest = 1
    for left, right in merges:
        best = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0) + size(left)
        if best > reach.get(left, 0):
            reach[left] = best
            longest = max(longest, best)
    return longest


class Words(dict):
    """Ids by word; a word that is missing is encoded, and the cache starts anew when it is full."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.coder.transduce(word))
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Coder:
    """Encoder and decoder for a vocabulary file with lower-cased words that end in a suffix."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words_of = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.cache = Words(self)
        strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.token = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.token_bytes = [t.encode() for t in self.token]
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.raw = [bytes(back[c] for c in t.removesuffix(self.suffix)) + (b" " if t.endswith(self.suffix) else b"") if t not in self.added and all(c in back for c in t.removesuffix(self.suffix)) else t.encode() for t in self.token]

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges in order of rank; of equal ranks the leftmost first."""
        get, never = self.rank.get, len(self.rank)
        ranks = [get(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            k = ranks.index(least)
            symbols[k] += symbols.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = get((symbols[k - 1], symbols[k]), never)
            if k < len(ranks):
                ranks[k] = get((symbols[k], symbols[k + 1]), never)
        return symbols

    def transduce(self, word: str) -> Iterator[int]:
        """The ids of one word; holds two lookaheads of symbols at most."""
        alphabet, vocab, hold = self.alphabet, self.vocab, self.lookahead + 1
        raw = word.encode()
        start, n, room = 0, len(raw), 2 * hold + LONG_WORD
        while n - start > room:
            at = start
            for token in self.merge([alphabet[b] for b in raw[start : start + room]]):
                at += len(token)
                if at > start + room - hold:
                    at -= len(token)
                    break
                yield vocab[token]
            start = at
        symbols = [alphabet[b] for b in raw[start:]]
        symbols[-1] += self.suffix
        for token in self.merge(symbols):
            yield vocab[token]

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> array:
        """All ids of a whole text, as unsigned 32-bit integers."""
        ids = array("I")
        for some in self.stretches(text):
            ids.extend(some)
        return ids

    def stretches(self, text: str) -> Iterator[array]:
        """The ids of a text, in pieces of bounded length."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._plain(text, at, m.start())
            yield array("I", [self.added[m.group()]])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[array]:
        """The ids of text[start:end], which holds no added token.

        Cuts come before an ASCII space, tab or line end: neither normalising, lower-casing nor
        splitting into words looks across one.
        """
        while start < end:
            cut = end
            if end - start > STRETCH and (m := BREAK.search(text, start + STRETCH, end)):
                cut = m.start()
            yield from self._words(self.normalised(text[start:cut]))
            start = cut

    def _words(self, text: str) -> Iterator[array]:
        if len(text) <= 2 * STRETCH:
            yield array("I", chain.from_iterable(map(self.cache.__getitem__, self.words_of.findall(text))))
            return
        ids = array("I")
        for m in self.words_of.finditer(text):
            word = m.group()
            for i in self.cache[word] if len(word) <= LONG_WORD else self.transduce(word):
                ids.append(i)
                if len(ids) >= IDS_AT_ONCE:
                    yield ids
                    ids = array("I")
        yield ids

    def decoded(self, ids: array) -> Iterator[str]:
        """The text of the ids as the library decodes a vocabulary without a decoder: token strings with a space between, piece by piece."""
        machine = Decoder(self.token_bytes, b" ")
        for k in range(0, len(ids), IDS_AT_ONCE):
            yield machine.feed(ids[k : k + IDS_AT_ONCE])
        yield machine.finish()

    def text(self, ids: Iterable[int]) -> str:
        """The words behind the ids, lower-cased, with a space after each."""
        machine = Decoder(self.raw, b"")
        return machine.feed(ids) + machine.finish()


class Decoder:
    """Ids to text, a piece at a time; keeps the bytes of a character that is not complete yet."""

    def __init__(self, table: list[bytes], between: bytes):
        self.table, self.between, self.begun = table, between, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if self.begun and data:
            data = self.between + data
        self.begun = self.begun or bool(data)
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def coder(path: str) -> Coder:
    """One coder a process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                total, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                machine = Decoder(c.token_bytes, b" ")
                for ids in c.stretches(text.as_py() or ""):
                    total += len(ids)
                    of_ids.update(little_endian(ids))
                    of_text.update(machine.feed(ids).encode())
                of_text.update(machine.finish().encode())
                n.append(total)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids (array<int>) of their whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            ids = [c.encode(t.as_py() or "").tolist() for t in b.column(b.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
