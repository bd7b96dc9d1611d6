"""Best-fit packing by the sum-of-squares rule.

Documents become token ids and an end id; longer ones than a sequence are cut into full pieces, the
first of which takes what is left over. Pieces are dealt by a hash into groups of about GROUP_ROWS,
so no group grows with the corpus; each group is packed on its own, largest pieces first: a piece
goes to the open sequence that it fits into and after which the sum over residual gaps of the
squared counts of open sequences is smallest. Opening a sequence is not weighed against the open gaps,
as the rule alone would: with as few sequences as possible wanted, it is done only where a piece fits
nowhere. A group leaves few open sequences, so dealing costs next to nothing in sequences. The place
of a piece in the table takes part in its hash, so copies of one document are dealt over all groups.

Defined results: a null text counts as empty and gives one piece, the end id alone; repeated rows
are packed each; a null doc_id is kept; other columns are ignored; an empty table gives no rows. Special strings in a text are
encoded as the tokenizers library does by default.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import saved, ship

LENGTH, END_ID, GROUP_ROWS = 1024, 2, 1 << 16
_encoders: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """ids of a text, equal to those of the tokenizers library with the JSON file of the same vocabulary.

    The faster encoder reads the vocabulary as ranks; texts on which its regex engine gives up go to
    the tokenizers library.
    """

    def __init__(self, ranks: str, json_file: str, pattern: str, specials: tuple[tuple[str, int], ...]):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(specials))
        self.json_file, self.slow = json_file, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_file)
                self.slow.no_truncation()
                self.slow.no_padding()
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(ranks: str, json_file: str) -> ByteEncoder:
    """One encoder a process."""
    if (ranks, json_file) not in _encoders:
        import json

        import public_tokenizers

        with open(json_file) as f:
            specials = tuple((x["content"], x["id"]) for x in json.load(f)["added_tokens"])
        _encoders[ranks, json_file] = ByteEncoder(ranks, json_file, public_tokenizers.PATTERN, specials)
    return _encoders[ranks, json_file]


def _pieces(ranks: str, json_file: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, json_file)
        for b in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % length or min(length, len(ids))
                bounds = [0, *range(first, len(ids) + 1, length)]
                for p, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    at.append(k)
                    piece.append(p)
                    start.append(i)
                    size.append(j - i)
                    crc.append(zlib.crc32(ids[i:j].tobytes()))
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length in the given order, and the number of sequences."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths):
        fitting = gaps[size:capacity]
        if fitting.any():
            # Leaving gap g lowers the sum by 2 gaps[g] - 1; reaching gap g - size raises it by 2 gaps[g - size] + 1, a closed one by nothing.
            rise = 2 * gaps[: capacity - size] + 1
            rise[0] = 0
            rise -= 2 * fitting - 1
            rise[fitting == 0] = np.iinfo(np.int64).max
            gap = int(size + np.argmin(rise))
            at = held[gap].pop()
            gaps[gap] -= 1
        else:
            gap, at, n = capacity, n, n + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > size:
            held[gap - size].append(at)
            gaps[gap - size] += 1
    return sequence, offset, n


def _pack_group(length: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset, _ = pack(t["length"].to_numpy(), length)
        return t.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence + (int(key[0].as_py()) << 40))).append_column("offset", pa.array(offset))

    return run


def packed(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, ranks: str | None = None, json_file: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs."""
    ship(docs.sparkSession)
    ranks, json_file = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), json_file or tokenizer_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = saved(docs.select("doc_id", "text").mapInArrow(_pieces(ranks, json_file, end_id, length), schema), "pieces")
    groups = max(1, round(pieces.count() / group_rows))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(_pack_group(length), f"{schema}, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
