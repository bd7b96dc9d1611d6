"""Words, word hashes and rolling windows over whole Arrow string arrays, in numpy.

A word is a maximal run of bytes outside space and 0x09-0x0D, which in UTF-8 is the regex
``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits wide and not polynomial; no Python object is made per word
of up to SIDE_BY_SIDE bytes. Two given different words or windows hash alike with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of a word that are hashed side by side with all other words; longer words go to BLAKE2 one by one.
SIDE_BY_SIDE = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: eight bytes after eight are mixed in, so no arithmetic relation of words gives equal hashes."""
    size = end - start
    # Unaligned reads of eight bytes from any place.
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(GRAM_BASE) + np.uint64(BASE))
    at = np.flatnonzero(size <= SIDE_BY_SIDE)
    from_, left = start[at], size[at]
    while len(at):
        h[at] = mix((h[at] ^ (eight[from_] & _LOW[np.minimum(left, 8)])) * np.uint64(BASE) + np.uint64(GRAM_BASE))
        more = left > 8
        at, from_, left = at[more], from_[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > SIDE_BY_SIDE):
        h[k] = int.from_bytes(blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its first and second part."""
    return mix(a * np.uint64(BASE) + (b ^ (b >> np.uint64(32))) * np.uint64(GRAM_BASE) + np.uint64(1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, of `most` bytes or one text each."""
    data, off = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in order, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] |= inside[1:-1][cut]
    ends[cut - 1] |= inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = word_hashes(LOWER[data] if lower else data, start, end)
    return h, start, end, np.searchsorted(start, off)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one text, and the word index where each starts.

    Hashes of 1, 2, 4, 8 … words are made of each other; the windows are put together from these.
    """
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, size, done, total = h, 1, 0, None
    while True:
        if k & size:
            part = power[done : done + n - k + 1]
            total = part if total is None else joint(total, part)
            done += size
        if 2 * size > k:
            break
        power, size = joint(power[:-size], power[size:]), 2 * size
    at = np.arange(n - k + 1)
    text_end = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    at = at[at + k <= text_end]
    return mix(total[at] + np.uint64(k)), at


def gram_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct k-word shingle hashes; below k words, the whole sequence as one."""
    g, at = windows(h, first, k)
    bound = np.searchsorted(at, first)
    out = []
    for i in range(len(first) - 1):
        if bound[i] < bound[i + 1]:
            s = np.sort(g[bound[i] : bound[i + 1]])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif first[i] < first[i + 1]:
            own = h[first[i] : first[i + 1]]
            out.append(windows(own, np.array([0, len(own)]), len(own))[0])
        else:
            out.append(g[:0])
    return out


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def text_hash(column: str):
    """A stable 64-bit hash as a Column, for dealing rows out; null counts as empty."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))
