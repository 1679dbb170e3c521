"""Vectorised text kernels over Arrow string columns.

Every function works on whole blocks of documents: the concatenated UTF-8
bytes and the offsets at which documents begin. No function loops over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once (their arrays of numbers take 8 bytes a byte).
PIECE = 1 << 20
#: Odd multipliers of the hashes and of the mixer.
R1 = 0x9E3779B97F4A7C15
R2 = 0xD1342543DE82EF95
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(MIX1)
    x ^= x >> U(27)
    x *= U(MIX2)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(R1) + U(seed * R2 & MASK)) | U(1)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents (first, end) of at most `limit` bytes, or one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_class(text: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(text)] = True
    return table


#: The separators of shingle words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = byte_class(b" \t\n\v\f\r")
#: Everything in ASCII but letters and digits; bytes of other scripts belong to words.
PUNCTUATION = ~byte_class(bytes(x for x in range(256) if x >= 128 or chr(x).isalnum()))


#: ASCII case folding of bytes; masks of the first 0..8 bytes of a little-endian word; bytes of a word beyond which a digest hashes it.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
LONG_WORD = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each data[starts[i]:ends[i]].

    Eight bytes at a time are mixed into a state that begins with the length, so
    no two words collide by structure; long words take a BLAKE2 digest.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(U) * U(R1) + U(R2))
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - at
        out[live] = mix((out[live] ^ (wide[starts[live] + at] & HEAD[np.minimum(left, 8)])) + U(R1))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Word hashes of a block of documents.

    hashes: one 64-bit hash a word (ASCII case folded); first: for document i,
    its words are first[i]:first[i+1]; starts, ends: byte places in the block.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = True
            before[1:] = ~inside[:-1]
            before |= edge[:n]
        starts = np.flatnonzero(inside & before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = True
            after[:-1] = ~inside[1:]
            after |= edge[1:]
        ends = np.flatnonzero(inside & after) + 1
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.hashes = word_hashes(LOWER[data], starts, ends)


def shingles(words: Words, size: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): shingle hashes in order; document i has first[i]:first[i+1].

    A document with fewer words than `size` has its whole sequence as its one
    shingle, or none if `whole_if_short` is false; one without words has none.
    """
    first, h = words.first, words.hashes
    n, counts = len(h), np.diff(words.first)
    if not n:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n)
    end = first[1:][doc]
    factors = constants(size, 77)
    total = np.zeros(n, dtype=U)
    for j in range(min(size, n)):
        here = h[j:] * factors[j]
        if j:
            here[place[: n - j] + j >= end[: n - j]] = 0
        total[: n - j] += here
    length = counts[doc]
    keep = place + size <= end
    if whole_if_short:
        short = (length < size) & (place == first[:-1][doc])
        total[short] += length[short].astype(U) * U(R2)
        keep |= short
    out = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=len(counts)), out=out[1:])
    return mix(total[keep]), out


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
