"""Removal of long repeated byte strings by distributed bucket-pointer refinement.

A suffix array sorted by bucket-pointer refinement starts with buckets of equal
q-grams and refines a bucket by the bucket identifiers found at later offsets,
reusing identifiers as they are updated. Here all suffixes begin in the buckets
of their 8-grams; a bucket of h bytes is refined by the identifier at offset h,
so that identifiers stand for 8, 16, 32, 64, 128 bytes and, by identifiers at
offsets that overlap, for any other length. An identifier is a 64-bit mix of the
two it was refined from instead of a rank, so tasks agree on it without sorting
together. Only sampled suffixes cross the network: of the GRAM-byte identifiers
in each LENGTH-byte window the least is the window's pointer, the same in every
copy of the window. The windows that share a pointer form a family.

1. Initial buckets: families by the identifier at their pointer. Buckets of one
   family are done: none of its windows is repeated.
2. First refinement: a digest of all bytes the family spans. If two families
   agree, all windows of both are repeated.
3. Further refinement, in buckets where families differ: the identifiers of
   runs of windows, then of single ones, for one family of each refined bucket.

Each level works on what the level before left unresolved. Strings are taken as
equal when two independent 64-bit identifiers agree, in step 2 one of them a
BLAKE2 digest of the bytes. The repeated windows of a document are joined into
maximal runs of removed bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, small_batches, text_of

LENGTH, GRAM = 200, 48
#: Bytes of the initial buckets.
Q = 8
#: Bits of a place in the keys whose least is a window's pointer; longer documents are cut into overlapping pieces.
BITS = 24
#: Rows of one or two numbers that are broadcast at most, 16 MB.
BROADCAST_KEYS = 1_000_000


def refined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Identifiers of the buckets `a` refined by the identifiers `b`."""
    x = a * K.U(K.R1) + (b ^ K.U(salt)) * K.U(K.R2)
    x ^= x >> K.U(32)
    x *= K.U(K.MIX1)
    x ^= x >> K.U(29)
    return x


class Buckets:
    """Bucket identifiers of all suffixes of `data`, for Q bytes and each doubling up to `most` bytes."""

    def __init__(self, data: np.ndarray, most: int):
        padded = np.zeros(len(data) + Q, np.uint8)
        padded[: len(data)] = data
        width = max(len(data) - Q + 1, 0)
        self.of = {Q: K.mix(np.ndarray((width,), "<u8", buffer=padded, strides=(1,)) + K.U(K.R1))}
        h = Q
        while 2 * h <= most:
            self.of[2 * h] = refined(self.of[h][: max(width - 2 * h + Q, 0)], self.of[h][h:])
            h *= 2

    def at(self, start: np.ndarray, size: np.ndarray, h: int, salt: int = 0) -> np.ndarray:
        """Identifiers of the strings of `size` >= h bytes at `start`, refined from those of h bytes at offsets h, 2 h, ... and the last that fits."""
        out, k = K.mix(self.of[h][start] ^ K.U(salt)), h
        most = int(size.max()) if len(size) else 0
        while k < most:
            live = np.flatnonzero(size > k)
            out[live] = refined(out[live], self.of[h][start[live] + np.minimum(k, size[live] - h)], salt)
            k += h
        return out


def step_of(size: int) -> int:
    """The largest doubling of Q within `size` bytes."""
    h = Q
    while 2 * h <= size:
        h *= 2
    return h


def families(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, pointer, bucket, identifier) of each family of a block.

    Windows are given by their start in the document.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, K.U) for _ in range(2))
    n = len(data)
    if n < length:
        return none
    h = step_of(gram)
    ids = Buckets(data, h).of[h]
    places = n - gram + 1
    hashes = K.mix(refined(ids[:places], ids[gram - h : gram - h + places]) if gram > h else ids[:places])
    low = K.U((1 << BITS) - 1)
    key = (hashes & ~low) | np.arange(places, dtype=K.U)
    span, width = 1, length - gram + 1  # least of `span` places; doubled up to `width`
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    pointer = (key & low).astype(np.int64)  # of the windows 0 .. n - length
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[1:][doc])
    if not len(start):
        return none
    at, owner = pointer[start], doc[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s, e, p, d = start[first], start[last], at[first], owner[first]
    text, digest = memoryview(data.tobytes()), hashlib.blake2b
    joined = b"".join([digest(text[x:y], digest_size=8).digest() for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)])
    whole = np.frombuffer(joined, "<u8") ^ K.mix((p - s).astype(K.U))
    return d, s - offsets[d], e - offsets[d], p - offsets[d], hashes[p], whole


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first document, bytes, offsets, windows before) of blocks that fit BITS; long documents overlap by length - 1 bytes."""
    most = min(1 << (BITS - 1), 2 * K.PIECE)  # a block above it is one document
    for i, j in K.blocks(offsets, min(K.PIECE, most)):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= most:
            yield i, data[a:b], offsets[i : j + 1] - a, 0
        else:
            for skip in range(0, b - a - length + 1, most):
                piece = data[a + skip : min(b, a + skip + most + length - 1)]
                yield i, piece, np.array([0, len(piece)]), skip


def _families(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, piece, at, skip in _pieces(data, offsets, length):
                d, s, e, p, bucket, whole = families(piece, at, length, gram)
                places = [pa.array((x + skip).astype(np.int64)) for x in (s, e, p)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + d]), *places, pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.ones(len(d), np.int64))], names=NAMES)

    return run


NAMES = ["key", "s", "e", "p", "bucket", "whole", "n"]
ROWS = "key long, s long, e long, p long, bucket long, whole long, n long"


def _finer(length: int, step: int) -> Callable:
    """Cut the families listed for each text into runs of `step` windows, aligned at their pointers.

    The bucket of a run is the identifier of the bytes that all its windows
    have, since runs that share a window share those.
    """

    def one(key: int, text: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lead = (p - s) // step  # runs count from the pointer backwards and stay within the family
        tail = (p - e) // step
        count = lead - tail + 1
        family = np.repeat(np.arange(len(s)), count)
        turn = lead[family] - (np.arange(len(family)) - np.repeat(np.cumsum(count) - count, count))
        high = p[family] - turn * step
        a, b = np.maximum(high - step + 1, s[family]), np.minimum(high, e[family])
        base, h = int(s.min()), step_of(length - step + 1)
        ids = Buckets(text[base : int(e.max()) + length], h)
        # the bytes of every window that the run could have, so a run cut short by its family's end has the same bucket
        core = K.mix(ids.at(high - base, np.full(len(a), length - step + 1), h) + (p[family] - high).astype(K.U))
        whole = ids.at(a - base, b - a + length, h // 2 if h > Q else h, K.MIX2) ^ K.mix((b - a).astype(K.U) * K.U(K.R1) + (p[family] - a).astype(K.U) * K.U(K.R2))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), key)), pa.array(a), pa.array(b), pa.array(p[family]), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(n[family])], names=NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            lists = batch.column(2)
            spans, items = lists.offsets.to_numpy(), lists.values
            columns = [items.field(c).to_numpy() for c in ("s", "e", "p", "n")]
            for k, key in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                order = np.argsort(columns[0][spans[k] : spans[k + 1]], kind="stable")
                s, e, p, n = (c[spans[k] : spans[k + 1]][order] for c in columns)
                at = 0
                while at < len(s):  # neighbouring families share one prefix sum of bounded length
                    to = max(at + 1, int(np.searchsorted(s, s[at] + K.PIECE // 2)))
                    yield one(key, text, s[at:to], e[at:to], p[at:to], n[at:to])
                    at = to

    return run


def _digests(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            listed = batch.column(2) if batch.num_columns > 2 else None
            sizes, removed, spans, prints = [], [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                cover = None
                if listed is not None and listed[k].is_valid:
                    edges = np.zeros(len(text) + 1, np.int64)
                    at, to = spans_of(listed, k)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, to + length, -1)
                    cover = np.cumsum(edges[:-1]) > 0
                sizes.append(len(text))
                removed.append(int(cover.sum()) if cover is not None else 0)
                spans.append(int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()) if cover is not None else 0)
                prints.append(hashlib.sha256(text[~cover].tobytes() if cover is not None else text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(prints)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def spans_of(lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = lists.offsets[k].as_py(), lists.offsets[k + 1].as_py()
    items = lists.values.slice(a, b - a)
    return items.field("s").to_numpy(), items.field("e").to_numpy()


def _texts(source: DataFrame, lists: DataFrame) -> DataFrame:
    """`source` (key, ...) joined with `lists` (key, list): texts without a list are left out before the shuffle if the keys fit a broadcast."""
    if lists.count() <= BROADCAST_KEYS:
        source = source.join(F.broadcast(lists.select("key")), "key", "left_semi")
    return source.join(lists, "key")


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def refine(rows: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame]:
    """One refinement of `rows` (ROWS): (spans of windows found repeated, classes that need a finer look).

    n tells how many families a row stands for; windows of rows with n > 1 are
    known to be repeated and only help others.
    """
    again = scratch.save(rows.groupBy("bucket").agg(F.sum("n").alias("c")).where("c > 1").select("bucket"), f"again-{level}")
    # beyond a broadcast, joins that are written at once, so that a hot bucket's rows can be split over tasks
    live = scratch.save(rows.join(_small(again), "bucket", "left_semi"), f"live-{level}")
    scratch.drop(f"rows-{level}")
    kinds = live.groupBy("bucket", "whole").agg(F.sum("n").alias("total"), F.min(F.struct("key", "s", "e", "p")).alias("x"))
    kinds = scratch.save(kinds, f"kinds-{level}")
    twice = kinds.where("total > 1").select("bucket", "whole")
    spans = scratch.save(live.where("n = 1").join(_small(twice), ["bucket", "whole"], "left_semi").select("key", "s", "e"), f"spans-{level}")
    scratch.drop(f"live-{level}", f"again-{level}")
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("m"), F.min("total").alias("least")).where("m > 1 and least = 1").select("bucket")
    open_ = kinds.join(mixed, "bucket", "left_semi").select("x.key", F.struct("x.s", "x.e", "x.p", F.col("total").alias("n")).alias("family"))
    return spans, open_


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, steps: tuple[int, ...] = (8, 1)) -> DataFrame:
    """What is left of all `docs` (doc_id, text) without repeated strings of `length` bytes.

    Every byte is removed that a `length`-byte string covers which starts
    anywhere else as well, in the same document or another, judged on the
    input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept_sha256 (lower-case hex of the remaining bytes joined). Null texts
    are empty; shorter texts keep everything. Repeated rows are copies of each
    other; a null doc_id stays null; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = text_of()
    source = docs.select(F.xxhash64("doc_id", text).alias("key"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = scratch.save(source.select("key", "text").mapInArrow(_families(length, gram), ROWS), "rows-0")
    spans, open_ = refine(rows, scratch, 0)
    found = [spans]
    for level, step in enumerate(steps, 1):
        lists = scratch.save(open_.groupBy("key").agg(F.collect_list("family").alias("list")), f"lists-{level}")
        cut = _texts(source.select("key", "text"), lists)
        rows = scratch.save(cut.mapInArrow(_finer(length, step), ROWS), f"rows-{level}")
        spans, open_ = refine(rows, scratch, level)
        found.append(spans)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    lists = scratch.save(every.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("list")), "spans")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    keys = lists.select("key")
    if keys.count() > BROADCAST_KEYS:
        return source.join(lists, "key", "left").select("doc_id", "text", "list").mapInArrow(_digests(length), out)
    cut = _texts(source, lists).select("doc_id", "text", "list").mapInArrow(_digests(length), out)
    return cut.unionByName(source.join(F.broadcast(keys), "key", "left_anti").select("doc_id", "text").mapInArrow(_digests(length), out))
