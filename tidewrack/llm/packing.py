"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each input partition tokenises its documents and packs them best-fit, longest
first. Sequences that are full or nearly so are done; the others are merged
over a tree of partitions, each acting as one item of its length in the next
best-fit round. Only token counts and checksums travel, never texts or ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of

CAPACITY, SLACK, FAN_IN = 2048, 4, 8
#: Characters of white space in a row that are left to tokenizers.
SPACES = 1000
SPACE_RUN = re.compile(rf"\s{{{SPACES}}}")
#: Underfull sequences that one task of a merge round takes at most, about.
TASK_BINS = 50_000
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "fill long, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library.

    The merges run in tiktoken, several times faster, whose ids are the same
    for a vocabulary numbered by merge rank: merges and split pattern are the
    same, and the tests compare both over every code point. Texts that spell an
    added token and runs of white space too long for tiktoken's backtracking go
    through tokenizers itself, as does a file of any other kind.
    """

    #: Fixed value: the split of byte-level vocabularies.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        vocab, split = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
        merges = spec["model"].get("merges") or []
        ranked = lambda: all(vocab["".join(m if isinstance(m, list) else m.split(" "))] == 256 + k for k, m in enumerate(merges))
        if spec["model"].get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer") and ranked():
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in token): n for token, n in vocab.items() if token not in self.added}
            self.fast = tiktoken.Encoding("byte_level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _spacious(self, text: str) -> bool:
        """Whether `text` has a run of SPACES characters of white space."""
        if len(text) < SPACES:
            return False
        words = text.split()
        return len(text) - sum(map(len, words)) - len(words) >= SPACES - 2 and SPACE_RUN.search(text) is not None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added) or self._spacious(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of the items of each bin: largest items first, each into the bin it leaves least room in."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        fits = mask >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
            bins[b].append(i)
            left -= need
        else:
            b, left = len(bins), capacity - need
            bins.append([i])
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins


def _emit(bins: list[list[int]], fills: np.ndarray, items: pa.StructArray, spans: np.ndarray) -> pa.RecordBatch:
    """Bins over bins: child c holds items spans[c]:spans[c+1]."""
    order = [np.arange(spans[c], spans[c + 1]) for b in bins for c in b]
    ends = np.cumsum([0, *(int(sum(spans[c + 1] - spans[c] for c in b)) for b in bins)])
    taken = items.take(pa.array(np.concatenate(order) if order else np.zeros(0, np.int64)))
    fill = np.array([fills[b].sum() for b in bins], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fill), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken)], names=["fill", "items"])


def _first_round(path: str, capacity: int, end_id: int, flush: int = 500_000) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ITEM, strict=True)], fields=list(ITEM))
            sizes = np.array(columns[3], dtype=np.int64)
            return _emit(best_fit(sizes, capacity), sizes, items, np.arange(len(rows) + 1))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*code.ids(text.as_py()), end_id], dtype="<u4")
                head = len(ids) % capacity or capacity
                start = 0
                for piece in range(-(-len(ids) // capacity)):
                    stop = head + piece * capacity
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            if len(rows) >= flush:
                yield packed()
                rows.clear()
        if rows:
            yield packed()

    return run


def _merge(capacity: int) -> Callable:
    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lists = table.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        fills = table.column("fill").to_numpy()
        spans = lists.offsets.to_numpy().astype(np.int64)
        yield _emit(best_fit(fills, capacity), fills, lists.flatten(), spans - spans[0])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        items, spans = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        spans = spans - spans[0]
        lengths = items.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        counts = np.diff(spans)
        offset = before - np.repeat(before[spans[:-1]] if len(before) else before, counts)
        sequence = np.repeat(batch.column(0).to_numpy(), counts)
        yield pa.RecordBatch.from_arrays([*(items.field(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Sequences of at most `capacity` tokens from all `docs` (doc_id, text).

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and
    offset. A document is its token ids and `end_id`; null and empty texts are
    `end_id` alone. One of more than `capacity` ids is cut into pieces of that
    length, the first of which may be shorter; no other is cut. Repeated rows
    are packed once each, a null doc_id stays null, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    state = scratch.save(source.mapInArrow(_first_round(tokenizer, capacity, end_id), BINS), "round-0")
    full = state.where(F.col("fill") >= capacity - SLACK)
    open_ = state.where(F.col("fill") < capacity - SLACK)
    done, turn, groups = [full], 0, max(1, source.rdd.getNumPartitions())
    left = open_.count()
    while left:
        groups = max(-(-groups // FAN_IN), -(-left // TASK_BINS))
        turn += 1
        state = scratch.save(open_.coalesce(groups).mapInArrow(_merge(capacity), BINS), f"round-{turn}")
        now = state.where(F.col("fill") < capacity - SLACK).count()
        last = groups == 1 or (groups == -(-left // TASK_BINS) and now > 0.99 * left)
        if last or not now:
            done.append(state)
            break
        done.append(state.where(F.col("fill") >= capacity - SLACK))
        open_, left = state.where(F.col("fill") < capacity - SLACK), now
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return numbered.mapInArrow(_places, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
