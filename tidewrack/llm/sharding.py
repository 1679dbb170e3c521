"""Balanced shards by vector bin packing on bytes, tokens and rows.

Documents with equal text form a group. Groups are dealt over tasks by hash;
each task places its groups, largest first, into the shard whose residual
capacity vector has the highest dot product with the group's size vector. The
shards of the tasks are then matched by the same rule, so that their
differences cancel in all three dimensions. A group above a small share of a shard is split, which
keeps sizes near equal even if one text holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: A group is split if it holds more than 1 / SPLIT of what one task gives one shard, in any dimension; rows in a task, about; most tasks.
SPLIT, TASK_ROWS, MOST_TASKS = 8, 100_000, 4096
#: Weights of bytes, tokens and rows in the dot product: all three are balanced jointly, the law's bytes most closely.
WEIGHTS = np.array([8.0, 2.0, 1.0])


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each group. sizes: a row (bytes, tokens, rows) a group.

    Each dimension is scaled by what one shard should hold, so that residual
    capacities start at 1; the dot product of size and residual picks the
    shard. Once rounding has filled all shards the residuals go negative and
    the rule still prefers the emptiest.
    """
    total = sizes.sum(0)
    unit = sizes / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-(unit @ WEIGHTS), kind="stable").tolist():
        best = int(np.argmax(left @ (WEIGHTS * unit[i])))
        out[i] = best
        left[best] -= unit[i]
    return out


def _packed(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("print", "ascending"), ("chunk", "ascending"), ("doc_id", "ascending")])
        part = table.column("part").to_numpy()
        size, tokens = table.column("size").to_numpy(), table.column("tokens").to_numpy()
        prints = table.column("print").combine_chunks().dictionary_encode()
        prints = (prints.chunk(0) if isinstance(prints, pa.ChunkedArray) else prints).indices.to_numpy()
        chunk = table.column("chunk").to_numpy()
        new = np.ones(len(part), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (prints[1:] != prints[:-1]) | (chunk[1:] != chunk[:-1])
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        sums = np.stack([np.add.reduceat(x, starts) for x in (size, tokens, np.ones(len(part), np.int64))], axis=1)
        bins, at = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        home = part[starts]
        for p in np.unique(home):
            bins[part == p] = place(sums[home == p], shards)[group[part == p] - np.flatnonzero(home == p)[0]]
        name = part.astype(np.int64) * shards + bins
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        first = np.searchsorted(ranked, ranked)
        at[order] = np.arange(len(order)) - first
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "size", "text_crc32")]
        yield from pa.Table.from_arrays([*columns, pa.array(tokens), pa.array(part), pa.array(bins), pa.array(at)], names=["doc_id", "size", "text_crc32", "tokens", "part", "bin", "at"]).to_batches(max_chunksize=50_000)

    return run


def match(loads: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, first slot) of each bin. loads: [tasks, shards, (bytes, tokens, rows)].

    Bins are measured by what they hold above or below their task's mean. Task
    after task, the most uneven first, its bins go to the shards one to one,
    the most extreme bin first, to the free shard whose own deviation has the
    lowest dot product with the bin's.
    """
    total = loads.sum((0, 1))
    off = loads / np.where(total > 0, total / shards, 1)
    off = off - off.mean(1, keepdims=True)
    held, rows = np.zeros((shards, loads.shape[2])), np.zeros(shards, np.int64)
    shard, slot = np.empty(loads.shape[:2], np.int64), np.empty(loads.shape[:2], np.int64)
    spread = (WEIGHTS * off**2).sum(2)
    for t in np.argsort(-spread.sum(1), kind="stable").tolist():
        free = np.ones(shards, dtype=bool)
        for b in np.argsort(-spread[t], kind="stable").tolist():
            open_ = np.flatnonzero(free)
            to = int(open_[np.argmin(held[open_] @ (WEIGHTS * off[t, b]))])
            shard[t, b], free[to] = to, False
            held[to] += off[t, b]
    for t in range(len(loads)):
        slot[t] = rows[shard[t]]
        rows[shard[t]] += loads[t, :, 2].astype(np.int64)
    return shard, slot


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of all `docs` (doc_id, text): law `bytes`, sizes near equal.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. size is the
    text's UTF-8 bytes plus 8; null texts count as empty. Rows with equal text
    share a shard unless the group is split. Repeated rows are placed once
    each, a null doc_id stays null, an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = text_of()
    words = F.octet_length(text) - F.octet_length(F.translate(text, " \n\t\r", "")) + 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), words.cast("long").alias("tokens"), F.unhex(F.md5(text)).alias("print")
    )
    rows = scratch.save(rows, "rows")
    total = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    count = max(1, total[0])
    tasks = int(min(MOST_TASKS, max(1, -(-count // TASK_ROWS))))
    limit = [max(1, (x or 0) / (shards * SPLIT * tasks)) for x in (total[1], total[2], total[0])]
    groups = rows.groupBy("print").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    share = F.greatest(F.col("b") / limit[0], F.col("t") / limit[1], F.col("r") / limit[2])
    # Each has over 1 / (shards * SPLIT * tasks) of a total, in one of three dimensions: at most 3 * shards * SPLIT * tasks groups.
    hot = groups.where((share > 1) & (F.col("r") > 1)).select("print", F.ceil(share).cast("long").alias("chunks"))
    dealt = rows.join(F.broadcast(hot), "print", "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).otherwise(F.lit(0).cast("long")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("print", "chunk"), F.lit(tasks)).cast("long")).drop("chunks")
    binned = scratch.save(dealt.repartition(tasks, "part").mapInArrow(_packed(shards), "doc_id long, size long, text_crc32 long, tokens long, part long, bin long, at long"), "binned")
    scratch.drop("rows")
    loads = np.zeros((tasks, shards, 3))
    for r in binned.groupBy("part", "bin").agg(F.sum("size"), F.sum("tokens"), F.count("*")).toLocalIterator():  # tasks * shards rows at most
        loads[r[0], r[1]] = r[2:]
    to, slots = match(loads, shards)
    table = [(t, b, int(to[t, b]), int(slots[t, b])) for t in range(tasks) for b in range(shards)]
    names = spark.createDataFrame(table, "part long, bin long, shard int, first long")
    out = binned.join(F.broadcast(names), ["part", "bin"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
