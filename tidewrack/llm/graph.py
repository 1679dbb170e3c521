"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Forest:
    """Union-find over positions 0..n-1; a root is the smallest position of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


#: Edges that one task holds at most, 16 MB of ids.
LOCAL_EDGES = 1 << 20


def trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of the edges u[i], v[i]."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # shorten all paths to their roots
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            return names, names[label]
        label = new


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task, up to LOCAL_EDGES at a time, by a star for each of their trees."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        node, root = trees(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])

    size = 0
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield stars()
            held.clear()
            size = 0
    if size:
        yield stars()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the one task."""
    held = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)) for b in batches]
    if held:
        node, root = trees(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the smallest node.

    Each task first thins its edges to stars. Above `local` edges, alternating
    large-star and small-star steps shrink them to one star a component in a
    logarithmic number of rounds, each a shuffle of the edges that remain and a
    table in the shared folder; hubs are handled by partial aggregates and
    skew-splittable joins. At most `local` edges, counted, are solved in one
    task of bounded size.
    """
    thin = lambda df: df.mapInArrow(_thin, "u long, v long")
    e = scratch.save(thin(edges.where("u != v").select("u", "v")), f"{name}-0")
    before, turn = None, 0
    while True:
        if turn:
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        else:
            now = (e.count(), None)
        if now[0] <= local:
            return e.coalesce(1).mapInArrow(_solve, "node long, component long")
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        turn += 1
        e = scratch.save(thin(small.where("u != v").distinct()), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
