"""MinHash near-duplicate classes by a signature-coordinate inverted join.

Each document is posted under every (coordinate, value) pair of its MinHash
signature. A similar pair shares at least MATCHES of the COORDINATES values
(below that, a pair at the threshold is missed with a chance about 1 in 23,000),
so only the postings that are shared at all count, and of a document's m shared
ones only its m - MATCHES + 1 rarest are merged; the longer lists are skipped
and later only probed, through the signatures. Documents whose merged lists
meet form a family: no similar pair crosses families. Within a family,
signatures are compared, pairs with enough matches are confirmed on the full
shingle sets, and only links that join two classes are kept, so that groups of
copies never unfold into all their pairs. Sets hold 64-bit hashes of shingles
that mix every byte of their words; two different shingles of a corpus agree
with a chance of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, runs, small_batches, text_of
from .graph import Forest, components

COORDINATES, MATCHES = 64, 38
#: Members of a family that one task compares with each other.
CHUNK = 256
#: Ids beyond which a set of documents is not broadcast.
BROADCAST_IDS = 1_000_000


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signature of each run hashes[first[i]:first[i+1]]; empty runs get the largest value."""
    out = np.full((len(first) - 1, COORDINATES), K.MASK, dtype=K.U)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        a, b = K.constants(COORDINATES, 5), K.constants(COORDINATES, 6)
        at = first[:-1][full]
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat((hashes ^ b[k]) * a[k], at)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for i, j in K.blocks(offsets):
            words = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.column(0).slice(i, j - i), *K.shingles(words, size)


def _features(size: int) -> Callable:
    coordinate = np.arange(1, COORDINATES + 1, dtype=K.U) * K.U(K.R2)

    def run(batches):
        for ids, hashes, first in _blocks(batches, size):
            keys = K.mix(signatures(hashes, first) ^ coordinate).view(np.int64)
            counts, prints = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                one = np.unique(hashes[a:b])
                counts.append(len(one))
                prints.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, COORDINATES, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), lists], names=["doc_id", "n_shingles", "print", "keys"])

    return run


def _members(size: int) -> Callable:
    def run(batches):
        for ids, hashes, first in _blocks(batches, size):
            sigs = signatures(hashes, first)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "sig", "members"])

    return run


class _Rows:
    """The rows of one group: document, known class, signature, set, and side (0: a row, 1: a query)."""

    def __init__(self, table: pa.Table):
        self.doc = table.column("doc_id").to_numpy()
        self.cls = table.column("cls").to_numpy()
        self.side = table.column("side").to_numpy()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), K.U).reshape(-1, COORDINATES)
        self.sets = [np.frombuffer(x, K.U) for x in table.column("members").to_pylist()]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_group(rows: _Rows, percent: int, crossed: bool) -> list[tuple[int, int]]:
    """Links (class, class) that join all similar rows of the group that are not yet of one class.

    crossed: only rows against queries. Pairs whose classes are already joined
    need no comparison; the others are all compared.
    """
    names, at = np.unique(rows.cls, return_inverse=True)
    forest, out, classes = Forest(len(names)), [], at.tolist()
    left = np.flatnonzero(rows.side == 1) if crossed else np.arange(len(at))
    right = np.flatnonzero(rows.side == 0) if crossed else left
    sizes = np.array([len(x) for x in rows.sets])
    for x in left.tolist():
        others = right if crossed else right[right > x]
        if not len(others):
            continue
        matches = (rows.sig[others] == rows.sig[x]).sum(1)
        fit = (matches >= MATCHES) & (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x]))
        order = np.argsort(-matches[fit], kind="stable")
        for y in others[fit][order].tolist():
            if forest.find(classes[x]) != forest.find(classes[y]) and _linked(rows.sets[x], rows.sets[y], percent):
                forest.join(classes[x], classes[y])
                out.append((int(rows.cls[x]), int(rows.cls[y])))
    return out


def _linker(key: list[str], percent: int, crossed: bool) -> Callable:
    def run(batches):
        for table in runs(batches, key):
            links = link_group(_Rows(table), percent, crossed)
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links(rows: DataFrame, key: list[str], percent: int, crossed: bool) -> DataFrame:
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_linker(key, percent, crossed), "u long, v long")


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """`df` joined with the table `ids` (doc_id, ...): broadcast if its counted size allows, else by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, "doc_id", how)


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Near-duplicate classes of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their
    sets of distinct `shingle`-word shingles (ASCII case folded, words divided
    by ASCII white space; a text with fewer words is one shingle). component_id
    is the smallest doc_id reachable over links, kept marks that document.
    Null and empty texts have no shingles and are linked with nothing. Rows
    that repeat a doc_id count as one document. A null doc_id is linked with
    nothing and kept; its component_id is null. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    features = scratch.save(source.mapInArrow(_features(shingle), "doc_id long, n_shingles long, print binary, keys array<long>"), "features")
    firsts = scratch.save(features.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id")), "firsts")
    posted = features.where("doc_id is not null").join(firsts, ["doc_id", "print"], "left_semi").select("doc_id", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    merged = (
        posted.join(shared, "key")
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("live"))
        .where(F.size("live") >= MATCHES)
        .select("doc_id", F.explode(F.slice("live", F.lit(1), F.size("live") - (MATCHES - 1))).alias("x"))
        .select("doc_id", F.col("x.key").alias("key"))
    )
    merged = scratch.save(merged, "merged")
    stars = merged.join(merged.groupBy("key").agg(F.min("doc_id").alias("v")), "key").select(F.col("doc_id").alias("u"), "v").where("u != v").distinct()
    family = components(stars, scratch, "family").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sized = family.join(family.groupBy("family").agg(F.count("*").alias("size")), "family")
    sized = scratch.save(sized, "sized")
    sets = only(source, sized.select("doc_id").distinct()).mapInArrow(_members(shingle), "doc_id long, sig binary, members binary")
    chunks = F.ceil(F.col("size") / chunk).cast("long")
    member = scratch.save(
        sets.join(sized, "doc_id").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).withColumns({"cls": F.col("doc_id"), "side": F.lit(0)}), "member"
    )
    scratch.drop("merged")
    found = scratch.save(_links(member, ["family", "chunk"], percent, False), "links-1")
    wide = member.where("chunks > 1")
    if wide.limit(1).count():
        found = _across(wide, found, percent, scratch)
    graph = scratch.save(components(found, scratch, "final"), "graph").select(F.col("node").alias("first"), F.col("component").alias("component"))
    scratch.drop("member", "sized")
    named = firsts.select("print", F.col("doc_id").alias("first")).join(graph, "first", "left").select("print", F.coalesce("component", "first").alias("component"))
    out = features.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(wide: DataFrame, found: DataFrame, percent: int, scratch: Scratch, hubs: int = 64) -> DataFrame:
    """Links between the chunks of large families, added to the links `found` inside them.

    First every chunk is compared with a few hubs (one document of each of the
    family's largest classes), which joins the bulk of the family at linear
    cost. Then each document outside the family's largest class is a query
    against all chunks, in blocks; so no pair of different classes is left out.
    """
    spark = wide.sparkSession

    def known(links: DataFrame, name: str) -> DataFrame:
        graph = scratch.save(components(links, scratch, name), f"{name}-graph").select(F.col("node").alias("doc_id"), F.col("component").alias("now"))
        return wide.drop("cls").join(graph, "doc_id", "left").withColumn("cls", F.coalesce("now", "doc_id")).drop("now")

    from pyspark.sql import Window

    rows = scratch.save(known(found, "round-1"), "rows-1")
    sizes = rows.groupBy("family", "cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max("chunks").alias("chunks"))
    rank = Window.partitionBy("family").orderBy(F.desc("n"), "cls")
    top = sizes.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= hubs).select("doc_id", "r")
    hub = rows.join(top.select("doc_id"), "doc_id", "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1))
    found = scratch.save(found.unionByName(_links(rows.unionByName(hub), ["family", "chunk"], percent, True)), "links-2")

    rows = scratch.save(known(found, "round-2"), "rows-2")
    sizes = rows.groupBy("family", "cls").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("cls", "n").alias("largest"), F.sum("n").alias("size"), F.max("n").alias("n"))
    largest = largest.withColumn("blocks", F.ceil((F.col("size") - F.col("n")) / CHUNK).cast("long")).where("blocks > 0").select("family", "largest", "blocks")
    rows = rows.join(largest, "family")
    queries = rows.where("cls != largest").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")))
    queries = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1))
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = each.unionByName(queries)
    return scratch.save(found.unionByName(_links(dealt, ["family", "chunk", "block"], percent, True)), "links-3")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each near-duplicate class, all columns; rows that repeat a doc_id stay once."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(classes(docs, shingle, percent), "classes")
    gone = scratch.save(made.where("not kept").select("doc_id").distinct(), "gone")
    twice = scratch.save(made.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.limit(1).count():
        docs = only(docs, twice, "left_anti").unionByName(only(docs, twice).dropDuplicates(["doc_id"]))
    return only(docs, gone, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: The classes of 4-word shingles at 80 percent, by all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT p, q FROM c JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.q FROM reach JOIN link ON reach.r = link.p),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""
