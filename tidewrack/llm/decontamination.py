"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item is contained in a document if at least PERCENT of the item's distinct
word shingles occur there. Item and document differ in size by orders of
magnitude, where a fixed MinHash signature of the document would say nothing
about a short item. So items are partitioned by size, and each has its own
sketch: the k smallest shingle hashes, with k = n - least + 1 for n shingles of
which `least` must occur. Of any `least` shingles one is in the sketch, so the
search misses nothing. A document posts only hashes up to the largest sketch
hash of the size partitions whose items it has room for. Candidates are
verified by the words of all their shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

SHINGLE, PERCENT = 5, 80
#: Rows of item sketches (32 bytes each), document ids of candidates and bytes of item shingles that are broadcast at most.
BROADCAST_ROWS, BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 1_000_000, 1 << 24


# Fixed scripts written without spaces: each letter is a word.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_CLASS = "".join(rf"\p{{Is{x}}}" for x in UNSPACED)
WORD = rf"[{_CLASS}&&[\p{{L}}\p{{N}}]]|[\p{{L}}\p{{N}}&&[^{_CLASS}]]+"
#: Words below which a text matches only as a whole.
PHRASE = 3


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; single letters in scripts without spaces."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def windows(name: str, sizes: list[int], one: Callable[[int, Column], Column], kind: str) -> Column:
    """The windows of each of `sizes` elements of the array `name`, as `one` makes them; below PHRASE only of a whole array."""
    n, none, made = F.size(name), F.array().cast(f"array<{kind}>"), []
    for k in sizes:
        fits = n >= k if k >= PHRASE else n == k
        made.append(F.when(fits, F.transform(F.sequence(F.lit(0), n - k), partial(one, k))).otherwise(none))
    return F.concat(*made) if len(made) > 1 else made[0] if made else none


def hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Add h, the hashes of the shingles of t of the given sizes, and room, their number."""
    df = df.withColumn("w", words(F.col("t"))).withColumn("v", F.transform("w", lambda x: F.xxhash64(x))).drop("w")
    made = windows("v", sizes, lambda k, i: F.xxhash64(*(F.get("v", i + j) for j in range(k))), "bigint")
    return df.withColumn("h", made).drop("v").withColumn("room", F.size("h"))


def shingles(df: DataFrame, name: str, sizes: list[int] | None, size: int) -> DataFrame:
    """Add `name`, the distinct shingles of t as texts: of the given sizes, or else of `size` words and of the whole text if it has fewer."""
    df = df.withColumn("w", words(F.col("t")))
    text = lambda k, i: F.concat_ws(" ", *(F.get("w", i + j) for j in range(k)))
    if sizes is None:
        few = F.when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
        made = F.when(F.size("w") >= size, windows("w", [size], text, "string")).otherwise(few)
    else:
        made = windows("w", sizes, text, "string")
    return df.withColumn(name, F.array_distinct(made)).drop("w")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows allow."""
    return F.broadcast(df) if df.count() <= most else df


def contained(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Items of `benchmark` (item_id, text) inside `docs` (doc_id, text).

    Returns a row for each pair with 100 * common >= percent * item_shingles:
    doc_id, item_id, item_shingles, common, containment. Words are lower-cased
    runs of letters and digits, so white space and punctuation do not matter,
    and single letters in scripts without spaces. An item of fewer than `size`
    words is one shingle, its whole word sequence: it is found wherever these
    words follow each other, one of fewer than PHRASE words only where they are
    all of a document's words. Texts without words, null ones among them, match
    nothing, nor do null ids. Rows that repeat a doc_id are each looked at and
    the best counts; rows that repeat an item_id are one item with the shingles
    of all. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    least = lambda n: F.ceil(n * percent / 100).cast("int")
    items = shingles(benchmark.where("item_id is not null").select("item_id", text_of().alias("t")), "s", None, size)
    items = items.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")).where(F.size("s") > 0)
    items = scratch.save(items.select("item_id", F.size("s").alias("n"), "s"), "items")
    length = lambda x: F.size(F.split(x, " "))
    sizes = sorted(r[0] for r in items.select(F.explode(F.transform("s", length))).distinct().collect())  # 1 .. size
    hashed = F.transform("s", lambda x: F.coalesce(*(F.when(length(x) == k, F.xxhash64(*(F.xxhash64(F.get(F.split(x, " "), j)) for j in range(k)))) for k in range(1, size + 1))))
    sketch = items.select("item_id", F.floor(F.log2("n")).alias("part"), least(F.col("n")).alias("least"), F.explode(F.slice(F.array_sort(hashed), F.lit(1), F.col("n") - least(F.col("n")) + 1)).alias("x"))
    sketch = scratch.save(sketch, "sketch")
    # by size partition, a row each: the least room a document needs, and the largest hash that its sketches hold
    parts = sketch.groupBy("part").agg(F.min("least").alias("least"), F.max("x").alias("x")).orderBy("least").collect()
    reach = F.lit(None).cast("long")
    for k in range(len(parts)):
        reach = F.when(F.col("room") >= parts[k]["least"], F.lit(max(p["x"] for p in parts[: k + 1]))).otherwise(reach)

    source = docs.where("doc_id is not null").select("doc_id", text_of().alias("t"))
    # explode_outer: for explode the optimizer infers a filter on the array and would compute all hashes in it again
    posted = hashes(source, sizes).withColumn("reach", reach).select("doc_id", "room", F.explode_outer(F.filter("h", lambda x: x <= F.col("reach"))).alias("x"))
    found = posted.join(bounded(sketch.drop("part"), BROADCAST_ROWS), "x").where("room >= least").select("doc_id", "item_id").distinct()
    found = scratch.save(found, "candidates")
    ids = found.select("doc_id").distinct()
    texts = shingles(source.join(bounded(ids, BROADCAST_IDS), "doc_id", "left_semi"), "d", sizes, size).select("doc_id", "d")
    letters = items.agg(F.sum(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    pairs = found.join(F.broadcast(items) if letters <= BROADCAST_BYTES else items, "item_id").join(texts, "doc_id")
    matched = pairs.select("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), F.size(F.array_intersect("s", "d")).cast("long").alias("common"))
    enough = matched.groupBy("doc_id", "item_id").agg(F.first("item_shingles").alias("item_shingles"), F.max("common").alias("common"))
    return enough.where(100 * F.col("common") >= percent * F.col("item_shingles")).withColumn("containment", F.col("common") / F.col("item_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` without the documents that contain an item; rows with a null doc_id stay."""
    hit = contained(docs, benchmark, size, percent).select("doc_id").distinct()
    hit = Scratch(docs.sparkSession).save(hit, "hit")
    return docs.join(bounded(hit, BROADCAST_IDS), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d
       UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) FROM d
       UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM d
       UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
bs AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b
       UNION SELECT item_id, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS common, count(*) / item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""
