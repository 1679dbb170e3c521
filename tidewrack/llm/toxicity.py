"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents is indexed with all its terms; inverse
document frequencies are counted over all documents. A query adds up the
postings of all its terms in the blocks of examples whose bounds can reach its
nearest, so its neighbours are exact. They vote with weights
that fall with distance. A second vote is that of the nearest examples by the
telling terms alone: those whose document frequency differs between the
classes beyond chance (likelihood ratio, corrected for the number of terms
tried) and by a real factor, which few toxic words in a long text would
otherwise not outweigh. Leave-one-out votes of the examples calibrate the
score from both.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, small_batches, text_of

#: Labelled examples of each class that the index holds at most: the bounded sample of the fit.
EXAMPLES = 4096
#: LIFT: factor by which a telling term's share of all words must differ between the classes, in either direction, so that
#: common words do not count as telling because the texts of a class are longer.
LIFT = 3.0
#: SURE: terms of no class that may be taken for telling, of all terms tried, in expectation.
NEIGHBOURS, SURE = 16, 1.0
#: Examples of a block (NEIGHBOURS at least); blocks scored first; examples that make a term common; groups of common terms.
BLOCK, SEEDS, COMMON, GROUPS = 64, 8, 192, 8
#: Blocks multiplied at once, by the common terms that they and the texts hold.
SPAN = 4
#: Texts scored together.
BATCH = 256
#: Added to a distance before it is inverted, and the votes of the prior.
FLOOR, PRIOR_VOTES = 0.05, 0.5


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of the term, tf) of every distinct term of each text, in order; the terms that the numbers stand for, sorted."""
    words = K.Words(data, offsets, K.PUNCTUATION)
    names, number = np.unique(words.hashes.view(np.int64), return_inverse=True)
    key = np.repeat(np.arange(len(offsets) - 1) * len(names), np.diff(words.first)) + number
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    doc, number = np.divmod(key[at], max(len(names), 1))
    return doc, number, np.diff(at, append=len(key)), names


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, term, tf of every text."""
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for i, j in K.blocks(offsets):
            d, number, tf, names = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = batch.column(0).slice(i, j - i).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[number]), pa.array(tf.astype(np.int64))], names=["doc_id", "term", "tf"])


def _spread(terms: np.ndarray) -> Callable:
    """at, df: texts that hold each of `terms` (sorted), and the number of all texts at len(terms); a partial count a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            data, offsets = K.flat(batch.column(0))
            df[-1] += batch.num_rows
            for i, j in K.blocks(offsets):
                _, number, _, names = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.minimum(np.searchsorted(terms, names), len(terms) - 1)
                hit = terms[at] == names
                df[at[hit]] += np.bincount(number, minlength=len(names))[hit]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    return run


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members of all ranges start[i]:end[i], sizes of the ranges)."""
    size = end - start
    members = np.repeat(start - (np.cumsum(size) - size), size)
    members += np.arange(len(members))
    return members, size


def grouped(term: np.ndarray, example: np.ndarray, value: np.ndarray, terms: int, examples: int, sample: int = 512) -> np.ndarray:
    """Group of each common term: terms of the same examples together, by k-means over an even sample of examples."""
    if not terms:
        return np.zeros(0, np.int64)
    chosen = np.full(examples, -1)
    chosen[np.linspace(0, examples - 1, min(sample, examples)).astype(int)] = 0
    chosen[chosen == 0] = np.arange((chosen == 0).sum())
    x = np.zeros((terms, sample))
    held = chosen[example] >= 0
    x[term[held], chosen[example[held]]] = value[held]
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    centres = x[np.linspace(0, terms - 1, GROUPS).astype(int)]
    for _ in range(6):
        at = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[at == g].sum(0) if (at == g).any() else centres[g] for g in range(GROUPS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return at


@dataclass
class Index:
    """Block-max inverted index of the examples' unit vectors, and the calibrated vote."""

    terms: np.ndarray  # sorted term hashes
    idf: np.ndarray
    ids: np.ndarray  # doc_id of each example, in index order
    toxic: np.ndarray
    weight: np.ndarray  # documents that an example stands for
    vectors: list[tuple[np.ndarray, np.ndarray]]  # (term numbers, weights)
    none: float  # score of a text without any of the terms
    slopes: tuple[float, ...] = (1.0,)
    shift: float = 0.0
    #: The same examples by their telling terms alone; examples without any are left to the other vote.
    telling: Index | None = None
    #: Example at each position, and position of each example: alike ones stand together, BLOCK to a block.
    at: np.ndarray | None = None
    place: np.ndarray | None = None
    #: Postings by term: those of term t are first[t]:first[t + 1].
    first: np.ndarray | None = None
    position: np.ndarray | None = None
    value: np.ndarray | None = None
    common: np.ndarray | None = None  # number among the common terms, -1 for a rare term
    group: np.ndarray | None = None  # group of each common term
    most: np.ndarray | None = None  # by block: the largest norm of an example over the terms of each group
    #: Made where it is needed: weights of common terms by block, example and term; terms and weights by position.
    made: tuple[np.ndarray, ...] | None = None

    def build(self) -> Index:
        n, sizes = len(self.vectors), np.array([len(t) for t, _ in self.vectors], dtype=np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.vectors)])
        value = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        example = np.repeat(np.arange(n), sizes)
        often = np.flatnonzero(np.bincount(term, minlength=len(self.terms)) >= COMMON)
        self.common = np.full(len(self.terms), -1, np.int32)
        self.common[often] = np.arange(len(often))
        among = self.common[term] >= 0
        self.group = grouped(self.common[term[among]], example[among], value[among], len(often), n)
        norms = np.sqrt(np.bincount(example[among] * GROUPS + self.group[self.common[term[among]]], value[among] ** 2, n * GROUPS).reshape(n, GROUPS))
        self.at = np.lexsort((sizes, norms.argmax(1))) if n else np.zeros(0, np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.at] = np.arange(n)
        blocks = np.arange(-(-n // BLOCK) + 1) * BLOCK
        self.most = np.maximum.reduceat(norms[self.at], blocks[:-1]) if n else np.zeros((0, GROUPS))
        order = np.argsort(term, kind="stable")
        term, self.position, self.value = term[order], self.place[example][order].astype(np.int32), value[order]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1)).astype(np.int32)
        return self

    def forward(self) -> tuple[np.ndarray, ...]:
        """(`first` and `position` in whole words; weights of common terms by term and position in single precision, whether a run of SPAN blocks holds each; first, number, value of each position's common terms)."""
        if self.made is None:
            number, width = np.repeat(self.common, np.diff(self.first)), len(self.most) * BLOCK
            among = np.flatnonzero(number >= 0)
            number, position, value = number[among].astype(np.int64), self.position[among], self.value[among]
            dense = np.zeros((len(self.group), width), np.float32)
            dense[number, position] = value
            filled = np.zeros((-(-width // (SPAN * BLOCK)), len(self.group)), dtype=bool)
            filled[position // (SPAN * BLOCK), number] = True
            order = np.argsort(position, kind="stable")
            self.made = (self.first.astype(np.int64), self.position.astype(np.int64), dense, filled, np.searchsorted(position[order], np.arange(width + 1)), number[order], value[order])
        return self.made

    def vector(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[term]
        return term, w / np.sqrt((w * w).sum())

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (examples, cosines) of the NEIGHBOURS nearest with a common term, but for the example `without`.

        Ties go to the earlier example. Texts of one main group of terms are
        scored together, since they leave out the same blocks.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        if len(self.ids):
            norms = np.array([np.bincount(self.group[c[c >= 0]], w[c >= 0] ** 2, GROUPS) for c, w in ((self.common[t], w) for t, w in texts)])
            main = norms.argmax(1)
            for g in np.unique(main).tolist():
                some = np.flatnonzero(main == g).tolist()
                for k, found in zip(some, self._near([texts[k] for k in some], np.sqrt(norms[some]), [without[k] for k in some]), strict=True):
                    out[k] = found
        return out

    def _near(self, texts: list[tuple[np.ndarray, np.ndarray]], norms: np.ndarray, without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rare terms are added up in full. What the common ones can add in a
        block is bounded by the norms of their groups (Cauchy and Schwarz), at
        the block's largest. The blocks with the highest bounds give the last
        of the nearest so far; only blocks whose bounds reach it, and the rest
        of their runs of SPAN, are scored then. Scores of common terms are
        products in single precision, over the terms that both the texts and
        the run hold; for all examples within their error of the last of the
        nearest the common terms are added up again in double precision.
        """
        first, position, dense, filled, start, numbers, values = self.forward()
        blocks, width = len(self.most), dense.shape[1]
        rare, q = np.zeros((len(texts), width)), np.zeros((len(texts), len(self.group)))
        for k, (term, weight) in enumerate(texts):
            number = self.common[term]
            few = number < 0
            post, size = spread(first[term[few]], first[term[few] + 1])
            rare[k] = np.bincount(position.take(post), self.value.take(post) * np.repeat(weight[few], size), width)
            q[k, number[~few]] = weight[~few]
        used, single = q.any(0), q.astype(np.float32)
        # of unit vectors, for as many products as a text has common terms and the sum with the rare ones; the rest add exact zeros
        error = 2 * (int((q > 0).sum(1).max()) + 8) * 2.0**-24
        bound = rare.reshape(len(texts), blocks, BLOCK).max(2) + norms @ self.most.T + error
        score = np.zeros((len(texts), width), np.float32)
        scored, least = np.zeros(blocks, dtype=bool), np.zeros(len(texts))
        now = np.zeros(blocks, dtype=bool)
        now[np.argsort(-bound, axis=1, kind="stable")[:, :SEEDS]] = True
        while now.any():
            due = np.logical_or.reduceat(now, np.arange(0, blocks, SPAN))
            for r in np.flatnonzero(due).tolist():
                part, some = slice(r * SPAN * BLOCK, (r + 1) * SPAN * BLOCK), np.flatnonzero(filled[r] & used)
                score[:, part] = single[:, some] @ dense[some, part] + rare[:, part]
            scored |= np.repeat(due, SPAN)[:blocks]
            held = score if scored.all() else score.reshape(len(texts), blocks, BLOCK)[:, scored].reshape(len(texts), -1)
            for k, x in enumerate(without):
                if x >= 0:
                    held[k, held_place(self.place[x], scored)] = 0
            least = np.partition(held, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS].astype(np.float64) if held.shape[1] >= NEIGHBOURS else least
            now = (bound > np.maximum(least - error, 0)[:, None]).any(0) & ~scored
        names = (np.flatnonzero(scored)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        for k in range(len(texts)):
            place = names[np.flatnonzero(held[k] > max(least[k] - error, 0))]
            post, size = spread(start[place], start[place + 1])
            near = np.round(rare[k, place] + np.bincount(np.repeat(np.arange(len(place)), size), values.take(post) * q[k].take(numbers.take(post)), len(place)), 12)
            found = self.at[place]
            best = np.lexsort((found, -near))[:NEIGHBOURS]
            yield found[best], near[best]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Logit of the distance-weighted share of toxic neighbours."""
        w = self.weight[found] / (FLOOR + np.maximum(1 - cosines, 0))
        unit = self.weight.mean() / (FLOOR + 0.5)
        share = ((w * self.toxic[found]).sum() + PRIOR_VOTES * unit * self.none) / (w.sum() + PRIOR_VOTES * unit)
        share = min(max(share, 1e-4), 1 - 1e-4)
        return math.log(share / (1 - share))

    def score(self, votes: tuple[float, ...]) -> float:
        total = sum(a * x for a, x in zip(self.slopes, votes, strict=True)) + self.shift
        return 1 / (1 + math.exp(-max(min(total, 30), -30)))

    def known(self, doc: np.ndarray, number: np.ndarray, tf: np.ndarray, names: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The unit vectors of texts 0 to n - 1 of terms names[number]; empty without a term of the index."""
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        hit = np.flatnonzero((self.terms[at] == names)[number])
        at, doc = at[number[hit]], doc[hit]
        w = (1 + np.log(tf[hit])) * self.idf[at]
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc]
        edge = np.searchsorted(doc, np.arange(n + 1)).tolist()
        return [(at[i:j], w[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def judge(self, doc: np.ndarray, number: np.ndarray, tf: np.ndarray, names: np.ndarray, n: int, without: list[int | None] | None = None) -> Iterator[tuple[tuple[float, float], np.ndarray, np.ndarray]]:
        """For each of n texts, as `known` takes them: (votes by all and by telling terms, nearest examples by all terms, cosines); `without` the example of that doc_id."""
        without = without or [None] * n
        near = []
        for index in (self, self.telling):
            at = [-1 if x is None else int(np.searchsorted(index.ids, x)) for x in without]
            at = [a if 0 <= a < len(index.ids) and index.ids[a] == x else -1 for a, x in zip(at, without, strict=True)]
            near.append((index, index.nearest(index.known(doc, number, tf, names, n), at)))
        for k in range(n):
            votes = tuple(index.vote(*n[k]) if len(n[k][0]) else math.log(index.none / (1 - index.none)) for index, n in near)
            yield votes, *near[0][1][k]


def held_place(place: int, scored: np.ndarray) -> int | slice:
    """Where the position stands among those of the scored blocks; nowhere if its block is not scored."""
    block = place // BLOCK
    return int(scored[:block].sum()) * BLOCK + int(place) % BLOCK if scored[block] else slice(0, 0)


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of a weighted logistic fit of [example, vote] (Newton steps, slightly damped towards the mean vote)."""
    k = votes.shape[1]
    start = np.append(np.full(k, 1 / k), 0.0)
    a, x = start, np.column_stack([votes, np.ones(len(votes))])
    w = weight / max(weight.mean(), 1e-12)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (w * (p - toxic)) + a - start
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(k + 1)
        a = a - np.linalg.solve(h, g)
    return tuple(max(float(y), 0.05) for y in a[:-1]), float(a[-1])


def telling(number: np.ndarray, tf: np.ndarray, doc: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """Of the `terms` terms, those that tell the classes apart; term number, count and example of each posting."""
    y = toxic[doc].astype(bool)
    n = [float((toxic == k).sum()) for k in (0, 1)]
    seen = [np.bincount(number[y == k], minlength=terms).astype(float) for k in (0, 1)]
    said = [np.bincount(number[y == k], tf[y == k], terms) for k in (0, 1)]
    lift = (said[1] + 0.5) / (said[0] + 0.5) * (said[0].sum() + 1) / (said[1].sum() + 1)
    both, ratio = seen[0] + seen[1], np.zeros(terms)
    for k in (0, 1):
        for here, share in ((seen[k], both), (n[k] - seen[k], sum(n) - both)):
            expected = share * n[k] / sum(n)
            some = (here > 0) & (expected > 0)
            ratio[some] += 2 * here[some] * np.log(here[some] / expected[some])
    return np.flatnonzero((ratio >= 2 * math.log(max(terms, 1) / SURE)) & ((lift >= LIFT) | (lift <= 1 / LIFT)))


@dataclass
class Fitted:
    """A pickled index, broadcast, and its calibration; without a blob the index is empty and its score 0."""

    blob: Broadcast | None = None
    slopes: tuple[float, ...] = (1.0,)
    shift: float = 0.0

    def load(self) -> Index:
        if self.blob is None:
            return Index(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [], 0.0)
        index = pickle.loads(self.blob.value)
        index.slopes, index.shift = self.slopes, self.shift
        return index


#: Rows of the task that builds the index, by kind: term counts (doc_id, term, tf), document frequencies (at, df) and labels (doc_id, y).
COUNTS, SPREAD, LABELS = 0, 1, 2
#: Bytes of a row of the pickled index.
CHUNK = 4 << 20


def _rows(df: DataFrame, kind: int, *columns: str) -> DataFrame:
    names = [*columns, *["0"] * (3 - len(columns))]
    return df.select(F.lit(kind).alias("kind"), *(F.expr(f"cast({n} as long)").alias(a) for n, a in zip(names, "abc", strict=True)))


def _index(total: dict[int, int]) -> Callable:
    """n, part: the pickled index over all examples, made in one task; total: labels of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[list[np.ndarray]]] = [[], [], []]
        for batch in batches:
            kind, *columns = (c.to_numpy() for c in batch.columns)
            for k in np.unique(kind).tolist():
                held[k].append([c[kind == k] for c in columns])
        if not held[COUNTS]:
            return
        (held_ids, held_terms, counts), (at, seen, _), (chosen, y, _) = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in held)
        held.clear()
        order = np.lexsort((held_terms, held_ids))
        held_ids, held_terms, counts = held_ids[order], held_terms[order], counts[order]
        names, number = np.unique(held_terms, return_inverse=True)
        df = np.zeros(len(names) + 1)
        df[at] = seen
        idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
        ids, doc = np.unique(held_ids, return_inverse=True)
        order = np.argsort(chosen)
        toxic = y[order][np.searchsorted(chosen[order], ids)].astype(np.float64)
        rate = total.get(1, 0) / sum(total.values())
        weight = weights(toxic, total)

        def over(kept: np.ndarray) -> Index:
            """Index of the examples by the terms `kept` (sorted numbers)."""
            place = np.full(len(names), -1)
            place[kept] = np.arange(len(kept))
            at = np.flatnonzero(place[number] >= 0)
            held, first = np.unique(doc[at], return_index=True)
            left = np.ones(len(ids), dtype=bool)
            left[held] = False
            none = ((weight * toxic)[left].sum() + 0.5 * rate) / (weight[left].sum() + 0.5)
            index = Index(names[kept], idf[kept], ids[held], toxic[held], weight[held], [], min(max(none, 1e-4), 1 - 1e-4))
            index.vectors = [index.vector(place[number[x]], counts[x]) for x in np.split(at, first[1:])] if len(held) else []
            index.build()
            index.vectors = []
            return index

        index = over(np.arange(len(names)))
        index.telling = over(telling(number, counts, doc, toxic, len(names)))
        blob = pickle.dumps(index, pickle.HIGHEST_PROTOCOL)
        for n in range(0, len(blob), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([blob[n : n + CHUNK]], pa.binary())], names=["n", "part"])

    return run


def weights(toxic: np.ndarray, total: dict[int, int]) -> np.ndarray:
    """Labelled documents that each example stands for."""
    stands = np.array([total.get(y, 0) / max((toxic == y).sum(), 1) for y in (0, 1)])
    return stands[toxic.astype(np.int64)]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Fitted | None:
    """Index of at most `examples` of each class of `labels` (doc_id, toxic) with their texts in `docs`.

    Null labels, ids and ids with labels of both kinds are left out; repeated
    rows count once. None without an example. An executor builds the index; the
    driver holds its distinct terms, then its bytes until they are broadcast.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z")
    marked = scratch.save(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")), "marked")
    total = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not total:
        return None
    chosen = marked.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).unionByName(marked.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    chosen = scratch.save(chosen, "chosen")  # 2 * examples rows at most
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    tf = source.mapInArrow(_counts, "doc_id long, term long, tf long").groupBy("doc_id", "term").agg(F.max("tf").alias("tf"))
    tf = scratch.save(tf, "tf")  # the terms of 2 * examples texts
    names = np.sort(tf.select("term").distinct().toArrow().column(0).to_numpy())
    if not len(names):
        return None
    spread = docs.select(text_of().alias("text")).mapInArrow(_spread(names), "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    spread = scratch.save(spread, "spread")
    del names
    rows = _rows(tf, COUNTS, "doc_id", "term", "tf").unionByName(_rows(spread, SPREAD, "at", "df")).unionByName(_rows(chosen, LABELS, "doc_id", "y"))
    made = scratch.save(rows.coalesce(1).mapInArrow(_index(total), "n long, part binary"), "index")
    parts = made.toArrow().sort_by("n").column("part")
    blob = docs.sparkSession.sparkContext.broadcast(b"".join(memoryview(x.as_buffer()) for x in parts))
    del parts
    pa.default_memory_pool().release_unused()
    # leave-one-out votes of 2 * examples rows
    votes = source.mapInArrow(_votes(Fitted(blob)), "doc_id long, near double, telling double").groupBy("doc_id").agg(F.avg("near").alias("near"), F.avg("telling").alias("telling"))
    voted = votes.join(F.broadcast(chosen), "doc_id").toArrow()
    toxic = voted["y"].to_numpy().astype(np.float64)
    slopes, shift = calibrate(np.stack([voted[c].to_numpy() for c in ("near", "telling")], axis=1), toxic, weights(toxic, total))
    scratch.drop("marked", "tf", "spread", "index")
    return Fitted(blob, slopes, shift)


def _judged(index: Index, data: np.ndarray, offsets: np.ndarray, without: list | None = None) -> Iterator[tuple]:
    """`Index.judge` of every text of a batch, in order."""
    for i, j in K.blocks(offsets):
        doc, number, tf, names = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(i, j, BATCH):
            end = min(k + BATCH, j)
            a, b = np.searchsorted(doc, (k - i, end - i)).tolist()
            yield from index.judge(doc[a:b] - (k - i), number[a:b], tf[a:b], names, end - k, without and without[k:end])


def _votes(fitted: Fitted) -> Callable:
    """doc_id and the votes on each example without itself; documents without a term are no examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = fitted.load()
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), index.ids)))
            votes = [v for v, *_ in _judged(index, *K.flat(batch.column(1)), batch.column(0).to_pylist())]
            if votes:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in zip(*votes, strict=True))], names=["doc_id", "near", "telling"])

    return run


def _scores(fitted: Fitted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = fitted.load()
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            score = np.full(batch.num_rows, index.none)
            evidence: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            judged = _judged(index, data, offsets) if len(index.terms) else ()
            for d, (votes, found, cosines) in enumerate(judged):
                if len(found):
                    score[d] = index.score(votes)
                    evidence[d] = [{"doc_id": int(index.ids[f]), "toxic": int(index.toxic[f]), "cosine": float(c)} for f, c in zip(found[:3], cosines[:3], strict=True)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != 1), pa.array(score), pa.array(evidence, kind)], names=[*(n for k, n in enumerate(batch.schema.names) if k != 1), "score", "evidence"])

    return run


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the doc_id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def scored(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for every row of `docs` (doc_id, text).

    Examples are rows of `labels` that may be learned from, with their texts in
    `source` (`docs` unless given). score is a calibrated probability in 0..1;
    texts without any term of the examples, null and empty ones among them,
    get the rate of all labels. evidence lists the three nearest
    examples. Repeated rows are scored each, a null doc_id stays null and is
    not held out. Without labels every score is 0; an empty table gives no rows.
    """
    fitted = fit(source or docs, learnable(labels)) or Fitted()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    made = rows.mapInArrow(_scores(fitted), "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with all their columns; every row is judged by its own text."""
    fitted = fit(docs, learnable(labels))
    if fitted is None:
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, text_of().alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(_scores(fitted), f"row {kind}, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    return made.where("score < 0.5").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
