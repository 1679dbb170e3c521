"""Language identification of web pages by Bayesian evidence fusion.

The posterior of a page multiplies the likelihood of its visible text under
character trigram models, the likelihoods of the declared markup language and
of the address suffix, and a prior of its host. Host priors are counts of text
decisions, smoothed towards the registered domain and that towards all pages;
the likelihoods of declarations and suffixes are counted the same way. All
counts are grouped aggregates over all pages; what a page adds to them itself
is taken out again before it is judged, so its text counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, small_batches, text_of

#: Labelled documents of each language that a fit uses at most, and trigram cells.
EXAMPLES, CELLS = 2000, 1 << 14
#: Trigrams of a page count as this many independent ones at most; weights of the levels of a host prior.
INDEPENDENT, KAPPA = 40.0, 5.0

HIDDEN = regex.compile(r"(?is)<!--.*?(?:-->|\z)|<(script|style|nav|noscript|template)\b.*?(?:</\1\s*>|\z)")
TAG = regex.compile(r"(?s)<[^>]*>")
ENTITY = regex.compile(r"&#?\w+;")


def visible(html: str) -> str:
    """Text of a page without markup, scripts, styles and navigation."""
    return ENTITY.sub(" ", TAG.sub(" ", HIDDEN.sub(" ", html)))


def cells(data: np.ndarray) -> np.ndarray:
    """Cell of each byte trigram; digits and punctuation count as one space."""
    folded = FOLD[data]
    if len(folded) < 3:
        return np.zeros(0, np.int64)
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    x = folded[keep].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    return (K.mix(x[:-2] << K.U(16) | x[1:-1] << K.U(8) | x[2:]) % K.U(CELLS)).astype(np.int64)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[K.PUNCTUATION] = 32
FOLD[48:58] = 32
FOLD[65:91] += 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for k, lang in enumerate(batch.column(0).to_pylist()):
            total.setdefault(lang, np.zeros(CELLS, np.int64))
            total[lang] += np.bincount(cells(data[offsets[k] : offsets[k + 1]]), minlength=CELLS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "cell", "n"])


def fit(documents: DataFrame, examples: int = EXAMPLES) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods [cell, language]) from at most `examples` labelled documents of each."""
    scratch = Scratch(documents.sparkSession)
    rows = documents.where("lang is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), "doc_id")
    shares = scratch.save(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(examples)) / F.count("*")).alias("share")), "shares")
    names = sorted(r["lang"] for r in shares.collect())  # a row a language
    if not names:
        return [], np.zeros((CELLS, 0))
    # a hash of the id below the language's share: a bounded sample without a sort
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    counted = documents.select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"), "doc_id").join(F.broadcast(shares), "lang").where(inside).select("lang", "text").mapInArrow(_count, "lang string, cell long, n long")
    counted = scratch.save(counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "cells")
    place = {x: k for k, x in enumerate(names)}
    out = np.full((CELLS, len(names)), 0.5)
    for r in counted.toLocalIterator():  # CELLS rows a language at most
        out[r["cell"], place[r["lang"]]] += r["n"]
    scratch.drop("shares", "cells")
    return names, np.log(out / out.sum(0))


def _evidence(names: list[str], model: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, top = [], []
            for html in batch.column(1):
                at = cells(np.frombuffer(visible(html.as_py()).encode(), np.uint8))
                ll = model[at].sum(0) if len(at) else np.zeros(len(names))
                ll = ll * min(1.0, INDEPENDENT / max(len(at), 1))
                scores.append((ll - ll.max() if len(ll) else ll).tolist())
                top.append(names[int(np.argmax(ll))] if len(at) and len(ll) else None)
            keep = [k for k in range(batch.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, pa.list_(pa.float64())), pa.array(top, pa.string())], names=[*(batch.schema.names[k] for k in keep), "ll", "text_lang"])

    return run


#: Fixed second-level labels under which countries register domains.
SECOND = r"\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}$"


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain, suffix) of a URL, lower-cased; empty if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    domain = F.when(host.rlike(SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return host, domain, F.substring_index(host, ".", -1)


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Language of each of `pages` (page_id, url, html), learned from `documents` (doc_id, text, lang).

    Returns page_id, lang, posterior, text_lang (by the text alone) and
    declared. Evidence that is missing (null or empty html, no declaration)
    leaves the posterior as it is; a page without host has the prior of all pages. Repeated rows are judged each, a null
    page_id stays null; without labelled documents lang is null.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession)
    names, model = fit(documents)
    url, html = text_of("url"), text_of("html")
    host, domain, suffix = address(url)
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared.alias("declared"))
    kinds = "page_id long, host string, domain string, suffix string, declared string, ll array<double>, text_lang string"
    seen = scratch.save(rows.mapInArrow(_evidence(names, model), kinds), "evidence")
    if not names:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), "text_lang", "declared")
    L = len(names)

    def counts(*by: str) -> DataFrame:
        each = [F.count(F.when(F.col("text_lang") == x, 1)).cast("double") for x in names]
        return seen.groupBy(*by).agg(F.array(*each).alias("n"))

    total = [float(x) for x in counts().first()["n"]]
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    domains = counts("domain").select("domain", F.col("n").alias("in_domain"))
    hosts = counts("host", "domain").where("host != ''").select("host", "domain", F.col("n").alias("in_host")).join(domains, "domain").drop("domain")
    hosts = scratch.save(hosts.withColumns({"hosts": sums(F.col("in_host")), "domains": sums(F.col("in_domain"))}), "hosts")
    # values of a markup attribute or suffix are counted before they are broadcast
    marks, ends = (scratch.save(counts(x).where(F.col(x) != "").select(x, F.col("n").alias(f"of_{x}")), f"of-{x}") for x in ("declared", "suffix"))
    small = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    joined = seen.join(small(hosts), "host", "left").join(small(marks), "declared", "left").join(small(ends), "suffix", "left")
    joined = joined.withColumn("own", F.coalesce(F.array_position(F.array(*(F.lit(x) for x in names)), F.col("text_lang")) - 1, F.lit(-1)))
    every = F.array(*(F.lit(x) for x in total))
    one = F.when(F.col("own") >= 0, 1.0).otherwise(0.0)  # the page's own decision, taken out of all counts

    def step(i: Column) -> Column:
        less = lambda a: F.get(a, i) - F.when(F.col("own") == i, 1.0).otherwise(0.0)
        base = (less(every) + 1) / (sum(total) - one + L)
        above = (less(F.col("in_domain")) + KAPPA * base) / (F.col("domains") - one + KAPPA)
        prior = F.coalesce((less(F.col("in_host")) + KAPPA * above) / (F.col("hosts") - one + KAPPA), base)
        said = lambda a: F.coalesce((less(F.col(a)) + base) / (less(every) + 1), F.lit(1.0))
        return F.get(F.col("ll"), i) + F.log(prior) + F.log(said("of_declared")) + F.log(said("of_suffix"))

    log = joined.withColumn("log", F.transform(F.sequence(F.lit(0), F.lit(L - 1)), step))
    log = log.withColumn("p", F.transform("log", lambda x: F.exp(x - F.array_max("log"))))
    best = F.array_position(F.col("log"), F.array_max("log")).cast("int")
    return log.select("page_id", F.get(F.array(*(F.lit(x) for x in names)), best - 1).alias("lang"), (F.array_max("p") / sums(F.col("p"))).alias("posterior"), "text_lang", "declared")
