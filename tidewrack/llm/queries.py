"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """The vocabulary the packing query uses; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained

    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import strip

    return strip(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=200)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import classes

    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import classes

    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import fit, parse, transcripts

    raw = transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return parse(raw, fit(raw))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _oracles() -> None:
    from . import decontamination, near_duplicates

    ORACLE_SQL["op1_benchmark_decontamination"] = decontamination.ORACLE
    ORACLE_SQL["op6_near_duplicates"] = near_duplicates.ORACLE


_oracles()
