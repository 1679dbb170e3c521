"""The pipeline against what its stages' brute forces keep, and the registry."""

from __future__ import annotations

import corpus_pipeline

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert ids >= kept["toxicity"] >= kept["near_duplicates"] > kept["decontamination"] == kept["secrets"] == kept["packing"]
    run = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()}


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_containment_matches_its_oracle(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    name = "op1_benchmark_decontamination"
    order = "doc_id, item_id, item_shingles, common"
    want = c.execute(f"SELECT {order} FROM ({entry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r) for r in entry.queries()[name](spark, SF).select(*order.split(", ")).collect()) == want
