"""The corpus pipeline: order, empty and odd rows, repeated rows. Its run is held to brute force in test_resemblance.py."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_output"]


def test_empty_corpus(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_and_nulls_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "seven words that no other document has", None, None, None), (10**6, None, "en", None, 0)], docs.schema)
    named = docs.unionAll(odd).selectExpr("*", "1 AS score", "2 AS component", "3 AS copies", "4 AS item", "5 AS fp", "6 AS digest", "7 AS id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        named = spark.createDataFrame(stage(spark, named, SF).collect(), named.schema)
        assert len(named.columns) == 12, name
        nulls = named.filter("doc_id is null").count()
        assert nulls == 1 or name == "mixing" and nulls in (0, 1, 2, 3), name  # the mix may take any document up to three times


def test_repeated_rows(spark, tmp_path):
    """Every row of the corpus twice: the near-duplicate stage leaves one of each, and the run is that of the corpus."""
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.unionAll(rows) if name == "documents" else rows).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
