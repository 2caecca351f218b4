"""The evaluation queries measure every item of a benchmark table, however many there are."""

from quirelake.plans.catalog import QUERIES

NAMES = ("ngram_coverage", "token_coverage", "word_recall")


def test_every_item_is_measured(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(120))
    spark.createDataFrame([(3 * k + 7, text if k == 44 else f"item {k} has a few words") for k in range(45)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, text) for k in range(90)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in NAMES}
    for name in ("ngram_coverage", "token_coverage"):
        assert {(r.doc_id, r.item_id) for r in rows[name]} == {(k, 3 * (k % 45) + 7) for k in range(90)}
    assert sorted(r.doc_id for r in rows["ngram_coverage"] if r.recall == 1) == [44, 89] == sorted(r.doc_id for r in rows["word_recall"] if r.recall == 1)
