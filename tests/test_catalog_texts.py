"""Texts of hits beside the hits."""

from quarry.plans import catalog


def test_only_texts_that_were_found_are_moved(spark, tmp_path):
    """The documents meet the hits' ids before they are shuffled or sorted; hits of several queries share a text."""
    spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = spark.createDataFrame([(1, 7, 1), (1, 9, 2), (2, 7, 1), (2, 900, 2)], "qid long, id long, rank int")
    got = catalog._texts(spark, str(tmp_path), hits)
    assert sorted((r.qid, r.id, r.rank, r.text) for r in got.collect()) == [(1, 7, 1, "text 7"), (1, 9, 2, "text 9"), (2, 7, 1, "text 7")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
