"""How rows are dealt out."""

from quarry.operators import checks
from quarry.sources import shared


def test_shares_by_keys_are_bounded(spark, tmp_path, monkeypatch):
    """The number of tasks follows the tables' bytes, and manifests are compared in that many."""
    spark.range(20_000).selectExpr("id as k", "sha2(cast(id as string), 256) as s").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(shared, "SPREAD_BYTES", 50_000)
    a, b = shared.by_keys(["k"], rows, rows.where("k < 9000"))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() > 20
    got = checks.mismatched(rows.where("k <> 7"), rows, ["k"], ["s"])
    assert [tuple(r) for r in got.collect()] == [(7, "missing")]
