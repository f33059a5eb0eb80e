"""The SimHash step of near-dedup by itself."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import near_copies, simhash


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """Without a min-hash band, near copies meet by fingerprints of one or two differing bits, in chains too; others don't."""
    monkeypatch.setattr(near_copies, "keys", lambda hashes: [])
    rng, texts = np.random.default_rng(7), {}
    while len(texts) < 12:
        own = [f"w{x}" for x in rng.integers(0, 5000, 3000)]
        other = [*own[:1500], "x", *own[1501:]]
        a, b = (simhash.fingerprint(" ".join(t), near_copies.SHINGLE) for t in (own, other))
        if 1 <= (a ^ b).bit_count() <= 2:
            texts |= {len(texts): " ".join(own), len(texts) + 1: " ".join(other)}
    texts |= {100: "", 101: None, 102: "alone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_copies.near_copies(docs, "doc_id").groupBy("root").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    assert sorted(r.ids for r in got) == [*([i, i + 1] for i in range(0, 12, 2)), [100, 101], [102]]
