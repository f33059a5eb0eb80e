import pytest

from quarry.llm import line_dedup


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Rarity levels in 1,024 buckets: the constant array of all of them takes longer to plan with than small fixtures to run."""
    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 10)
