"""All queries of the library."""

from __future__ import annotations

from . import catalog, checks, files, generate, ledgers, prompts, readers, scores, stories, transcripts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
