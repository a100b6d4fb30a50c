"""All queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from causeway.llm.common import ORACLES, QUERIES
from causeway.llm import (  # noqa: F401  (imported to register their queries)
    collocations,
    decontaminate,
    exact_dedup,
    language_id,
    lexical_search,
    licenses,
    lm_score,
    mixing,
    ngram_join,
    packing,
    pii,
    substring_dedup,
    toxicity,
)

__all__ = ["ORACLES", "QUERIES"]
