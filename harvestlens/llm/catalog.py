"""All queries of this subpackage."""

from harvestlens.llm import (  # noqa: F401
    content,
    jaccard,
    language,
    merkle,
    mixing,
    packing,
    periods,
    quality,
    spans,
    topk,
    toxicity,
    vectors,
    warc,
)
from harvestlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
