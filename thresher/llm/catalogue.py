"""All registered queries of the subpackage."""

from thresher.llm import chat, class_model, collocations, contamination, credentials, hard_negatives, host_rules, overlap_join, packing, passages, records, style_tree, toxicity  # noqa: F401
from thresher.llm.registry import QUERIES

__all__ = ["QUERIES"]
