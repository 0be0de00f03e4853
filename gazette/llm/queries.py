"""All queries of this subpackage; importing a module registers its query."""

from gazette.llm import chat, codes, decontaminate, jaccard, language, lines, lm, packing, repair, repeats, simhash, topk, toxicity  # noqa: F401
from gazette.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
