"""Imports every operator module, so that its queries are registered."""

from sievelark.llm import collocations, decontaminate, jaccard, licenses, line_dedup, mixing, ngram_lm, order_minhash, quality, rule_forest, secrets, token_align, toxicity  # noqa: F401
from sievelark.llm.registry import QUERIES, SQL  # noqa: F401
