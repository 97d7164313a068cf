"""Loads every module that registers a query of this subpackage."""

from linewright.llm import decontamination, exact_dedup, hard_negatives, language, line_dedup, mixing, near_dup, packing, substring_dedup, token_counts, token_files, vector_codes, warc  # noqa: F401
from linewright.llm.registry import ORACLES, QUERIES  # noqa: F401
