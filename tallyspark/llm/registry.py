"""The corpus operators' queries and oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import conversations, decontamination, fingerprints, line_dedup, mixing, quality, secrets, simhash, spelling, token_counts, toxicity, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (line_dedup, secrets, simhash, mixing, token_counts, decontamination, vectors, toxicity, quality, conversations, fingerprints, spelling, whitening):
    QUERIES |= module.QUERIES
    ORACLES |= getattr(module, "ORACLES", {})
