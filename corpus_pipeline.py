"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, encoding."""

from mosaiq.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
