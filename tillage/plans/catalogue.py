"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import boards, documents, extraction, programme, records, relational, rules, small, stored, structure, weather  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

flagship = relational.g1_entity_summary

__all__ = ["ORACLES", "QUERIES", "flagship"]
