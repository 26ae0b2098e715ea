"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from chorale.llm import plans_records, plans_text

QUERIES = {**plans_records.QUERIES, **plans_text.QUERIES}
ORACLE = {**plans_records.ORACLE, **plans_text.ORACLE}
