"""Queries over the provided tables, by family, each with its SQL."""

from __future__ import annotations

from shutterloom.plans import archive, capture, dedup, similar

FAMILIES = (dedup, capture, archive, similar)
QUERIES = {k: v for family in FAMILIES for k, v in family.QUERIES.items()}
ORACLES = {k: v for family in FAMILIES for k, v in family.ORACLES.items()}
