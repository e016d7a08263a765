"""Registered queries of the catalogue engine and the SQL each is checked against."""

from __future__ import annotations

from tessera.plans import curation_plans, dedupe_plans, editorial_plans, evidence_plans, overlaps, pipelines, reads, research_plans, texts  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
