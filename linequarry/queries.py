"""The registry of the engine's own queries and their SQL."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLE, QUERIES

for _name in ("sources_queries", "review_queries", "search_queries", "layout_queries", "state_queries", "contract_queries", "job_queries", "intake_queries", "commit_queries", "folder_queries", "variant_queries", "recovery_queries"):
    importlib.import_module(f"linequarry.plans.{_name}")

flagship = QUERIES["e_review_overlay"]

__all__ = ["ORACLE", "QUERIES", "flagship"]
