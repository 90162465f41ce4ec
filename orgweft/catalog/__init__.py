"""Registered queries: every operator over the given tables, with its reference SQL."""

from __future__ import annotations

from orgweft.catalog import evaluation, files, graphs, ingest, lenses, reviews  # noqa: F401
from orgweft.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
