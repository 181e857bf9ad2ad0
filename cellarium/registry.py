"""Registered queries and their SQL."""

from __future__ import annotations

from cellarium.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
