"""Queries over the driver's tables: single operators, and whole workflows."""

from lectern.plans import queries, workflows

__all__ = ["queries", "workflows"]
