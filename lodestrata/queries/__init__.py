"""Registered queries: every operator on whole driver tables, beside SQL that says the same."""

from __future__ import annotations

from . import answers, chunks, evaluation, ingest, plans, reconcile, retrieval, scalars
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "answers", "chunks", "evaluation", "ingest", "plans", "reconcile", "retrieval", "scalars"]
