"""Queries on the test tables and their SQL."""

from quercus.plans import audits, catalogue, evidence, retrieval, scalars, sources, submissions, text
from quercus.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "catalogue", "evidence", "retrieval", "scalars", "sources", "submissions", "text"]
