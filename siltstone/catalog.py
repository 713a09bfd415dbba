"""Imports every module that registers core queries."""

from siltstone.plans import contracts, corpus, retrieval, tables, texts  # noqa: F401
from siltstone.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
