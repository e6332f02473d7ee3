"""Queries over the Parquet tables: importing the modules fills the registry."""

from . import base, corpus, matching, reports, runs, selection
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "base", "corpus", "matching", "reports", "runs", "selection"]
