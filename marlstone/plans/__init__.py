"""Registered queries: each applies operators to the stand-in tables, beside the SQL for the same rows."""

from . import dialog, etl, retrieval
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dialog", "etl", "retrieval"]
