"""Registered queries: the operators over the sample tables, with their SQL."""

from . import changes, flows, loads, schemas, tables  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
