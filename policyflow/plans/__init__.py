"""Operators bound to the driver tables: each query next to the SQL that states its result."""

from . import (  # noqa: F401
    codes, tables, grouping, windows, sections, tagging, results, handoff, storage, streams, surface, timed, runs,
)
from .registry import ORACLES, QUERIES  # noqa: F401
