"""Registered queries over the driver's tables, each with its SQL oracle where one exists."""

from snapgate.queries import (  # noqa: F401
    conforming,
    decoding,
    landing,
    policies,
    profiling,
    publishing,
    quality,
    relations,
    runs,
    writing,
)
from snapgate.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
