"""Registered queries: operators applied to the driver's tables, each with its SQL check."""

from pointprep.registry.core import ORACLES, QUERIES
from pointprep.registry import (  # noqa: F401
    scalars, curation, neighbourhood, sampling, evaluation, shapes, quality, streams, storage,
)

__all__ = ["ORACLES", "QUERIES"]
