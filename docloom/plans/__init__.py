"""Queries over the test tables, one module per group of operators."""

from . import (  # noqa: F401
    aggregates,
    chains,
    folds,
    graphs,
    scalars,
    scans,
    schemas,
    sources,
    streams,
    texts,
    vectors,
    webs,
)
from .registry import CATALOG  # noqa: F401
