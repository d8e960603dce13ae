"""Registered queries over the given tables, one or more per operator."""

from . import (  # noqa: F401
    aggregates, datasets, expressions, frames, geometry, ingest, joins, positions, predicates, relational, sinks,
    sources, streams)
from .registry import REGISTRY, Query, Tables  # noqa: F401
