"""All query modules, imported for what they register."""

from tidemark.plans import aggregates, ingest, modelling, ordering, panels, scalars, similarity, windows  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
