"""The full catalogue: importing the query modules registers their queries."""

from oddsloom.plans import (  # noqa: F401
    queries_data,
    queries_evaluation,
    queries_operations,
    queries_pricing,
    queries_reports,
)
from oddsloom.plans.catalog import CATALOG

__all__ = ["CATALOG"]
