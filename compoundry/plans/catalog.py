"""All registered queries."""

from compoundry.plans import (  # noqa: F401
    curation_queries,
    file_queries,
    fragment_queries,
    learning_queries,
    model_queries,
    pair_queries,
    structure_queries,
    table_queries,
)
from compoundry.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
