"""All registered queries."""

from millrace.plans import (  # noqa: F401
    clean_queries,
    detector_queries,
    evaluation_queries,
    source_queries,
    window_queries,
)
from millrace.plans.registry import QUERIES, SQL  # noqa: F401
