"""All registered queries."""

from parlance.plans import io_queries, order_queries, set_queries, text_queries  # noqa: F401
from parlance.plans.registry import ORACLES, QUERIES  # noqa: F401
