"""All registered queries."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import event_queries, ordered_queries, page_queries, probe_queries  # noqa: F401
