"""Query plans and the SQL they are held against."""

from locusmill.plans import boundary_queries, catalog_queries, interval_queries, label_queries, layout_queries, locate_queries, projection_queries, quote_queries, record_queries, source_queries, span_queries, storage_queries, stream_queries, text_queries  # noqa: F401
from locusmill.plans.registry import ORACLES, QUERIES, Query

__all__ = ["ORACLES", "QUERIES", "Query"]
