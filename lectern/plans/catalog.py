"""All registered queries."""

from . import corpus_queries, evaluate_queries, locate_queries, place_queries, series_queries, source_queries, stored_queries, stream_queries, text_queries, usage_queries  # noqa: F401
from .registry import registry  # noqa: F401
