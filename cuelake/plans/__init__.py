"""Queries over the test tables, one for each operator."""

from cuelake.plans import check_queries, document_queries, file_queries, process_queries, relational_queries, source_queries, stream_queries, text_queries
from cuelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "check_queries", "document_queries", "file_queries", "process_queries", "relational_queries", "source_queries", "stream_queries", "text_queries"]


def flagship(spark, sf_dir):
    return QUERIES["flt2_limits"](spark, sf_dir)
