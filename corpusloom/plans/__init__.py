"""Named queries over the driver's tables."""

from corpusloom.plans import data_queries, file_queries, job_queries, more_queries, page_queries, text_queries
from corpusloom.plans.catalog import REGISTRY, Query, query

__all__ = ["REGISTRY", "Query", "data_queries", "file_queries", "job_queries", "more_queries", "page_queries", "query", "text_queries"]
