"""Named queries over the driver tables, each with its SQL twin."""

from parcelflow.plans import backfill_queries, cohort_queries, filter_queries, function_queries, ingest_queries, list_queries, page_queries, planning_queries, postal_queries, proposal_queries, record_queries, sales_queries, search_queries, stream_queries, unified_queries, upkeep_queries

__all__ = ["backfill_queries", "cohort_queries", "filter_queries", "function_queries", "ingest_queries", "list_queries", "page_queries", "planning_queries", "postal_queries", "proposal_queries", "record_queries", "sales_queries", "search_queries", "stream_queries", "unified_queries", "upkeep_queries"]
