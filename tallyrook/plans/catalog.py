"""The registered queries of the listing, evidence and corpus operators, with their DuckDB twins."""

from __future__ import annotations

from tallyrook.plans import evidence_queries, feed_queries, keyed_queries, listing_queries, provenance_queries, publish_queries, report_queries, run_queries, state_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (listing_queries, state_queries, evidence_queries, feed_queries, keyed_queries, provenance_queries, publish_queries, run_queries, report_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
