"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import dataset_queries, landed_queries, market_queries, source_queries

QUERIES = {**market_queries.QUERIES, **dataset_queries.QUERIES, **source_queries.QUERIES, **landed_queries.QUERIES}
ORACLES = {**market_queries.ORACLES, **dataset_queries.ORACLES, **source_queries.ORACLES, **landed_queries.ORACLES}
