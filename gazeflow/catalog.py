"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from .plans import choice_queries, codec_queries, geometry_queries, image_queries, ml_queries, mosaic_queries, operator_queries, region_queries, relational_queries, transform_queries, vigilance_queries

MODULES = (vigilance_queries, relational_queries, image_queries, transform_queries, ml_queries, geometry_queries, operator_queries, codec_queries, mosaic_queries, region_queries, choice_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = vigilance_queries.QUERIES["perclos_alerts"]
