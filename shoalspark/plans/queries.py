"""All queries of the engine's own operators."""

from shoalspark.plans import alignment_queries, asof_queries, catalog_queries, channel_queries, ingest_queries, link_queries, pipeline_queries, river_queries, sampling_queries, scalar_queries, section_queries, selection_queries, source_queries, survey_queries, table_queries  # noqa: F401
from shoalspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
