"""All registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from trialweave.plans import contrast_queries, linked_queries, map_queries, merge_queries, model_queries, ordered_queries, regression_queries, selection_queries, spatial_queries, vector_queries

QUERIES = ordered_queries.QUERIES | vector_queries.QUERIES | model_queries.QUERIES | selection_queries.QUERIES | merge_queries.QUERIES | linked_queries.QUERIES | spatial_queries.QUERIES | map_queries.QUERIES | contrast_queries.QUERIES | regression_queries.QUERIES
ORACLE = ordered_queries.ORACLE | vector_queries.ORACLE | model_queries.ORACLE | selection_queries.ORACLE | merge_queries.ORACLE | linked_queries.ORACLE | spatial_queries.ORACLE | map_queries.ORACLE | contrast_queries.ORACLE | regression_queries.ORACLE
FLAGSHIP = "drift_by_group"
