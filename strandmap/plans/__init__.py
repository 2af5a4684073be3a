"""Views, parameters and the registered queries with their SQL."""

from strandmap.plans import annotation_queries, cluster_queries, contact_queries, interval_queries, plane_queries, record_queries, report_queries, sequence_queries

MODULES = (annotation_queries, cluster_queries, contact_queries, interval_queries, plane_queries, record_queries, report_queries, sequence_queries)
