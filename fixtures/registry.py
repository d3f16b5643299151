"""All registered queries by name."""

from fixtures import cohort_queries, feature_queries, label_queries, linkage_queries, signal_queries, study_queries

QUERIES = {
    **linkage_queries.QUERIES,
    **cohort_queries.QUERIES,
    **signal_queries.QUERIES,
    **label_queries.QUERIES,
    **feature_queries.QUERIES,
    **study_queries.QUERIES,
}
