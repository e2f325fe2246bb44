"""All queries of the library, with the SQL that each must equal (or None)."""

from __future__ import annotations

from evidentia.plans import answer_queries, claim_queries, corpus_queries, evaluation_queries, experiment_queries, graph_queries, log_queries, run_queries, surface_queries

ALL = {
    **corpus_queries.QUERIES, **claim_queries.QUERIES, **answer_queries.QUERIES, **evaluation_queries.QUERIES, **graph_queries.QUERIES, **log_queries.QUERIES, **run_queries.QUERIES, **experiment_queries.QUERIES, **surface_queries.QUERIES,
}
