"""Composed work: building the wide table, cleaning it, and the queries on the test tables."""


def all_queries():
    """All registered queries and their SQL counterparts."""
    from . import (  # noqa: F401
        catalog,
        clean_queries,
        decided_queries,
        learner_queries,
        model_queries,
        relation_queries,
        saturated_queries,
        statistic_queries,
        value_queries,
        wide_queries,
    )

    return catalog.QUERIES, catalog.ORACLES
