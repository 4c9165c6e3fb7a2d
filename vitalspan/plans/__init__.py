"""Views over the given tables and the registered queries."""


def load_entries():
    from vitalspan.plans import (  # noqa: F401  registration happens on import
        attribution_queries, cohort_queries, contrast_queries, explain_queries, feature_queries, model_queries, relational_queries, survival_queries,
    )
    from vitalspan.plans.registry import ENTRIES
    return ENTRIES
