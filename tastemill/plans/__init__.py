"""Registered queries: one Spark builder and (where SQL can express it)
one DuckDB SQL text per operator. Importing the submodules fills
``REGISTRY``."""

from tastemill.plans.registry import REGISTRY, query  # noqa: F401


def load_all() -> dict:
    from tastemill.plans import (  # noqa: F401
        q_features, q_recs, q_ensemble, q_energy, q_text, q_rules, q_models, q_regression, q_content, q_streaming, q_nets,
    )
    return REGISTRY
