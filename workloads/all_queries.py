"""Importing this module registers every query."""

from workloads import (  # noqa: F401
    audit_queries,
    feature_queries,
    group_queries,
    model_queries,
    profile_queries,
    source_queries,
)
