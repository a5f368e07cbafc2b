"""Registered queries; importing this package registers all of them."""

from . import advantage_queries, batch_queries, catalog, composed_queries, grading_queries, metric_queries, policy_queries, relational_queries, rollout_queries, scoring_queries, stored_queries, stream_queries  # noqa: F401
