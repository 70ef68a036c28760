"""Queries over the given tables, one or more per operator."""

from tidemark.plans import (  # noqa: F401
    alert_plans,
    change_plans,
    error_plans,
    governance_plans,
    join_plans,
    privacy_plans,
    reconcile_plans,
    routing_plans,
    rule_plans,
    series_plans,
    sink_plans,
    source_plans,
    stream_plans,
    window_plans,
)
from tidemark.plans.registry import PLANS, Tables  # noqa: F401
