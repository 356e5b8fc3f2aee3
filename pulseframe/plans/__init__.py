from pulseframe.plans.incremental import IncrementalTables
from pulseframe.plans.narrative import chat_context, insight_payload, user_stats
from pulseframe.plans.read_models import (
    correlation_payload,
    dataset_profile,
    latest_day,
    overview_payload,
    recent_anomalies,
    select_user,
    trend_slice,
)
from pulseframe.plans.report import report_rows
from pulseframe.plans.store import EventStore

__all__ = [
    "EventStore",
    "IncrementalTables",
    "chat_context",
    "correlation_payload",
    "dataset_profile",
    "insight_payload",
    "latest_day",
    "overview_payload",
    "recent_anomalies",
    "report_rows",
    "select_user",
    "trend_slice",
    "user_stats",
]
