"""Newest-first views of the logs. Ties are broken by the row's id, and look-ups join only the rows shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmart.operators.ordering import descending

# Rows shown where the caller names no limit.
SYNC_ROWS = 20
EVENT_ROWS = 50
AUDIT_ROWS = 200
REPORT_ROWS = 20


def _newest(log: DataFrame, time: str, row_id: str, limit: int) -> DataFrame:
    return log.orderBy(descending(time), descending(row_id)).limit(limit)


def sync_history(sync_log: DataFrame, limit: int = SYNC_ROWS) -> DataFrame:
    shown = sync_log.select(
        *["sync_id", "channel", "sync_type", "started_at", "completed_at"],
        *["records_ingested", "records_failed", "status", "error_detail"],
    )
    return _newest(shown, "started_at", "sync_id", limit)


def alert_event_history(
    events: DataFrame, rules: DataFrame, dim_product: DataFrame, limit: int = EVENT_ROWS
) -> DataFrame:
    named = events.join(rules.select("rule_id", "rule_name"), "rule_id")
    shown = _newest(named, "triggered_at", "event_id", limit)
    titles = dim_product.select("product_id", F.col("title").alias("product_title"))
    return (
        shown.join(titles, "product_id", "left")
        .select("event_id", "rule_id", "rule_name", "product_id", "product_title", "triggered_at", "email_sent")
        .orderBy(descending("triggered_at"), descending("event_id"))
    )


def audit_history(audit_log: DataFrame, users: DataFrame, limit: int = AUDIT_ROWS) -> DataFrame:
    shown = _newest(audit_log, "created_at", "log_id", limit)
    return (
        shown.join(users.select("user_id", "username"), "user_id", "left")
        .select("log_id", "username", "action", "resource", "ip_address", "created_at")
        .orderBy(descending("created_at"), descending("log_id"))
    )


def report_history(catalogue: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    shown = catalogue.select("report_id", "report_type", "format", "parameters", "generated_at", "generated_by")
    return _newest(shown, "generated_at", "report_id", limit)


def alert_rule_list(rules: DataFrame) -> DataFrame:
    return rules.orderBy(descending("created_at"), descending("rule_id"))


def channel_list(channels: DataFrame) -> DataFrame:
    return channels.select("channel_id", "channel_name").orderBy("channel_id")
