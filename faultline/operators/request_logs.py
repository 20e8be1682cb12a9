"""Log lines of a service: JSON projection of requests, and requests from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv


def log_time(ts: Column) -> Column:
    """UTC text cut to milliseconds, with ``Z``."""
    return F.date_format(F.date_trunc("millisecond", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_records(
    records: DataFrame, service: str, environment: str = "development", version: str = "local"
) -> DataFrame:
    """``seq, payload``: one JSON line per record.

    ``records``: ``seq, ts, severity, message``, optionally ``request_id``,
    ``stack_trace`` and other columns. Only allow-listed columns are written,
    absent values are left out, and the removed names never appear.
    """
    have = set(records.columns)
    parts = [
        log_time(F.col("ts")).alias("timestamp"), F.col("severity"),
        F.lit(service).alias("service"), F.lit(environment).alias("environment"),
        F.lit(version).alias("version"), F.col("message"),
    ]
    if "request_id" in have:
        parts.append(F.when(F.col("request_id") != "", F.col("request_id")).alias("request_id"))
    parts += [F.col(name) for name in fv.LOG_EXTRA_FIELDS if name in have]
    if "stack_trace" in have:
        parts.append(F.col("stack_trace"))
    return records.select("seq", F.to_json(F.struct(*parts)).alias("payload"))


def request_rollup(lines: DataFrame) -> DataFrame:
    """One row per request_id from its log lines (a partial aggregate, no order needed).

    ``lines``: ``request_id, ts, severity, http_status, latency_ms``. A request
    that ended in an unhandled error has one line, the error itself.
    """
    return lines.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max("http_status").alias("http_status"),
        F.max("latency_ms").alias("latency_ms"),
        F.min("ts").alias("started_at"),
        F.count_if(F.col("severity").isin(*fv.CLUSTERED_SEVERITIES)).alias("error_lines"),
    )
