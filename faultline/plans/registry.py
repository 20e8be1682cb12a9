"""All registered queries, with a session check and plain output types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans import queries_checkout, queries_handoff, queries_incidents, queries_ingest, queries_packages
from faultline.session import configure

ALL = {
    **queries_ingest.QUERIES,
    **queries_incidents.QUERIES,
    **queries_packages.QUERIES,
    **queries_handoff.QUERIES,
    **queries_checkout.QUERIES,
}


def _plain(df: DataFrame) -> DataFrame:
    """Instants as zone-free timestamps (UTC), so that every client reads them alike."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def runner(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(build(configure(spark), sf_dir))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(build) for name, (build, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
