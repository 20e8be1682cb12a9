"""Ridge regression from normal equations that partitions sum on their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def partition_sums(rows: DataFrame, features: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Sums of Z'Z and Z'Y over all rows; ``features`` gives Z and Y of a batch.

    A task sends one row of numbers for each feature, whatever its number of rows; these are summed by
    feature, so the driver gets one square matrix in all. None for no rows.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z, y = (a.astype(np.float64) for a in features(batch))
                part = z.T @ np.hstack([z, y])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(len(total)), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        sums = np.array(table.column("sums").to_pylist()).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "i int, sums array<double>"
    found = rows.mapInArrow(gather, schema).groupBy("i").applyInArrow(add, schema).collect()
    if not found:
        return None
    both = np.array([r["sums"] for r in sorted(found, key=lambda r: r["i"])])
    return both[:, :len(both)], both[:, len(both):]


def ridge(squares: np.ndarray, targets: np.ndarray, strength: float) -> np.ndarray:
    """Weights of least squared error plus ``strength`` times the mean diagonal on each weight."""
    scale = strength * max(float(np.trace(squares)) / len(squares), 1e-12)
    return np.linalg.solve(squares + scale * np.eye(len(squares)), targets)
