"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Largest side we broadcast without a shuffle; beyond it the join shuffles on
# its keys and AQE (skew join on) takes over.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
            max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and its string payload is
    at most ``max_bytes``; one aggregate over the whole frame."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    payload = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in strings), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(payload + F.lit(16)).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size is proven below the bounds, else ``df``."""
    return F.broadcast(df) if bounded(df, max_rows, max_bytes) else df
