"""Broadcast decisions backed by a row check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 200,000 dimension rows stay in the tens of megabytes even with long text columns.
BROADCAST_ROWS = 200_000


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the frame is proven to hold at most ``max_rows`` rows.

    The probe stops after ``max_rows + 1`` rows. Above the bound the frame is returned
    without a hint, and Spark falls back to a shuffle join with adaptive skew handling.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
