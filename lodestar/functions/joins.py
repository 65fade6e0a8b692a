"""Join sides whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to all executors.
ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, of few bytes each; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
