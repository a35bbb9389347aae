"""Tables that joins bring to the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of queries' terms that a join may broadcast, by count; above it both sides are shuffled.
SMALL = 400_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if a count shows that it may be."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
