"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import MAX_BROADCAST_ROWS, drop_scratch, scratch, shared_dir, small

__all__ = ["MAX_BROADCAST_ROWS", "drop_scratch", "most_frequent", "scratch", "shared_dir", "small", "text_or_empty"]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def most_frequent(counts: DataFrame, k: int, n: str = "n") -> DataFrame:
    """The rows of highest ``n``, at most ``k``: all that lie above the first step of counts that doesn't fit.

    Steps are sixteenths of powers of two (each small count is a step of its own).  Only a
    histogram of some hundred steps is collected; a plain ordered limit would send ``k`` rows
    from every task to the driver.  ``counts`` is read twice, so it should be a written table.
    """
    step = F.floor(F.log2(n) * 16)
    left, floor = k, None
    for s, size in sorted(((r.s, r.c) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        if size > left:
            floor = s
            break
        left -= size
    return counts if floor is None else counts.where(step > floor)
