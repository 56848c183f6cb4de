"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is joined by broadcasting its one right row.
HOT_ROWS = 200_000
#: At most so many hot keys; the bar rises with the total, so total / MAX_HOT_KEYS bounds the broadcast.
MAX_HOT_KEYS = 20_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner", hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """left join right, where right has one row for each key and in `count` how many left rows hold the key.

    right must be a written table (it is read several times). how: inner, left or left_semi.
    Keys at or over the bar are hot: their right rows are at most MAX_HOT_KEYS by
    construction and are broadcast, so that no task gets a hot key's rows; the others are
    joined by shuffling. The count column is dropped. total: the left rows, if known; fewer than
    hot_rows hold no hot key.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    if total < hot_rows:
        return left.join(right.drop(count), on, how)
    bar = max(hot_rows, total // MAX_HOT_KEYS)
    if not right.filter(F.col(count) >= bar).limit(1).count():
        return left.join(right.drop(count), on, how)
    hot = right.filter(F.col(count) >= bar).drop(count)
    keys = hot.select(on)
    # Null keys match nothing; the anti join keeps them on the shuffled side.
    return left.join(F.broadcast(hot), on, "left_semi" if how == "left_semi" else "inner").unionByName(
        left.join(F.broadcast(keys), on, "left_anti").join(right.filter(F.col(count) < bar).drop(count), on, how)
    )
