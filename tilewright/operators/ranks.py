"""Places in a whole order, without a window that one task sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import written

#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: Column, within: Column | None = None, name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in the given order, which must tell all rows apart; within groups of a column if one is given (nulls are one group).

    Rows are dealt out by ranges of the order and sorted there; a range's first place is the sum of the sizes of those before it. Only the sizes, one row for each
    range, meet in one task. A group may spread over any number of ranges. Empty tables give no rows.
    """
    group = F.lit(0) if within is None else within
    keys = [F.col("__group").asc_nulls_first(), *order]
    dealt = df.withColumn("__group", group).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    rows = written(dealt.withColumn("__range", F.shiftright(at, _ROW_BITS)).withColumn("__row", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), "ranges")
    sizes = rows.groupBy("__range").agg((F.max("__row") + 1).alias("n"))
    # a row for each range, so its window is as large as the number of tasks
    before = sizes.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    placed = rows.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__row"))
    if within is not None:
        first = placed.groupBy("__group").agg(F.min(name).alias("__first"))
        placed = placed.join(first.withColumnRenamed("__group", "__own"), F.col("__group").eqNullSafe(F.col("__own"))).withColumn(name, F.col(name) - F.col("__first")).drop("__own", "__first")
    return placed.drop("__group", "__range", "__row", "__before")
