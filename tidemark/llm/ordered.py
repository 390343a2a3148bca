"""Places of rows in an order of all of them, found over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import written

#: Rows of a range, about.
ROWS = 1 << 17


def ranged(rows: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """The rows as a written table with `_at`, which rises with the keys, nulls first, and the number of its ranges.

    A range's number is `_at >> 33`. Equal rows are told apart by where they stood, so that a hot key is cut as well.
    """
    kept = written(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // ROWS))
    order = [F.col(k).asc_nulls_first() for k in (*keys, "_tie")]
    spread = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    return written(spread.withColumn("_at", F.monotonically_increasing_id()), name), parts


def part() -> Column:
    return F.shiftright("_at", 33)


def pieces(at: DataFrame, group: str, **sums: Column) -> DataFrame:
    """_part, group, `_first` (the least _at), before and here (rows of the group in earlier ranges and in this one), whole (all of them).

    For each further name its sum over the group's rows in earlier ranges, and as `<name>_whole` over all of them.
    A group has at most one row a range.
    """
    one = at.groupBy(part().alias("_part"), group).agg(F.min("_at").alias("_first"), F.count("*").alias("here"), *(F.sum(c).alias(n) for n, c in sums.items()))
    own, earlier = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    return one.select(
        "_part", group, "_first", "here", none(F.sum("here").over(earlier)).alias("before"), F.sum("here").over(own).alias("whole"),
        *(none(F.sum(n).over(earlier)).alias(n) for n in sums), *(F.sum(n).over(own).alias(f"{n}_whole") for n in sums),
    )


def placed(at: DataFrame, of: DataFrame, group: str) -> DataFrame:
    """The rows of `ranged` with their piece's columns, and `place` from 0 within their group."""
    right = of.withColumnRenamed(group, "_group")
    on = (part() == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    return at.join(right, on).withColumn("place", F.col("_at") - F.col("_first") + F.col("before")).drop("_group")
