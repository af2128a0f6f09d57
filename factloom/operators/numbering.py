"""Numbers in an order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch


def numbered(rows: DataFrame, *keys: Column | str, by: tuple[str, ...] = (), name: str = "number", first: int = 1) -> DataFrame:
    """The rows with their number in the order of the keys, within ``by``.

    Rows are dealt by ranges of (by, keys) and written in order, each with its place;
    a row's number is its distance from the first of its partition and group, and
    what earlier partitions hold of the group. Of these there is a row for each
    partition and group. Rows that are equal in by and keys come in any order, and
    stand in one partition.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "numbers")
    order = [*by, *keys]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch.table(placed).withColumn("_part", F.shiftright("_place", 33))
    groups = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_place").alias("_from"))
    if by:
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        held, total = [], 0
        for r in sorted(groups.collect()):  # a row for each partition
            held.append((r["_part"], r["_from"], total))
            total += r["_n"]
        groups = F.broadcast(spark.createDataFrame(held, "_part long, _from long, _before long"))
    a, b = placed.alias("a"), groups.alias("b")
    same = reduce(Column.__and__, [F.col("a._part") == F.col("b._part"), *[F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by]])
    number = F.col("a._place") - F.col("b._from") + F.col("b._before") + first
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in rows.columns], number.cast("long").alias(name))
