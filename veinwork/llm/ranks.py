"""Exact ranks without a global sort: digit histograms for ids, ranges for strings.

``radix_offsets`` counts ids by their leading digits, level over level: a
level is counted from the one below it, and the offset of a prefix is that of
its parent plus what its smaller siblings hold, so a window sees at most
``1 << BITS`` rows.  Within a prefix of the lowest level rows are few: at most
``1 << BITS`` different ids.

``ranked_strings`` numbers different strings in UTF-8 order: ranges of them
are sorted apart, and a range starts where those before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.workspace import partitions, written

#: Bits of one digit of an id.
BITS = 12


def prefix(key: Column) -> Column:
    """The digits of an id that name its group of the lowest level; ids of one group are ``1 << BITS`` at most."""
    return F.shiftright(key, BITS)


def radix_offsets(rows: DataFrame, group: str, key: str, path: str) -> DataFrame:
    """group, prefix, offset, total: for each lowest prefix the rows of its group in smaller prefixes, and the rows of the group.

    ``group`` and ``key`` (a long) must not be null; the counts of the lowest level are written to ``path``.
    """
    ends = rows.agg(F.min(key).alias("least"), F.max(key).alias("most")).first()
    low, high, depth = ends["least"] or 0, ends["most"] or 0, 1
    while low >> BITS * depth != high >> BITS * depth and (low >> BITS * depth, high >> BITS * depth) != (-1, 0):
        depth += 1
    counts = [written(rows.groupBy(group, prefix(F.col(key)).alias("p0")).agg(F.count(F.lit(1)).alias("n")), path)]
    for k in range(1, depth):
        counts.append(counts[-1].groupBy(group, prefix(F.col(f"p{k - 1}")).alias(f"p{k}")).agg(F.sum("n").alias("n")))
    last = f"p{depth - 1}"  # one prefix that all ids share, or -1 and what is not negative
    whole = Window.partitionBy(group)
    earlier = whole.orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts[-1].select(group, last, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    for k in range(depth - 2, -1, -1):
        smaller = Window.partitionBy(group, f"p{k + 1}").orderBy(f"p{k}").rowsBetween(Window.unboundedPreceding, -1)
        own = counts[k].select(group, f"p{k}", prefix(F.col(f"p{k}")).alias(f"p{k + 1}"), "n")
        own = own.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        placed = own.join(placed, [group, f"p{k + 1}"]).select(group, f"p{k}", (F.col("offset") + F.col("before")).alias("offset"), "total")
    return placed.withColumnRenamed("p0", "prefix")


def ranked_strings(rows: DataFrame, name: str, path: str) -> DataFrame:
    """``rows`` (one for each string, which is not null) with ``rank`` from 0, in UTF-8 order."""
    number = partitions(rows.sparkSession)
    ranges = written(rows.repartitionByRange(number, name).withColumn("range", F.spark_partition_id()), path)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row a range, as many as there are partitions
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(name)) - 1
    return ranges.withColumn("within", within).join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + F.col("within")).drop("range", "within", "start")
