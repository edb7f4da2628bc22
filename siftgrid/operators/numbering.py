"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``rows`` with their positions in ``order`` as a long column.

    The table is sorted by range partitions; a position is that within the
    partition plus the sizes of the partitions before, of which only the counts
    reach the driver.  The sorted rows are kept (memory and disk), so that both
    steps see the same partitions.
    """
    kept = rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    partition = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = start, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += n
    base = F.element_at(F.create_map(*offsets), partition) if offsets else F.lit(start)
    return kept.withColumn(name, (base + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
