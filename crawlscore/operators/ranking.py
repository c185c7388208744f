"""Ranks within a key of any size: no window and no list holds a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscore.session import materialise


def ranked(df: DataFrame, key: list[str], order: list[str], into: str = "rank", descending: bool = False) -> DataFrame:
    """Rows with their rank (from 1) within `key` by `order`, nulls last, rows with equal keys together in range order.

    The rows are dealt out by range of (key, order) and written; a window ranks what one range holds of a key, and the
    sizes of a key's earlier ranges, at most one row for each partition, shift these ranks.
    """
    part, within, ahead, size = "__part", "__within", "__ahead", "__size"
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]
    keys = [F.col(c).asc_nulls_first() for c in key]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *keys, *by).withColumn(part, F.spark_partition_id()), "ranges")
    names = {c: f"__of_{c}" for c in key}
    sizes = dealt.groupBy(part, *key).agg(F.count("*").alias(size)).withColumnsRenamed({part: "__range", **names})
    earlier = Window.partitionBy(*names.values()).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(ahead, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    own = dealt.withColumn(within, F.row_number().over(Window.partitionBy(part, *key).orderBy(*by)))
    same = F.col(part) == F.col("__range")
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return own.join(sizes, same).withColumn(into, F.col(within) + F.col(ahead)).drop(
        part, within, ahead, size, "__range", *names.values())
