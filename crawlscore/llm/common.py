"""Helpers of the operators here: column names, intermediate tables, ranks over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscore.session import materialise, shared_folder, ship_package

#: The words of a text are its runs of characters other than these.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of `df` has them (case ignored)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Rows with their rank (from 0) by the `order` columns, nulls last, without a single-task window.

    The rows are dealt out by range and written; ranks within a range are shifted by the sizes of
    the ranges before it, of which there are as many as partitions.
    """
    part, within, ahead = fresh(df, "part", "within", "ahead")
    by = [F.col(c).asc_nulls_last() for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias(into))
    sizes = sizes.withColumn(
        ahead, F.coalesce(F.sum(into).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return (ranked.join(sizes.select(part, ahead), part)
            .withColumn(into, F.col(within) + F.col(ahead) - 1).drop(part, within, ahead))


__all__ = ["WHITE", "fresh", "materialise", "new_folder", "numbered", "shared_folder", "ship_package", "table"]
