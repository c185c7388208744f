"""Connected components of a table of links, by contraction; no group and no label goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscore.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in a link (a, b); the label is the component's smallest node.

    Each round maps every node to the smallest of itself and its neighbours and replaces the links by
    links between these, so a star vanishes in one round and a chain shrinks by more than half. The
    rounds' maps are written tables, so a lost executor repeats its tasks of one round only. Hot
    nodes are combined before the shuffle (`min`), and their joins are left to adaptive skew splitting.
    """
    spark = links.sparkSession
    edges = common.materialise(links.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label"))
        maps.append(common.materialise(down, "contraction"))
        to = maps[-1]
        edges = common.materialise(
            edges.join(to.selectExpr("node AS a", "label AS x"), "a").join(to.selectExpr("node AS b", "label AS y"), "b")
            .where("x <> y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node bigint, label bigint")
    labels = maps[0]
    for later in maps[1:]:
        step = later.selectExpr("node AS label", "label AS next")
        labels = labels.join(step, "label", "left").selectExpr("node", "coalesce(next, label) AS label")
    return common.materialise(labels, "components")
