"""Connected components of a link table, by alternating large-star and small-star steps.

Links may come in any direction, with repeats and self-links; those are
dropped, as are links with a null end. An empty table gives an empty table.
Each step is a min per node and a join on the node, so a hub's links are split
like any skewed join, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point a node's larger (or smaller) neighbours at its smallest one."""
    if large:
        near = links.unionAll(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "near")
    else:
        near = links.toDF("node", "near")
    least = near.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    pairs = near.join(least, "node")
    if large:
        return pairs.where(F.col("near") > F.col("node")).select(F.col("near").alias("high"), F.col("least").alias("low"))
    moved = pairs.where(F.col("near") != F.col("least")).select(F.col("near").alias("high"), F.col("least").alias("low"))
    return moved.unionAll(least.select(F.col("node").alias("high"), F.col("least").alias("low")))


def connected_components(links: DataFrame, one: str, other: str) -> DataFrame:
    """Rows (node, root): every linked node with the smallest node it can reach."""
    current = settle(
        links.where(F.col(one).isNotNull() & F.col(other).isNotNull() & (F.col(one) != F.col(other)))
        .select(F.greatest(one, other).alias("high"), F.least(one, other).alias("low")).distinct(),
        "links",
    )

    def state(table: DataFrame):
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())

    seen = state(current)
    while seen[0]:
        current = settle(_star(_star(current, True).distinct(), False).distinct(), "links")
        now = state(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return current.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(roots)
