"""Connected components of a link table by alternating large-star and small-star steps.

Each step takes the least neighbour of every node by a partially aggregated ``min`` and joins
it back, so a node with very many links is pre-aggregated and, as the minima are written
first, its join side can be split;
links, nodes and labels stay in Spark. Steps are checkpointed into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize


def _state(links: DataFrame):
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
    own = least.select("a", F.col("m").alias("b"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node that is not itself the least of its component;
    ``links`` has two columns ``a`` and ``b`` of one orderable type. No links: no rows."""
    links = materialize(links.where("a <> b").distinct())
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
