"""Connected components of a link table: large-star and small-star steps (Kiveris et al. 2014).

Links stay distributed; each step is one map-side combined minimum per node and a join.
A node with very many links is a hot join key that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least neighbour: the greater ones (large) or the lesser (small)."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not large:
        both = both.where("dst < src")
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionAll(
            least.select("src", F.col("low").alias("dst"))
        )
    return out.where("src <> dst").distinct()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node that has a link; component is the least node.

    Null ends and self links are ignored; repeated links count once; no links, no rows.
    """
    now = cut(
        edges.select(
            F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")
        ).where("src <> dst").distinct()
    )
    last = None
    while True:
        now = cut(_star(_star(now, large=True), large=False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()
        if state == last:
            break
        last = state
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
