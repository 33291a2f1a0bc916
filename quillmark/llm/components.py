"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for each vertex of ``edges`` (``a, b``) but the roots, the
    root being the least id of the component.

    Large and small stars by turns: every vertex links its larger neighbours,
    then its smaller ones, to the least it knows, until nothing changes.  The
    number of rounds grows with the logarithm of the vertices.
    """
    near = Window.partitionBy("a")
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(near))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.withColumn("m", F.min("b").over(near))
        small = least.select("a", F.col("m").alias("b")).unionByName(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(small.distinct())
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(r) == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = tuple(r)
