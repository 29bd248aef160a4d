"""Connected components of a table of links, by alternating star contraction.

Each round every vertex takes its smallest neighbour and hands it to the other
neighbours; the number of links never grows, and a component becomes a star
around its smallest vertex after a number of rounds that is logarithmic in its
size.  A round is two shuffles of the links, a vertex with millions of links
costs one partial aggregate and a join that AQE may split; nothing but a count
and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, root): every vertex that has a link and the smallest vertex of its component.

    Links from a vertex to itself and links with a null end count as none;
    repeated links count once.
    """
    edges = durable(
        links.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct(),
        "edges",
    )
    seen = _checksum(edges)
    while seen[0]:
        # large star: neighbours above a vertex go to its smallest neighbour (or itself)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            edges.join(least.withColumnRenamed("u", "lo"), "lo")
            .select("hi", F.col("m").alias("lo"))
            .filter(F.col("hi") != F.col("lo"))
            .distinct()
        )
        # small star: all lower neighbours of a vertex go to the smallest of them
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(small.withColumnRenamed("u", "hi"), "hi")
        edges = durable(
            joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter(F.col("hi") != F.col("lo"))
            .unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            "edges",
        )
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("vertex"), F.col("lo").alias("root")).distinct()
    )
