"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import written


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _ends(links: DataFrame) -> DataFrame:
    """``a, low, high``: the least and the greatest node that each ``a`` is linked to."""
    return written(links.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")), "ends")


def _large_star(links: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours; as many rows as ``links``."""
    ends = _ends(links.unionByName(_turned(links))) if ends is None else ends
    return _turned(links).join(ends, "a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))


def _small_star(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; ``ends``: of ``links`` as they are."""
    many = ends.filter("low < high")
    if many.isEmpty():
        return ends.select("a", F.col("low").alias("b"))
    rest = links.join(many, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return ends.select("a", F.col("low").alias("b")).unionByName(written(rest, "small-star"))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each node that isn't the smallest of its component, with that smallest one.

    ``links`` has two columns of whole numbers; direction, repeats and links to oneself don't matter. What a round makes is
    written to the shared folder, the result too. A node's links are reduced to their ends, which are written before they meet
    the links: both sides of the join then have a shuffle of their own, and where a node has very many links, the join splits
    them; no component is gathered in one place. The ends also tell when all is done: when each node has only larger
    neighbours, or one. They hold a node's least link once, so that further repeats are not worth a shuffle of all links.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    links = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = written(links, "links")
    while True:
        ends = _ends(links.unionByName(_turned(links)))
        if ends.filter("low < a AND low < high").isEmpty():
            return ends.filter("low < a").select(F.col("a").alias("node"), F.col("low").alias("root"))
        links = written(_large_star(links, ends), "large-star")
        links = _small_star(links, _ends(links))
