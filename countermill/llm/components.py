"""Connected components of a link table by alternating star contraction.

Each round links every node's larger neighbours to its smallest one, then every node and its smaller
neighbours to the smallest of them. Rounds are logarithmic in the number of nodes, each is two
grouped minima on plain columns, and no component's links are ever gathered in memory. Every
round's links are stored, so a lost executor costs a read. Rounds end when the links are stars whose
centres are their smallest nodes, which is seen in one pass over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countermill.llm.common import stored


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with the smallest of u and all its v as `m`."""
    return links.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))


def _round(links: DataFrame) -> DataFrame:
    """A large star, where larger neighbours move, then a small star from the larger end. All u > v after it."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = links.select(F.explode(ends).alias("end")).select("end.u", "end.v")
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    small = _with_least(large).select(F.explode(moved).alias("end")).select("end.u", "end.v")
    return small.where("u <> v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    side = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(0).alias("ends")),
        F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("ends")),
    )
    nodes = links.select(F.explode(side).alias("side")).select("side.*")
    open_nodes = nodes.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max("ends").alias("ends"))
    return open_nodes.where("least <> most or (least is not null and ends = 1)").agg(F.count("*")).first()[0] == 0


def centres(links: DataFrame) -> DataFrame:
    """(u, v) to (node, component) of the nodes that reach a smaller one: the smallest they reach."""
    links = links.select("u", "v").where("u <> v")
    while True:
        links = stored(_round(links))
        if _are_stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(u, v) to (node, component): the smallest node each node reaches. Nodes without links are not in it."""
    found = centres(links)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
