"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the same for all nodes of a component.

    In each round the nodes get a random order (a hash of node and round), and every node hooks onto the first node
    within two links of itself. A star hooks onto one node at once, and along a chain about one node in five stays. Each
    pointer is followed twice, and the links are drawn anew between the nodes they reach; loops and repeats go, and with
    them most of the nodes, so the rounds are logarithmic. Hooks and links are written to the shared folder, and both
    sides of each join come from there, so that a hub's rows can be split; nothing is broadcast.
    """
    links = materialise(links.where("a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        number = F.lit(len(rounds))
        both = links.union(links.select("b", "a"))
        near = _first(both, number)
        next_to = near.select(F.col("a").alias("b"), F.col("p").alias("q"))
        beyond = both.join(next_to.hint("merge"), "b").select("a", F.col("q").alias("b"))
        hooks = _first(beyond, number)
        hooks = materialise(_followed(hooks, hooks))
        ends = links.join(hooks.hint("merge"), "a").select(F.col("p").alias("c"), "b")
        ends = ends.join(hooks.withColumnRenamed("a", "b").hint("merge"), "b").select("c", F.col("p").alias("d"))
        links = materialise(ends.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        rounds.append(hooks)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for hooks in rounds[1:]:
        onward = hooks.withColumnRenamed("a", "root")
        roots = materialise(roots.join(onward.hint("merge"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
    return roots


def _first(links: DataFrame, number: Column) -> DataFrame:
    """(a, p): of a node and those it is linked with, the first in the order of this round."""
    best = links.groupBy("a").agg(F.min_by("b", F.xxhash64("b", number)).alias("b"))
    own = F.when(F.xxhash64("b", number) < F.xxhash64("a", number), F.col("b")).otherwise(F.col("a"))
    return materialise(best.select("a", own.alias("p")))


def _followed(hooks: DataFrame, onward: DataFrame) -> DataFrame:
    """(a, p): where the pointer of ``onward`` leads from where that of ``hooks`` leads."""
    further = onward.select(F.col("a").alias("p"), F.col("p").alias("q"))
    return hooks.join(further.hint("merge"), "p").select("a", F.col("q").alias("p"))
