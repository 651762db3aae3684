"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node and one join, so a hub is never gathered into
one task. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared


#: Links a file of a round's table holds at least.
LINKS_PER_FILE = 250_000


def _step(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
    return small.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): its smallest node.

    Self-loops and repeated edges are allowed; null ends are dropped.
    """
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND u <> v").distinct()
    links, before = shared.save(start, "links"), None
    for _ in range(rounds):
        after = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        files = after[0] // LINKS_PER_FILE + 1
        new = _step(links)
        new = shared.save(new.coalesce(files) if files < 64 else new, "links")
        shared.drop(links)
        links, before = new, after
    raise RuntimeError("components did not settle")
