"""Connected components of a table of links, by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import removed, written


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) to (id, component): for each id in a link, the smallest id that it reaches.

    Null ends and links of an id to itself are ignored; repeated links count once; no links give an empty result.
    Each round hooks every group to its smallest neighbouring group, follows hooks to their roots, and relabels the links
    that are left. The number of groups at least halves in two rounds. Tables are written between steps, which cuts
    lineage and leaves both sides of each join free to be split where a key is hot.
    """
    left = written(
        links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    tables = [left]
    found = left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id"))
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"), "hooks")
        tables.append(hooks)
        further = hooks.select(F.col("a").alias("to"), F.col("to").alias("further"))
        while not hooks.join(further, "to", "left_semi").isEmpty():
            hooks = written(hooks.join(further, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "hooks")
            tables.append(hooks)
            further = hooks.select(F.col("a").alias("to"), F.col("to").alias("further"))
        ends = [hooks.select(F.col("a").alias(end), F.col("to").alias(f"{end}_to")) for end in ("a", "b")]
        left = left.join(ends[0], "a", "left").withColumn("a", F.coalesce("a_to", "a")).join(ends[1], "b", "left").withColumn("b", F.coalesce("b_to", "b"))
        left = written(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        tables.append(left)
        found = found.join(hooks.select(F.col("a").alias("component"), F.col("to").alias("root")), "component", "left")
        found = found.select("id", F.coalesce("root", "component").alias("component"))
    found = written(found, "components")
    removed(*tables)
    return found
