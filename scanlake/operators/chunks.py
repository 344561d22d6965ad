"""Ordered arrays of a key's rows in chunks of a bounded size, and hash trees over files: no row or task holds all of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.sources.work import written

#: Rows of a range that is ranked in one task; files of a leaf of a hash tree.
RANGE, LEAF = 1 << 20, 4096


def places(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with `i`, the place (from 1) of a row among those of its key by order; rows that are equal in it have any order.

    Rows are dealt to ranges of key and order and written, so a key with very many rows lies in several ranges; a row's place is that in its range
    and the number of the key's rows in the ranges before, of which there is a row for each range.
    """
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE))
    rows = written(df.repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    joined = rows.withColumn("_own", own).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("i", (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_own", "_start", "_key", "_of")


def chunked(df: DataFrame, key: str, order: list[str], value: Column, size: int) -> DataFrame:
    """key, chunk (from 0), n and `found`: the values of a key's rows by order, in arrays of `size` values, the last of a key with what is left."""
    rows = places(df, key, *order).withColumn("chunk", F.floor((F.col("i") - 1) / F.lit(size)).cast("long"))
    lists = rows.groupBy(key, "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("found"))
    return lists.withColumn("found", F.transform("found", lambda s: s["v"]))


def hash_tree(files: DataFrame, digits: int | None = None) -> DataFrame:
    """level, node, n, digest: a tree over files(path, digest), each path once.

    A leaf is the files whose path has a hash with the same first hexadecimal digits, as many as make a leaf about LEAF files; its digest is that of their
    paths and digests by path. A node above has the digest of its up to 16 children in order; level 0 is the whole dataset. A changed file
    changes one node of each level. digits: for trees that are to be compared.
    """
    if digits is None:
        digits, n = 1, files.count()
        while n > LEAF * 16**digits:
            digits += 1
    rows = files.withColumn("node", F.substring(F.md5("path"), 1, digits))
    listed = F.array_sort(F.collect_list(F.struct("path", "digest")))
    joined = F.array_join(F.transform(listed, lambda s: F.concat(s["path"], F.lit(":"), s["digest"])), ",")
    level = rows.groupBy("node").agg(F.count("*").alias("n"), F.md5(joined).alias("digest"))
    level = written(level, "leaves")
    out = level.select(F.lit(digits).alias("level"), "node", "n", "digest")
    for depth in range(digits - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        up = F.array_join(F.transform(children, lambda s: F.concat(s["node"], F.lit(":"), s["digest"])), ",")
        level = level.groupBy(F.substring("node", 1, depth).alias("node")).agg(F.sum("n").alias("n"), F.md5(up).alias("digest"))
        out = out.unionByName(level.select(F.lit(depth).alias("level"), "node", "n", "digest"))
    return out


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, node, n_a, n_b of the nodes whose digests differ between two trees of equal depth; nodes that one lacks have 0 files there."""
    left, right = (t.select("level", "node", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"d_{s}")) for t, s in ((a, "a"), (b, "b")))
    rows = left.join(right, ["level", "node"], "full").filter(~F.col("d_a").eqNullSafe(F.col("d_b")))
    return rows.select("level", "node", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
