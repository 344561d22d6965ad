"""Exact seeded order and splits of exact sizes, without a window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {sum(ratios)}")


#: Rows of a bucket of seeded_rank, about, which one task sorts.
BUCKET = 1 << 20


def seeded_rank(df: DataFrame, key: str, seed: int = 42, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `rank`, its place (from 1) in the order of md5(seed:key), ties by key, and `total`, the number of rows.

    Rows are ranked in buckets by the first digits of their hash, so many that a bucket holds about BUCKET rows; a bucket starts after the
    rows of those before it. Null keys come last, in the order of a hash of the columns `ties`, which
    spreads them over buckets too; without ties they are one bucket, in any order, and no other column is read.
    """
    digits = max(2, math.ceil(math.log(max(1, df.count() / BUCKET), 16)))
    by_key, by_row = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*ties)) if ties else F.lit("")))
    hashed = df.withColumn("_h", F.coalesce(by_key, F.concat(F.lit("~"), by_row))).withColumn("_b", F.substring("_h", 1, digits + 1))
    hashed = hashed.withColumn("_b", F.when(F.startswith("_h", F.lit("~")), F.col("_b")).otherwise(F.substring("_h", 1, digits)))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # A row for about BUCKET rows of df, and at most 32 times as many. Rows are ranked where they lie by bucket, so that a join by bucket
    # that is not broadcast moves none of them again.
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("total"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_own", own).join(starts, "_b").withColumn("rank", (F.col("_start") + F.col("_own")).cast("long")).drop("_h", "_b", "_own", "_start")


def cut(train: float, val: float, test: float, mode: str) -> Column:
    """The split of a ranked row. mode: "round" (half to even, as the command line tool) or "floor" (as the notebooks)."""
    check_ratios(train, val, test)
    size = {"round": lambda r: F.bround(F.col("total") * F.lit(float(r))), "floor": lambda r: F.floor(F.col("total") * F.lit(float(r)))}[mode]
    n_train = size(train)
    n_val = F.when(n_train + size(val) > F.col("total"), F.col("total") - n_train).otherwise(size(val))
    return F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")


def split_rows(df: DataFrame, key: str, ratios: tuple[float, float, float], mode: str, seed: int = 42) -> DataFrame:
    """df with rank, total and split; splits have exact sizes, and the same rows whatever the input order."""
    return seeded_rank(df, key, seed).withColumn("split", cut(*ratios, mode))


def split_groups(df: DataFrame, group: str, ratios: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """df with split; groups are split by truncation and members follow their group."""
    groups = split_rows(df.select(group).distinct(), group, ratios, "floor", seed).select(group, "split")
    return df.join(groups, group)


def holdout(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with split train or val: max(1, floor(share * n)) rows are val, none if there is a single row."""
    n_val = F.when(F.col("total") > 1, F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(share))))).otherwise(0)
    ranked = seeded_rank(df, key, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train"))


def minibatches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    return seeded_rank(df, key, seed).withColumn("batch", F.floor((F.col("rank") - 1) / F.lit(size)).cast("long"))


def ranked_within(df: DataFrame, key: str, order: Column, *ties: str) -> DataFrame:
    """df with `i`, the place (from 1) of a row among those of its key by order (a column that coarsens what ties sort by) and ties; and `n`, their number.

    A key's rows are ranked in the parts that `order` makes of them, so that one key of very many rows is not the work of one task.
    """
    parts = df.withColumn("_part", order)
    sizes = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(key)
    before = F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(of_key).alias("n"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*ties))
    joined = parts.withColumn("_own", own).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")))
    return joined.withColumn("i", (F.col("_start") + F.col("_own")).cast("long")).drop("_part", "_own", "_key", "_of", "_start")


def exact_median(df: DataFrame, column: str, most: int = 1024, accuracy: int = 1000) -> float | None:
    """The median of a column of doubles (mean of the two middle values), without sorting all of it; nulls and NaN are left out, infinities count.

    Approximate quantiles on both sides of a middle place bracket it, whatever the scale of the values. What lies below and at the ends of the bracket
    is counted exactly; the place is at an end, or strictly between, where a small share of the rows is left. That is repeated until `most` rows are.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    total = rows.count()

    def at(place: int) -> float:
        part, n, width = rows, total, 3.0
        while n > most:
            share = [min(1.0, max(0.0, place / n + d * width / accuracy)) for d in (-1, 1)]
            low, high = part.agg(F.percentile_approx("v", share, accuracy)).first()[0]
            v = F.col("v")
            below, first, inside, last = part.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if((v == high) & (v > low))).first()
            place -= below
            if not 0 <= place < first + inside + last:  # not within the error that was allowed for
                place, width = place + below, 4 * width
            elif place < first:
                return low
            elif place >= first + inside:
                return high
            else:
                part, n, place = part.filter((v > low) & (v < high)), inside, place - first
        return sorted(r.v for r in part.collect())[place]

    return (at((total - 1) // 2) + at(total // 2)) / 2 if total else None
