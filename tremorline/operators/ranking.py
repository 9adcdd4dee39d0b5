"""Choosing rows within groups: best candidates, top-k, caps with ties, outlier-free medians, unique pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.operators.ordered import largest
from tremorline.session import cut


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the least ``order`` in each group, by a combinable minimum: a hot group is reduced before the shuffle.

    Each order column must be orderable inside a struct; nulls come first. Ties are settled by ``keep`` itself.
    """
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("_row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("_m")).select(*keys, "_m._row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` (Spark limits each group before the shuffle)."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def cap_with_ties(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows at least as good as the ``k``-th best of their group; ties with it are kept."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.rank().over(line)).where(F.col("rank") <= k)


def median_without_outlier(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], most: int = 100_000) -> DataFrame:
    """Per group ``median`` after the one value farthest from the median was left out (the first by ``tie`` of those equal to 1e-9), and ``n``, all its values.

    Groups of one value have a null median. Null and NaN values do not count. Groups of up to ``most`` rows are handled as arrays; if one
    is larger, all go by joins, which split it.
    """
    own = cut(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)]), "values")
    ties = [f"_t{i}" for i in range(len(tie))]
    if largest(own, keys) <= most:
        rows = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_v", *ties))).alias("a")).withColumn("n", F.size("a").cast("bigint"))
        at = lambda k: F.get("a", k.cast("int"))["_v"]
        half = lambda k: F.floor(k / 2)
        rows = rows.withColumn("mid", (at(half(F.col("n") - 1)) + at(half(F.col("n")))) / 2)
        away = F.transform("a", lambda x, i: F.struct((-F.round(F.abs(x["_v"] - F.col("mid")), 9)).alias("d"), *[x[t].alias(t) for t in ties], i.alias("i")))
        rows = rows.withColumn("out", F.array_min(away)["i"])
        rest = lambda k: at(k + F.when(k >= F.col("out"), 1).otherwise(0))
        return rows.select(*keys, F.when(F.col("n") > 1, (rest(half(F.col("n") - 2)) + rest(half(F.col("n") - 1))) / 2).alias("median"), "n")
    medians = own.groupBy(*keys).agg(F.median("_v").alias("_median"))
    dev = own.join(medians, list(keys)).withColumn("_dev", F.round(F.abs(F.col("_v") - F.col("_median")), 9))
    worst = dev.groupBy(*keys).agg(F.min(F.struct((-F.col("_dev")).alias("d"), *ties)).alias("_w"))
    same = F.lit(True)
    for t in ties:
        same = same & F.col(t).eqNullSafe(F.col(f"_w.{t}"))
    rest = dev.join(worst, list(keys))
    return rest.groupBy(*keys).agg(F.median(F.when(~same, F.col("_v"))).alias("median"), F.count("*").alias("n"))


def unique_pairs(df: DataFrame, a: str, b: str, station: str, least: int) -> DataFrame:
    """Undirected pairs ``a < b`` with their rows ``n`` and distinct stations, from ``least`` stations on. Missing ids and self pairs are left out."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(station).alias("s"))
    sums = pairs.groupBy("a", "b", "s").agg(F.count("*").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("s").alias("stations"))
    return sums.where(F.col("stations") >= least)
