"""Ordered computations that do not put one large key into one task.

Where no key holds more than ``MOST`` rows, a plain window over the keys does. Else rows of a key are cut
into blocks, by time or by position, and each block takes along the rows at its edges that its windows
need (the halo). What must run on past a block, such as the number of a row or the last header
seen, is carried over a small table with one row per block. The rows are the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Rows of a key that one task may sort.
MOST = 1_000_000


def largest(df: DataFrame, keys: Sequence[Column | str]) -> int:
    """Rows of the largest key."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def positions(df: DataFrame, keys: Sequence[str], time: str, tie: str, bucket: int = HOUR, most: int = MOST) -> DataFrame:
    """``df`` with ``pos bigint``: the number (from 1) of the row within its keys, ordered by ``time`` (bigint), then ``tie``.

    Rows of large keys are numbered within buckets of time, finer ones where a bucket still holds too many; the counts of the
    earlier buckets are added. Rows without time are left out. Without keys all rows are numbered through.
    """
    own = df.where(F.col(time).isNotNull())
    if largest(own, keys) <= most:
        return own.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(time, tie)).cast("bigint"))
    while bucket > 1 and largest(own, [*keys, F.floor(F.col(time) / bucket)]) > most:
        bucket = max(1, bucket // 60)
    own = own.withColumn("_b", F.floor(F.col(time) / bucket))
    counts = own.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(time, tie))
    same = F.lit(True)
    for k in (*keys, "_b"):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = own.withColumn("_r", row).alias("l").join(counts.alias("r"), same)
    return joined.select("l.*", "r._before").withColumn("pos", F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")


def in_blocks(df: DataFrame, keys: Sequence[str], at: str, size: int, before: int = 0, after: int = 0, most: int = MOST) -> DataFrame:
    """``df`` in one block where no key is large, else with ``block bigint`` and ``home boolean``: every row in its own block (``home``) and, as halo, in the others
    whose windows reach it. ``before`` and ``after`` are how far a window looks back and ahead along ``at`` (bigint)."""
    if largest(df, keys) <= most:
        return df.withColumn("block", F.lit(0).cast("bigint")).withColumn("home", F.lit(True))
    block = lambda c: F.floor(c / size)
    blocks = F.sequence(block(F.col(at) - after), block(F.col(at) + before))
    return df.withColumn("block", F.explode(blocks)).withColumn("home", F.col("block") == block(F.col(at)))


def carry_last(df: DataFrame, keys: Sequence[str], at: str, value: Column, name: str, size: int, most: int = MOST) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` at or before each row, ordered by ``at`` (bigint, unique within the keys)."""
    if largest(df, keys) <= most:
        line = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, True).over(line))
    own = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(at) / size))
    line = Window.partitionBy(*keys, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_last", F.last("_v", True).over(line))
    ends = own.where("_v is not null").groupBy(*keys, "_b").agg(F.max_by("_v", at).alias("_end"))
    every = own.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*keys, "_b", F.last("_end", True).over(upto).alias("_before"))
    return own.join(every, [*keys, "_b"]).withColumn(name, F.coalesce("_last", "_before")).drop("_v", "_b", "_last", "_before")


def rolling(df: DataFrame, keys: Sequence[str], frames: dict[str, tuple[int, int, Column]], carry: Sequence[str], block: int = 100_000, most: int = MOST) -> DataFrame:
    """Aggregates over row frames ``{name: (first, last, aggregate)}`` relative to the row; needs ``pos`` from ``positions``.

    Returns ``carry``, ``pos`` and the aggregates; rows at the ends of a key have the partial frame.
    """
    back = max(0, *(-first for first, _, _ in frames.values()))
    ahead = max(0, *(last for _, last, _ in frames.values()))
    parts = in_blocks(df, keys, "pos", block, back, ahead, most)
    line = Window.partitionBy(*keys, "block").orderBy("pos")
    for name, (first, last, agg) in frames.items():
        parts = parts.withColumn(name, agg.over(line.rowsBetween(first, last)))
    return parts.where("home").select(*carry, "pos", *frames)


def sta_lta(df: DataFrame, keys: Sequence[str], value: str, short: int, long: int, carry: Sequence[str]) -> DataFrame:
    """``ratio``: mean of the next ``short`` squared values over the mean of the last ``long``, the row included.

    The first ``long - 1`` rows and the last ``short`` rows of a key have 0, as have ratios without a finite value.
    """
    power = F.col(value) * F.col(value)
    frames = {"_s": (1, short, F.sum(power)), "_ns": (1, short, F.count(value)), "_l": (1 - long, 0, F.sum(power)), "_nl": (1 - long, 0, F.count(value))}
    out = rolling(df, keys, frames, carry)
    full = (F.col("_ns") == short) & (F.col("_nl") == long) & (F.col("_l") > 0)
    return out.select(*carry, "pos", F.when(full, F.col("_s") / short / (F.col("_l") / long)).otherwise(0.0).alias("ratio"))


def neighbour_count(df: DataFrame, keys: Sequence[str], time: str, within: int, carry: Sequence[str], block: int = HOUR, most: int = MOST) -> DataFrame:
    """``n``: rows of the same keys less than ``within`` from the row along ``time`` (bigint), itself included."""
    parts = in_blocks(df.where(F.col(time).isNotNull()), keys, time, max(block, within), within, within, most)
    line = Window.partitionBy(*keys, "block").orderBy(time).rangeBetween(1 - within, within - 1)
    return parts.withColumn("n", F.count("*").over(line)).where("home").select(*carry, "n")


def time_islands(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap: int, block: int = HOUR, most: int = MOST) -> DataFrame:
    """``df`` with ``island bigint``: the time of the first row of its island; an island ends before a gap of ``gap`` or more.

    Rows without time are left out.
    """
    own = df.where(F.col(time).isNotNull())
    if largest(own, keys) <= most:
        line = Window.partitionBy(*keys).orderBy(time, tie)
        before = F.lag(time).over(line)
        fresh = own.withColumn("_start", F.when(before.isNull() | (F.col(time) - before >= gap), F.col(time)))
        return fresh.withColumn("island", F.last("_start", True).over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
    rows = positions(df, keys, time, tie, block, most)
    parts = in_blocks(rows, keys, time, max(block, gap), gap, 0, most)
    line = Window.partitionBy(*keys, "block").orderBy(time, tie)
    before = F.lag(time).over(line)
    fresh = F.when(before.isNull() | (F.col(time) - before >= gap), F.col(time))
    starts = parts.withColumn("_start", fresh).where("home").drop("block", "home")
    return carry_last(starts, keys, "pos", F.col("_start"), "island", 100_000, most).drop("_start", "pos")


def runs(df: DataFrame, keys: Sequence[str], value: str, least: int, block: int = 100_000, most: int = MOST) -> DataFrame:
    """Runs of at least ``least`` equal successive values: keys, ``first`` and ``last`` position, ``value``, ``n``. Needs ``pos``; null ends a run."""
    parts = in_blocks(df, keys, "pos", block, 1, 0, most)
    line = Window.partitionBy(*keys, "block").orderBy("pos")
    same = F.col(value).isNotNull() & (F.col(value) == F.lag(value).over(line))
    starts = parts.withColumn("_start", F.when(~F.coalesce(same, F.lit(False)), F.col("pos"))).where("home").drop("block", "home")
    marked = carry_last(starts, keys, "pos", F.col("_start"), "first", block, most).where(F.col(value).isNotNull())
    return marked.groupBy(*keys, "first").agg(F.max("pos").alias("last"), F.first(value).alias("value"), F.count("*").alias("n")).where(F.col("n") >= least)


def turning_points(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key ``first_turn`` and ``second_turn`` as in ``signal.turning_index``, as positions (from 1); 0 where there is none. Needs ``pos``."""
    parts = in_blocks(df, keys, "pos", 100_000, 1, 0)
    line = Window.partitionBy(*keys, "block").orderBy("pos")
    parts = parts.withColumn("_step", F.col(value) - F.lag(value).over(line)).where("home")
    spot, down = F.col("pos") - 1, F.col("_step") < 0
    seen = lambda when: F.greatest(F.min(F.when(when & down, spot)), F.min(F.when(when & ~down, spot)))
    both = F.min(F.when(down, 1)).isNotNull() & F.min(F.when(F.col("_step") > 0, 1)).isNotNull()
    # greatest skips nulls: with both directions there, it is the later of their first steps
    firsts = parts.groupBy(*keys).agg(F.when(both, seen(F.lit(True))).alias("first_turn"))
    later = parts.join(firsts, list(keys)).where(spot > F.col("first_turn"))
    two = F.min(F.when(down, 1)).isNotNull() & F.min(F.when(~down, 1)).isNotNull()
    later = later.groupBy(*keys).agg(F.when(two, seen(F.lit(True))).alias("second_turn"))
    out = firsts.join(later, list(keys), "left")
    return out.select(*keys, F.coalesce("first_turn", F.lit(0)).alias("first_turn"), F.coalesce("second_turn", "first_turn", F.lit(0)).alias("second_turn"))
