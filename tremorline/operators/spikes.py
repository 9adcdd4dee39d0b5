"""Implausible readings per source: state-space forecasts, withheld updates, stuck values.

Every source has two state-space models. The first holds the level of its readings (a mean-reverting
state around the source's usual level, with observation noise as wide as the source's own spread); a
reading whose standardised innovation exceeds the gate is flagged and its update withheld, so a spike
cannot drag the forecast along. The second is the pure random walk without observation noise, whose
innovation is the step from the reading before; where the variance of its last innovations vanishes, the
sensor is stuck.

The readings are sorted over the cluster by source and time and cut where a task's share ends, so that one
source with a third of all rows becomes many blocks. A block goes on from the state in which the block
before it ended: all blocks start at the usual level first, and those whose true start differs run
again from it, until no start changes. As the filter forgets, two rounds are the rule. Runs of equal readings that
cross blocks are found from the first and last readings of the blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.functions.geo import code, micros
from tremorline.session import cut, small_side, spread


#: Decimals of the (log10) readings whose counts give a source's level and spread; they bound the counts of a source.
DIGITS = 3


@dataclass(frozen=True)
class ReadingRule:
    """What a reading may be. ``limit`` is in units of the (log10) value."""

    log10: bool
    limit: float
    missing: float | None = None
    low: float | None = None
    high: float | None = None
    run: int = 5
    gate: float = 3.0
    phi: float = 0.98
    block_rows: int = 250_000


AMPLITUDE = ReadingRule(log10=True, limit=2.0, missing=-1.0)
MAGNITUDE = ReadingRule(log10=False, limit=3.0, low=-5.0, high=10.0)


#: The state of a source's level: its deviation from the usual level and the variance of that.
State = tuple[float, float]


def filter_level(z: np.ndarray, r: float, gate: float, phi: float, state: State | None = None) -> tuple[np.ndarray, np.ndarray, State]:
    """Standardised innovations of readings ``z`` (as deviations from the usual level), the flags, and the last state.

    Without a ``state`` the filter starts at the usual level; a flagged reading does not update it. ``r`` is the variance of the
    observations.
    """
    q, phi2, gate2 = 0.01 * r, phi * phi, gate * gate
    x, p = state or (0.0, 0.25 * r)
    score, flag = [0.0] * len(z), [False] * len(z)
    for i, y in enumerate(z.tolist()):
        x *= phi
        p = phi2 * p + q
        v, s = y - x, p + r
        score[i] = v / s**0.5
        if v * v > gate2 * s:
            flag[i] = True
        else:
            k = p / s
            x += k * v
            p *= 1.0 - k
    return np.array(score, "f8"), np.array(flag, bool), (x, p)


def level_innovations(z: np.ndarray, r: float, gate: float, phi: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and flags of ``filter_level`` from the usual level on."""
    return filter_level(z, r, gate, phi)[:2]


def stuck_members(y: np.ndarray, run: int) -> np.ndarray:
    """Members of runs of at least ``run`` equal values; NaN ends a run.

    The innovations of the random walk are the steps. Where the mean square of the last ``run - 1`` of them vanishes, those
    ``run`` readings are marked.
    """
    out, need = np.zeros(len(y), bool), run - 1
    if len(y) < run:
        return out
    innovations = np.diff(y)
    variance = np.zeros(len(y) - need)
    for k in range(need):  # sums of squares: zero only if every step is
        variance += innovations[k : k + len(variance)] ** 2 / need
    at = np.flatnonzero(variance == 0)
    for k in range(run):
        out[at + k] = True
    return out


def flag_readings(df: DataFrame, id_col: str, source_col: str, time_col: str, value_col: str, rule: ReadingRule) -> DataFrame:
    """Rows ``(row_id bigint, reason string, score double)``: one per flagged reading and reason.

    Reasons: ``impossible``, ``spike`` (flagged by the forecast and beyond ``limit`` from the source's
    median), ``jump`` (flagged by the forecast alone), ``stuck``. ``score`` is the standardised innovation. Null readings and the missing mark are no readings. Rows without source can only
    be impossible, rows without time only impossible or a spike (against the source's usual level).
    Whole repeated rows count once; ties in time are ordered by id. An empty table gives no rows; other
    columns are not read.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("id"), code(source_col).alias("source"), micros(time_col).alias("t"), F.col(value_col).cast("double").alias("y"))
    base = base.where(F.col("y").isNotNull())
    y = F.col("y")
    finite = ~(F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    ok = finite & (y > 0) if rule.log10 else finite & (y >= rule.low) & (y <= rule.high)
    if rule.missing is not None:
        base = base.where(F.col("y") != rule.missing)
    base = base.withColumn("ok", ok)
    wrong = base.where(~F.col("ok")).select(F.col("id").alias("row_id"), F.lit("impossible").alias("reason"), F.lit(None).cast("double").alias("score"))

    sourced = base.where("source is not null").select("source", "t", "id", "y", "ok")
    blocks = max(1, math.ceil(sourced.count() / rule.block_rows))
    # sorted over the cluster; repeated rows lie in one partition, so dropping them needs no further shuffle
    sorted_rows = sourced.repartitionByRange(blocks, "source", "t", "id").dropDuplicates(["source", "t", "id"])
    readings = cut(sorted_rows.withColumn("block", F.spark_partition_id()), "sorted")
    z = F.when(F.col("ok"), F.log10("y") if rule.log10 else F.col("y"))
    levels = small_side(_quartiles(readings.where("ok").select("source", F.round(z, DIGITS).alias("z"))), "levels")
    readings = readings.join(levels, "source", "left")

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _flag_block(key, pdf, rule)

    none = F.lit(None).cast("double")
    found = cut(spread(readings.select("*", none.alias("x0"), none.alias("p0")), "source", "block").groupBy("source", "block").applyInPandas(kernel, FOUND), "flags")
    assumed = None  # the starts that ``found`` was made with
    while blocks > 1:
        line = Window.partitionBy("source").orderBy("block")
        starts = found.where("reason = 'state'").select("source", "block", F.lag("x").over(line).alias("x0"), F.lag("p").over(line).alias("p0")).where("x0 is not null")
        starts = cut(starts, "starts")  # a row per block that goes on from another
        todo = starts if assumed is None else starts.join(assumed, ["source", "block", "x0", "p0"], "left_anti")
        if not todo.limit(1).count():
            break
        todo, assumed = small_side(todo, "again"), starts
        again = spread(readings.join(todo, ["source", "block"]), "source", "block").groupBy("source", "block").applyInPandas(kernel, FOUND)
        found = cut(found.join(todo.select("source", "block"), ["source", "block"], "left_anti").unionByName(again), "flags")

    line = Window.partitionBy("source").orderBy("t", "row_id")
    edges = found.where("reason = 'edge'").withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    same = (F.col("y") == F.lag("y").over(line)) & ~F.lag("far").over(line)
    edges = edges.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    crossing = edges.withColumn("n", F.count("*").over(Window.partitionBy("source", "island"))).where((F.col("n") >= rule.run) & F.col("y").isNotNull())
    crossing = crossing.select("row_id", F.lit("stuck").alias("reason"), F.lit(0.0).alias("score"))
    inner = found.where("reason not in ('edge', 'state')").select("row_id", "reason", "score")
    return wrong.unionByName(inner).unionByName(crossing).dropDuplicates(["row_id", "reason"])


def _quartiles(values: DataFrame) -> DataFrame:
    """``source, q``: the quartiles of ``z`` (the first value that so many are at or below), from counts per value, however the rows are divided."""
    counts = values.groupBy("source", "z").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("z").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    return counts.groupBy("source").agg(F.array(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * f), F.col("z"))) for f in (0.25, 0.5, 0.75)]).alias("q"))


FOUND = "row_id bigint, reason string, score double, source string, block int, t bigint, y double, far boolean, x double, p double"


def _flag_block(key: tuple, pdf: pd.DataFrame, rule: ReadingRule) -> pd.DataFrame:
    """The flags of one source's readings in one block, its first and last readings (``edge``) and the last ``state``."""
    pdf = pdf.sort_values(["t", "id"], kind="stable", na_position="first")
    ids, y, good, timed = pdf["id"].to_numpy(), pdf["y"].to_numpy("f8"), pdf["ok"].to_numpy(bool), pdf["t"].notna().to_numpy()
    out = []  # (rows, reason, score, far)
    state = (np.nan, np.nan)
    if good.any():
        q1, usual, q3 = pdf["q"].iloc[0]
        sd = max((q3 - q1) / 1.349, rule.limit / 40)
        z = np.zeros(len(y))
        z[good] = (np.log10(y[good]) if rule.log10 else y[good]) - usual
        score, flag = z / (1.25**0.5 * sd), np.abs(z) > rule.gate * 1.25**0.5 * sd  # without time: held against the usual level
        line, x0 = np.flatnonzero(good & timed), pdf["x0"].iloc[0]
        start = None if pd.isna(x0) else (float(x0), float(pdf["p0"].iloc[0]))
        score[line], flag[line], state = filter_level(z[line], sd * sd, rule.gate, rule.phi, start)
        far = np.abs(z) > rule.limit
        for reason, hit in (("spike", good & flag & far), ("jump", good & flag & ~far)):
            out.append((np.flatnonzero(hit), reason, score[hit], False))
    elif not pd.isna(pdf["x0"].iloc[0]):  # nothing to learn here: the state goes on
        state = (float(pdf["x0"].iloc[0]), float(pdf["p0"].iloc[0]))
    line = np.flatnonzero(timed)
    held, n, k = line[stuck_members(np.where(good, y, np.nan)[line], rule.run)], len(line), rule.run - 1
    keep = np.arange(n) if n <= 2 * k else np.r_[0:k, n - k : n]
    out += [(held, "stuck", np.zeros(len(held)), False), (line[keep], "edge", np.zeros(len(keep)), (keep == k - 1) & (n > 2 * k))]
    at = np.concatenate([o[0] for o in out])
    made = pd.DataFrame({
        "row_id": ids[at], "reason": np.array([o[1] for o in out for _ in o[0]], object), "score": np.concatenate([o[2] for o in out]), "source": key[0], "block": key[1],
        "t": pdf["t"].fillna(0).to_numpy("i8")[at], "y": np.where(good, y, np.nan)[at], "far": np.concatenate([np.broadcast_to(o[3], len(o[0])) for o in out]), "x": np.nan, "p": np.nan,
    })
    last = pd.DataFrame({"row_id": [-1], "reason": ["state"], "score": [0.0], "source": [key[0]], "block": [key[1]], "t": [0], "y": [np.nan], "far": [False], "x": [state[0]], "p": [state[1]]})
    return pd.concat([made, last], ignore_index=True) if len(made) else last
