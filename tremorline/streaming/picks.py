"""Picks as a stream: islands of origin times by session windows, and the latest rate per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.geo import code


def pick_islands(stream: DataFrame, time: str = "sta_ot", gap: str = "2 seconds", late: str = "10 minutes", least: int = 4) -> DataFrame:
    """``start, last, picks, stations`` of islands with at least ``least`` picks; works on streams and tables alike.

    Days are kept apart, as in the association. An island closes when ``late`` has passed beyond it; later picks are dropped, so ``late`` must exceed the delays of
    the feed. Picks without station or time are left out; a pick delivered twice within ``late`` counts once.
    """
    rows = stream.withColumn("sta", code("net_sta")).where(F.col("sta").isNotNull() & F.col(time).isNotNull())
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["pick_id"]) if stream.isStreaming else rows.dropDuplicates(["pick_id"])
    islands = rows.groupBy(F.to_date(time).alias("day"), F.session_window(time, gap).alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("picks"), F.approx_count_distinct("sta").alias("stations"))
    return islands.where(F.col("picks") >= least).select("start", "last", "picks", "stations")


def station_rates(stream: DataFrame, time: str = "tp", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``sta, start, picks, amp``: picks per station and window, with the mean usable amplitude."""
    rows = stream.withColumn("sta", code("net_sta")).where(F.col("sta").isNotNull() & F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    amp = F.avg(F.when((F.col("s_amp") > 0) & (F.col("s_amp") < float("inf")), F.col("s_amp"))).alias("amp")
    return rows.groupBy("sta", F.window(time, window).alias("w")).agg(F.count("*").alias("picks"), amp).select("sta", F.col("w.start").alias("start"), "picks", "amp")
