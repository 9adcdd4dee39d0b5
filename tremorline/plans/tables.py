"""Clean forms of the domain tables: one row per key, codes and times normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions.geo import code, east, micros
from tremorline.session import load


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pick_id, sta, ot, tp, ts`` (microseconds), ``s_amp`` (-1 is null) and the quality columns."""
    df = load(spark, sf_dir, "picks").dropDuplicates(["pick_id"])
    amp = F.when(F.col("s_amp") != -1, F.col("s_amp"))
    return df.select("pick_id", code("net_sta").alias("sta"), micros("sta_ot").alias("ot"), micros("tp").alias("tp"), micros("ts").alias("ts"), amp.alias("s_amp"), "p_snr", "fd", "amp_ratio", "a12", "a13")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, net, ot, lat, lon, dep, mag, res``."""
    df = load(spark, sf_dir, "evt_catalog").dropDuplicates(["event_id"])
    return df.select("event_id", code("net").alias("net"), micros("evt_ot").alias("ot"), F.col("evt_lat").alias("lat"), east("evt_lon").alias("lon"), F.col("evt_dep").alias("dep"), "mag", "res")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sta, lat, lon, ele_m``, the stations with coordinates."""
    df = load(spark, sf_dir, "stations").where("lat is not null and lon is not null")
    return df.select(code("net_sta").alias("sta"), "lat", "lon", F.coalesce("ele_m", F.lit(0.0)).alias("ele_m")).dropDuplicates(["sta"])


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``det_id, clu_id, temp_id`` (missing is null), ``ot, lat, lon, dep, cc`` (impossible is null), ``picks``."""
    df = load(spark, sf_dir, "detections").dropDuplicates(["det_id"])
    temp = F.trim("temp_id")
    cc = F.when((F.col("cc") > 0) & (F.col("cc") <= 1), F.col("cc"))
    return df.select("det_id", "clu_id", F.when((temp != "") & (temp != "-1"), temp).alias("temp_id"), micros("det_ot").alias("ot"), "lat", east("lon").alias("lon"), "dep", cc.alias("cc"), "picks")


def detection_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station of a detection, the first in its list: ``det_id, sta, ord, dt_p, dt_s, s_amp, cc_p, cc_s``."""
    rows = detections(spark, sf_dir).select("det_id", F.posexplode("picks").alias("ord", "p")).where("p.net_sta is not null")
    rows = rows.select("det_id", code("p.net_sta").alias("sta"), "ord", "p.dt_p", "p.dt_s", "p.s_amp", "p.cc_p", "p.cc_s").where("sta is not null")
    first = rows.groupBy("det_id", "sta").agg(F.min(F.struct("ord", "dt_p", "dt_s", "s_amp", "cc_p", "cc_s")).alias("p"))
    return first.select("det_id", "sta", "p.*")
