"""Queries p1, p3, p4 and p5 of TESTDATA.md on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators.asof import as_known
from tremorline.operators.rejects import split_rows, station_table
from tremorline.operators.spatial import near_pairs, near_sites, regions_of, triangles
from tremorline.operators.spikes import AMPLITUDE, MAGNITUDE, flag_readings
from tremorline.session import load


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tab, row_id, reason``: every flagged reading with each of its reasons."""
    picks = flag_readings(load(spark, sf_dir, "picks"), "pick_id", "net_sta", "tp", "s_amp", AMPLITUDE)
    mags = flag_readings(load(spark, sf_dir, "evt_catalog"), "event_id", "net", "evt_ot", "mag", MAGNITUDE)
    tabs = [d.select(F.lit(t).alias("tab"), "row_id", "reason") for t, d in (("picks", picks), ("evt_catalog", mags))]
    return tabs[0].unionByName(tabs[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_flags(spark, sf_dir).where("reason <> 'jump'").select("tab", "row_id").dropDuplicates()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = as_known(load(spark, sf_dir, "picks"), load(spark, sf_dir, "gain_epochs"), "pick_id", "net_sta", "tp", "epoch_id", "net_sta", "t0", "t1", "known_at")
    return got.select(F.col("event_id").alias("pick_id"), F.col("attr_id").alias("epoch_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(load(spark, sf_dir, "station_lines"), "line").where("reason is not null").select("line_no", "reason")


def p4_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing lines with the position of their first broken field."""
    return split_rows(load(spark, sf_dir, "station_lines"), "line").where("reason is not null").select("line_no", "reason", "broken")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of the station files."""
    return station_table(load(spark, sf_dir, "station_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, stations = load(spark, sf_dir, "evt_catalog"), load(spark, sf_dir, "stations")
    args = (events, "event_id", "evt_lat", "evt_lon")
    pairs = near_pairs(*args, km=0.06).select(F.col("id").alias("event_id"), F.lit("event").alias("kind"), F.col("other").cast("string").alias("other"))
    sites = near_sites(*args, stations, "net_sta", "lat", "lon", km=6.0).select(F.col("id").alias("event_id"), F.lit("station").alias("kind"), F.col("site").alias("other"))
    inside = regions_of(*args, triangles(load(spark, sf_dir, "zones"), "zone_id", "ring_lon", "ring_lat")).select(F.col("id").alias("event_id"), F.lit("zone").alias("kind"), F.col("region").alias("other"))
    return pairs.unionByName(sites).unionByName(inside)


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p3_found": p3_found, "p4_found": p4_found, "p4_broken": p4_broken, "p4_rows": p4_rows, "p5_found": p5_found}
