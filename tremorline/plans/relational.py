
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions import formats
from tremorline.functions.geo import hypo_km, micros, origin_time, station_magnitude
from tremorline.operators import ordered, ranking
from tremorline.operators.asof import epoch_lookup
from tremorline.operators.greedy import cluster_detections, gap_selection
from tremorline.operators.grid import Grid, padded_cells
from tremorline.operators.rejects import station_table
from tremorline.operators.relocate import relocate_all
from tremorline.operators.spatial import nearest
from tremorline.plans import tables
from tremorline.plans.associate import detection_arrivals
from tremorline.session import cut, join_hot, load

SECOND = 1_000_000
AREA = Grid(lon_min=-42.0, lat_min=48.0, dx=1.0, dy=1.0, nx=4, ny=4, pad=0.1)


def _finite(c: str) -> Column:
    return F.when(F.abs(F.col(c)) < float("inf"), F.col(c))


def _numbered(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    """Picks with a station and a time, numbered per station by time; a sample that is missing or not finite is 0, as in waveforms."""
    rows = tables.picks(spark, sf_dir).where(F.col("sta").isNotNull() & F.col("tp").isNotNull())
    rows = rows.select("pick_id", "sta", "tp", F.coalesce(_finite(value), F.lit(0.0)).alias(value))
    return ordered.positions(cut(rows, "samples"), ["sta"], "tp", "pick_id")


def o05_gain_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_table(load(spark, sf_dir, "station_lines")).select("net_sta", "lat", "lon", "ele_m", "ge", "gn", "gz", "t0", "t1").distinct()


def o06_gain_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = epoch_lookup(load(spark, sf_dir, "picks"), load(spark, sf_dir, "gain_epochs"), "pick_id", "net_sta", "tp", "epoch_id", "net_sta", "t0", "t1")
    return got.withColumnRenamed("event_id", "pick_id")


def o30_origin_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.picks(spark, sf_dir).where("tp is not null and ts >= tp")
    return rows.select("pick_id", F.round(origin_time(F.col("tp") / 1e6, F.col("ts") / 1e6), 3).alias("ot"))


def _magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station magnitudes of detections; a station is joined by its code, a table of fixed size."""
    dets = tables.detections(spark, sf_dir).select("det_id", F.col("lat").alias("elat"), F.col("lon").alias("elon"), "dep").where("elat is not null and elon is not null and dep is not null")
    rows = tables.detection_picks(spark, sf_dir).join(dets, "det_id").join(tables.stations(spark, sf_dir), "sta")
    km = hypo_km(F.col("elat"), F.col("elon"), F.col("dep"), F.col("lat"), F.col("lon"), F.col("ele_m"))
    return rows.select("det_id", "sta", "ord", "cc_p", km.alias("km"), station_magnitude(F.col("s_amp"), km).alias("mag"))


def o32_station_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _magnitudes(spark, sf_dir).select("det_id", "sta", F.round("km", 6).alias("km"), F.round("mag", 6).alias("mag"))


def o56_event_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.median_without_outlier(_magnitudes(spark, sf_dir), ["det_id"], "mag", ["ord"])
    return got.select("det_id", F.round("median", 6).alias("mag"), "n")


def o36_rounded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its five rounded columns; a missing or infinite value is null."""
    digits = {"lon": 2, "lat": 2, "dep": 0, "res": 1, "mag": 2}
    return tables.catalog(spark, sf_dir).select("event_id", *[F.bround(_finite(c), n).alias(c) for c, n in digits.items()])


o36_rounded_events = o36_rounded_columns


def o34_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.catalog(spark, sf_dir).where("ot is not null").select("event_id", formats.compact_time(F.col("ot")).alias("name"))


def o33_degree_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.catalog(spark, sf_dir).where("lat is not null and lon is not null")
    lat, lon = formats.degree_minutes(F.col("lat"), "N", "S", 2), formats.degree_minutes(F.col("lon"), "E", "W", 3)
    return rows.select("event_id", lat.alias("lat"), lon.alias("lon"))


def o37_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ot = micros(F.lit("2000-02-01").cast("timestamp")), micros(F.lit("2000-03-01").cast("timestamp"))
    rows = tables.catalog(spark, sf_dir).where((F.col("ot") > ot[0]) & (F.col("ot") < ot[1]))
    return rows.where("lat > 49 and lat < 51 and lon > -41 and lon < -39").select("event_id", "lat", "lon")


def o38_known_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of stations that the table has coordinates for."""
    return tables.picks(spark, sf_dir).join(tables.stations(spark, sf_dir).select("sta"), "sta", "left_semi").select("pick_id", "sta")


def o39_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks with their verdict; a missing measure fails."""
    good = (F.col("fd") > 2.5) & (F.col("amp_ratio") < 5) & (F.col("a12") < 8) & (F.col("a13") < 3)
    return tables.picks(spark, sf_dir).select("pick_id", F.coalesce(good, F.lit(False)).alias("good"))


def o41_flat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more steps of zero, which are four or more equal samples."""
    return ordered.runs(_numbered(spark, sf_dir, "s_amp"), ["sta"], "s_amp", 4)


def o43_sta_lta(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.sta_lta(_numbered(spark, sf_dir, "p_snr"), ["sta"], "p_snr", 4, 16, ["pick_id"])
    return got.select("pick_id", F.round("ratio", 6).alias("ratio"))


def o44_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"k": (-9, 0, F.kurtosis("p_snr")), "n": (-9, 0, F.count("p_snr")), "low": (-9, 0, F.min("p_snr")), "high": (-9, 0, F.max("p_snr"))}
    got = ordered.rolling(_numbered(spark, sf_dir, "p_snr"), ["sta"], frames, ["pick_id"])
    return got.where("n = 10 and low < high").select("pick_id", F.round("k", 6).alias("kurtosis"))


def o47c_turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.turning_points(_numbered(spark, sf_dir, "p_snr"), ["sta"], "p_snr")


def o47e_rolling_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.rolling(_numbered(spark, sf_dir, "p_snr"), ["sta"], {"s": (1, 8, F.sum(F.col("p_snr") * F.col("p_snr")))}, ["pick_id"])
    return got.select("pick_id", F.round(F.sqrt(F.coalesce("s", F.lit(0.0))), 6).alias("norm"))


def o48_nearest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen stations of each detection with the earliest P."""
    got = ranking.top_k(detection_arrivals(spark, sf_dir), ["det_id"], [F.col("tp"), F.col("sta")], 15)
    return got.select("det_id", "sta", "rank")


def o51_gap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_selection(tables.picks(spark, sf_dir).where("sta is not null"), ["sta"], "tp", "pick_id", 600 * SECOND)


def o53_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbour_count(tables.picks(spark, sf_dir), [], "ot", 60 * SECOND, ["pick_id"])


def o54_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.time_islands(tables.picks(spark, sf_dir), [], "ot", "pick_id", 60 * SECOND).select("pick_id", "island")


def o57_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located events that serve as templates, with the number of their detections."""
    used = tables.detections(spark, sf_dir).groupBy(F.col("temp_id").try_cast("bigint").alias("event_id")).agg(F.count("*").alias("n"))
    return tables.catalog(spark, sf_dir).join(used, "event_id").select("event_id", "lat", "lon", "n")


def o58_event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of detections with the magnitude of the template's event."""
    dets = tables.detections(spark, sf_dir).select("det_id", F.col("temp_id").try_cast("bigint").alias("event_id"))
    mags = tables.catalog(spark, sf_dir).select("event_id", "mag")
    return tables.detection_picks(spark, sf_dir).join(dets, "det_id").join(mags, "event_id").select("det_id", "sta", "event_id", "mag")


def o59_enough_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tables.detection_picks(spark, sf_dir).join(tables.stations(spark, sf_dir).select("sta"), "sta")
    return known.groupBy("det_id").agg(F.count("*").alias("stations")).where("stations >= 4")


def o60_all_template_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template with every day from the first detection of all to the last (keys only)."""
    dets = tables.detections(spark, sf_dir).where("ot is not null")
    day = F.to_date(F.timestamp_micros("ot"))
    first, last = dets.agg(F.min(day), F.max(day)).first()
    temps = dets.where("temp_id is not null").select("temp_id").distinct()
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return temps.select("temp_id", F.explode(days).alias("day")).select("temp_id", F.col("day").cast("string").alias("day"))


o60_template_days = o60_all_template_days


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the clusters are made of: detections of known templates, with the template's time."""
    dets = tables.detections(spark, sf_dir).where("cc >= 0.2 and temp_id is not null")
    temps = tables.catalog(spark, sf_dir).select(F.col("event_id").cast("string").alias("temp_id"), F.col("ot").alias("temp_ot"))
    return dets.join(temps, "temp_id").select("det_id", "temp_id", "ot", "cc", "temp_ot", F.size("picks").alias("n_picks"))


def o70_detection_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of one shock, each cluster seeded by the first remaining one (O-70, O-71)."""
    return cluster_detections(clustered(spark, sf_dir), 2 * SECOND)


def o72_neighbour_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of clusters with two or more detections the thirty with the greatest correlation, and ties."""
    rows = tables.detections(spark, sf_dir).where("cc is not null and clu_id is not null")
    many = rows.groupBy("clu_id").agg(F.count("*").alias("n")).where("n >= 2").select("clu_id")
    return ranking.cap_with_ties(join_hot(rows, many, "clu_id"), ["clu_id"], [F.col("cc").desc()], 30).select("clu_id", "det_id", "cc", "rank")


def o73_mean_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.detections(spark, sf_dir).where("clu_id is not null")
    mean = lambda c: F.round(F.avg(c), 8).alias(c)
    return rows.groupBy("clu_id").agg(mean("lat"), mean("lon"), mean("dep"), F.count("*").alias("n"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = lambda c: F.when(F.col(c) != -1, F.col(c)).alias(c)
    return load(spark, sf_dir, "dt_cc").select(present("evid1"), present("evid2"), "sta", "dt", "weight", "phase").where("evid1 is not null and evid2 is not null")


def o74_weighted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, sf_dir).where("abs(dt) <= 0.5 and weight >= 0.3")
    return rows.select("evid1", "evid2", "sta", "dt", F.round(F.sqrt("weight"), 6).alias("weight"), "phase").distinct()


def o75_unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.unique_pairs(_links(spark, sf_dir), "evid1", "evid2", "sta", 4)


def o76_running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.positions(tables.catalog(spark, sf_dir), [], "ot", "event_id").select("event_id", F.col("pos").alias("evid"))


def o77_padded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padded_cells(tables.catalog(spark, sf_dir), "lat", "lon", AREA).select("event_id", "i", "j", "is_home")


def o81_relocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placed event with links, relocated by all differential times at once (O-81)."""
    sites = tables.stations(spark, sf_dir).withColumn("sta", F.substring_index("sta", ".", -1)).dropDuplicates(["sta"])  # links name no network
    got = relocate_all(tables.catalog(spark, sf_dir).select("event_id", "lat", "lon", "dep"), _links(spark, sf_dir), sites)
    return got.select("event_id", *[F.round(c, 4).alias(c) for c in ("lat", "lon", "dep", "rms")], "links")


def o79_best_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best solution of each network and day: least residual, then greatest magnitude (one that is not finite last), then id."""
    rows = tables.catalog(spark, sf_dir).where("ot is not null and net is not null and res is not null").withColumn("day", F.to_date(F.timestamp_micros("ot")).cast("string"))
    order = [F.col("res"), _finite("mag").isNull(), -F.coalesce(_finite("mag"), F.lit(0.0)), F.col("event_id")]
    return ranking.best_row(rows, ["net", "day"], order, ["event_id", "res"])


o79_best_solution = o79_best_of_all


def o80_event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest events within 5 km (hypocentral) of each event."""
    return nearest(tables.catalog(spark, sf_dir), "event_id", "lat", "lon", "dep", 5.0, 10).select("id", "other", "rank")


def o83_first_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each station in the station files."""
    rows = station_table(load(spark, sf_dir, "station_lines"))
    return ranking.best_row(rows, ["net_sta"], [F.col("line_no")], ["line_no", "lat", "lon"])


def o84_all_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenation of events and detections with a place."""
    parts = [d.where("lat is not null and lon is not null").select(F.lit(n).alias("kind"), F.col(i).alias("id"), "lat", "lon") for n, i, d in (("event", "event_id", tables.catalog(spark, sf_dir)), ("detection", "det_id", tables.detections(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


def o85_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks per segment of 30 days."""
    start = micros(F.lit("2000-01-01").cast("timestamp"))
    rows = tables.picks(spark, sf_dir).where("tp is not null").withColumn("segment", F.floor((F.col("tp") - start) / (30 * 86400 * SECOND)))
    return rows.groupBy("segment").agg(F.count("*").alias("picks"), F.count_distinct("sta").alias("stations"))


def o20_all_catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every event with a time and a place; a magnitude that is missing or not finite is written as -1."""
    rows = tables.catalog(spark, sf_dir).where("ot is not null and lat is not null and lon is not null and dep is not null")
    mag = F.coalesce(_finite("mag"), F.lit(-1.0))
    return rows.select("event_id", formats.catalog_line(F.col("ot"), F.col("lat"), F.col("lon"), F.col("dep"), mag).alias("line"))


o20_catalog_lines = o20_all_catalog_lines


def o11_phase_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as header and phase lines and read back (O-09 to O-12, O-22)."""
    lines = formats.detection_lines(tables.detections(spark, sf_dir).where("ot is not null and lat is not null and lon is not null and dep is not null and cc is not null and temp_id is not null"))
    got = formats.read_blocks(lines)
    return got.groupBy("head").agg(F.count("line").alias("phases"))


def o25_phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.picks(spark, sf_dir).where("tp is not null and ts >= tp and sta is not null")
    return rows.select("pick_id", formats.hypoinverse_phase(F.col("sta"), F.col("tp"), F.col("ts")).alias("line"))


def lineitem_best_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-56 on another table: the median price per supplier without its outlier."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    got = ranking.median_without_outlier(rows, ["l_suppkey"], "price", ["l_orderkey"])
    return got.select("l_suppkey", F.round("median", 4).alias("price"), "n")


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-54 on another table: islands of events per type with gaps of ten minutes."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("t"))
    got = ordered.time_islands(rows, ["event_type"], "t", "event_id", 600 * SECOND)
    return got.groupBy("event_type", "island").agg(F.count("*").alias("n"))


def embeddings_template_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-62 at zero lag: normalised correlation of every vector with the first vector of its label."""
    vecs = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    temps = vecs.groupBy("label").agg(F.min(F.struct("vec_id", "v")).alias("t")).select("label", F.col("t.vec_id").alias("temp_id"), F.col("t.v").alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cc = dot("v", "t") / F.sqrt(dot("v", "v") * dot("t", "t"))
    return vecs.join(temps, "label").select("vec_id", "temp_id", F.round(cc, 5).alias("cc"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and (name[:1] == "o" and name[1:3].isdigit() or name in ("lineitem_best_supplier", "events_sessions", "embeddings_template_cc"))}
