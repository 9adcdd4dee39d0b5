"""From detections to links between events (O-70 to O-76), phases of associated events (O-21), and amplitudes by gain (O-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions import formats
from tremorline.operators import ordered
from tremorline.operators.asof import epoch_lookup
from tremorline.operators.greedy import linked_clusters
from tremorline.operators.ranking import best_row
from tremorline.plans import tables
from tremorline.plans.associate import associate, detection_arrivals
from tremorline.plans.relational import SECOND, clustered
from tremorline.session import cut, load

# Fixed values, as surveyed (O-72 to O-76): smallest and greatest number of links, greatest differences of P and S in seconds,
# smallest correlation of a pick, stations of a pair, numbers per worker and days per worker.
LINKS, DT_P, DT_S, CC_PICK, MIN_STA = (2, 30), 0.6, 1.0, 0.4, 4
STRIDE, WORKER_DAYS = 10_000_000_000, 60
DAY = 86_400 * SECOND


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that are kept, numbered in the order of their seeds (those not kept are counted too): ``evid`` is the template's own
    event for a self detection, else a new number."""
    found = cut(linked_clusters(clustered(spark, sf_dir), 2 * SECOND, LINKS[1]), "clusters")
    numbered = ordered.positions(found, [], "seed", "event", bucket=100_000)
    temps = tables.detections(spark, sf_dir).select(F.col("det_id").alias("event"), F.col("temp_id").cast("bigint").alias("own"))
    evid = F.when(F.col("is_self"), F.col("own")).otherwise(F.lit(STRIDE) + F.col("pos") - 1)
    return numbered.where(F.col("is_self") | (F.col("links") >= LINKS[0])).join(temps, "event").select("seed", "event", "is_self", "ot", "linked", evid.alias("evid"))


def o71_cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections that every kept cluster links to its event."""
    return _clusters(spark, sf_dir).select("evid", "event", F.explode("linked").alias("det_id"))


def o73_initial_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a kept cluster's event is sought first: at its own template, else at the mean of its links' templates."""
    kept = _clusters(spark, sf_dir).select("evid", "event", F.explode(F.when(F.col("is_self"), F.array("event")).otherwise(F.col("linked"))).alias("det_id"))
    temps = tables.detections(spark, sf_dir).select("det_id", F.col("temp_id").cast("bigint").alias("event_id"))
    places = tables.catalog(spark, sf_dir).select("event_id", "lat", "lon", "dep")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return kept.join(temps, "det_id").join(places, "event_id").groupBy("evid", "event").agg(mean("lat"), mean("lon"), mean("dep"), F.count("*").alias("templates"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per link and phase; a detection's differences are corrected by how much later than the event it is."""
    kept = _clusters(spark, sf_dir).select("seed", "evid", F.col("ot").alias("event_ot"), F.explode("linked").alias("det_id"))
    dets = tables.detections(spark, sf_dir).select("det_id", F.col("temp_id").cast("bigint").alias("temp"), "ot")
    rows = kept.join(dets, "det_id").join(tables.detection_picks(spark, sf_dir), "det_id")
    late = (F.col("ot") - F.col("event_ot")) / 1e6
    phase = lambda name, dt, cc, most: F.struct(F.lit(name).alias("phase"), (F.col(dt) + late).alias("dt"), F.col(cc).alias("cc"), F.lit(most).alias("most"))
    rows = rows.withColumn("p", F.explode(F.array(phase("P", "dt_p", "cc_p", DT_P), phase("S", "dt_s", "cc_s", DT_S))))
    rows = rows.where((F.abs("p.dt") <= F.col("p.most")) & (F.col("p.cc") >= CC_PICK))
    return rows.select("seed", "evid", "temp", "det_id", "sta", F.round("p.dt", 6).alias("dt"), F.round(F.sqrt("p.cc"), 4).alias("weight"), "p.phase")


def o74_detection_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("evid", "temp", "det_id", "sta", "dt", "weight", "phase")


def link_blocks(links: DataFrame, a: str, b: str, block: list[str], station: str, least: int) -> DataFrame:
    """Of every undirected pair the block with the most rows (of equal ones the last by ``block``), if it names ``least`` stations: ``a < b``, block, ``n, stations``."""
    own = links.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))
    sums = own.groupBy("a", "b", *block, F.col(station).alias("_s")).agg(F.count("*").alias("n")).groupBy("a", "b", *block).agg(F.sum("n").alias("n"), F.count("_s").alias("stations"))
    best = best_row(sums, ["a", "b"], [-F.col("n"), *[-F.col(c) for c in block]], [*block, "n", "stations"])
    return best.where(F.col("stations") >= least)


def o75_link_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of one detection are a block; they come in the order of the clusters."""
    return link_blocks(_links(spark, sf_dir), "evid", "temp", ["seed", "det_id"], "sta", MIN_STA).select("a", "b", "det_id", "n", "stations")


def o75_pair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the table of links a block is what stands under a pair in one order of its events."""
    rows = load(spark, sf_dir, "dt_cc").where("evid1 <> -1 and evid2 <> -1 and evid1 <> evid2").distinct()
    return link_blocks(rows, "evid1", "evid2", ["evid1"], "sta", MIN_STA).select("a", "b", F.col("evid1").alias("first"), "n", "stations")


def o76_worker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers of workers that each have sixty days: ``stride * (1 + worker) + i``, with ``i`` from 0."""
    rows = tables.catalog(spark, sf_dir).where("ot is not null").withColumn("worker", F.floor(F.col("ot") / (WORKER_DAYS * DAY)))
    return ordered.positions(rows, ["worker"], "ot", "event_id").select("event_id", "worker", (F.lit(STRIDE) * (1 + F.col("worker")) + F.col("pos") - 1).alias("evid"))


def o03_ground_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes divided by the vertical gain of their station at P (O-03 with O-06)."""
    got = epoch_lookup(load(spark, sf_dir, "picks"), load(spark, sf_dir, "gain_epochs"), "pick_id", "net_sta", "tp", "epoch_id", "net_sta", "t0", "t1")
    gains = load(spark, sf_dir, "gain_epochs").select("epoch_id", "gz").dropDuplicates(["epoch_id"]).where("gz > 0")
    rows = tables.picks(spark, sf_dir).where("s_amp is not null").select(F.col("pick_id").alias("event_id"), "s_amp")
    return got.join(rows, "event_id").join(gains, "epoch_id").select(F.col("event_id").alias("pick_id"), "epoch_id", (F.col("s_amp") / F.col("gz")).alias("motion"))


def o21_event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associated events and their phases as text: the event's line, then a line per phase in the order of its stations."""
    arrivals = cut(detection_arrivals(spark, sf_dir), "arrivals")
    events = cut(associate(arrivals, tables.stations(spark, sf_dir)), "events")
    phases = events.select("ot", "lat", "lon", "dep", F.explode("pick_ids").alias("pick_id")).join(arrivals.drop("ot"), "pick_id")
    return formats.event_lines(events, phases).select("event", "ord", "line")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[:1] == "o" and name[1:3].isdigit()}
