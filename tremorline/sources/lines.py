"""Text files as lines with their order, and the formats read from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.functions.formats import parse_compact, read_blocks
from tremorline.functions.geo import code, micros, origin_time
from tremorline.operators.ranking import best_row
from tremorline.operators.rejects import station_table

PICK_COLUMNS = "net_sta string, sta_ot string, tp string, ts string, s_amp double, p_snr double, fd double, amp_ratio double, a12 double, a13 double"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line``: ``pos`` grows along each file, also over the splits that different tasks read."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    first = F.min("id").over(Window.partitionBy("file", "start"))  # one split; it has at least one byte per line
    return raw.select("file", (F.col("start") + F.col("id") - first).alias("pos"), "line")


def read_stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(stations, epochs)`` of files in any of the three formats (O-05): the first row of a station gives its place, every row an epoch."""
    rows = station_table(read_lines(spark, path))
    return best_row(rows, ["net_sta"], [F.col("file"), F.col("pos")], ["lat", "lon", "ele_m"]), rows.select("net_sta", "file", "pos", "ge", "gn", "gz", "t0", "t1")


def _time(text: Column) -> Column:
    return micros(F.when(text != "-1", text).try_cast("timestamp"))


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """Daily pick files (O-07): ``sta, ot, tp, ts, s_amp`` and the quality columns. A path without files gives no rows; lines without a station are left out."""
    try:
        rows = spark.read.schema(PICK_COLUMNS).csv(path)
    except AnalysisException:
        rows = spark.createDataFrame([], PICK_COLUMNS)
    own = [F.col(c) for c in ("p_snr", "fd", "amp_ratio", "a12", "a13")]
    return rows.where("net_sta is not null").select(code("net_sta").alias("sta"), *[_time(F.col(c)).alias(n) for c, n in (("sta_ot", "ot"), ("tp", "tp"), ("ts", "ts"))], F.when(F.col("s_amp") != -1, F.col("s_amp")).alias("s_amp"), *own)


def read_external_picks(spark: SparkSession, path: str, vp: float = 6.0, vs: float = 3.45) -> DataFrame:
    """Picks ``net_sta,tp,ts,s_amp`` whose origin time is computed (O-08)."""
    rows = spark.read.schema("net_sta string, tp string, ts string, s_amp double").csv(path)
    rows = rows.select(code("net_sta").alias("sta"), _time(F.col("tp")).alias("tp"), _time(F.col("ts")).alias("ts"), F.when(F.col("s_amp") != -1, F.col("s_amp")).alias("s_amp"))
    ot = origin_time(F.col("tp") / 1e6, F.col("ts") / 1e6, vp, vs)
    return rows.withColumn("ot", F.round(ot * 1e6).cast("bigint"))


def read_phases(spark: SparkSession, path: str, after: str | None = None, before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(heads, phases)`` of phase files (O-09 to O-12).

    A header is a line whose first field is a time or a name ``digits_...``: ``[name,]ot,lat,lon,dep,mag[,evid]``. Phases are ``net_sta,tp,ts,...``
    with -1 for a missing one. ``after`` and ``before`` keep the headers strictly between two times, with their phases.
    """
    first = F.get(F.split("line", ","), F.lit(0))
    is_head = F.coalesce(first.try_cast("timestamp").isNotNull() | parse_compact(first).isNotNull() | first.rlike(r"^[0-9]+_"), F.lit(False))
    is_head = is_head & F.contains(F.col("line"), F.lit(","))
    rows = read_blocks(read_lines(spark, path), is_head)
    part = F.split("head", ",")
    named = F.get(part, F.lit(0)).rlike(r"^[0-9]+_")
    field = lambda i: F.when(named, F.get(part, F.lit(i + 1))).otherwise(F.get(part, F.lit(i)))
    ot = F.coalesce(_time(field(0)), parse_compact(field(0)))
    rows = rows.select("file", "pos", "head", "line", F.when(named, F.get(part, F.lit(0))).alias("name"), ot.alias("ot"), *[field(i).try_cast("double").alias(n) for i, n in ((1, "lat"), (2, "lon"), (3, "dep"), (4, "mag"))], field(5).try_cast("bigint").alias("evid"))
    for bound, test in ((after, lambda b: F.col("ot") > b), (before, lambda b: F.col("ot") < b)):
        if bound is not None:
            rows = rows.where(test(micros(F.lit(bound).cast("timestamp"))))
    heads = rows.select("file", "head", "name", "ot", "lat", "lon", "dep", "mag", "evid").distinct()
    p = F.split("line", ",")
    get = lambda i: F.get(p, F.lit(i))
    phases = rows.where("line is not null").select("file", "pos", "head", "evid", code(get(0)).alias("sta"), _time(get(1)).alias("tp"), _time(get(2)).alias("ts"), get(3).try_cast("double").alias("s_amp"))
    return heads, phases


def parse_summary(lines: DataFrame, north: bool = True, east: bool = True, ground_km: float = 0.0) -> DataFrame:
    """Location summaries in fixed columns (O-13, O-33, O-35): one row per line with ``evid, ot, lat, lon, dep, n_pha, gap, rms, quality, reliable``.

    Lines whose last word is no event number, or whose place is no number, are left out.
    """
    at = lambda start, n: F.trim(F.substring("line", start, n)).try_cast("double")
    word = F.split(F.trim("line"), r"\s+")
    sec = F.lpad(F.get(word, F.lit(2)), 5, "0")
    size = at(21, 2) + at(24, 5) / 60, at(30, 3) + at(34, 5) / 60
    rows = lines.select(
        F.element_at(word, -1).try_cast("bigint").alias("evid"), parse_compact(F.concat(F.get(word, F.lit(0)), F.get(word, F.lit(1)), sec)).alias("ot"),
        (size[0] if north else -size[0]).alias("lat"), (size[1] if east else -size[1]).alias("lon"), (at(39, 6) + ground_km).alias("dep"),
        at(53, 3).alias("n_pha"), at(57, 3).alias("gap"), at(65, 5).alias("rms"), F.substring("line", 81, 1).alias("quality"),
        (~(F.array_contains(word, "-") | F.array_contains(word, "#"))).alias("reliable"), "line",
    )
    return rows.where("evid is not null and lat is not null and lon is not null")


def best_locations(summaries: DataFrame) -> DataFrame:
    """The best location of each event over all trial depths (O-79): reliable ones first, then quality, gap, more phases, residual, the line."""
    order = [F.when(F.col("reliable"), 0).otherwise(1), F.col("quality"), F.col("gap"), -F.col("n_pha"), F.col("rms"), F.col("line")]
    return best_row(summaries, ["evid"], order, ["ot", "lat", "lon", "dep", "n_pha", "gap", "rms", "quality", "reliable", "line"])


def parse_relocated(lines: DataFrame, dep_corr: float = 0.0) -> DataFrame:
    """Relocated events (O-14): ``evid, ot, lat, lon, dep``; lines with an unreadable depth or time are left out, a full minute becomes 59.999 s."""
    w = F.split(F.trim("line"), r"\s+")
    get = lambda i: F.get(w, F.lit(i))
    two = lambda i: F.lpad(get(i), 2, "0")
    sec = F.lpad(F.when(get(15) == "60.000", "59.999").otherwise(get(15)), 6, "0")
    ot = F.unix_micros(F.try_to_timestamp(F.concat(get(10), two(11), two(12), two(13), two(14), sec), F.lit("yyyyMMddHHmmss.SSS")))
    rows = lines.select(get(0).try_cast("bigint").alias("evid"), ot.alias("ot"), get(1).try_cast("double").alias("lat"), get(2).try_cast("double").alias("lon"), F.round(get(3).try_cast("double") - dep_corr, 2).alias("dep"))
    return rows.where("evid is not null and ot is not null and dep is not null")


def write_lines(df: DataFrame, order: list[str], path: str, line: str = "line") -> None:
    """Text files whose lines follow ``order`` within and over the parts (O-20 to O-24)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)
