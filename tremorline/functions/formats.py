"""Text forms of the pipeline as column expressions, and the readers that undo them.

Line orders are columns (``file``, ``pos``), so lines can be made and read back without one task per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.operators.ordered import carry_last


def iso_time(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def compact_time(us: Column) -> Column:
    """``yyyyMMddHHmmss.SS``, cut to hundredths."""
    return F.date_format(F.timestamp_micros(us), "yyyyMMddHHmmss.SS")


def parse_compact(text: Column) -> Column:
    """Microseconds of a compact time; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss.SS")))


def degree_minutes(x: Column, positive: str, negative: str, width: int) -> Column:
    """Whole degrees, hemisphere and minutes in hundredths, cut: ``35N4295``."""
    size = F.abs(x)
    degrees = F.floor(size)
    minutes = F.floor((size - degrees) * 6000)
    return F.concat(F.lpad(degrees.cast("string"), width, "0"), F.when(x < 0, negative).otherwise(positive), F.lpad(minutes.cast("string"), 4, "0"))


def parse_degree_minutes(text: Column) -> Column:
    """Decimal degrees of ``degree_minutes``."""
    parts = [F.regexp_extract(text, r"^(\d+)([NSEW])(\d{4})$", k) for k in (1, 2, 3)]
    size = parts[0].try_cast("double") + parts[2].try_cast("double") / 6000
    return F.when(parts[1].isin("S", "W"), -size).otherwise(size)


def catalog_line(ot: Column, lat: Column, lon: Column, dep: Column, mag: Column) -> Column:
    return F.concat_ws(",", iso_time(ot), F.format_string("%.4f", lat), F.format_string("%.4f", lon), F.format_string("%.1f", dep), F.format_string("%.2f", mag))


def detection_lines(dets: DataFrame) -> DataFrame:
    """``file, pos, line``: a header ``name,time,lat,lon,dep,cc`` per detection, then a line per station of its picks.

    The name is the template and its detection's compact time. Missing numbers are written as -1. One file per day.
    """
    name = F.concat_ws("_", "temp_id", compact_time(F.col("ot")))
    head = F.concat_ws(",", name, iso_time(F.col("ot")), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), F.format_string("%.1f", "dep"), F.format_string("%.3f", "cc"))
    number = lambda form, c: F.when(c.isNull(), "-1").otherwise(F.format_string(form, c))
    used = F.filter(F.coalesce("picks", F.array().cast(dets.schema["picks"].dataType)), lambda p: p.isNotNull())
    body = F.transform(used, lambda p: F.concat_ws(",", F.coalesce(p["net_sta"], F.lit("-1")), number("%.2f", p["dt_p"]), number("%.2f", p["dt_s"]), number("%.3e", p["s_amp"]), number("%.3f", p["cc_p"]), number("%.3f", p["cc_s"])))
    rows = dets.select(F.to_date(F.timestamp_micros("ot")).cast("string").alias("file"), "det_id", F.posexplode(F.concat(F.array(head), body)).alias("ord", "line"))
    return rows.select("file", (F.shiftleft("det_id", 20) + F.col("ord")).alias("pos"), "line")


def read_blocks(lines: DataFrame, is_head: Column | None = None, block: int = 1 << 30) -> DataFrame:
    """``file, pos, head, line``: every body line with the header line above it, and headers without body with a null line.

    A header is a line whose first field is a name: digits, then an underscore (or ``is_head``). Body lines above the
    first header of a file have a null head and are left out.
    """
    head = F.col("line").rlike(r"^[0-9]+_") if is_head is None else is_head
    rows = carry_last(lines.withColumn("_h", head), ["file"], "pos", F.when(F.col("_h"), F.struct("pos", "line")), "top", block).where("top is not null")
    body = rows.where("not _h").select("file", F.col("top.pos").alias("at"), "pos", F.col("top.line").alias("head"), "line")
    heads = rows.where("_h").select("file", F.col("pos").alias("at"), F.col("pos").alias("pos"), F.col("line").alias("head"), F.lit(None).cast("string").alias("line"))
    full = body.select("file", "at").distinct()
    return body.unionByName(heads.join(full, ["file", "at"], "left_anti")).drop("at")


def event_lines(events: DataFrame, phases: DataFrame) -> DataFrame:
    """``event, ord, line``: per event (by its time and place) its catalogue line, then a line ``net_sta,tp,ts,s_amp`` per phase.

    ``events (ot, lat, lon, dep, mag)``, ``phases (ot, lat, lon, dep, sta, tp, ts, s_amp)`` with the event's own time and place. A missing number
    is written as -1.
    """
    event = F.concat_ws("_", compact_time(F.col("ot")), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), F.format_string("%.1f", "dep")).alias("event")
    head = catalog_line(F.col("ot"), F.col("lat"), F.col("lon"), F.col("dep"), F.coalesce("mag", F.lit(-1.0)))
    time = lambda c: F.coalesce(iso_time(F.col(c)), F.lit("-1"))
    amp = F.when(F.col("s_amp").isNull(), "-1").otherwise(F.col("s_amp").cast("string"))
    body = phases.select(event, F.concat_ws(",", "sta", "tp").alias("ord"), F.concat_ws(",", "sta", time("tp"), time("ts"), amp).alias("line"))
    return events.select(event, F.lit("").alias("ord"), head.alias("line")).unionByName(body)


def _hms(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "HHmmssSS")


def hypoinverse_phase(sta: Column, tp: Column, ts: Column, p_weight: int = 0, s_weight: int = 1) -> Column:
    """A phase line in fixed columns: station, network, P minute and second, S second since that minute (hundredths, cut)."""
    net, name = F.substring_index(sta, ".", 1), F.substring_index(sta, ".", -1)
    minute = F.floor(tp / 60_000_000) * 60_000_000
    s_hundredths = F.floor((ts - minute) / 10_000).cast("string")
    day = F.date_format(F.timestamp_micros(tp), "yyyyMMddHHmm")
    return F.concat(F.rpad(name, 5, " "), net, F.lit(f"  HHZ IP {p_weight} "), day, F.lit(" "), F.substring(_hms(tp), 5, 4), F.lit(" " * 7 + " "), F.when(F.length(s_hundredths) < 4, F.rpad(s_hundredths, 4, " ")).otherwise(s_hundredths), F.lit(f"ES {s_weight} "))


def hypodd_head(ot: Column, lat: Column, lon: Column, dep: Column, mag: Column, evid: Column, dep_corr: float = 0.0) -> Column:
    """``# Y M D h m s lat lon dep mag 0 0 0 evid`` in fixed columns; depths are shifted by ``dep_corr``."""
    at = F.timestamp_micros(ot)
    sec = F.second(at) + F.pmod(ot, F.lit(1_000_000)) / 1e6
    return F.format_string("# %4d %2d %2d %2d %2d %5.2f  %7.4f %9.4f  %6.2f %4.2f  0.00  0.00  0.00  %9d", F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at), sec, lat, lon, dep + dep_corr, mag, evid)


def hypodd_phase(sta: Column, travel_s: Column, phase: str, weight: float = 1.0) -> Column:
    return F.format_string(f"%-5s      %6.3f  {weight:6.3f}   {phase}", F.substring_index(sta, ".", -1), travel_s)


def hypoinverse_head(ot: Column, lat: Column, lon: Column, evid: Column) -> Column:
    """An event line in fixed columns; the magnitude is written as 0 and joined back by ``evid`` after the location."""
    place = F.concat(degree_minutes(lat, "N", "S", 2), degree_minutes(lon, "E", "W", 3))
    return F.concat(F.date_format(F.timestamp_micros(ot), "yyyyMMddHHmmssSS"), place, F.lit(" " * 91 + "L0.00" + " " * 9), F.lpad(evid.cast("string"), 10, " "), F.lit("L"))


def hypoinverse_station(sta: Column, lat: Column, lon: Column, ele_m: Column) -> Column:
    """A station line in fixed columns: degrees, decimal minutes and whole metres."""
    minutes = lambda x: (F.abs(x) - F.floor(F.abs(x))) * 60
    side = lambda x, a, b: F.when(x < 0, b).otherwise(a)
    net, name = F.substring_index(sta, ".", 1), F.substring_index(sta, ".", -1)
    text = F.format_string("%-5s %s  HHZ  %2d %7.4f%s%3d %7.4f%s%4d", name, net, F.floor(F.abs(lat)), minutes(lat), side(lat, "N", "S"), F.floor(F.abs(lon)), minutes(lon), side(lon, "E", "W"), ele_m.cast("int"))
    return text


def link_lines(links: DataFrame) -> DataFrame:
    """``evid1, evid2, ord, line``: a head ``# evid1 evid2 0.0`` per pair, then ``sta dt weight phase`` per link."""
    heads = links.select("evid1", "evid2").distinct().select("evid1", "evid2", F.lit("").alias("ord"), F.format_string("# %9d %9d 0.0", "evid1", "evid2").alias("line"))
    body = links.select("evid1", "evid2", F.concat_ws(" ", "sta", "phase").alias("ord"), F.format_string("%-7s %7.4f %.4f %s", "sta", "dt", "weight", "phase").alias("line"))
    return heads.unionByName(body)


def event_line(ot: Column, lat: Column, lon: Column, dep: Column, mag: Column, evid: Column) -> Column:
    """``yyyyMMdd  HHmmssSS lat lon dep mag errors evid``."""
    at = F.timestamp_micros(ot)
    return F.format_string("%s  %s  %8.4f  %9.4f  %8.2f  %5.2f    0.0   0.0   0.0 %9d", F.date_format(at, "yyyyMMdd"), F.date_format(at, "HHmmssSS"), lat, lon, dep, mag, evid)


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """``evid, mag`` of event lines; others are left out."""
    w = F.split(F.trim("line"), r"\s+")
    rows = lines.select(F.element_at(w, -1).try_cast("bigint").alias("evid"), F.get(w, F.lit(5)).try_cast("double").alias("mag"))
    return rows.where("evid is not null and mag is not null")


def location_lines(best: DataFrame) -> DataFrame:
    """The catalogue line of every best location with its verdict: the files of good and bad locations are its two parts."""
    line = F.concat_ws(",", compact_time(F.col("ot")), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), F.format_string("%.1f", "dep"))
    return best.select("evid", "reliable", line.alias("line"))


def hypodd_station(sta: Column, lat: Column, lon: Column) -> Column:
    """A station line: code without network, latitude, longitude."""
    return F.format_string("%-5s %9.4f %9.4f", F.substring_index(sta, ".", -1), lat, lon)


def location_outputs(best: DataFrame, mags: DataFrame, phases: DataFrame) -> dict[str, DataFrame]:
    """The six texts of located events as ``evid, ord, line`` (O-23): ``catalog``, ``summary``, ``good``, ``bad``, ``phases`` and ``full`` (with the event's number).

    ``best`` as from ``best_locations``, ``mags (evid, mag)``, ``phases (evid, sta, tp, ts, s_amp)``; what is missing is written as -1. An event is
    bad if none of its locations is reliable. Phases of unknown events are left out.
    """
    number = lambda form, c: F.when(F.col(c).isNull(), "-1").otherwise(F.format_string(form, c))
    head = F.concat_ws(",", compact_time(F.col("ot")), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), F.format_string("%.1f", "dep"), number("%.2f", "mag"))
    rows = best.join(mags.select("evid", "mag").dropDuplicates(["evid"]), "evid", "left").select("evid", "reliable", "line", head.alias("head"))
    time = lambda c: F.coalesce(iso_time(F.col(c)), F.lit("-1"))
    body = phases.join(best.select("evid"), "evid", "left_semi")
    body = body.select("evid", F.concat_ws(",", "sta", "tp").alias("ord"), F.concat_ws(",", "sta", time("tp"), time("ts"), F.coalesce(F.col("s_amp").cast("string"), F.lit("-1"))).alias("line"))
    one = lambda d, c: d.select("evid", F.lit("").alias("ord"), c.alias("line"))
    plain = one(rows, F.col("head"))
    return {
        "catalog": plain, "summary": one(rows, F.col("line")), "good": one(rows.where("reliable"), F.col("head")), "bad": one(rows.where("not reliable"), F.col("head")),
        "phases": plain.unionByName(body), "full": one(rows, F.concat_ws(",", "head", F.col("evid").cast("string"))).unionByName(body),
    }
