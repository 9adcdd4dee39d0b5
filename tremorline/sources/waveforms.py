"""Waveform files: folders of one day, three channels per station, in SAC format."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators.asof import epoch_lookup

WAVES = "sta string, date string, chn int, start_us bigint, samp_rate double, data array<float>"


def encode_sac(data: np.ndarray, start_us: int, samp_rate: float) -> bytes:
    """A little-endian SAC file with the fields that ``decode_sac`` needs."""
    floats, ints, text = np.full(70, -12345.0, "<f4"), np.full(40, -12345, "<i4"), b"-12345  " * 24
    at = pd.Timestamp(start_us, unit="us")
    floats[[0, 5]] = 1 / samp_rate, (start_us % 1000) / 1e6
    ints[[0, 1, 2, 3, 4, 5]] = at.year, at.dayofyear, at.hour, at.minute, at.second, at.microsecond // 1000
    ints[[6, 9, 15, 35]] = 6, len(data), 1, 1
    return floats.tobytes() + ints.tobytes() + text + np.asarray(data, "<f4").tobytes()


def decode_sac(raw: bytes) -> tuple[int, float, np.ndarray] | None:
    """``(start_us, samp_rate, samples)`` of a SAC file of either byte order; None if it is no such file."""
    for order in "<>":
        if len(raw) < 632:
            return None
        floats, ints = np.frombuffer(raw, f"{order}f4", 70), np.frombuffer(raw, f"{order}i4", 40, 280)
        if 1 <= ints[6] <= 7 and 0 <= ints[9] <= (len(raw) - 632) // 4 and floats[0] > 0:
            day = pd.Timestamp(int(ints[0]), 1, 1).value // 1000 + (int(ints[1]) - 1) * 86_400_000_000
            start = day + ((int(ints[2]) * 60 + int(ints[3])) * 60 + int(ints[4])) * 1_000_000 + int(ints[5]) * 1000
            begin = float(floats[5]) if floats[5] != -12345.0 else 0.0
            return start + round(begin * 1e6), float(np.round(1 / float(floats[0]), 4)), np.frombuffer(raw, f"{order}f4", int(ints[9]), 632)
    return None


def scan_stations(files: DataFrame, fill: bool = False) -> DataFrame:
    """``date, sta, paths`` of ``files (path)`` named ``.../date/NET.STA.*`` (O-01): stations with exactly three files.

    With ``fill`` a station with fewer has its last file repeated and one with more keeps all (O-02).
    """
    parts = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("date"), F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("sta"))
    groups = rows.groupBy("date", "sta").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    if not fill:
        return groups.where(F.size("paths") == 3)
    more = F.array_repeat(F.element_at("paths", -1), F.greatest(3 - F.size("paths"), F.lit(0)))
    return groups.withColumn("paths", F.concat("paths", more))


def read_waveforms(spark: SparkSession, path: str, fill: bool = False) -> DataFrame:
    """Rows of ``WAVES`` (O-03, O-04), the channels numbered by file name; files that cannot be read give nothing."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    chosen = scan_stations(files.select("path"), fill).select("date", "sta", F.posexplode("paths").alias("chn", "path"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.sta, r.date, r.chn, *got) for r in pdf.itertuples() if (got := decode_sac(r.content))]
            out = pd.DataFrame(rows, columns=["sta", "date", "chn", "start_us", "samp_rate", "data"])
            yield out.astype({"sta": object, "date": object, "chn": "i4", "start_us": "i8", "samp_rate": "f8", "data": object})

    return chosen.join(files, "path").select("sta", "date", "chn", "content").mapInPandas(kernel, WAVES)


def divide_gain(waves: DataFrame, gain: str = "gain") -> DataFrame:
    """Samples divided by the column ``gain``; rows without a gain above zero stay as they are."""
    scaled = F.transform("data", lambda x: (x / F.col(gain)).cast("float"))
    return waves.withColumn("data", F.when(F.col(gain) > 0, scaled).otherwise(F.col("data"))).drop(gain)


def apply_gain(waves: DataFrame, epochs: DataFrame) -> DataFrame:
    """``WAVES`` divided by the gain of their station at the middle of the trace, channel by channel (O-03 with O-06).

    ``epochs``: ``epoch_id, net_sta, ge, gn, gz, t0, t1``. As in ``epoch_lookup``, the last epoch holds where none fits; stations without
    epochs, and gains that are not above zero, leave the samples as they are.
    """
    middle = F.timestamp_micros((F.col("start_us") + F.size("data") / F.col("samp_rate") / 2 * 1e6).cast("bigint"))
    keyed = waves.withColumn("_id", F.xxhash64("date", "sta", "chn")).withColumn("_mid", middle)
    got = epoch_lookup(keyed, epochs, "_id", "sta", "_mid", "epoch_id", "net_sta", "t0", "t1").select(F.col("event_id").alias("_id"), "epoch_id")
    gains = got.join(epochs.select("epoch_id", F.array("ge", "gn", "gz").alias("_g")).dropDuplicates(["epoch_id"]), "epoch_id").select("_id", "_g")
    rows = keyed.join(gains, "_id", "left").withColumn("_gain", F.get("_g", F.col("chn")))
    return divide_gain(rows, "_gain").select(*waves.columns)


def write_templates(windows: DataFrame, path: str) -> None:
    """The windows of templates (``operators.waveforms.template_windows``) as Parquet, sorted so that a template is read from few files (O-27)."""
    windows.repartitionByRange("temp_id", "sta").sortWithinPartitions("temp_id", "sta", "win", "chn").write.mode("overwrite").parquet(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
