"""Queries of the array kernels on series that the test tables hold; they hold no waveforms.

``embeddings``: the vectors of a label one after another are a trace of three channels, each vector a third of its numbers per
channel, and the first vector of the label is the template that is sought in it (O-62 to O-66). ``picks``: the picks of a
station in order of time are samples of three channels, in which the picker seeks onsets (O-40, O-50).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators import ordered
from tremorline.operators.waveforms import MatchOptions, PickOptions, match_templates, pick_stretches
from tremorline.plans import tables
from tremorline.session import load

#: Vectors of a label that make one stretch, and samples of a vector per channel.
VECTORS, WIDTH = 200, 21
#: Picks of a station that make one stretch, and samples per second that the picker is told.
PICKS, RATE = 3_000, 50.0
#: One vector is a second; a detection holds for a third of it.
MATCH = MatchOptions(fs=float(WIDTH), det=(0.0, 1.0), p=(0.0, 1.0), s=(0.0, 1.0), search_p=(0.3, 0.3), search_s=(0.3, 0.3), trigger=0.3, expand_s=1 / 3, gap_s=0.5, min_sta=1, amp_win=(0.2, 0.8))


def _joined(pdf: pd.DataFrame) -> list[list[float]]:
    """Three channels of the vectors in order of their ids."""
    rows = np.stack(pdf.sort_values("vec_id")["v"].to_list()).astype("f4")
    return [rows[:, k * WIDTH : (k + 1) * WIDTH].ravel().tolist() for k in range(3)]


def vector_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, part, sta, vec_id, lo, hi, data``: stretches ``data[lo:hi]`` of ``VECTORS`` vectors of a label, with the first one's id.

    A stretch takes along the first vector of the next one: correlation gives no value for the window at a stretch's first sample, so every
    window of the label's trace but the very first, which is the template, has its value in exactly one stretch. ``data`` has a vector more on
    either side, where there is one, so that picks are sought around matches at the edges too.
    """
    vecs = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("v"))
    vecs = vecs.where(F.col("label").isNotNull() & (F.size("v") >= 3 * WIDTH))
    rows = ordered.positions(vecs, ["label"], "vec_id", "label", bucket=100_000)
    part = F.floor((F.col("pos") - 1) / VECTORS)
    place = (F.col("pos") - 1) % VECTORS
    before, after = (part > 0) & (place < 2), place == VECTORS - 1
    rows = rows.withColumn("part", F.explode(F.array_compact(F.array(part, F.when(before, part - 1), F.when(after, part + 1)))))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf["pos"] - 1 - key[1] * VECTORS
        own, lo = pdf[(place >= 0) & (place < VECTORS)], int((place < 0).sum()) * WIDTH
        hi = lo + int(((place >= 0) & (place <= VECTORS)).sum()) * WIDTH
        out = [(key[0], key[1], "v", int(own["vec_id"].min()), lo, hi, _joined(pdf))] if len(own) else []  # else behind the label's end
        return pd.DataFrame(out, columns=["label", "part", "sta", "vec_id", "lo", "hi", "data"])

    return rows.select("label", "part", "pos", "vec_id", "v").groupBy("label", "part").applyInPandas(kernel, "label bigint, part bigint, sta string, vec_id bigint, lo int, hi int, data array<array<float>>")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = vector_traces(spark, sf_dir)
    first = waves.where("part = 0").select("label", F.transform("data", lambda x: F.slice(x, 1, WIDTH)).alias("own"))
    pairs = waves.join(first, "label").withColumn("temp_id", F.col("label").cast("string"))
    traces = pairs.select("temp_id", "part", "sta", F.col("own").alias("data"), F.lit(0).alias("tp"), F.lit(0).alias("ts"), F.lit(0).alias("ot"))
    parts = pairs.select(*[F.col(c).alias(c) for c in ("temp_id", "part", "sta", "lo", "hi", "data")])  # new columns: both sides come from one table
    return match_templates(traces, parts, MATCH)


def o62_matched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first vector of each label is found again in the label's trace: stretch, sample, correlation."""
    got = _matches(spark, sf_dir)
    return got.select(F.col("temp_id").cast("bigint").alias("label"), "part", F.round(F.col("ot_s") * WIDTH, 1).alias("sample"), F.round("cc", 4).alias("cc"))


def o66_vector_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of every match, by correlation around it (O-66)."""
    got = _matches(spark, sf_dir).select(F.col("temp_id").cast("bigint").alias("label"), "part", F.round(F.col("ot_s") * WIDTH, 1).alias("sample"), F.explode("picks").alias("p"))
    return got.select("label", "part", "sample", F.round("p.dt_p", 4).alias("dt_p"), F.round("p.dt_s", 4).alias("dt_s"), F.round("p.cc_p", 4).alias("cc_p"), F.round("p.cc_s", 4).alias("cc_s"))


def o50_series_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets in the series that every station's picks make: channels ``a12``, ``a13`` and ``p_snr``, samples in order of time."""
    rows = tables.picks(spark, sf_dir).where("sta is not null and tp is not null")
    rows = ordered.positions(rows.select("sta", "tp", "pick_id", "a12", "a13", "p_snr"), ["sta"], "tp", "pick_id").withColumn("part", F.floor((F.col("pos") - 1) / PICKS))
    channels = F.array(*[F.transform(F.col(f"s.{c}"), lambda x: F.coalesce(x, F.lit(0.0))) for c in ("a12", "a13", "p_snr")])
    waves = rows.groupBy("sta", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "a12", "a13", "p_snr"))).alias("s"))
    waves = waves.select("sta", "part", F.lit(0).cast("bigint").alias("start_us"), F.lit(RATE).alias("samp_rate"), channels.alias("data"))
    got = pick_stretches(waves, ["sta", "part"], PickOptions(trigger=3.0))
    sample = lambda us: F.round(F.col(us) / 1e6 * RATE).cast("int")
    return got.select("sta", "part", sample("tp_us").alias("onset"), sample("ts_us").alias("second"), F.round("p_snr", 3).alias("ratio"), "good")


QUERIES = {"o50_series_picks": o50_series_picks, "o62_matched_vectors": o62_matched_vectors, "o66_vector_picks": o66_vector_picks}
