"""Association of picks into located events (O-52 to O-56)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions.geo import KM_PER_DEGREE, hypo_km, origin_time
from tremorline.operators.ordered import time_islands
from tremorline.operators.ranking import best_row
from tremorline.plans import tables
from tremorline.session import spread

HOUR = 3_600_000_000
EVENT = "ot bigint, lat double, lon double, dep double, mag double, res double, n_picks int, pick_ids array<bigint>"


#: Cells of a block's side in the search.
BLOCK = 4
#: Cells of the grid of travel times; larger areas are refused, as a task holds a sixteenth of them per station (5 MB).
MOST_CELLS = 20_000_000


@dataclass(frozen=True)
class AssociationOptions:
    """Windows in seconds, grid steps in degrees, depths in km, velocity in km/s."""

    min_sta: int = 4
    ot_dev: float = 2.0
    max_res: float = 1.5
    max_drop: int = 1
    xy_margin: float = 0.1
    xy_grid: float = 0.02
    depths: tuple[float, ...] = (2.0, 5.0, 8.0, 11.0, 14.0, 17.0)
    vp: float = 6.0


class TravelTimes:
    """P travel times on straight rays from the cells of a grid around the stations (the far edge excluded)."""

    def __init__(self, stations: pd.DataFrame, options: AssociationOptions) -> None:
        lat, lon = stations["lat"].to_numpy(), stations["lon"].to_numpy()
        edge_lat, edge_lon = options.xy_margin * np.ptp(lat), options.xy_margin * np.ptp(lon)
        nx = max(1, int((np.ptp(lon) + 2 * edge_lon) / options.xy_grid))
        ny = max(1, int((np.ptp(lat) + 2 * edge_lat) / options.xy_grid))
        if nx * ny * len(options.depths) > MOST_CELLS:
            raise ValueError(f"a grid of {nx} x {ny} x {len(options.depths)} cells is too large for a task: divide the stations by area (operators.grid)")
        self.lon = lon.min() - edge_lon + options.xy_grid * np.arange(nx)
        self.lat = lat.min() - edge_lat + options.xy_grid * np.arange(ny)
        self.dep, self.vp, self.step = np.array(options.depths), options.vp, options.xy_grid
        self.station = {r.sta: (r.lat, r.lon, r.ele_m) for r in stations.itertuples()}
        self._coarse: dict[str, np.ndarray] = {}

    def at(self, sta: str, z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Seconds from cells (index of depth, longitude, latitude) to a station."""
        lat, lon, ele = self.station[sta]
        dx = KM_PER_DEGREE * (self.lon[x] - lon) * np.cos(np.radians(lat))
        dy = KM_PER_DEGREE * (self.lat[y] - lat)
        dz = self.dep[z] + ele / 1000
        return (np.sqrt(dz**2 + dx**2 + dy**2) / self.vp).astype("f4")

    def of(self, sta: str) -> np.ndarray:
        """The whole grid ``[depth, lon, lat]`` in seconds."""
        return self.at(sta, np.arange(len(self.dep))[:, None, None], np.arange(len(self.lon))[None, :, None], np.arange(len(self.lat))[None, None, :])

    def middles(self, sta: str) -> np.ndarray:
        """As ``of`` at the middle cells of the blocks only; kept, as a task asks for a station many times."""
        if sta not in self._coarse:
            x, y = (np.minimum(np.arange(0, len(axis), BLOCK) + BLOCK // 2, len(axis) - 1) for axis in (self.lon, self.lat))
            self._coarse[sta] = self.at(sta, np.arange(len(self.dep))[:, None, None], x[None, :, None], y[None, None, :])
        return self._coarse[sta]

    def best_cells(self, names: list[str], travel: np.ndarray, max_res: float) -> list[tuple[int, float, int, int]]:
        """Per depth ``(picks explained, their mean residual, lon, lat)`` of the best cell of the whole grid: most picks, then least mean, then the first.

        From the middle of a block of cells no travel time changes by more than the way to its corner takes, which bounds what any of its cells
        can reach; only blocks that might hold the best cell are looked at cell by cell.
        """
        t = travel.astype("f4")
        res = np.abs(np.stack([self.middles(s) for s in names]) - t[:, None, None, None])
        slack = np.float32(KM_PER_DEGREE * self.step * (BLOCK // 2) * np.sqrt(2) / self.vp + 1e-3)
        near = res < max_res
        count = near.sum(axis=0)
        most = count.max(axis=(1, 2))[:, None, None]
        mean = np.where((count == most) & (count > 0), np.einsum("kzxy,kzxy->zxy", res, near) / np.maximum(count, 1), np.inf)
        least = mean.min(axis=(1, 2))[:, None, None]
        bound = (res < max_res + slack).sum(axis=0)
        open_ = bound > most
        even = np.nonzero(bound == most)  # as many picks at best: the least residuals that they could have
        low = np.cumsum(np.sort(np.maximum(res[:, *even] - slack, 0), axis=0), axis=0)
        need = np.broadcast_to(most, count.shape)[even]
        low = np.where(need > 0, low[np.maximum(need - 1, 0), np.arange(len(need))] / np.maximum(need, 1), 0)
        open_[even] = low <= np.broadcast_to(least, count.shape)[even] + 1e-4
        z, bx, by = np.nonzero(open_)
        x, y = np.broadcast_arrays(bx[:, None, None] * BLOCK + np.arange(BLOCK)[:, None], by[:, None, None] * BLOCK + np.arange(BLOCK))
        z = np.broadcast_to(z[:, None, None], x.shape)
        inside = (x < len(self.lon)) & (y < len(self.lat))
        z, x, y = z[inside], x[inside], y[inside]
        count, total = np.zeros(len(z), "i4"), np.zeros(len(z), "f4")
        for name, at in zip(names, t, strict=True):
            off = np.abs(self.at(name, z, x, y) - at)
            hit = off < max_res
            count += hit
            total += np.where(hit, off, np.float32(0))
        mean = total / np.maximum(count, 1)
        order = np.lexsort((y, x, mean, -count, z))
        first = order[np.searchsorted(z[order], np.arange(len(self.dep)))]
        return [(int(count[i]), float(mean[i]), int(x[i]), int(y[i])) for i in first]


def locate(sta: list[str], tp: np.ndarray, ot: float, times: TravelTimes, options: AssociationOptions) -> tuple[int, float, tuple[int, int, int], np.ndarray] | None:
    """The cell that explains most picks, of those the one with the least mean residual: ``(picks, residual, cell, explained)``."""
    per_depth = times.best_cells(sta, tp - ot, options.max_res)
    z = min(range(len(per_depth)), key=lambda k: (-per_depth[k][0], per_depth[k][1], k))
    most, mean, x, y = per_depth[z]
    if most < options.min_sta:
        return None
    explained = np.array([abs(float(times.at(name, z, x, y)) - t) < options.max_res for name, t in zip(sta, tp - ot, strict=True)])
    return most, mean, (z, x, y), explained


def magnitude(sta: list[str], amp: np.ndarray, lat: float, lon: float, dep: float, times: TravelTimes) -> float:
    """Median station magnitude without the value farthest from the median; NaN if no amplitude is usable."""
    at = np.array([times.station[s] for s in sta])
    km = np.sqrt((KM_PER_DEGREE * (at[:, 0] - lat)) ** 2 + (KM_PER_DEGREE * (at[:, 1] - lon) * np.cos(np.radians(at[:, 0]))) ** 2 + (dep + at[:, 2] / 1000) ** 2)
    good = np.isfinite(amp) & (amp > 0)
    mags = np.log10(amp[good] * 1e6) + np.log10(km[good]) + 1
    if len(mags) > 1:
        mags = np.delete(mags, int(np.argmax(np.abs(mags - np.median(mags)))))
    return float(np.median(mags)) if len(mags) else float("nan")


def associate_island(pdf: pd.DataFrame, times: TravelTimes, options: AssociationOptions) -> list[tuple]:
    """Events of the picks (``pick_id, sta, ot, tp, s_amp``, in seconds) of one island: densest origin time first."""
    pdf = pdf.sort_values(["ot", "pick_id"], kind="stable")
    ids, sta, ot, tp, amp = pdf["pick_id"].to_numpy(), pdf["sta"].to_list(), pdf["ot"].to_numpy("f8"), pdf["tp"].to_numpy("f8"), pdf["s_amp"].to_numpy("f8")
    left, drops, out = np.arange(len(pdf)), np.zeros(len(pdf), int), []
    while len(left) >= options.min_sta:
        own = ot[left]
        density = np.searchsorted(own, own + options.ot_dev, "left") - np.searchsorted(own, own - options.ot_dev, "right")
        seed = int(np.argmax(density))
        if density[seed] < options.min_sta:
            break
        part = left[np.abs(own - own[seed]) < options.ot_dev]
        at = ot[part[len(part) // 2]]
        names = [sta[i] for i in part]
        got = locate(names, tp[part], at, times, options)
        taken = np.zeros(len(part), bool)
        if got:
            most, res, (z, x, y), taken = got
            lat, lon, dep = round(float(times.lat[y]), 2), round(float(times.lon[x]), 2), float(round(times.dep[z]))
            used = part[taken]
            mag = magnitude([sta[i] for i in used], amp[used], lat, lon, dep, times)
            out.append((round(at * 1e6), lat, lon, dep, round(mag, 2), round(res, 1), most, ids[used].tolist()))
        drops[part[~taken]] += 1
        gone = np.concatenate([part[taken], left[drops[left] > options.max_drop]])
        left = left[~np.isin(left, gone)]
    return out


def associate(picks: DataFrame, stations: DataFrame, options: AssociationOptions = AssociationOptions()) -> DataFrame:  # noqa: B008
    """Located events of ``picks (pick_id, sta, ot, tp, s_amp)``, times in microseconds.

    Picks of stations without coordinates are left out, and so are picks without origin time or P time. Days are
    associated separately. Islands of origin times (gaps of ``ot_dev`` or more) are independent and kept whole;
    the islands that start in one hour are one group. The station table must fit a task: it is counted and refused
    beyond 100,000 rows.
    """
    if stations.count() > 100_000:
        raise ValueError("more than 100000 stations")
    table = stations.toPandas()
    if table.empty:
        return picks.sparkSession.createDataFrame([], EVENT)
    known = picks.join(stations.select("sta"), "sta", "left_semi").where("ot is not null and tp is not null")
    known = known.withColumn("day", F.floor(F.col("tp") / (24 * HOUR)))
    rows = time_islands(known, ["day"], "ot", "pick_id", int(options.ot_dev * 1e6))
    sizes = rows.groupBy("day", "island").agg(F.count("*").alias("n")).where(F.col("n") >= options.min_sta).select("day", "island")
    rows = rows.join(sizes, ["day", "island"]).withColumn("part", F.floor(F.col("island") / HOUR))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        times = TravelTimes(table, options)
        pdf = pdf.assign(ot=pdf["ot"] / 1e6, tp=pdf["tp"] / 1e6)
        found = [e for _, own in pdf.groupby("island", sort=True) for e in associate_island(own, times, options)]
        return pd.DataFrame(found, columns=["ot", "lat", "lon", "dep", "mag", "res", "n_picks", "pick_ids"]).astype({"ot": "i8", "n_picks": "i4"})

    return spread(rows, "day", "part").groupBy("day", "part").applyInPandas(kernel, EVENT)


def detection_arrivals(spark: SparkSession, sf_dir: str, vp: float = 6.0, vs: float = 3.45) -> DataFrame:
    """Picks ``pick_id, sta, ot, tp, ts, s_amp, det_id`` that the detections imply: arrival times on straight rays plus the measured differences."""
    dets = tables.detections(spark, sf_dir).select("det_id", F.col("ot").alias("det_ot"), F.col("lat").alias("elat"), F.col("lon").alias("elon"), "dep").where("det_ot is not null and elat is not null and elon is not null and dep is not null")
    rows = tables.detection_picks(spark, sf_dir).join(dets, "det_id").join(tables.stations(spark, sf_dir), "sta")
    km = hypo_km(F.col("elat"), F.col("elon"), F.col("dep"), F.col("lat"), F.col("lon"), F.col("ele_m"))
    arrival = lambda v, dt: F.round((F.col("det_ot") / 1e6 + km / v + F.coalesce(dt, F.lit(0.0))) * 1e6).cast("bigint")
    rows = rows.select("det_id", "ord", "sta", "s_amp", arrival(vp, F.col("dt_p")).alias("tp"), arrival(vs, F.col("dt_s")).alias("ts")).where("ts > tp")
    ot = F.round(origin_time(F.col("tp") / 1e6, F.col("ts") / 1e6, vp, vs) * 1e6).cast("bigint")
    return rows.select((F.shiftleft("det_id", 16) + F.col("ord")).alias("pick_id"), "sta", ot.alias("ot"), "tp", "ts", "s_amp", "det_id")


def o54_associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all arrivals of the detections; the origin times come from the delays of S."""
    rows = detection_arrivals(spark, sf_dir)
    got = associate(rows, tables.stations(spark, sf_dir))
    return got.select(F.timestamp_micros("ot").alias("ot"), "lat", "lon", "dep", "mag", "res", "n_picks")


LOCATION = "evid bigint, dep double, lat double, lon double, n_pha int, rms double, gap double"


def azimuthal_gap(azimuths: np.ndarray) -> float:
    """The greatest angle between neighbouring directions, in degrees; 360 for one."""
    a = np.sort(azimuths % 360)
    return float(np.max(np.diff(np.append(a, a[0] + 360)))) if len(a) else 360.0


def trial_locations(picks: DataFrame, stations: DataFrame, options: AssociationOptions = AssociationOptions(), batch: int = 400) -> DataFrame:  # noqa: B008
    """Every event located at every trial depth (O-78): ``evid, dep, lat, lon, n_pha, rms, gap``.

    ``picks (evid, sta, ot, tp)`` in microseconds. A depth at which fewer than ``min_sta`` picks are explained gives no row. About
    ``batch`` events share a task's travel times; the station table must fit a task, as in ``associate``.
    """
    if stations.count() > 100_000:
        raise ValueError("more than 100000 stations")
    table = stations.toPandas()
    if table.empty:
        return picks.sparkSession.createDataFrame([], LOCATION)
    own = picks.join(stations.select("sta"), "sta", "left_semi").where("evid is not null and ot is not null and tp is not null")
    parts = max(1, own.select("evid").distinct().count() // batch)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        times, rows = TravelTimes(table, options), []
        for evid, ev in pdf.groupby("evid", sort=True):
            ev = ev.drop_duplicates(["sta", "tp"]).sort_values(["tp", "sta"])
            names, ot = ev["sta"].to_list(), float(ev["ot"].median()) / 1e6
            travel = ev["tp"].to_numpy("f8") / 1e6 - ot
            for z, (most, _, x, y) in enumerate(times.best_cells(names, travel, options.max_res)):
                if most < options.min_sta:
                    continue
                res = np.abs(np.array([times.at(s, z, x, y) for s in names]) - travel.astype("f4"))
                used = res < options.max_res
                at = np.array([times.station[s] for s, u in zip(names, used, strict=True) if u])
                gap = azimuthal_gap(np.degrees(np.arctan2((at[:, 1] - times.lon[x]) * np.cos(np.radians(times.lat[y])), at[:, 0] - times.lat[y])))
                rows.append((evid, float(times.dep[z]), float(times.lat[y]), float(times.lon[x]), most, float(np.sqrt((res[used].astype("f8") ** 2).mean())), gap))
        return pd.DataFrame(rows, columns=["evid", "dep", "lat", "lon", "n_pha", "rms", "gap"]).astype({"evid": "i8", "n_pha": "i4"})

    own = own.withColumn("part", F.pmod(F.xxhash64("evid"), F.lit(parts)))
    return spread(own, "part").groupBy("part").applyInPandas(kernel, LOCATION)


#: Fixed value: the trial depths of locations in km.
TRIAL_DEPTHS = tuple(float(z) for z in range(20))


def o78_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the trial depths of every detection (O-78, O-79): more phases, then less residual, then the shallower."""
    rows = detection_arrivals(spark, sf_dir).select(F.col("det_id").alias("evid"), "sta", "ot", "tp")
    got = trial_locations(rows, tables.stations(spark, sf_dir), AssociationOptions(depths=TRIAL_DEPTHS))
    best = best_row(got, ["evid"], [-F.col("n_pha"), F.col("rms"), F.col("dep")], ["dep", "lat", "lon", "n_pha", "rms", "gap"])
    return best.select("evid", "dep", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "n_pha", F.round("rms", 3).alias("rms"), F.round("gap", 1).alias("gap"))


QUERIES = {"o78_locations": o78_locations, "o54_associate": o54_associate}
