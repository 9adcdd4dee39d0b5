"""Points near other points, and the regions around points.

Polygons are cut into triangles by ear clipping; what lies within a distance of a point is a disc.
Triangles and discs meet the points in tiles of the map, where a bounding-volume hierarchy over the boxes of
the tile's shapes gives the candidates for each point and every candidate is tested exactly. A point on an
edge that two triangles of one region share is reported once.

A crowded tile is divided into finer ones, and a fine tile that still holds too many points and shapes into
blocks of some points and some shapes each, so that no task holds more than a bounded number of possible pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.geo import KM_PER_DEGREE, east
from tremorline.operators.ranking import top_k
from tremorline.session import cut, small_side


def ear_triangles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles ``[n, 3, 2]`` of a simple polygon. The ring may be closed or open and turn either way.

    Repeated neighbours, non-finite points and flat corners vanish; fewer than three points give none.
    """
    keep = np.isfinite(x) & np.isfinite(y)
    pts = np.column_stack([x[keep], y[keep]]).astype("f8")
    if len(pts):
        pts = pts[np.r_[True, (np.diff(pts, axis=0) != 0).any(axis=1)]]
    if len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    if len(pts) < 3:
        return np.empty((0, 3, 2))
    px, py = pts[:, 0], pts[:, 1]
    if np.sum(px * np.roll(py, -1) - np.roll(px, -1) * py) < 0:
        pts = pts[::-1]
        px, py = pts[:, 0], pts[:, 1]
    n, out = len(pts), []
    before, after = np.arange(n) - 1, (np.arange(n) + 1) % n
    before[0], left, alive = n - 1, n, np.ones(n, bool)

    def turn(a: int, b: int, c: int) -> float:
        return (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])

    def holds_none(a: int, b: int, c: int) -> bool:
        """Whether no other corner of the ring lies in the triangle (corners at the same place as its own do not count)."""
        rest = np.flatnonzero(alive & (px >= min(px[a], px[b], px[c])) & (px <= max(px[a], px[b], px[c])))
        qx, qy = px[rest], py[rest]
        inside = (rest != a) & (rest != b) & (rest != c)
        for u, v in ((a, b), (b, c), (c, a)):
            inside &= ((px[v] - px[u]) * (qy - py[u]) - (py[v] - py[u]) * (qx - px[u]) >= 0) & ((qx != px[u]) | (qy != py[u]))
        return not inside.any()

    at, tried = 0, 0
    while left > 3:
        a, c = before[at], after[at]
        area = turn(a, at, c)
        # after a whole turn without an ear the polygon is not simple: cut any corner that turns inwards
        if area != 0 and not (area > 0 and (tried > left or holds_none(a, at, c))) and tried <= 2 * left:
            at, tried = c, tried + 1
            continue
        if area > 0:
            out.append((a, at, c))
        alive[at], left, tried = False, left - 1, 0
        after[a], before[c] = c, a
        at = a
    last = (before[at], at, after[at])
    if turn(*last) > 0:
        out.append(last)
    return pts[np.array(out, "i8").reshape(-1, 3)]


class BoxTree:
    """A bounding-volume hierarchy over boxes ``[n, 4]`` (x0, y0, x1, y1): neighbours in slabs of x, then by y, are bound together."""

    def __init__(self, boxes: np.ndarray, fan: int = 16) -> None:
        boxes = np.asarray(boxes, "f8").reshape(-1, 4)
        n, self.fan = len(boxes), fan
        centre = boxes[:, :2] + boxes[:, 2:]
        slab = np.empty(n, "i8")
        slab[np.argsort(centre[:, 0], kind="stable")] = np.arange(n) // max(1, math.ceil(n / max(1, math.ceil(math.sqrt(n / fan)))))
        self.order = np.lexsort((centre[:, 1], slab))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > fan:
            low = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append(np.hstack([np.minimum.reduceat(low[:, :2], at), np.maximum.reduceat(low[:, 2:], at)]))

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, box) of all points and the boxes that hold them."""
        pts, boxes = [np.empty(0, "i8")], [np.empty(0, "i8")]
        for first in range(0, len(x), 50_000):
            own = np.arange(first, min(first + 50_000, len(x)))
            p, node = np.repeat(own, len(self.levels[-1])), np.tile(np.arange(len(self.levels[-1])), len(own))
            for k in range(len(self.levels) - 1, -1, -1):
                box = self.levels[k][node]
                held = (x[p] >= box[:, 0]) & (x[p] <= box[:, 2]) & (y[p] >= box[:, 1]) & (y[p] <= box[:, 3])
                p, node = p[held], node[held]
                if k:
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    p = np.repeat(p, self.fan)
                    p, node = p[node < len(self.levels[k - 1])], node[node < len(self.levels[k - 1])]
            pts.append(p)
            boxes.append(self.order[node])
        return np.concatenate(pts), np.concatenate(boxes)


def in_triangles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Whether point k lies in or on the (left-turning) triangle k."""
    ok = np.ones(len(x), bool)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        ok &= (tri[:, j, 0] - tri[:, i, 0]) * (y - tri[:, i, 1]) - (tri[:, j, 1] - tri[:, i, 1]) * (x - tri[:, i, 0]) >= 0
    return ok


def triangles(regions: DataFrame, id_col: str, x_col: str, y_col: str) -> DataFrame:
    """``region string, tri array<double>`` (x and y of three corners), one row per triangle.

    Repeated rows of a region count once. Null rings, null corners and rings of fewer than three points give nothing.
    """
    def kernel(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            names, rows = [], []
            for name, xs, ys in zip(pdf["region"], pdf["xs"], pdf["ys"], strict=True):
                n = min(len(xs), len(ys))
                for t in ear_triangles(np.asarray(xs[:n], "f8"), np.asarray(ys[:n], "f8")):
                    names.append(name)
                    rows.append(t.ravel().tolist())
            yield pd.DataFrame({"region": np.array(names, object), "tri": pd.Series(rows, dtype=object)})

    rings = regions.select(F.col(id_col).cast("string").alias("region"), F.col(x_col).alias("xs"), F.col(y_col).alias("ys")).where("region is not null and xs is not null and ys is not null")
    return rings.dropDuplicates(["region"]).mapInPandas(kernel, "region string, tri array<double>")


#: A tile with more points is divided so that a part has about as many; more possible pairs in one part are split into blocks.
TILE_POINTS, BLOCK_PAIRS = 20_000, 16_000_000


def _meet(points: DataFrame, shapes: DataFrame, exact: Callable, tile: float = 0.5, tile_points: int = TILE_POINTS, block_pairs: int = BLOCK_PAIRS, best: int = 0) -> DataFrame:
    """``(id, region)`` of ``points (id, x, y)`` and ``shapes (region, x0, y0, x1, y1, shape)`` that pass ``exact(id, x, y, region, shape)``.

    With ``best``, points also have ``z``, ``exact(id, x, y, z, region, shape)`` gives distances (NaN: too far), and only the nearest ``best`` points of
    each shape within a task are kept, with ``km``. A point lies in one tile, a shape in all that its box touches. Repeated points and shapes give a pair once.
    """
    kinds = {"id": dict(points.dtypes)["id"], "region": dict(shapes.dtypes)["region"]}
    floor = lambda c: F.floor(c).cast("bigint")
    own = ["id", "x", "y", "z"] if best else ["id", "x", "y"]
    pts = points.select(*own, floor(F.col("x") / tile).alias("i"), floor(F.col("y") / tile).alias("j"))
    span = lambda lo, hi: F.explode(F.sequence(floor(F.col(lo) / tile), floor(F.col(hi) / tile)))
    shp = shapes.withColumn("i", span("x0", "x1")).withColumn("j", span("y0", "y1"))
    tiles = pts.groupBy("i", "j").agg(F.count("*").alias("n"))
    busiest = tiles.agg(F.max("n")).first()[0] or 0
    easy = busiest <= tile_points and busiest * shapes.count() <= block_pairs
    key = ["i", "j"]
    if busiest > tile_points:
        crowded = small_side(tiles.where(F.col("n") > tile_points).select("i", "j", F.ceil(F.sqrt(F.col("n") / tile_points) * 2).cast("bigint").alias("parts")), "crowded")
        part = lambda c, own: F.least(F.greatest(floor((F.col(c) / tile - F.col(own)) * F.col("parts")), F.lit(0)), F.col("parts") - 1)
        pts = pts.join(crowded, ["i", "j"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        pts = pts.select(*own, "i", "j", part("x", "i").alias("fi"), part("y", "j").alias("fj"))
        shp = shp.join(crowded, ["i", "j"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        shp = shp.withColumn("fi", F.explode(F.sequence(part("x0", "i"), part("x1", "i")))).withColumn("fj", F.explode(F.sequence(part("y0", "j"), part("y1", "j")))).drop("parts")
        key = [*key, "fi", "fj"]
    if not easy:  # parts whose points and shapes could make too many pairs for a task
        pairs = pts.groupBy(key).agg(F.count("*").alias("np")).join(shp.groupBy(key).agg(F.count("*").alias("ns")), key)
        many = F.sqrt(F.col("np") / block_pairs * F.col("ns"))
        hot = cut(pairs.where(many > 1).select(*key, F.least(F.ceil(many), F.col("np")).alias("pb"), F.least(F.ceil(many), F.col("ns")).alias("sb")), "blocks")
    if not easy and hot.limit(1).count():
        hot = small_side(hot, "blocks")
        one = lambda c: F.coalesce(F.col(c), F.lit(1).cast("bigint"))
        mine = lambda c, n: F.pmod(F.xxhash64(c), one(n))
        copies = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), one(n) - 1))
        pts = pts.join(hot, key, "left").withColumn("p", mine("id", "pb")).withColumn("s", copies("sb")).drop("pb", "sb")
        shp = shp.join(hot, key, "left").withColumn("s", mine("region", "sb")).withColumn("p", copies("pb")).drop("pb", "sb")
        key = [*key, "p", "s"]

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left[own], right[["region", "x0", "y0", "x1", "y1", "shape"]]
        if left.empty or right.empty:
            none = pd.DataFrame({"id": left["id"].iloc[:0], "region": right["region"].iloc[:0]})
            return none.assign(km=0.0) if best else none
        x, y, ids, regions = left["x"].to_numpy(), left["y"].to_numpy(), left["id"].to_numpy(), right["region"].to_numpy()
        p, s = BoxTree(right[["x0", "y0", "x1", "y1"]].to_numpy()).candidates(x, y)
        shape = np.stack(right["shape"].to_list())
        if best:
            km = exact(ids[p], x[p], y[p], left["z"].to_numpy()[p], regions[s], shape[s])
            near = pd.DataFrame({"id": ids[p], "region": regions[s], "km": km}).dropna().drop_duplicates().sort_values(["region", "km", "id"], kind="stable")
            return near.groupby("region", sort=False).head(best)
        hit = exact(ids[p], x[p], y[p], regions[s], shape[s])
        return pd.DataFrame({"id": ids[p[hit]], "region": regions[s[hit]]}).drop_duplicates()

    return pts.groupBy(key).cogroup(shp.groupBy(key)).applyInPandas(kernel, f"id {kinds['id']}, region {kinds['region']}" + (", km double" if best else ""))


def regions_of(points: DataFrame, id_col: str, lat_col: str, lon_col: str, tri: DataFrame, tile: float = 0.5, tile_points: int = TILE_POINTS) -> DataFrame:
    """``(id bigint, region string)``: every region that holds the point, its border included, once.

    Points need an id and both coordinates; others, and points in no region, are left out. Longitudes on
    0..360 count as on -180..180. Repeated points count once.
    """
    pts = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(lat_col).cast("double").alias("y"), east(F.col(lon_col).cast("double")).alias("x"))
    pts = pts.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    xs, ys = (F.array(*[F.element_at("tri", k) for k in ks]) for ks in ((1, 3, 5), (2, 4, 6)))
    shapes = tri.select("region", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.col("tri").alias("shape"))
    return _meet(pts, shapes, lambda _id, x, y, _region, tri: in_triangles(x, y, tri.reshape(-1, 3, 2)), tile, tile_points)


def _places(df: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    out = df.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("y"), east(F.col(lon_col).cast("double")).alias("x"))
    return out.where("id is not null and y between -90 and 90 and x between -180 and 180")


def _discs(places: DataFrame, km: float, upward: bool = False) -> DataFrame:
    """The boxes of all discs of ``km`` around places, two where a disc crosses the date line (``upward``: the half from its own latitude up)."""
    pad = F.lit(km / KM_PER_DEGREE * 1.01)
    narrow = F.cos(F.radians(F.least(F.abs(F.col("y")) + pad, F.lit(90.0))))
    reach = F.when(narrow > 1e-3, F.least(pad / narrow, F.lit(180.0))).otherwise(180.0)
    box = lambda a, b: F.struct(a.cast("double").alias("x0"), b.cast("double").alias("x1"))
    x, all_round = F.col("x"), reach >= 180.0
    boxes = F.array(
        F.when(all_round, box(F.lit(-180), F.lit(180))).otherwise(box(F.greatest(x - reach, F.lit(-180.0)), F.least(x + reach, F.lit(180.0)))),
        F.when(~all_round & (x - reach < -180), box(x - reach + 360, F.lit(180))),
        F.when(~all_round & (x + reach > 180), box(F.lit(-180), x + reach - 360)),
    )
    rows = places.select(F.col("id").alias("region"), "x", "y", pad.alias("pad"), F.explode(F.filter(boxes, lambda b: b.isNotNull())).alias("b"))
    return rows.select("region", "b.x0", (F.col("y") if upward else F.col("y") - F.col("pad")).alias("y0"), "b.x1", (F.col("y") + F.col("pad")).alias("y1"), F.array("x", "y").alias("shape"))


def _km(x: np.ndarray, y: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance on the plane at latitude ``at``, across the date line too."""
    d = np.abs(x - to[:, 0])
    return np.hypot(KM_PER_DEGREE * np.minimum(d, 360.0 - d) * np.cos(np.radians(at)), KM_PER_DEGREE * (y - to[:, 1]))


def near_pairs(points: DataFrame, id_col: str, lat_col: str, lon_col: str, km: float, tile_points: int = TILE_POINTS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``(id, other)`` with ``id < other``: all pairs of different points within ``km`` of each other.

    Points without both coordinates are left out; a repeated id counts once. Every point's disc reaches from its own
    latitude up, so that each pair is met once.
    """
    pts = _places(points, id_col, lat_col, lon_col)

    def exact(ids: np.ndarray, x: np.ndarray, y: np.ndarray, other: np.ndarray, place: np.ndarray) -> np.ndarray:
        above = (y > place[:, 1]) | ((y == place[:, 1]) & (other < ids))
        return above & (_km(x, y, place, y) < km)

    found = _meet(pts, _discs(pts, km, upward=True), exact, max(0.5, 4 * km / KM_PER_DEGREE), tile_points, block_pairs)
    return found.select(F.least("id", "region").alias("id"), F.greatest("id", "region").alias("other"))


def nearest(points: DataFrame, id_col: str, lat_col: str, lon_col: str, dep_col: str, km: float, k: int, tile_points: int = TILE_POINTS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``(id, other, km, rank)``: the ``k`` nearest other points within ``km`` of each, by distance in space (six decimals), then id.

    Points need both coordinates and a depth in km. A task keeps no more than ``k`` of a point's neighbours, so a crowded place costs time, not room.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("y"), east(F.col(lon_col).cast("double")).alias("x"), F.col(dep_col).cast("double").alias("z"))
    rows = rows.where("id is not null and y between -90 and 90 and x between -180 and 180 and abs(z) < 1e9")
    discs = _discs(rows, km)
    # the searching point is the disc, so its depth goes with it; the depth of the met point goes with its id
    discs = discs.join(rows.select(F.col("id").alias("region"), F.col("z")).dropDuplicates(["region"]), "region").withColumn("shape", F.concat("shape", F.array("z"))).drop("z")

    def closest(ids: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, other: np.ndarray, place: np.ndarray) -> np.ndarray:
        # the plane of the event with the smaller id, so that both directions agree
        d = np.hypot(_km(x, y, place, np.where(ids < other, y, place[:, 1])), z - place[:, 2])
        return np.where((ids != other) & (d < km), np.round(d, 6), np.nan)

    found = _meet(rows, discs, closest, max(0.5, 4 * km / KM_PER_DEGREE), tile_points, block_pairs, best=k)
    return top_k(found.select(F.col("region").alias("id"), F.col("id").alias("other"), "km"), ["id"], [F.col("km"), F.col("other")], k)


def near_sites(points: DataFrame, id_col: str, lat_col: str, lon_col: str, sites: DataFrame, site_col: str, site_lat: str, site_lon: str, km: float) -> DataFrame:
    """``(id, site)``: the sites within ``km`` of every point. Nulls and repeats as in ``near_pairs``."""
    discs = _discs(_places(sites, site_col, site_lat, site_lon), km)
    exact = lambda _id, x, y, _site, place: _km(x, y, place, place[:, 1]) < km
    return _meet(_places(points, id_col, lat_col, lon_col), discs, exact, max(0.5, 4 * km / KM_PER_DEGREE)).withColumnRenamed("region", "site")
