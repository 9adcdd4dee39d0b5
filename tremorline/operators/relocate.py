"""Double-difference relocation: events move so that differences of travel times match the measured ones, over all links at once or in padded cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tremorline.functions.geo import KM_PER_DEGREE
from tremorline.operators.grid import Grid, padded_cells
from tremorline.session import cut, drop, spread

RELOCATED = "event_id bigint, i int, j int, lat double, lon double, dep double, shift_s double, links int, rms double"


@dataclass(frozen=True)
class RelocationOptions:
    """Velocities in km/s; ``damping`` holds events near their start; ``cutoff_s`` drops links that no longer fit.

    ``solver_steps`` bounds the steps of a round; over all links a round also ends when the residual fell to ``tolerance`` of its start.
    """

    vp: float = 6.0
    vs: float = 3.45
    rounds: int = 5
    damping: float = 0.05
    cutoff_s: float = 1.0
    solver_steps: int = 60
    tolerance: float = 1e-3


def damped_least_squares(g1: np.ndarray, g2: np.ndarray, a: np.ndarray, b: np.ndarray, rhs: np.ndarray, n: int, damping: float, steps: int) -> np.ndarray:
    """Moves ``[n, 4]`` with ``g1 . x[a] - g2 . x[b] = rhs`` in the least-squares sense, by conjugate gradients on the sparse rows."""

    def forward(x: np.ndarray) -> np.ndarray:
        return (g1 * x[a]).sum(axis=1) - (g2 * x[b]).sum(axis=1)

    def back(r: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 4))
        np.add.at(out, a, g1 * r[:, None])
        np.add.at(out, b, -g2 * r[:, None])
        return out

    x = np.zeros((n, 4))
    r = rhs.copy()
    s = back(r)
    p, norm = s.copy(), float((s * s).sum())
    for _ in range(steps):
        if norm < 1e-20:
            break
        q = forward(p)
        step = norm / (float(q @ q) + damping**2 * float((p * p).sum()))
        x += step * p
        r -= step * q
        s = back(r) - damping**2 * x
        norm, old = float((s * s).sum()), norm
        p = s + norm / old * p
    return x


def relocate_cell(events: pd.DataFrame, links: pd.DataFrame, o: RelocationOptions) -> pd.DataFrame:
    """Relocated ``events (event_id, lat, lon, dep)`` of one cell by its ``links (evid1, evid2, slat, slon, ele_m, dt, weight, phase)``.

    ``dt`` is the travel time of the first event minus that of the second. Events without links are left out.
    """
    events = events.drop_duplicates("event_id").sort_values("event_id").reset_index(drop=True)
    at = pd.Series(events.index, index=events["event_id"])
    lat0 = float(events["lat"].mean())
    kx, ky = KM_PER_DEGREE * np.cos(np.radians(lat0)), KM_PER_DEGREE
    pos = np.column_stack([(events["lon"] - events["lon"].mean()) * kx, (events["lat"] - lat0) * ky, events["dep"], np.zeros(len(events))])
    sta = np.column_stack([(links["slon"] - events["lon"].mean()) * kx, (links["slat"] - lat0) * ky, -links["ele_m"] / 1000])
    a, b = at[links["evid1"]].to_numpy(), at[links["evid2"]].to_numpy()
    v = np.where(links["phase"] == "S", o.vs, o.vp)
    dt, w = links["dt"].to_numpy("f8"), links["weight"].to_numpy("f8")

    def travel(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = pos[k, :3] - sta
        km = np.maximum(np.sqrt((d * d).sum(axis=1)), 1e-6)
        return km / v + pos[k, 3], np.column_stack([d / (km * v)[:, None], np.ones(len(k))])

    for _ in range(o.rounds):
        t1, g1 = travel(a)
        t2, g2 = travel(b)
        rest = dt - (t1 - t2)
        own = w * (np.abs(rest) <= o.cutoff_s)
        if not own.any():
            break
        pos = pos + damped_least_squares(g1 * own[:, None], g2 * own[:, None], a, b, rest * own, len(pos), o.damping, o.solver_steps)
    rest = dt - (travel(a)[0] - travel(b)[0])
    n = np.bincount(a, minlength=len(pos)) + np.bincount(b, minlength=len(pos))
    square = np.bincount(a, weights=rest**2, minlength=len(pos)) + np.bincount(b, weights=rest**2, minlength=len(pos))
    out = pd.DataFrame({"event_id": events["event_id"], "lat": lat0 + pos[:, 1] / ky, "lon": events["lon"].mean() + pos[:, 0] / kx, "dep": pos[:, 2], "shift_s": pos[:, 3], "links": n, "rms": np.sqrt(square / np.maximum(n, 1))})
    return out[n > 0]


def relocate(events: DataFrame, links: DataFrame, stations: DataFrame, grid: Grid, options: RelocationOptions = RelocationOptions()) -> DataFrame:  # noqa: B008
    """``event_id, i, j, lat, lon, dep, shift_s, links, rms``: every event with links, relocated in its home cell.

    ``events (event_id, lat, lon, dep)``, ``links (evid1, evid2, sta, dt, weight, phase)``, ``stations (sta, lat, lon, ele_m)``. A link counts in
    each cell whose padded box holds both events. Links without a time, a weight above zero, or a known station are left
    out, and so are repeated ones. One task holds one cell: choose the grid so that a cell fits. Links between events that
    share no padded box are lost, and so are events without a home cell; ``relocate_all`` keeps both.
    """
    cells = padded_cells(events.where("dep is not null").dropDuplicates(["event_id"]), "lat", "lon", grid).select("event_id", "lat", "lon", "dep", "i", "j", "is_home")
    known = stations.select("sta", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "ele_m")
    good = links.where("dt is not null and weight > 0 and evid1 <> evid2").join(known, "sta").select("evid1", "evid2", "sta", "slat", "slon", "ele_m", "dt", "weight", "phase").distinct()
    side = lambda k: cells.select(F.col("event_id").alias(f"evid{k}"), F.col("i").alias(f"i{k}"), F.col("j").alias(f"j{k}"))
    placed = good.join(side(1), "evid1").join(side(2), "evid2").where("i1 = i2 and j1 = j2").withColumnRenamed("i1", "i").withColumnRenamed("j1", "j").drop("i2", "j2", "sta")

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            got = pd.DataFrame({c.split()[0]: np.array([], "f8") for c in RELOCATED.split(", ")})
        else:
            got = relocate_cell(left[["event_id", "lat", "lon", "dep"]], right, options)
            got = got[got["event_id"].isin(left.loc[left["is_home"], "event_id"])].assign(i=int(key[0]), j=int(key[1]))
        return got[[c.split()[0] for c in RELOCATED.split(", ")]].astype({"event_id": "i8", "i": "i4", "j": "i4", "links": "i4"})

    cells = cells.select(*[F.col(c).alias(c) for c in cells.columns])  # new columns: both sides come from one table
    return spread(cells, "i", "j").groupBy("i", "j").cogroup(spread(placed, "i", "j").groupBy("i", "j")).applyInPandas(kernel, RELOCATED)


AXES = range(4)  # east, north, down (km), origin time (s)
SIDES = [(c, r) for c in AXES for r in range(c + 1)]


def _travel(k: int, speed: Column) -> tuple[Column, list[Column]]:
    """Travel time of event ``k`` of a link, its shift included, and the derivatives for moves in km and seconds."""
    c = lambda name: F.col(f"{name}{k}")
    scale = F.cos(F.radians("slat"))
    d = [KM_PER_DEGREE * (c("lon") - F.col("slon")) * scale, KM_PER_DEGREE * (c("lat") - F.col("slat")), c("dep") + F.col("ele_m") / 1000]
    km = F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(1e-6))
    return km / speed + c("shift_s"), [d[0] / (km * speed) * scale / F.cos(F.radians(c("lat"))), d[1] / (km * speed), d[2] / (km * speed), F.lit(1.0)]


def _residuals(links: DataFrame, at: DataFrame, o: RelocationOptions) -> DataFrame:
    """``links`` with ``rest``, the measured minus the computed difference, and the derivatives ``u0..3`` and ``v0..3`` of both ends."""
    side = lambda k: at.select(F.col("event_id").alias(f"evid{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("lat", "lon", "dep", "shift_s")])
    speed = F.when(F.col("phase") == "S", o.vs).otherwise(o.vp)
    (t1, g1), (t2, g2) = _travel(1, speed), _travel(2, speed)
    rows = links.join(side(1), "evid1").join(side(2), "evid2")
    return rows.select("evid1", "evid2", "weight", (F.col("dt") - (t1 - t2)).alias("rest"), *[g1[c].alias(f"u{c}") for c in AXES], *[(-g2[c]).alias(f"v{c}") for c in AXES])


def _both_ends(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Each link once from either end: ``i, j``, derivatives ``u`` at ``i`` and ``v`` at ``j``."""
    one = lambda a, b, u, v: rows.select(F.col(a).alias("i"), F.col(b).alias("j"), *keep, *[F.col(f"{u}{c}").alias(f"u{c}") for c in AXES], *[F.col(f"{v}{c}").alias(f"v{c}") for c in AXES])
    return one("evid1", "evid2", "u", "v").unionByName(one("evid2", "evid1", "v", "u"))


def _roots(damping: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Events' own blocks ``d`` to the inverse ``m`` of their Cholesky factors and the scaled right-hand side ``r``."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.zeros((len(pdf), 4, 4))
            for c, r in SIDES:
                d[:, c, r] = d[:, r, c] = pdf[f"d{c}{r}"]
            m = np.linalg.inv(np.linalg.cholesky(d + damping**2 * np.eye(4)))
            r = np.einsum("ncr,nr->nc", m, pdf[[f"b{c}" for c in AXES]].to_numpy())
            yield pd.DataFrame({"i": pdf["i"], "m": list(m.reshape(-1, 16)), **{f"r{c}": r[:, c] for c in AXES}})

    return kernel


def _scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks ``h`` between two events, scaled by the factors of both."""
    for pdf in batches:
        if len(pdf):
            of = lambda c: np.stack(pdf[c].to_numpy()).reshape(-1, 4, 4)  # noqa: B023, E731
            h = pdf[[f"h{c}{r}" for c in AXES for r in AXES]].to_numpy().reshape(-1, 4, 4)
            h = np.einsum("nab,nbc,ndc->nad", of("mi"), h, of("mj"))
            yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], **{f"h{c}{r}": h[:, c, r] for c in AXES for r in AXES}})


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            x = np.einsum("nrc,nr->nc", np.stack(pdf["m"].to_numpy()).reshape(-1, 4, 4), pdf[[f"x{c}" for c in AXES]].to_numpy())
            yield pd.DataFrame({"event_id": pdf["i"], **{f"x{c}": x[:, c] for c in AXES}})


def _conjugate_gradients(pairs: DataFrame, start: DataFrame, o: RelocationOptions) -> DataFrame:
    """``i, x0..3`` with ``x_i + sum_j h_ij x_j = r_i``: one job a step, which joins the blocks with the residuals, sums them per event and
    writes the next state. Both products of a step come from that job (Chronopoulos and Gear), and the state before it is deleted.
    """
    col = lambda v, c: F.col(f"{v}{c}")
    state = start.select("i", *[F.lit(0.0).alias(f"{v}{c}") for v in "xpsw" for c in AXES], *[f"r{c}" for c in AXES])
    alpha = beta = 0.0
    first = last = before = None
    for _ in range(o.solver_steps + 1):
        p, s = [[col(a, c) + beta * col(b, c) for c in AXES] for a, b in ("rp", "ws")]
        new = [(col("x", c) + alpha * p[c]).alias(f"x{c}") for c in AXES] + [(col("r", c) - alpha * s[c]).alias(f"r{c}") for c in AXES]
        if last is None:  # no direction yet
            p = s = [F.lit(0.0)] * 4
        moved = state.select("i", *new, *[p[c].alias(f"p{c}") for c in AXES], *[s[c].alias(f"s{c}") for c in AXES])
        sums = pairs.join(moved.select(F.col("i").alias("j"), *[f"r{c}" for c in AXES]), "j")
        sums = sums.groupBy("i").agg(*[F.sum(sum(F.col(f"h{c}{r}") * col("r", r) for r in AXES)).alias(f"w{c}") for c in AXES])
        following = moved.join(sums, "i", "left").select("i", *[f"{v}{c}" for v in "xrps" for c in AXES], *[(col("r", c) + F.coalesce(col("w", c), F.lit(0.0))).alias(f"w{c}") for c in AXES])
        seen = Observation()
        dot = lambda a: F.sum(sum(col("r", c) * col(a, c) for c in AXES))
        following = cut(following.observe(seen, dot("r").alias("rr"), dot("w").alias("rw")), "step")
        if last is not None:
            drop(state)
        state, rr, rw = following, seen.get["rr"] or 0.0, seen.get["rw"] or 0.0
        first = rr if first is None else first
        if rr <= o.tolerance**2 * first or rw <= 0:
            break
        beta = rr / last if before else 0.0
        alpha, last = rr / (rw - (beta * rr / before if before else 0.0)), rr
        before = alpha
    return state.select("i", *[f"x{c}" for c in AXES])


def relocate_all(events: DataFrame, links: DataFrame, stations: DataFrame, options: RelocationOptions = RelocationOptions()) -> DataFrame:  # noqa: B008
    """``event_id, lat, lon, dep, shift_s, links, rms``: every event with links, all links solved together without cells.

    ``events (event_id, lat, lon, dep)``, ``links (evid1, evid2, sta, dt, weight, phase)``, ``stations (sta, lat, lon, ele_m)``. Links without a
    time, a weight above zero, a known station or two placed events are left out, and so are repeated ones. No group is held in a
    task: the normal equations are a table of 4 x 4 blocks, one per pair of linked events and one per event.
    """
    o = options
    placed = events.where("lat is not null and lon is not null and dep is not null").dropDuplicates(["event_id"])
    known = stations.select("sta", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "ele_m")
    good = links.where("dt is not null and weight > 0 and evid1 <> evid2").join(known, "sta").select("evid1", "evid2", "sta", "slat", "slon", "ele_m", "dt", "weight", "phase").distinct()
    for k in (1, 2):
        good = good.join(placed.select(F.col("event_id").alias(f"evid{k}")), f"evid{k}", "left_semi")
    good = cut(good, "links")
    linked = good.select(F.explode(F.array("evid1", "evid2")).alias("event_id")).distinct()
    at = cut(placed.join(linked, "event_id", "left_semi").select("event_id", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "dep")], F.lit(0.0).alias("shift_s")), "places")
    for _ in range(o.rounds):
        rows = _residuals(good, at, o).where(F.abs("rest") <= o.cutoff_s)
        rows = cut(rows.select("evid1", "evid2", (F.col("rest") * F.col("weight")).alias("rest"), *[(F.col(f"{g}{c}") * F.col("weight")).alias(f"{g}{c}") for g in "uv" for c in AXES]), "linear")
        ends = _both_ends(rows, ["rest"])
        own = ends.groupBy("i").agg(*[F.sum(F.col(f"u{c}") * F.col(f"u{r}")).alias(f"d{c}{r}") for c, r in SIDES], *[F.sum(F.col(f"u{c}") * F.col("rest")).alias(f"b{c}") for c in AXES])
        start = cut(own.mapInPandas(_roots(o.damping), "i bigint, m array<double>, r0 double, r1 double, r2 double, r3 double"), "roots")
        blocks = ends.groupBy("i", "j").agg(*[F.sum(F.col(f"u{c}") * F.col(f"v{r}")).alias(f"h{c}{r}") for c in AXES for r in AXES])
        blocks = blocks.join(start.select("i", F.col("m").alias("mi")), "i").join(start.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
        pairs = cut(blocks.mapInPandas(_scaled, "i bigint, j bigint, " + ", ".join(f"h{c}{r} double" for c in AXES for r in AXES)), "blocks")
        solved = _conjugate_gradients(pairs, start, o)
        moves = solved.join(start.select("i", "m"), "i").mapInPandas(_moved, "event_id bigint, x0 double, x1 double, x2 double, x3 double")
        x = lambda c: F.coalesce(F.col(f"x{c}"), F.lit(0.0))
        east = x(0) / (KM_PER_DEGREE * F.cos(F.radians("lat")))
        after = cut(at.join(moves, "event_id", "left").select("event_id", (F.col("lat") + x(1) / KM_PER_DEGREE).alias("lat"), (F.col("lon") + east).alias("lon"), (F.col("dep") + x(2)).alias("dep"), (F.col("shift_s") + x(3)).alias("shift_s")), "places")
        for table in (rows, start, pairs, solved, at):
            drop(table)
        at = after
    ends = _residuals(good, at, o).select(F.explode(F.array("evid1", "evid2")).alias("event_id"), "rest")
    fit = ends.groupBy("event_id").agg(F.count("*").cast("int").alias("links"), F.sqrt(F.avg(F.col("rest") * F.col("rest"))).alias("rms"))
    return at.join(fit, "event_id").select("event_id", "lat", "lon", "dep", "shift_s", "links", "rms")
