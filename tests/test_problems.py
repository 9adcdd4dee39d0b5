"""Operators of problems 1, 3, 4 and 5 against brute force on small random and dirty tables."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tremorline.operators.asof import as_known, epoch_lookup
from tremorline.operators.rejects import split_rows, station_table
from tremorline.operators.spatial import BoxTree, ear_triangles, in_triangles, near_pairs, near_sites, regions_of, triangles
from tremorline.operators.spikes import AMPLITUDE, MAGNITUDE, ReadingRule, flag_readings, level_innovations, stuck_members

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


# ---------------------------------------------------------------- problem 1


def test_innovations_withhold_spikes():
    z = np.array([0.0, 0.1, 5.0, 5.0, 0.05])
    score, flag = level_innovations(z, 0.05, 3.0, 0.98)
    assert flag.tolist() == [False, False, True, True, False]
    assert abs(score[4]) < 1  # the spikes did not move the level


def test_stuck_members():
    y = np.array([1, 1, 1, 1, 2, 3, 3, 3, 3, 3, 3, np.nan, 3, 3, 3, 3], "f8")
    assert np.flatnonzero(stuck_members(y, 5)).tolist() == [5, 6, 7, 8, 9, 10]


def brute_flags(rows, log10, limit, missing, low, high):
    """``{id: reasons}`` by the definitions in TESTDATA.md."""
    seen = {r[0]: (r[0], r[1].strip().upper() or None if r[1] else None, r[2], r[3]) for r in rows}
    out = {}
    rows = [r for r in seen.values() if r[3] is not None and r[3] != missing]
    bad = lambda y: not (math.isfinite(y) and (y > 0 if log10 else low <= y <= high))
    z = lambda y: math.log10(y) if log10 else y
    for r in rows:
        if bad(r[3]):
            out.setdefault(r[0], set()).add("impossible")
    for src in {r[1] for r in rows if r[1]}:
        own = [r for r in rows if r[1] == src]
        good = [z(r[3]) for r in own if not bad(r[3])]
        if good:
            mid = float(np.median(good))
            for r in own:
                if not bad(r[3]) and abs(z(r[3]) - mid) > limit:
                    out.setdefault(r[0], set()).add("spike")
        line = sorted((r for r in own if r[2] is not None), key=lambda r: (r[2], r[0]))
        start = 0
        for i in range(1, len(line) + 1):
            if i == len(line) or bad(line[i][3]) or bad(line[i - 1][3]) or line[i][3] != line[i - 1][3]:
                if i - start >= 5:
                    for r in line[start:i]:
                        out.setdefault(r[0], set()).add("stuck")
                start = i
    return out


def random_readings(seed, n=600):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 5, 900, 4000])
        y = 10 ** rng.gauss(-5, 0.2)
        if rng.random() < 0.02:
            y *= 10 ** rng.choice([-3, 3])
        if rng.random() < 0.03:
            y = rng.choice([float("nan"), float("inf"), 0.0, -5.0, -1.0, None])
        if rows and rng.random() < 0.6 and (i // 7) % 4 == 0:
            y = rows[-1][3]
        src = rng.choice(["A.B", " a.b", "A.B", "A.B", "C.D", None])
        rows.append((i, src, None if rng.random() < 0.03 else t, y))
        if rng.random() < 0.02:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block_rows", [250_000, 40])
def test_flags_against_brute_force(spark, block_rows):
    rows = random_readings(block_rows)
    rule = ReadingRule(log10=True, limit=2.0, missing=-1.0, block_rows=block_rows)
    df = spark.createDataFrame([(i, s, at(t), y, "x") for i, s, t, y in rows], "id bigint, src string, t timestamp, y double, source string")
    got: dict = {}
    for r in flag_readings(df, "id", "src", "t", "y", rule).where("reason <> 'jump'").collect():
        got.setdefault(r.row_id, set()).add(r.reason)
    assert got == brute_flags(rows, True, 2.0, -1.0, None, None)


def brute_jumps(rows, rule):
    """``{id: score}`` of readings that one filter over each whole source flags, within the limit."""
    out = {}
    seen = {r[0]: r for r in rows if r[1] and r[3] is not None and r[3] != rule.missing}
    for src in {r[1].strip().upper() for r in seen.values()}:
        own = [(r[2], r[0], math.log10(r[3])) for r in seen.values() if r[1].strip().upper() == src and math.isfinite(r[3]) and r[3] > 0]
        values = sorted(round(y, 3) for _, _, y in own)
        q1, mid, q3 = (values[max(0, math.ceil(f * len(values)) - 1)] for f in (0.25, 0.5, 0.75))
        r = max((q3 - q1) / 1.349, rule.limit / 40) ** 2
        x, p = 0.0, 0.25 * r
        for t, i, y in sorted(own, key=lambda o: (-1 if o[0] is None else o[0], o[1])):
            z = y - mid
            if t is None:
                v, s = z, 1.25 * r
            else:
                x, p = x * rule.phi, p * rule.phi**2 + 0.01 * r
                v, s = z - x, p + r
            if v * v > rule.gate**2 * s:
                if abs(z) <= rule.limit:
                    out[i] = v / math.sqrt(s)
            elif t is not None:
                x, p = x + p / s * v, p * (1 - p / s)
    return out


def test_scores_do_not_depend_on_blocks(spark):
    """Jumps come from the filter alone, and its state goes on from block to block."""
    rng = random.Random(3)
    rows = random_readings(3, 400) + [(1000 + i, "J.K", 10**7 + 60 * i, 10 ** (-5 + 0.6 * (i % 19 == 3) + rng.gauss(0, 0.1))) for i in range(200)]
    df = spark.createDataFrame([(i, s, at(t), y) for i, s, t, y in rows], "id bigint, src string, t timestamp, y double")
    want = brute_jumps(rows, ReadingRule(log10=True, limit=2.0, missing=-1.0))
    assert len(want) > 5
    for block_rows in (250_000, 60):
        rule = ReadingRule(log10=True, limit=2.0, missing=-1.0, block_rows=block_rows)
        got = {r.row_id: r.score for r in flag_readings(df, "id", "src", "t", "y", rule).where("reason = 'jump'").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_flags_of_magnitudes_and_empty_table(spark):
    rows = [(k, "N", at(k * 10), 2.0 + 0.01 * k) for k in range(9)] + [(20, "N", at(200), 11.0), (21, "N", at(210), 6.5), (22, None, at(5), -9.0), (23, "N", None, -2.0), (24, "N", at(1), None)]
    df = spark.createDataFrame(rows, "id bigint, src string, t timestamp, y double")
    got = {(r.row_id, r.reason) for r in flag_readings(df, "id", "src", "t", "y", MAGNITUDE).collect()}
    assert got == {(20, "impossible"), (22, "impossible"), (21, "spike"), (23, "spike")}
    assert flag_readings(df.limit(0), "id", "src", "t", "y", AMPLITUDE).count() == 0


# ---------------------------------------------------------------- problem 3


@pytest.mark.parametrize("shard_rows", [200_000, 7])
def test_as_known_against_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    ends = [None, 3, 10, 20, 30, 50, 99]
    attrs = [(i, rng.choice(["A", "a ", "B", None]), rng.choice([0, 1, 5, 10, 20, None]), rng.choice(ends), rng.choice([None, *range(0, 60)])) for i in range(60)]
    attrs += attrs[:5]
    events = [(i, rng.choice(["A", " a", "B", "C", None]), rng.choice([None, *range(-5, 110)])) for i in range(150)]
    events += events[:9]
    want = {}
    for i, e, t in set(events):
        if e is None or t is None:
            continue
        ok = [(k, s, -a) for a, ent, s, u, k in attrs if ent and ent.strip().upper() == e.strip().upper() and s is not None and k is not None and s <= t and (u is None or t < u) and k <= t]
        if ok:
            want[i] = -max(ok)[2]
    ev = spark.createDataFrame([(i, e, at(t), 1) for i, e, t in events], "id bigint, e string, t timestamp, aid int")
    af = spark.createDataFrame([(i, e, at(a), at(b), at(k)) for i, e, a, b, k in attrs], "aid bigint, e string, t0 timestamp, t1 timestamp, known timestamp")
    got = as_known(ev, af, "id", "e", "t", "aid", "e", "t0", "t1", "known", shard_rows).collect()
    assert {r.event_id: r.attr_id for r in got} == want and len(got) == len(want)
    assert as_known(ev.limit(0), af, "id", "e", "t", "aid", "e", "t0", "t1", "known").count() == 0
    assert as_known(ev, af.limit(0), "id", "e", "t", "aid", "e", "t0", "t1", "known").count() == 0


def test_epoch_lookup(spark):
    rng = random.Random(3)
    epochs = [(i, rng.choice("AB"), rng.choice([None, *range(20)]), rng.choice([None, *range(5, 40)])) for i in range(25)]
    events = [(i, rng.choice("ABC"), rng.randrange(45)) for i in range(120)]
    want = {}
    for i, e, t in events:
        own = [x for x in epochs if x[1] == e]
        hit = [k for k, _, a, b in own if (a is None or a < t) and (b is None or t < b)]
        if own:
            want[i] = (min(hit), True) if hit else (max(k for k, *_ in own), False)
    ev = spark.createDataFrame([(i, e, at(t)) for i, e, t in events], "id bigint, e string, t timestamp")
    ep = spark.createDataFrame([(i, e, at(a), at(b)) for i, e, a, b in epochs], "k bigint, e string, a timestamp, b timestamp")
    got = {r.event_id: (r.epoch_id, r.matched) for r in epoch_lookup(ev, ep, "id", "e", "t", "k", "e", "a", "b").collect()}
    assert got == want


# ---------------------------------------------------------------- problem 4

LINES = [
    ("AB.C1,1,2,3,4", None, None), (" AB.C1 , +1.5 ,\t-2e1,.5,4E+3 \r", None, None), ('"AB.C1","1","2","3","4"', None, None),
    ("AB.C1,1,2,3,4,5,6", None, None), ("ab.c1,90,-180,3,4,5,6,2020/02/29,3000/01/01", None, None),
    ("# AB.C1,1,2,3,4", "remark", None), ('  #"', "remark", None),
    ('AB.C1,1,2,3,"4', "quoting", 5), ('AB"C1,1,2,3,4', "quoting", 1), ('"AB.C1" x,1,2,3,4', "quoting", 1), ('AB.C1,"1" "1",2,3,4', "quoting", 2),
    ('"a,b",1,2', "columns", 4), ("", "columns", 2), (None, "columns", 2), ("a.b,1,2,3,4,5", "columns", 7), ("a.b,1,2,3,4,5,6,7,8,9", "columns", 10),
    ('"say ""hi""",1,2,3,4', "value", 1), ("AB.C.D,1,2,3,4", "value", 1), ("ABC,1,2,3,4", "value", 1), ("AB.Cé,1,2,3,4", "value", 1),
    ("A.B,90.1,2,3,4", "value", 2), ("A.B,1,180.5,3,4", "value", 3), ('A.B,1,"2,5",3,4', "value", 3), ("A.B,1,2,x,4", "value", 4), ("A.B,1,2,3,0", "value", 5), ("A.B,1,2,3,nan", "value", 5),
    ("A.B,1,2,3,4,-5,6", "value", 6), ("A.B,1,2,3,4,5,6,2021/02/29,3000/01/01", "value", 8), ("A.B,1,2,3,4,5,6,2021/02/28,2021/02/28", "value", 9), ("A.B,1,2,3,4,5,6,2021-02-28,2022/02/28", "value", 8),
]


def test_split_rows(spark):
    long = "x" * 300_000 + "," * 20_000 + '"' + "y" * 10
    lines = [*LINES, (long, "quoting", 20_001), ("," * 50_000, "columns", 10)]
    df = spark.createDataFrame([(i, x, "kept") for i, (x, _, _) in enumerate(lines)], "n int, line string, _n string")
    got = {r.n: (r.reason, r.broken, r["_n"]) for r in split_rows(df, "line").select("n", "reason", "broken", "_n").collect()}
    assert got == {i: (reason, broken, "kept") for i, (_, reason, broken) in enumerate(lines) if reason != "remark"}
    assert split_rows(df.limit(0), "line").count() == 0


def test_station_table(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(LINES)], "n int, line string")
    rows = {r.n: r for r in station_table(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert (rows[0].net_sta, rows[0].ge, rows[0].gz, rows[0].t0) == ("AB.C1", 4.0, 4.0, None)
    assert (rows[1].lon, rows[1].ge) == (-20.0, 4000.0) and rows[3].gn == 5.0 and rows[4].t0.year == 2020 and rows[4].net_sta == "AB.C1"


# ---------------------------------------------------------------- problem 5


def inside(x, y, ring):
    hit, n = False, len(ring)
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def star(rng, cx, cy, n):
    """A simple polygon around a point; one third of a turn at most lies between two corners."""
    angles = sorted((k + rng.uniform(0, 0.99)) * 2 * math.pi / n for k in range(n)) if n > 3 else [0.1, 2.2, 4.3]
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles for r in [rng.uniform(0.2, 1)]]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_ear_clipping_keeps_area():
    rng = random.Random(1)
    for k in range(60):
        ring = star(rng, 0, 0, rng.randint(3, 20))
        ring = ring[::-1] if k % 2 else ring
        ring = [*ring, ring[0]] if k % 3 else ring
        tri = ear_triangles(*map(np.array, zip(*ring, strict=True)))
        parts = 0.5 * ((tri[:, 1, 0] - tri[:, 0, 0]) * (tri[:, 2, 1] - tri[:, 0, 1]) - (tri[:, 1, 1] - tri[:, 0, 1]) * (tri[:, 2, 0] - tri[:, 0, 0]))
        open_ring = ring[:-1] if ring[0] == ring[-1] else ring
        assert (parts > 0).all() and math.isclose(parts.sum(), area(open_ring), rel_tol=1e-9)
    assert len(ear_triangles(np.array([0, 1, 2.0]), np.array([0, 1, 2.0]))) == 0
    assert len(ear_triangles(np.array([0, 1.0]), np.array([0, 1.0]))) == 0
    square = ear_triangles(np.array([0, 1, 1, 1, 0.0]), np.array([0, 0, 0.5, 1, 1.0]))  # a flat corner
    assert math.isclose(sum(area([tuple(p) for p in t]) for t in square), 1.0)


def test_box_tree_finds_all():
    rng = np.random.default_rng(0)
    tri = rng.uniform(0, 1, (200, 1, 2)) + rng.uniform(-0.05, 0.05, (200, 3, 2))
    x, y = rng.uniform(0, 1, (2, 300))
    p, t = BoxTree(np.hstack([tri.min(axis=1), tri.max(axis=1)])).candidates(x, y)
    lo, hi = tri.min(axis=1), tri.max(axis=1)
    boxed = [(i, j) for i in range(300) for j in range(200) if lo[j, 0] <= x[i] <= hi[j, 0] and lo[j, 1] <= y[i] <= hi[j, 1]]
    assert set(boxed) <= set(zip(p.tolist(), t.tolist(), strict=True))
    assert in_triangles(np.array([0.25, 2.0]), np.array([0.25, 2.0]), np.array([[[0, 0], [1, 0], [0, 1.0]]] * 2)).tolist() == [True, False]


@pytest.mark.parametrize("tile_points", [20_000, 20])
def test_regions_against_brute_force(spark, tile_points):
    rng = random.Random(2)
    rings = {f"R{k}": star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 9) for k in range(12)}
    zones = spark.createDataFrame([(k, [p[0] for p in r], [p[1] for p in r]) for k, r in rings.items()] * 2 + [("N", None, [1.0])], "z string, x array<double>, y array<double>")
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(400)]
    rows = [(i, y, x + 360 if x < 0 and i % 2 and x > -180 else x) for i, x, y in pts] + [(900, None, 1.0), (901, 1.0, None), (0, pts[0][2], pts[0][1])]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    got = [(r.id, r.region) for r in regions_of(df, "id", "lat", "lon", triangles(zones, "z", "x", "y"), tile_points=tile_points).collect()]
    assert sorted(got) == sorted((i, k) for i, x, y in pts for k, r in rings.items() if inside(x, y, r))


def test_border_point_once(spark):
    zones = spark.createDataFrame([("S", [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])], "z string, x array<double>, y array<double>")
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.5), (3, 1.0, 1.0)], "id bigint, lat double, lon double")
    got = sorted((r.id, r.region) for r in regions_of(df, "id", "lat", "lon", triangles(zones, "z", "x", "y")).collect())
    assert got == [(1, "S"), (2, "S"), (3, "S")]
    assert regions_of(df.limit(0), "id", "lat", "lon", triangles(zones, "z", "x", "y")).count() == 0


@pytest.mark.parametrize("centre", [(50.0, -40.0), (0.0, 180.0), (89.7, 0.0), (-60.0, 0.0)])
def test_near_against_brute_force(spark, centre):
    rng, km = random.Random(5), 3.0
    wide = 0.3 / max(0.02, math.cos(math.radians(centre[0])))
    wrap = lambda x: (x + 180) % 360 - 180
    pts = [(i, min(90.0, centre[0] + rng.uniform(-0.3, 0.3)), wrap(centre[1] + rng.uniform(-wide, wide))) for i in range(150)]
    sites = [(f"S{k}", a, b) for k, a, b in [(k, *pts[k][1:]) for k in range(0, 30, 3)]]

    def dist(a, b):
        d = abs(a[2] - b[2])
        return math.hypot(111 * (a[1] - b[1]), 111 * min(d, 360 - d) * math.cos(math.radians(b[1])))

    df = spark.createDataFrame([*pts, pts[0], (999, None, 1.0)], "id bigint, lat double, lon double")
    sf = spark.createDataFrame([*sites, ("S0", *sites[0][1:]), ("X", None, None)], "s string, la double, lo double")
    got = [(r.id, r.other) for r in near_pairs(df, "id", "lat", "lon", km).collect()]
    sure = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and max(dist(a, b), dist(b, a)) < km}
    maybe = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and min(dist(a, b), dist(b, a)) < km}
    assert len(got) == len(set(got)) and sure <= set(got) <= maybe
    near = [(r.id, r.site) for r in near_sites(df, "id", "lat", "lon", sf, "s", "la", "lo", km).collect()]
    assert sorted(near) == sorted((p[0], s[0]) for p in pts for s in sites if dist(p, s) < km)


def test_crowded_place_is_spread(spark):
    """One spot with most points, in blocks of a few possible pairs: the same pairs, and no group holds them all."""
    rng = random.Random(9)
    pts = [(i, 50.0 + rng.uniform(0, 1e-3), -40.0 + rng.uniform(0, 1e-3)) for i in range(120)] + [(200 + i, 50 + rng.uniform(-1, 1), -40 + rng.uniform(-1, 1)) for i in range(60)]
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double")
    plain = sorted(map(tuple, near_pairs(df, "id", "lat", "lon", 0.06).collect()))
    split = sorted(map(tuple, near_pairs(df, "id", "lat", "lon", 0.06, tile_points=30, block_pairs=400).collect()))
    assert plain == split and len(plain) > 1000
