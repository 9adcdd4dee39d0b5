"""SQL of the links between events, of greedy selections and of the filter's flags, for DuckDB."""

from __future__ import annotations

from tremorline.plans.relational_sql import _DE, _DP, _EV, _PK, ORACLES as RELATIONAL, _islands

# The rest of an island shrinks by one cluster per step: the first remaining detection and all less than two seconds from it.
_CLUSTERS = f"""WITH RECURSIVE {_DE}, {_EV}, {_DP},
base AS (SELECT det_id, temp_id, de.ot, cc, ev.ot AS temp_ot, coalesce(len(picks), 0) AS np FROM de JOIN ev ON ev.event_id::varchar = temp_id WHERE cc >= 0.2),
isl AS ({_islands('base', '', 'ot', 'det_id', 2000000)}),
g AS (SELECT island, list({{'id': det_id, 'ot': ot, 'cc': cc, 'own': coalesce(abs(temp_ot - ot) <= 2000000, false), 'np': np}} ORDER BY det_id) AS rest FROM isl GROUP BY island),
r AS (SELECT island, rest, list_filter(rest, lambda x: false) AS members FROM g
  UNION ALL SELECT island, list_filter(rest, lambda x: abs(x.ot - rest[1].ot) >= 2000000), list_filter(rest, lambda x: abs(x.ot - rest[1].ot) < 2000000) FROM r WHERE len(rest) > 0),
m AS (SELECT members[1].id AS seed, len(list_filter(members, lambda x: x.own)) > 0 AS is_self, len(members)::int AS members, unnest(members) AS d FROM r WHERE len(members) > 0),
o AS (SELECT seed, is_self, members, d.id AS id, d.ot AS ot, d.own AS own, d.cc AS cc,
  row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN is_self AND NOT d.own THEN 1 ELSE 0 END, CASE WHEN is_self THEN d.np ELSE d.cc END DESC, d.id) AS best,
  rank() OVER (PARTITION BY seed, d.own AND is_self ORDER BY d.cc DESC) AS near FROM m),
c AS (SELECT seed, any_value(is_self) AS is_self, any_value(members) AS members, max(CASE WHEN best = 1 THEN id END) AS event, max(CASE WHEN best = 1 THEN ot END) AS ot,
  count(*) FILTER (WHERE NOT (is_self AND own) AND near <= 30)::int AS links FROM o GROUP BY seed),
k AS (SELECT c.*, row_number() OVER (ORDER BY seed) AS pos FROM c),
e AS (SELECT k.*, CASE WHEN is_self THEN de.temp_id::bigint ELSE 10000000000 + pos - 1 END AS evid FROM k JOIN de ON de.det_id = k.event WHERE is_self OR links >= 2),
l AS (SELECT e.*, o.id AS det_id FROM e JOIN o USING (seed) WHERE NOT (o.is_self AND o.own) AND o.near <= 30),
w AS (SELECT l.seed, l.evid, d.temp_id::bigint AS temp, l.det_id, dp.sta, (d.ot - l.ot) / 1e6 AS late, dp.p AS p FROM l JOIN de d ON d.det_id = l.det_id JOIN dp ON dp.det_id = l.det_id),
x AS (SELECT seed, evid, temp, det_id, sta, 'P' AS phase, p.dt_p + late AS dt, p.cc_p AS cc FROM w WHERE abs(p.dt_p + late) <= 0.6 AND p.cc_p >= 0.4
  UNION ALL SELECT seed, evid, temp, det_id, sta, 'S', p.dt_s + late, p.cc_s FROM w WHERE abs(p.dt_s + late) <= 1.0 AND p.cc_s >= 0.4)
"""


def _blocks(src: str, a: str, b: str, block: str, last: str, keep: str) -> str:
    return f"""
SELECT a, b, {keep}, n, stations FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, {last}) AS r FROM (
  SELECT least({a}, {b}) AS a, greatest({a}, {b}) AS b, {block}, count(*) AS n, count(DISTINCT sta) AS stations FROM {src} GROUP BY ALL)) WHERE r = 1 AND stations >= 4"""


def _flags(tab: str, row_id: str, source: str, at: str, value: str, read: str, bad: str, z: str, limit: str) -> str:
    """One filter over each whole source, a reading per step."""
    return f"""
SELECT * FROM (
  WITH RECURSIVE b AS (SELECT DISTINCT {row_id} AS row_id, nullif(upper(trim({source})), '') AS source, {at} AS t, {value} AS y FROM {tab} WHERE {read}),
  c AS (SELECT *, {bad} AS bad FROM b),
  q AS (SELECT source, quantile_disc(round({z}, 3), [0.25, 0.5, 0.75]) AS q FROM c WHERE NOT bad AND source IS NOT NULL GROUP BY source),
  s AS (SELECT row_id, source, t, {z} - q[2] AS z, power(greatest((q[3] - q[1]) / 1.349, {limit} / 40.0), 2) AS r FROM c JOIN q USING (source) WHERE NOT bad),
  n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, row_id) AS k FROM s WHERE t IS NOT NULL),
  f AS (
    SELECT source, 0::bigint AS k, 0.0::double AS x, 0.25 * r AS p, NULL::bigint AS row_id, false AS hit, 0.0::double AS z FROM n WHERE k = 1
    UNION ALL
    SELECT source, k, CASE WHEN hit THEN fx ELSE fx + fp / (fp + r) * (z - fx) END, CASE WHEN hit THEN fp ELSE fp * (1 - fp / (fp + r)) END, row_id, hit, z
    FROM (SELECT *, power(z - fx, 2) > 9 * (fp + r) AS hit FROM (SELECT n.source, n.k, n.row_id, n.z, n.r, f.x * 0.98 AS fx, f.p * 0.9604 + 0.01 * n.r AS fp FROM f JOIN n ON n.source = f.source AND n.k = f.k + 1))
  ),
  g AS (
    SELECT *, CASE WHEN NOT bad AND NOT lag(bad) OVER w AND y = lag(y) OVER w THEN 0 ELSE 1 END AS fresh
    FROM c WHERE source IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY t, row_id)
  ), i AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
  m AS (SELECT row_id, bad, count(*) OVER (PARTITION BY source, island) AS n FROM i)
  SELECT '{tab}' AS tab, row_id, 'impossible' AS reason FROM c WHERE bad
  UNION ALL SELECT '{tab}', row_id, CASE WHEN abs(z) > {limit} THEN 'spike' ELSE 'jump' END FROM f WHERE hit
  UNION ALL SELECT '{tab}', row_id, CASE WHEN abs(z) > {limit} THEN 'spike' ELSE 'jump' END FROM s WHERE t IS NULL AND abs(z) > 3 * sqrt(1.25 * r)
  UNION ALL SELECT '{tab}', row_id, 'stuck' FROM m WHERE n >= 5 AND NOT bad
)"""


_LOG = "log10(CASE WHEN y > 0 AND isfinite(y) THEN y END)"

ORACLES = {
    "p1_flags": _flags("picks", "pick_id", "net_sta", "tp", "s_amp", "s_amp IS NOT NULL AND s_amp <> -1", "NOT (isfinite(y) AND y > 0)", _LOG, "2")
    + "\nUNION ALL\n"
    + _flags("evt_catalog", "event_id", "net", "evt_ot", "mag", "mag IS NOT NULL", "NOT (isfinite(y) AND y BETWEEN -5 AND 10)", "y", "3"),
    "o70_detection_clusters": _CLUSTERS + "SELECT seed, event, is_self, members, links, ot FROM c",
    "o71_cluster_links": _CLUSTERS + "SELECT evid, event, det_id FROM l",
    "o73_initial_locations": _CLUSTERS
    + """, t AS (SELECT evid, event, event AS det_id FROM e WHERE is_self UNION ALL SELECT evid, event, det_id FROM l WHERE NOT is_self)
SELECT evid, event, round(avg(ev.lat), 6) AS lat, round(avg(ev.lon), 6) AS lon, round(avg(ev.dep), 6) AS dep, count(*) AS templates
FROM t JOIN de USING (det_id) JOIN ev ON ev.event_id::varchar = de.temp_id GROUP BY evid, event""",
    "o74_detection_links": _CLUSTERS + "SELECT evid, temp, det_id, sta, round(dt, 6) AS dt, round(sqrt(cc), 4) AS weight, phase FROM x",
    "o75_link_blocks": _CLUSTERS + _blocks("x", "evid", "temp", "seed, det_id", "seed DESC, det_id DESC", "det_id"),
    "o75_pair_blocks": "WITH d AS (SELECT DISTINCT * FROM dt_cc WHERE evid1 <> -1 AND evid2 <> -1 AND evid1 <> evid2)" + _blocks("d", "evid1", "evid2", "evid1", "evid1 DESC", "evid1 AS first"),
    "o76_worker_numbers": f"""WITH {_EV}, v AS (SELECT event_id, ot, ot // 5184000000000 AS worker FROM ev WHERE ot IS NOT NULL)
SELECT event_id, worker, 10000000000 * (1 + worker) + row_number() OVER (PARTITION BY worker ORDER BY ot, event_id) - 1 AS evid FROM v""",
    "o03_ground_motion": f"""SELECT o.pick_id, o.epoch_id, p.s_amp / g.gz AS motion FROM ({RELATIONAL['o06_gain_epoch']}) o
JOIN (SELECT DISTINCT pick_id, s_amp FROM picks WHERE s_amp <> -1) p USING (pick_id) JOIN (SELECT DISTINCT epoch_id, gz FROM gain_epochs WHERE gz > 0) g USING (epoch_id)""",
    "o51_gap_selection": f"""WITH RECURSIVE {_PK}, s AS (SELECT pick_id, sta, tp FROM pk WHERE sta IS NOT NULL), i AS ({_islands('s', 'sta', 'tp', 'pick_id', 600000000)}),
g AS (SELECT sta, island, list({{'t': tp, 'id': pick_id}} ORDER BY tp, pick_id) AS rest FROM i GROUP BY sta, island),
r AS (SELECT sta, rest, NULL::bigint AS tp, NULL::bigint AS pick_id FROM g
  UNION ALL SELECT sta, list_filter(rest, lambda x: x.t >= rest[1].t + 600000000), rest[1].t, rest[1].id FROM r WHERE len(rest) > 0)
SELECT sta, tp, pick_id FROM r WHERE pick_id IS NOT NULL""",
}
