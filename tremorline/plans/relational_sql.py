"""SQL of the relational queries, for DuckDB."""

from __future__ import annotations

_PK = """pk AS (
  SELECT DISTINCT pick_id, nullif(upper(trim(net_sta)), '') AS sta, epoch_us(sta_ot) AS ot, epoch_us(tp) AS tp, epoch_us(ts) AS ts,
    CASE WHEN s_amp <> -1 THEN s_amp END AS s_amp, p_snr, fd, amp_ratio, a12, a13 FROM picks)"""
_EV = """ev AS (
  SELECT DISTINCT event_id, nullif(upper(trim(net)), '') AS net, epoch_us(evt_ot) AS ot, evt_lat AS lat,
    CASE WHEN evt_lon > 180 THEN evt_lon - 360 ELSE evt_lon END AS lon, evt_dep AS dep, mag, res FROM evt_catalog)"""
_ST = """st AS (SELECT sta, any_value(lat) AS lat, any_value(lon) AS lon, any_value(coalesce(ele_m, 0)) AS ele_m
  FROM (SELECT upper(trim(net_sta)) AS sta, lat, lon, ele_m FROM stations WHERE lat IS NOT NULL AND lon IS NOT NULL) GROUP BY sta)"""
_DE = """de AS (
  SELECT DISTINCT det_id, clu_id, CASE WHEN trim(temp_id) NOT IN ('', '-1') THEN trim(temp_id) END AS temp_id, epoch_us(det_ot) AS ot, lat,
    CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, dep, CASE WHEN cc > 0 AND cc <= 1 THEN cc END AS cc, picks FROM detections)"""
_DP = """dp AS (
  SELECT det_id, upper(trim(p.net_sta)) AS sta, min(ord) AS ord, arg_min(p, ord) AS p
  FROM (SELECT det_id, unnest(picks) AS p, generate_subscripts(picks, 1) - 1 AS ord FROM de) WHERE p.net_sta IS NOT NULL AND trim(p.net_sta) <> '' GROUP BY 1, 2)"""
_MG = """mg AS (
  SELECT d.det_id, dp.sta, dp.ord, sqrt(power(111.0 * (d.lon - st.lon) * cos(radians(st.lat)), 2) + power(111.0 * (d.lat - st.lat), 2) + power(d.dep + st.ele_m / 1000, 2)) AS km, dp.p.s_amp AS amp
  FROM dp JOIN de d USING (det_id) JOIN st USING (sta) WHERE d.lat IS NOT NULL AND d.lon IS NOT NULL AND d.dep IS NOT NULL),
m AS (SELECT *, CASE WHEN amp > 0 AND km > 0 THEN log10(amp * 1e6) + log10(km) + 1 END AS mag FROM mg)"""


def _snr(select: str, value: str = "p_snr", tail: str = "") -> str:
    return f"""WITH {_PK}, n AS (SELECT pick_id, sta, tp, coalesce(CASE WHEN isfinite({value}) THEN {value} END, 0) AS {value},
  row_number() OVER (PARTITION BY sta ORDER BY tp, pick_id) AS pos, count(*) OVER (PARTITION BY sta) AS total
  FROM pk WHERE sta IS NOT NULL AND tp IS NOT NULL) {select} {tail}"""


def _median(src: str, key: str, value: str, tie: str) -> str:
    return f"""
SELECT {key}, median(CASE WHEN r > 1 THEN {value} END) AS med, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(abs({value} - mid), 9) DESC, {tie}) AS r
  FROM (SELECT *, median({value}) OVER (PARTITION BY {key}) AS mid FROM {src} WHERE {value} IS NOT NULL)
) GROUP BY {key}"""


def _islands(src: str, part: str, t: str, tie: str, gap: int) -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"""SELECT *, max(start) OVER ({by}ORDER BY {t}, {tie} ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lag({t}) OVER ({by}ORDER BY {t}, {tie}) IS NULL OR {t} - lag({t}) OVER ({by}ORDER BY {t}, {tie}) >= {gap} THEN {t} END AS start FROM {src} WHERE {t} IS NOT NULL)"""


_ISO = "strftime(make_timestamp(ot), '%Y-%m-%dT%H:%M:%S.%fZ')"
_COMPACT = "strftime(make_timestamp(ot), '%Y%m%d%H%M%S') || '.' || lpad((ot % 1000000 // 10000)::varchar, 2, '0')"


def _dm(x: str, pos: str, neg: str, width: int) -> str:
    return f"lpad(floor(abs({x}))::int::varchar, {width}, '0') || CASE WHEN {x} < 0 THEN '{neg}' ELSE '{pos}' END || lpad(floor((abs({x}) - floor(abs({x}))) * 6000)::int::varchar, 4, '0')"


ORACLES = {
    "o06_gain_epoch": f"""WITH {_PK}, g AS (
  SELECT DISTINCT epoch_id, nullif(upper(trim(net_sta)), '') AS sta, coalesce(epoch_us(t0), -9223372036854775807) AS t0, coalesce(epoch_us(t1), 9223372036854775807) AS t1 FROM gain_epochs),
e AS (SELECT sta, max(epoch_id) AS last FROM g GROUP BY sta),
f AS (SELECT p.pick_id, min(g.epoch_id) AS first FROM pk p JOIN g ON p.sta = g.sta AND g.t0 < p.tp AND p.tp < g.t1 GROUP BY 1)
SELECT p.pick_id, coalesce(f.first, e.last) AS epoch_id, f.first IS NOT NULL AS matched FROM pk p JOIN e USING (sta) LEFT JOIN f USING (pick_id) WHERE p.tp IS NOT NULL""",
    "o30_origin_time": f"WITH {_PK} SELECT pick_id, round(tp / 1e6 - (ts / 1e6 - tp / 1e6) / (1.0::double / 3.45::double - 1.0::double / 6.0::double) / 6.0::double, 3) AS ot FROM pk WHERE tp IS NOT NULL AND ts >= tp",
    "o32_station_magnitude": f"WITH {_DE}, {_DP}, {_ST}, {_MG} SELECT det_id, sta, round(km, 6) AS km, round(mag, 6) AS mag FROM m",
    "o56_event_magnitude": f"WITH {_DE}, {_DP}, {_ST}, {_MG} SELECT det_id, round(med, 6) AS mag, n FROM ({_median('m', 'det_id', 'mag', 'ord')})",
    "o36_rounded_columns": f"WITH {_EV} SELECT event_id, {', '.join(f'CASE WHEN isfinite({c}) THEN round_even({c}, {n}) END AS {c}' for c, n in (('lon', 2), ('lat', 2), ('dep', 0), ('res', 1), ('mag', 2)))} FROM ev",
    "o34_event_names": f"WITH {_EV} SELECT event_id, {_COMPACT} AS name FROM ev WHERE ot IS NOT NULL",
    "o33_degree_minutes": f"WITH {_EV} SELECT event_id, {_dm('lat', 'N', 'S', 2)} AS lat, {_dm('lon', 'E', 'W', 3)} AS lon FROM ev WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "o37_window": f"WITH {_EV} SELECT event_id, lat, lon FROM ev WHERE ot > epoch_us(TIMESTAMP '2000-02-01') AND ot < epoch_us(TIMESTAMP '2000-03-01') AND lat > 49 AND lat < 51 AND lon > -41 AND lon < -39",
    "o38_known_stations": f"WITH {_PK}, {_ST} SELECT pick_id, sta FROM pk SEMI JOIN st USING (sta)",
    "o39_quality": f"WITH {_PK} SELECT pick_id, coalesce(fd > 2.5 AND amp_ratio < 5 AND a12 < 8 AND a13 < 3, false) AS good FROM pk",
    "o41_flat_runs": _snr(""", s AS (SELECT *, CASE WHEN s_amp = lag(s_amp) OVER (PARTITION BY sta ORDER BY pos) THEN NULL ELSE pos END AS start FROM n),
i AS (SELECT *, max(start) OVER (PARTITION BY sta ORDER BY pos ROWS UNBOUNDED PRECEDING) AS first FROM s)
SELECT sta, first, max(pos) AS last, min(s_amp) AS value, count(*) AS n FROM i GROUP BY sta, first HAVING count(*) >= 4""", "s_amp"),
    "o43_sta_lta": _snr("""SELECT pick_id, round(CASE WHEN pos >= 16 AND pos <= total - 4 AND sum(p_snr * p_snr) OVER l > 0
  THEN sum(p_snr * p_snr) OVER s / 4 / (sum(p_snr * p_snr) OVER l / 16) ELSE 0 END, 6) AS ratio FROM n
WINDOW s AS (PARTITION BY sta ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), l AS (PARTITION BY sta ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"""),
    "o44_kurtosis": _snr("""SELECT pick_id, round(k, 6) AS kurtosis FROM (SELECT pick_id, kurtosis_pop(p_snr) OVER w AS k, min(p_snr) OVER w AS low, max(p_snr) OVER w AS high, pos FROM n
WINDOW w AS (PARTITION BY sta ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE pos >= 10 AND low < high"""),
    "o47c_turning_points": _snr(""", s AS (SELECT sta, pos - 1 AS spot, p_snr - lag(p_snr) OVER (PARTITION BY sta ORDER BY pos) AS step FROM n),
f AS (SELECT sta, CASE WHEN bool_or(step < 0) AND bool_or(step > 0) THEN greatest(min(CASE WHEN step < 0 THEN spot END), min(CASE WHEN step >= 0 THEN spot END)) ELSE 0 END AS first_turn FROM s GROUP BY sta),
l AS (SELECT sta, CASE WHEN bool_or(step < 0) AND bool_or(step >= 0) THEN greatest(min(CASE WHEN step < 0 THEN spot END), min(CASE WHEN step >= 0 THEN spot END)) END AS second_turn
  FROM s JOIN f USING (sta) WHERE first_turn > 0 AND spot > first_turn GROUP BY sta)
SELECT sta, first_turn, coalesce(second_turn, first_turn) AS second_turn FROM f LEFT JOIN l USING (sta)"""),
    "o47e_rolling_norm": _snr("SELECT pick_id, round(sqrt(coalesce(sum(p_snr * p_snr) OVER (PARTITION BY sta ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0)), 6) AS norm FROM n"),
    "o48_nearest_stations": f"""WITH {_DE}, {_DP}, {_ST}, {_MG}, v AS (
  SELECT m.det_id, m.sta, round((d.ot / 1e6 + km / 6.0::double + coalesce(dp.p.dt_p, 0)) * 1e6) AS tp, round((d.ot / 1e6 + km / 3.45::double + coalesce(dp.p.dt_s, 0)) * 1e6) AS ts
  FROM m JOIN de d USING (det_id) JOIN dp ON dp.det_id = m.det_id AND dp.sta = m.sta WHERE d.ot IS NOT NULL)
SELECT det_id, sta, rank FROM (SELECT det_id, sta, row_number() OVER (PARTITION BY det_id ORDER BY tp, sta)::int AS rank FROM v WHERE ts > tp) WHERE rank <= 15""",
    "o53_neighbours": f"WITH {_PK} SELECT pick_id, count(*) OVER (ORDER BY ot RANGE BETWEEN 59999999 PRECEDING AND 59999999 FOLLOWING) AS n FROM pk WHERE ot IS NOT NULL",
    "o54_islands": f"WITH {_PK} SELECT pick_id, island FROM ({_islands('pk', '', 'ot', 'pick_id', 60000000)})",
    "o57_templates": f"WITH {_DE}, {_EV} SELECT event_id, ev.lat, ev.lon, count(*) AS n FROM ev JOIN de ON try_cast(temp_id AS bigint) = event_id GROUP BY ALL",
    "o58_event_phases": f"WITH {_DE}, {_DP}, {_EV} SELECT det_id, sta, event_id, ev.mag FROM dp JOIN de USING (det_id) JOIN ev ON try_cast(temp_id AS bigint) = event_id",
    "o59_enough_stations": f"WITH {_DE}, {_DP}, {_ST} SELECT det_id, count(*) AS stations FROM dp JOIN st USING (sta) GROUP BY det_id HAVING count(*) >= 4",
    "o60_all_template_days": f"""WITH {_DE}, t AS (SELECT DISTINCT temp_id FROM de WHERE temp_id IS NOT NULL AND ot IS NOT NULL),
d AS (SELECT unnest(generate_series(date_trunc('day', min(make_timestamp(ot))), date_trunc('day', max(make_timestamp(ot))), INTERVAL 1 DAY))::date::varchar AS day FROM de WHERE ot IS NOT NULL)
SELECT temp_id, day FROM t CROSS JOIN d""",
    "o72_neighbour_cap": f"""WITH {_DE} SELECT clu_id, det_id, cc, rank FROM (SELECT *, rank() OVER (PARTITION BY clu_id ORDER BY cc DESC)::int AS rank, count(*) OVER (PARTITION BY clu_id) AS n
  FROM de WHERE cc IS NOT NULL AND clu_id IS NOT NULL) WHERE rank <= 30 AND n >= 2""",
    "o73_mean_location": f"WITH {_DE} SELECT clu_id, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon, round(avg(dep), 8) AS dep, count(*) AS n FROM de WHERE clu_id IS NOT NULL GROUP BY clu_id",
    "o74_weighted_links": "SELECT DISTINCT evid1, evid2, sta, dt, round(sqrt(weight), 6) AS weight, phase FROM dt_cc WHERE evid1 <> -1 AND evid2 <> -1 AND abs(dt) <= 0.5 AND weight >= 0.3",
    "o75_unique_pairs": "SELECT least(evid1, evid2) AS a, greatest(evid1, evid2) AS b, count(*) AS n, count(DISTINCT sta) AS stations FROM dt_cc WHERE evid1 <> -1 AND evid2 <> -1 AND evid1 <> evid2 GROUP BY 1, 2 HAVING count(DISTINCT sta) >= 4",
    "o76_running_numbers": f"WITH {_EV} SELECT event_id, row_number() OVER (ORDER BY ot, event_id) AS evid FROM ev WHERE ot IS NOT NULL",
    "o77_padded_cells": f"""WITH {_EV}, c AS (SELECT i, j FROM range(4) a(i), range(4) b(j))
SELECT event_id, i::int AS i, j::int AS j, lon > -42.0 + i AND lon <= -41.0 + i AND lat > 48.0 + j AND lat <= 49.0 + j AS is_home
FROM ev JOIN c ON lon + 42.0 + 0.1 > i AND lon + 42.0 - 0.1 <= i + 1 AND lat - 48.0 + 0.1 > j AND lat - 48.0 - 0.1 <= j + 1""",
    "o79_best_of_all": f"""WITH {_EV} SELECT net, day, event_id, res FROM (
  SELECT *, make_timestamp(ot)::date::varchar AS day, row_number() OVER (PARTITION BY net, make_timestamp(ot)::date ORDER BY res, CASE WHEN isfinite(mag) THEN mag END DESC NULLS LAST, event_id) AS r
  FROM ev WHERE ot IS NOT NULL AND net IS NOT NULL AND res IS NOT NULL) WHERE r = 1""",
    "o80_event_neighbours": f"""WITH {_EV}, e AS (SELECT * FROM ev WHERE lat IS NOT NULL AND lon IS NOT NULL AND dep IS NOT NULL),
p AS (SELECT a.event_id AS id, b.event_id AS other, sqrt(power(111 * (a.lon - b.lon) * cos(radians(CASE WHEN a.event_id < b.event_id THEN a.lat ELSE b.lat END)), 2) + power(111 * (a.lat - b.lat), 2) + power(a.dep - b.dep, 2)) AS km
  FROM e a JOIN e b ON a.event_id <> b.event_id AND abs(a.lat - b.lat) < 0.05)
SELECT id, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(km, 6), other)::int AS rank FROM p WHERE km < 5) WHERE rank <= 10""",
    "o84_all_places": f"WITH {_EV}, {_DE} SELECT 'event' AS kind, event_id AS id, lat, lon FROM ev WHERE lat IS NOT NULL AND lon IS NOT NULL UNION ALL SELECT 'detection', det_id, lat, lon FROM de WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "o85_segments": f"WITH {_PK} SELECT (tp - epoch_us(TIMESTAMP '2000-01-01')) // 2592000000000 AS segment, count(*) AS picks, count(DISTINCT sta) AS stations FROM pk WHERE tp IS NOT NULL GROUP BY 1",
    "o20_all_catalog_lines": f"WITH {_EV} SELECT event_id, {_ISO} || ',' || printf('%.4f,%.4f,%.1f,%.2f', lat, lon, dep, CASE WHEN isfinite(mag) THEN mag ELSE -1 END) AS line FROM ev WHERE ot IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND dep IS NOT NULL",
    "o11_phase_blocks": f"""WITH {_DE} SELECT temp_id || '_' || {_COMPACT} || ',' || {_ISO} || ',' || printf('%.4f,%.4f,%.1f,%.3f', lat, lon, dep, cc) AS head, sum(coalesce(len(list_filter(picks, lambda p: p IS NOT NULL)), 0))::bigint AS phases
FROM de WHERE ot IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND dep IS NOT NULL AND cc IS NOT NULL AND temp_id IS NOT NULL GROUP BY 1""",
    "o25_phase_times": f"""WITH {_PK} SELECT pick_id, rpad(split_part(sta, '.', 2), 5, ' ') || split_part(sta, '.', 1) || '  HHZ IP 0 ' || strftime(make_timestamp(tp), '%Y%m%d%H%M') || ' ' || strftime(make_timestamp(tp), '%S') || lpad((tp % 1000000 // 10000)::varchar, 2, '0')
  || '        ' || rpad(((ts - tp // 60000000 * 60000000) // 10000)::varchar, greatest(4, length(((ts - tp // 60000000 * 60000000) // 10000)::varchar))::int, ' ') || 'ES 1 ' AS line FROM pk WHERE tp IS NOT NULL AND ts >= tp AND sta IS NOT NULL""",
    "lineitem_best_supplier": f"WITH m AS (SELECT l_suppkey, l_orderkey, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(med, 4) AS price, n FROM ({_median('m', 'l_suppkey', 'price', 'l_orderkey')})",
    "events_sessions": f"WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events) SELECT event_type, island, count(*) AS n FROM ({_islands('e', 'event_type', 't', 'event_id', 600000000)}) GROUP BY 1, 2",
    "embeddings_template_cc": """WITH v AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), t AS (SELECT label, min(vec_id) AS temp_id, arg_min(v, vec_id) AS t FROM v GROUP BY label)
SELECT vec_id, temp_id, round(list_dot_product(v, t) / sqrt(list_dot_product(v, v) * list_dot_product(t, t)), 5) AS cc FROM v JOIN t USING (label)""",
}
ORACLES |= {old: ORACLES[new] for old, new in (("o36_rounded_events", "o36_rounded_columns"), ("o60_template_days", "o60_all_template_days"), ("o79_best_solution", "o79_best_of_all"), ("o20_catalog_lines", "o20_all_catalog_lines"))}
