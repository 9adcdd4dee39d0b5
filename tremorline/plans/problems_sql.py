"""SQL of the problem queries, for DuckDB."""

from __future__ import annotations


def _readings(tab: str, row_id: str, source: str, at: str, value: str, read: str, bad: str, z: str, limit: str) -> str:
    return f"""
SELECT DISTINCT '{tab}' AS tab, row_id FROM (
  WITH b AS (
    SELECT DISTINCT {row_id} AS row_id, nullif(upper(trim({source})), '') AS source, {at} AS t, {value} AS y
    FROM {tab} WHERE {read}
  ), c AS (SELECT *, {bad} AS bad FROM b),
  m AS (SELECT source, median({z}) AS level FROM c WHERE NOT bad AND source IS NOT NULL GROUP BY source),
  g AS (
    SELECT *, CASE WHEN NOT bad AND NOT lag(bad) OVER w AND y = lag(y) OVER w THEN 0 ELSE 1 END AS fresh
    FROM c WHERE source IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY t, row_id)
  ), i AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
  n AS (SELECT row_id, bad, count(*) OVER (PARTITION BY source, island) AS n FROM i)
  SELECT row_id FROM c WHERE bad
  UNION ALL SELECT c.row_id FROM c JOIN m USING (source) WHERE NOT bad AND abs(CASE WHEN NOT bad THEN {z} END - level) > {limit}
  UNION ALL SELECT row_id FROM n WHERE n >= 5 AND NOT bad
)"""


P1_FOUND = (
    _readings("picks", "pick_id", "net_sta", "tp", "s_amp", "s_amp IS NOT NULL AND s_amp <> -1", "NOT (isfinite(y) AND y > 0)", "log10(CASE WHEN y > 0 AND isfinite(y) THEN y END)", "2")
    + "\nUNION ALL\n"
    + _readings("evt_catalog", "event_id", "net", "evt_ot", "mag", "mag IS NOT NULL", "NOT (isfinite(y) AND y BETWEEN -5 AND 10)", "y", "3")
)

P3_FOUND = """
SELECT pick_id, epoch_id FROM (
  SELECT p.pick_id, g.epoch_id, row_number() OVER (PARTITION BY p.pick_id ORDER BY g.known_at DESC, g.t0 DESC, g.epoch_id) AS r
  FROM (SELECT DISTINCT pick_id, upper(trim(net_sta)) AS sta, tp FROM picks WHERE net_sta IS NOT NULL AND tp IS NOT NULL) p
  JOIN (SELECT DISTINCT epoch_id, upper(trim(net_sta)) AS sta, t0, t1, known_at FROM gain_epochs) g
    ON p.sta = g.sta AND g.t0 <= p.tp AND (g.t1 IS NULL OR p.tp < g.t1) AND g.known_at <= p.tp
) WHERE r = 1"""

_NUM = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LINES = r"""
WITH l AS (
  SELECT *, regexp_replace(line, '(^|,)[ \t\r]*"[^"]*("")*([^"]+("")*)*"[ \t\r]*(,|$)', '\1', 'g') AS unused FROM station_lines WHERE NOT regexp_matches(line, '^\s*#')
), f AS (
  SELECT line_no, line, regexp_matches(line, '^([^",]*|[ \t\r]*"([^"]|"")*"[ \t\r]*)(,([^",]*|[ \t\r]*"([^"]|"")*"[ \t\r]*))*$') AS quoted,
    regexp_extract_all(line || ',', '([ \t\r]*"([^"]|"")*"[ \t\r]*|[^",]*),', 1) AS raw FROM l
), v AS (
  SELECT line_no, quoted, list_transform(raw, lambda x: trim(x, E' \t\r')) AS c FROM f
), u AS (
  SELECT line_no, quoted, list_transform(c, lambda x: CASE WHEN x LIKE '"%' THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM v
), w AS (
  SELECT line_no, quoted, c, len(c) AS n,
    list_transform(c, lambda x: CASE WHEN regexp_full_match(x, 'NUMBER') THEN try_cast(x AS double) END) AS d,
    list_transform(c, lambda x: CASE WHEN regexp_full_match(x, '[0-9]{4}/[0-9]{2}/[0-9]{2}') THEN try_cast(replace(x, '/', '-') AS date) END) AS days
  FROM u
)
""".replace("NUMBER", _NUM).replace(", regexp_replace(line, '(^|,)[ \\t\\r]*\"[^\"]*(\"\")*([^\"]+(\"\")*)*\"[ \\t\\r]*(,|$)', '\\1', 'g') AS unused", "")
_GOOD = """regexp_full_match(c[1], '[A-Za-z0-9]+\\.[A-Za-z0-9]+') AND abs(d[2]) <= 90 AND abs(d[3]) <= 180 AND d[4] IS NOT NULL
    AND CASE WHEN n = 5 THEN d[5] > 0 ELSE d[5] > 0 AND d[6] > 0 AND d[7] > 0 END AND CASE WHEN n = 9 THEN days[8] < days[9] ELSE true END"""

P4_FOUND = f"""{_LINES}
SELECT line_no, reason FROM (
  SELECT line_no, CASE WHEN NOT quoted THEN 'quoting' WHEN n NOT IN (5, 7, 9) THEN 'columns' WHEN NOT coalesce({_GOOD}, false) THEN 'value' END AS reason FROM w
) WHERE reason IS NOT NULL"""

# The prefix of whole fields that keep the rule of quotes; the first field behind it is broken. Then the first field whose value is wrong.
_FIELD = r"""(?:[^",]*|[ \t\r]*"(?:[^"]|"")*"[ \t\r]*),"""
P4_BROKEN = f"""{_LINES}
SELECT line_no, reason, CASE reason WHEN 'quoting' THEN len(regexp_extract_all(regexp_extract(line || ',', '^(?:{_FIELD})*'), '{_FIELD}')) + 1 WHEN 'columns' THEN least(n, 9) + 1
  WHEN 'value' THEN CASE WHEN NOT regexp_full_match(c[1], '[A-Za-z0-9]+\\.[A-Za-z0-9]+') THEN 1 WHEN NOT coalesce(abs(d[2]) <= 90, false) THEN 2 WHEN NOT coalesce(abs(d[3]) <= 180, false) THEN 3
    WHEN d[4] IS NULL THEN 4 WHEN NOT coalesce(d[5] > 0, false) THEN 5 WHEN NOT coalesce(d[6] > 0, false) THEN 6 WHEN NOT coalesce(d[7] > 0, false) THEN 7 WHEN days[8] IS NULL THEN 8 ELSE 9 END END::int AS broken
FROM (SELECT w.*, s.line, CASE WHEN NOT quoted THEN 'quoting' WHEN n NOT IN (5, 7, 9) THEN 'columns' WHEN NOT coalesce({_GOOD}, false) THEN 'value' END AS reason FROM w JOIN station_lines s USING (line_no)) WHERE reason IS NOT NULL"""

P4_ROWS = f"""{_LINES}
SELECT s.line_no, s.file_name, upper(c[1]) AS net_sta, d[2] AS lat, d[3] AS lon, d[4] AS ele_m, d[5] AS ge,
  CASE WHEN n = 5 THEN d[5] ELSE d[6] END AS gn, CASE WHEN n = 5 THEN d[5] ELSE d[7] END AS gz,
  CASE WHEN n = 9 THEN days[8]::timestamp::timestamptz END AS t0, CASE WHEN n = 9 THEN days[9]::timestamp::timestamptz END AS t1
FROM w JOIN station_lines s USING (line_no) WHERE quoted AND n IN (5, 7, 9) AND coalesce({_GOOD}, false)"""

P5_FOUND = """
WITH e AS (
  SELECT DISTINCT event_id, evt_lat AS lat, CASE WHEN evt_lon > 180 THEN evt_lon - 360 ELSE evt_lon END AS lon
  FROM evt_catalog WHERE evt_lat IS NOT NULL AND evt_lon IS NOT NULL
), s AS (SELECT DISTINCT net_sta, lat, lon FROM stations WHERE lat IS NOT NULL AND lon IS NOT NULL),
ring AS (
  SELECT zone_id, unnest(ring_lon) AS x1, unnest(ring_lat) AS y1,
    unnest(list_append(ring_lon[2:], ring_lon[1])) AS x2, unnest(list_append(ring_lat[2:], ring_lat[1])) AS y2
  FROM (SELECT DISTINCT zone_id, ring_lon, ring_lat FROM zones)
)
SELECT a.event_id, 'event' AS kind, b.event_id::varchar AS other FROM e a JOIN e b ON a.event_id < b.event_id AND abs(a.lat - b.lat) < 0.001
WHERE sqrt(power(111 * (a.lat - b.lat), 2) + power(111 * (a.lon - b.lon) * cos(radians(b.lat)), 2)) < 0.06
UNION ALL
SELECT event_id, 'station', net_sta FROM e JOIN s ON abs(e.lat - s.lat) < 0.1
WHERE sqrt(power(111 * (e.lat - s.lat), 2) + power(111 * (e.lon - s.lon) * cos(radians(s.lat)), 2)) < 6
UNION ALL
SELECT event_id, 'zone', zone_id FROM e JOIN ring ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
GROUP BY event_id, zone_id HAVING count(*) % 2 = 1"""

O05_GAIN_EPOCHS = P4_ROWS.replace("SELECT s.line_no, s.file_name, upper", "SELECT DISTINCT upper")
O83_FIRST_STATION = f"SELECT net_sta, line_no, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY net_sta ORDER BY line_no) AS r FROM ({P4_ROWS})) WHERE r = 1"

ORACLES = {"o05_gain_epochs": O05_GAIN_EPOCHS, "o83_first_station": O83_FIRST_STATION, "p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_broken": P4_BROKEN, "p4_rows": P4_ROWS, "p5_found": P5_FOUND}
