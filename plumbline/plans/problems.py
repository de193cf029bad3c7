"""The queries of the numbered problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.numbers import quantised
from plumbline.operators import grid, history, nearest, spikes, timestamps, trips
from plumbline.plans.registry import Registry
from plumbline.sources.tables import table

REGISTRY = Registry()


def instants_sql() -> str:
    """The cascade of patterns is the operator's; what is done with its parts is SQL."""
    match, fill = [], []
    for pattern, order in timestamps.CASCADE:
        to = "|".join(f"\\{g}" if g else "" for g in order)
        match.append(f"WHEN regexp_matches(t, '{pattern}') THEN regexp_replace(t, '{pattern}', '{to}')")
    zones = ", ".join(f"('{k}', {v})" for k, v in timestamps.ZONE_MINUTES.items())
    months = ", ".join(f"'{m}'" for m in timestamps.MONTHS)
    fill = " ".join(match)
    offset = r"([+-])(\d{1,2}):?(\d{2})?$"
    return rf"""
WITH z AS (SELECT source_id, CASE WHEN count(DISTINCT clock_zone) = 1 THEN min(clock_zone) END AS zone FROM clock_sources GROUP BY source_id),
a(name, minutes) AS (VALUES {zones}),
r AS (SELECT DISTINCT 'telemetry_frames' AS table_name, seq AS row_no, regexp_replace(device_time, '^[\s\x00]+|[\s\x00]+$', '', 'g') AS t, recorder_id AS source_id, evidence_id || '/' || video_id AS video, frame_index FROM telemetry_frames WHERE device_time IS NOT NULL
  UNION ALL SELECT DISTINCT 'chain_of_custody', event_id, regexp_replace(timestamp_utc, '^[\s\x00]+|[\s\x00]+$', '', 'g'), station_id, NULL, NULL FROM chain_of_custody WHERE timestamp_utc IS NOT NULL),
p AS (SELECT *, string_split(CASE {fill} END, '|') AS x, CASE WHEN regexp_matches(t, '^[0-9]{{9,20}}$') THEN try_cast(t AS BIGINT) END AS e FROM r),
q AS (SELECT *, coalesce(try_cast(x[2] AS BIGINT), list_position([{months}], lower(left(x[2], 3)))) AS mo, try_cast(x[4] AS BIGINT) AS h, lower(left(x[8], 1)) AS half, upper(x[9]) AS w FROM p),
l AS (SELECT q.*, epoch_us(try(make_timestamp(CAST(x[1] AS BIGINT), CAST(mo AS BIGINT), CAST(x[3] AS BIGINT), CASE half WHEN '' THEN h WHEN 'a' THEN h % 12 ELSE h % 12 + 12 END, CAST(x[5] AS BIGINT), CAST(coalesce(try_cast(x[6] AS BIGINT), 0) AS DOUBLE))))
    + CAST(rpad(left(x[7], 6), 6, '0') AS BIGINT) AS local_us,
  CASE WHEN regexp_matches(w, '{offset}') THEN (CASE WHEN regexp_extract(w, '{offset}', 1) = '-' THEN -1 ELSE 1 END) * (CAST(regexp_extract(w, '{offset}', 2) AS BIGINT) * 60 + coalesce(try_cast(regexp_extract(w, '{offset}', 3) AS BIGINT), 0)) ELSE a.minutes END AS minutes
  FROM q LEFT JOIN a ON a.name = w),
u AS (SELECT l.*, zone, CASE WHEN e IS NOT NULL THEN CASE WHEN e < 1000000000 THEN NULL WHEN e < 100000000000 THEN e * 1000000 WHEN e < 100000000000000 THEN e * 1000 WHEN e < 100000000000000000 THEN e ELSE e // 1000 END ELSE local_us - minutes * 60000000 END AS told,
  CASE WHEN w = '' AND minutes IS NULL THEN epoch_us(timezone(zone, make_timestamp(local_us))) END AS late FROM l LEFT JOIN z USING (source_id)),
f AS (SELECT *, told IS NULL AND timezone(zone, make_timestamptz(late - 3600000000)) = make_timestamp(local_us) AS twice FROM u),
m AS (SELECT *, twice AND max(CASE WHEN twice THEN local_us END) OVER (PARTITION BY table_name, video ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - local_us >= 1800000000 AND video IS NOT NULL AS again FROM f)
SELECT table_name, row_no, CAST(coalesce(told, CASE WHEN twice AND NOT coalesce(again, false) THEN late - 3600000000 ELSE late END) AS BIGINT) AS utc_us FROM m WHERE coalesce(told, late) IS NOT NULL
UNION ALL SELECT DISTINCT 'forensic_timeline', seq, CAST(CASE WHEN boot_utc_us IS NOT NULL THEN boot_utc_us + timestamp_us WHEN timestamp_us < 1000000000 THEN NULL WHEN timestamp_us < 100000000000 THEN timestamp_us * 1000000 WHEN timestamp_us < 100000000000000 THEN timestamp_us * 1000
  WHEN timestamp_us < 100000000000000000 THEN timestamp_us ELSE timestamp_us // 1000 END AS BIGINT) FROM forensic_timeline WHERE timestamp_us > 0 AND (boot_utc_us IS NOT NULL OR timestamp_us >= 1000000000)"""


_VERSIONS = """
WITH raw AS (
  SELECT DISTINCT evidence_id, field, seq, CAST(round(timestamp_seconds * 1e6) AS BIGINT) AS t, lower(trim(new_value)) AS n, lower(trim(previous_value)) AS p
  FROM state_reconstruction WHERE new_value IS NOT NULL),
c AS (SELECT evidence_id, field, seq, t,
    CASE WHEN field IN ('arming_state', 'nav_state') THEN CAST(CAST(CAST(n AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN n IN ('true', '1', '1.0') THEN '1' ELSE '0' END AS n,
    CASE WHEN p IS NULL THEN NULL WHEN field IN ('arming_state', 'nav_state') THEN CAST(CAST(CAST(p AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN p IN ('true', '1', '1.0') THEN '1' ELSE '0' END AS p
  FROM raw),
i AS (SELECT evidence_id, field, t, list(n ORDER BY seq) AS ins, list(p ORDER BY seq) AS outs, count(*) AS k FROM c GROUP BY ALL),
e AS (SELECT *, list_filter(ins, lambda x: len(list_filter(ins, lambda y: y = x)) > len(list_filter(outs, lambda y: y = x))) AS ends FROM i),
v AS (SELECT evidence_id, field, t, CASE WHEN k = 1 THEN ins[1] ELSE ends[-1] END AS v, CASE WHEN k > 1 AND len(ends) = 0 THEN list_concat(ins, outs) END AS circle, ins[-1] AS fallback FROM e),
h AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY evidence_id, field ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM v),
s AS (SELECT evidence_id, field, t, CASE WHEN circle IS NULL THEN v WHEN held IS NULL OR NOT list_contains(circle, held) THEN fallback END AS v FROM h),
w AS (SELECT *, lag(v) OVER (PARTITION BY evidence_id, field ORDER BY t) AS before FROM s WHERE v IS NOT NULL),
y AS (SELECT evidence_id, field, v AS value, row_number() OVER (PARTITION BY evidence_id, field ORDER BY t) AS version, t AS valid_from_us, coalesce(lead(t) OVER (PARTITION BY evidence_id, field ORDER BY t), -1) AS valid_to_us
  FROM w WHERE before IS NULL OR before <> v)"""


@REGISTRY.add("p1_found", f"{_VERSIONS} SELECT evidence_id, field, valid_from_us, valid_to_us FROM y")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.attribute_history(table(spark, d, "state_reconstruction")).select("evidence_id", "field", "valid_from_us", "valid_to_us")


@REGISTRY.add("p1_history", f"{_VERSIONS} SELECT * FROM y")
def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their values and numbers."""
    return history.attribute_history(table(spark, d, "state_reconstruction"))


@REGISTRY.add("p2_found", instants_sql())
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.all_instants(*(table(spark, d, t) for t in ("telemetry_frames", "chain_of_custody", "forensic_timeline", "clock_sources")))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, d, "gps")).select("evidence_id", "kind", "first_seq", "last_seq")


@REGISTRY.add("p3_trips")
def p3_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with start, end, duration and distance."""
    return trips.stops_and_trips(table(spark, d, "gps"))


@REGISTRY.add("p4_found", """
WITH acks AS (
  SELECT c.seq AS l, a.seq AS r, abs(a.timestamp_us - c.command_timestamp_us) AS gap
  FROM commands c JOIN command_acks a ON a.evidence_id = c.evidence_id AND a.command_id = c.command_id
  AND a.timestamp_us BETWEEN c.command_timestamp_us - 2000000 AND c.command_timestamp_us + 2000000),
f AS (SELECT seq, evidence_id, CAST(round((log_offset_s + start_s) * 1e6) AS BIGINT) AS t FROM telemetry_frames),
p AS (SELECT seq, evidence_id, CAST(round("timestamp" * 1e6) AS BIGINT) AS t FROM gps),
pings AS (SELECT f.seq AS l, p.seq AS r, abs(p.t - f.t) AS gap FROM f JOIN p ON p.evidence_id = f.evidence_id AND p.t BETWEEN f.t - 1000000 AND f.t + 1000000)
SELECT 'command_ack' AS kind, l AS left_seq, arg_min(r, (gap, r)) AS right_seq FROM acks GROUP BY l
UNION ALL SELECT 'frame_gps', l, arg_min(r, (gap, r)) FROM pings GROUP BY l""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    acks = nearest.command_acks(table(spark, d, "commands"), table(spark, d, "command_acks"))
    pings = nearest.frame_pings(table(spark, d, "telemetry_frames"), table(spark, d, "gps"))
    return acks.select(F.lit("command_ack").alias("kind"), "left_seq", "right_seq").unionByName(pings.select(F.lit("frame_gps").alias("kind"), "left_seq", "right_seq"))


@REGISTRY.add("p5_found", """
WITH r AS (SELECT evidence_id, CAST(floor("timestamp") AS BIGINT) AS slot, x_m IS NOT NULL AND position_valid AS px, vx_m_s IS NOT NULL AND velocity_valid AS pv
           FROM trajectory WHERE evidence_id IS NOT NULL AND "timestamp" IS NOT NULL),
g AS (SELECT evidence_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM r GROUP BY evidence_id),
s AS (SELECT evidence_id, slot, bool_or(px) AS px, bool_or(pv) AS pv FROM r GROUP BY evidence_id, slot)
SELECT g.evidence_id, f.field, g.slot FROM g CROSS JOIN (VALUES ('x_m'), ('vx_m_s')) f(field)
LEFT JOIN s ON s.evidence_id = g.evidence_id AND s.slot = g.slot
WHERE NOT coalesce(CASE WHEN f.field = 'x_m' THEN s.px ELSE s.pv END, false)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "trajectory")).where("state <> 'observed'").select("evidence_id", "field", "slot")


@REGISTRY.add("p5_grid", """
WITH r AS (SELECT DISTINCT evidence_id, seq, "timestamp" AS ts, CAST(floor("timestamp") AS BIGINT) AS slot, CASE WHEN position_valid THEN x_m END AS x, CASE WHEN velocity_valid THEN vx_m_s END AS v FROM trajectory WHERE evidence_id IS NOT NULL AND "timestamp" IS NOT NULL),
g AS (SELECT evidence_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM r GROUP BY evidence_id),
p AS (SELECT evidence_id, seq, ts, slot, 'x_m' AS field, x AS y FROM r WHERE x IS NOT NULL UNION ALL SELECT evidence_id, seq, ts, slot, 'vx_m_s', v FROM r WHERE v IS NOT NULL),
m AS (SELECT evidence_id, field, slot, avg(y) AS y FROM p GROUP BY ALL), a AS (SELECT evidence_id, field, ts, slot, arg_max(y, seq) AS y FROM p GROUP BY ALL), z AS (SELECT evidence_id, field, ts, arg_min(y, seq) AS y FROM p GROUP BY ALL),
q AS (SELECT g.evidence_id, f.field, g.slot, CAST(g.slot AS DOUBLE) AS low, CAST(g.slot + 1 AS DOUBLE) AS high, m.y AS own FROM g CROSS JOIN (VALUES ('x_m'), ('vx_m_s')) f(field) LEFT JOIN m ON m.evidence_id = g.evidence_id AND m.field = f.field AND m.slot = g.slot),
l AS (SELECT q.*, a.ts AS lt, a.y AS ly FROM q ASOF LEFT JOIN a ON a.evidence_id = q.evidence_id AND a.field = q.field AND q.low > a.ts),
b AS (SELECT l.*, z.ts AS rt, z.y AS ry FROM l ASOF LEFT JOIN z ON z.evidence_id = l.evidence_id AND z.field = l.field AND l.high <= z.ts)
SELECT evidence_id, field, slot, floor(coalesce(own, CASE WHEN rt - lt <= 10 THEN ly + (ry - ly) * (slot + 0.5 - lt) / (rt - lt) END) * 1e7 + 0.5) / 1e7 AS value, CASE WHEN own IS NOT NULL THEN 'observed' WHEN rt - lt <= 10 THEN 'interpolated' ELSE 'missing' END AS state FROM b""")
def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole series, one value per second."""
    return grid.regular_grid(table(spark, d, "trajectory")).withColumn("value", quantised(F.col("value"), 7))


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "gps"), table(spark, d, "trajectory"))
