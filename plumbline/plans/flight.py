"""Queries over flight evidence: changes, intervals, matching, statistics, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import geo
from plumbline.functions.numbers import quantised
from plumbline.operators import changes, forecasts, indicators, statistics, trajectories
from plumbline.operators.history import CODE_FIELDS
from plumbline.operators.pieces import sequenced
from plumbline.plans.registry import Registry
from plumbline.sources.tables import once, table

REGISTRY = Registry()
LOG = ["evidence_id"]
FIELD = ["evidence_id", "field"]
TIME = ["timestamp", "seq"]

GPS = "g AS (SELECT DISTINCT * FROM gps WHERE evidence_id IS NOT NULL)"
TRAJECTORY = 't AS (SELECT DISTINCT * FROM trajectory WHERE evidence_id IS NOT NULL AND "timestamp" IS NOT NULL)'
STATES = "s AS (SELECT DISTINCT * FROM state_reconstruction WHERE evidence_id IS NOT NULL AND field IS NOT NULL)"
COMMANDS = "c AS (SELECT DISTINCT evidence_id, seq, command_timestamp_us AS at_us, command_id FROM commands WHERE evidence_id IS NOT NULL AND command_timestamp_us IS NOT NULL)"
ACKS = "a AS (SELECT DISTINCT evidence_id, seq, timestamp_us AS at_us, command_id, result FROM command_acks WHERE evidence_id IS NOT NULL AND timestamp_us IS NOT NULL)"


def floored(sql: str, places: int = 6) -> str:
    return f"floor(({sql}) * 1e{places} + 0.5) / 1e{places}"


# --- states and flags of the receiver -------------------------------------------------------


@REGISTRY.add("gps_state_asserted", f"""
WITH {GPS}
SELECT evidence_id, seq, 'GPS_JAMMING_STATE' AS indicator, jamming_state AS state FROM g WHERE jamming_state <> 0
UNION ALL SELECT evidence_id, seq, 'GPS_SPOOFING_STATE', spoofing_state FROM g WHERE spoofing_state <> 0""")
def gps_state_asserted(spark: SparkSession, d: str) -> DataFrame:
    g = once(table(spark, d, "gps").where("evidence_id is not null and (jamming_state <> 0 or spoofing_state <> 0)").select("evidence_id", "seq", "jamming_state", "spoofing_state"), "seq")
    rows = F.array(F.struct(F.lit("GPS_JAMMING_STATE").alias("indicator"), F.col("jamming_state").alias("state")), F.struct(F.lit("GPS_SPOOFING_STATE").alias("indicator"), F.col("spoofing_state").alias("state")))
    return g.select("evidence_id", "seq", F.explode(rows).alias("r")).select("evidence_id", "seq", "r.*").where("state <> 0")


def _gps(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return sequenced(table(spark, d, "gps").select("evidence_id", "seq", *columns), LOG, "seq")


def _change_sql(column: str) -> str:
    return f"""
WITH {GPS}, w AS (SELECT evidence_id, seq, lag({column}) OVER (PARTITION BY evidence_id ORDER BY seq) AS previous_value, {column} AS new_value FROM g WHERE {column} IS NOT NULL)
SELECT * FROM w WHERE previous_value <> new_value"""


@REGISTRY.add("gps_fix_change", _change_sql("fix_type"))
def gps_fix_change(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the fix type in order of emission; records without one are passed over."""
    rows = changes.changes(_gps(spark, d, "fix_type"), LOG, ["seq"], "fix_type", "skip")
    return rows.select("evidence_id", "seq", "previous_value", F.col("fix_type").alias("new_value"))


@REGISTRY.add("gps_satellite_change", _change_sql("satellites"))
def gps_satellite_change(spark: SparkSession, d: str) -> DataFrame:
    rows = changes.changes(_gps(spark, d, "satellites"), LOG, ["seq"], "satellites", "skip")
    return rows.select("evidence_id", "seq", "previous_value", F.col("satellites").alias("new_value"))


@REGISTRY.add("gps_receiver_states", f"""
WITH {GPS}, w AS (SELECT evidence_id, seq, fix_type, jamming_state, spoofing_state, row_number() OVER l AS n, lag(fix_type) OVER l AS f, lag(jamming_state) OVER l AS j, lag(spoofing_state) OVER l AS p
  FROM g WINDOW l AS (PARTITION BY evidence_id ORDER BY seq))
SELECT evidence_id, seq, fix_type, jamming_state, spoofing_state FROM w
WHERE n = 1 OR fix_type IS DISTINCT FROM f OR jamming_state IS DISTINCT FROM j OR spoofing_state IS DISTINCT FROM p""")
def gps_receiver_states(spark: SparkSession, d: str) -> DataFrame:
    """A record only where the tuple of states differs from the one before, null-safe."""
    columns = ["fix_type", "jamming_state", "spoofing_state"]
    rows = changes.with_previous(_gps(spark, d, *columns), LOG, ["seq"], {c: F.col(c) for c in columns})
    differs = F.col("prev").isNull()
    for c in columns:
        differs |= ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    return rows.where(differs).select("evidence_id", "seq", *columns)


JUMP_M = indicators.JUMP_M
HAVERSINE = """2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(1 - h, 0.0)))"""
HAVERSINE_PART = """pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2)"""


@REGISTRY.add("gps_position_jump", f"""
WITH {GPS}, w AS (SELECT evidence_id, seq, latitude, longitude, "timestamp" AS ts, lag(latitude) OVER l AS plat, lag(longitude) OVER l AS plon, lag("timestamp") OVER l AS pts, lag(seq) OVER l AS previous_seq
  FROM g WINDOW l AS (PARTITION BY evidence_id ORDER BY seq)),
x AS (SELECT evidence_id, seq, previous_seq, ts - pts AS dt, {HAVERSINE_PART} AS h FROM w WHERE ts > pts)
SELECT evidence_id, seq, previous_seq, CAST({floored(HAVERSINE, 2)} AS DOUBLE) AS distance_m FROM x WHERE {HAVERSINE} >= {JUMP_M}""")
def gps_position_jump(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle steps of 100 m and more between records next to each other in order of
    emission. The record before counts even without a position, which then gives no step."""
    rows = _gps(spark, d, "latitude", "longitude", "timestamp")
    rows = changes.with_previous(rows, LOG, ["seq"], {c: F.col(c) for c in ("latitude", "longitude", "timestamp", "seq")})
    distance = geo.haversine(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    rows = rows.where(F.col("timestamp") > F.col("prev.timestamp")).withColumn("distance_m", distance).where(F.col("distance_m") >= JUMP_M)
    return rows.select("evidence_id", "seq", F.col("prev.seq").alias("previous_seq"), quantised(F.col("distance_m"), 2).alias("distance_m"))


_FLAT = "sqrt(pow((latitude - plat) * 111320.0, 2) + pow((longitude - plon) * 111320.0 * cos(radians((plat + latitude) / 2)), 2))"


@REGISTRY.add("gps_step_statistics", f"""
WITH {GPS}, w AS (SELECT evidence_id, seq, latitude, longitude, lag(latitude) OVER l AS plat, lag(longitude) OVER l AS plon FROM g WINDOW l AS (PARTITION BY evidence_id ORDER BY seq)),
x AS (SELECT evidence_id, CAST(floor({_FLAT} * 100.0 + 0.5) AS BIGINT) AS cm FROM w WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND plat IS NOT NULL AND plon IS NOT NULL)
SELECT evidence_id, count(*) AS steps, max(cm) / 100.0 AS max_m, CAST(sum(cm) AS DOUBLE) / count(*) / 100.0 AS mean_m FROM x GROUP BY evidence_id""")
def gps_step_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Length of the steps between records next to each other, on the plane."""
    rows = changes.with_previous(_gps(spark, d, "latitude", "longitude"), LOG, ["seq"], {"latitude": F.col("latitude"), "longitude": F.col("longitude")})
    step = geo.equirectangular(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    cm = rows.select("evidence_id", F.floor(step * 100.0 + 0.5).cast("bigint").alias("cm")).where("cm is not null")
    return cm.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("steps"), (F.max("cm") / 100.0).alias("max_m"), (F.sum("cm").cast("double") / F.count(F.lit(1)) / 100.0).alias("mean_m"))


@REGISTRY.add("gps_local_plane", f"""
WITH {GPS}, v AS (SELECT evidence_id, seq, latitude, longitude FROM g WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND coalesce(fix_type, 3) >= 3),
o AS (SELECT evidence_id, arg_min(latitude, seq) AS lat0, arg_min(longitude, seq) AS lon0 FROM v GROUP BY evidence_id)
SELECT v.evidence_id, v.seq, {floored("radians(longitude - lon0) * 6378137.0 * cos(radians(lat0))", 2)} AS east_m, {floored("radians(latitude - lat0) * 6378137.0", 2)} AS north_m FROM v JOIN o USING (evidence_id)""")
def gps_local_plane(spark: SparkSession, d: str) -> DataFrame:
    """Metres east and north of each log's first valid fix."""
    valid = geo.valid_fix(F.col("latitude"), F.col("longitude"), F.col("fix_type"))
    v = once(table(spark, d, "gps").where("evidence_id is not null").where(valid).select("evidence_id", "seq", "latitude", "longitude"), "seq")
    origin = v.groupBy("evidence_id").agg(F.min_by(F.struct("latitude", "longitude"), "seq").alias("o"))
    east, north = geo.tangent_plane(F.col("latitude"), F.col("longitude"), F.col("o.latitude"), F.col("o.longitude"))
    return v.join(origin, "evidence_id").select("evidence_id", "seq", quantised(east, 2).alias("east_m"), quantised(north, 2).alias("north_m"))


# --- state fields --------------------------------------------------------------------------


def _states(spark: SparkSession, d: str, order: str = "timestamp_us") -> DataFrame:
    s = table(spark, d, "state_reconstruction").select("evidence_id", "field", "seq", "timestamp_us", F.lower(F.trim("new_value")).alias("value"))
    return sequenced(s, FIELD, order)


_STATE_ROWS = f"{STATES}, v AS (SELECT evidence_id, field, seq, timestamp_us, lower(trim(new_value)) AS value FROM s WHERE timestamp_us IS NOT NULL)"
_STATE_LAG = "lag(value) OVER (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq) AS previous_value, row_number() OVER (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq) AS n"


def _policy(name: str, policy: str, rows: str, test: str) -> None:
    sql = f"""
WITH {_STATE_ROWS}, w AS (SELECT evidence_id, field, seq, value, {_STATE_LAG} FROM v{rows})
SELECT evidence_id, field, seq, previous_value, value AS new_value FROM w WHERE {test}"""

    def query(spark: SparkSession, d: str) -> DataFrame:
        out = changes.changes(_states(spark, d), FIELD, ["timestamp_us", "seq"], "value", policy)
        return out.select("evidence_id", "field", "seq", "previous_value", F.col("value").alias("new_value"))

    query.__doc__ = f"Changes of each state field as written, nulls by the policy {policy!r}."
    REGISTRY.add(name, sql)(query)


_policy("state_changes", "skip", " WHERE value IS NOT NULL", "previous_value <> value")
_policy("state_transitions", "value", "", "n > 1 AND previous_value IS DISTINCT FROM value")
_policy("state_departures", "held", "", "previous_value IS NOT NULL AND previous_value IS DISTINCT FROM value")
_policy("state_neighbours", "both", "", "previous_value <> value")



@REGISTRY.add("state_change_sets", f"""
WITH {_STATE_ROWS}, w AS (SELECT evidence_id, field, seq, timestamp_us, value, {_STATE_LAG} FROM v)
SELECT evidence_id, timestamp_us AS at_us, count(*) AS fields, string_agg(field || ': ' || previous_value || ' -> ' || value, ', ' ORDER BY field, seq) AS changes FROM w WHERE previous_value <> value GROUP BY evidence_id, timestamp_us""")
def state_change_sets(spark: SparkSession, d: str) -> DataFrame:
    """What changed at each instant of a log, all fields together, where both values are known."""
    rows = changes.changes(_states(spark, d), FIELD, ["timestamp_us", "seq"], "value", "both")
    text = F.concat(F.col("field"), F.lit(": "), F.col("previous_value"), F.lit(" -> "), F.col("value"))
    sets = rows.groupBy("evidence_id", F.col("timestamp_us").alias("at_us")).agg(F.count(F.lit(1)).alias("fields"), F.sort_array(F.collect_list(F.struct("field", "seq", text.alias("text")))).alias("r"))
    return sets.select("evidence_id", "at_us", "fields", F.array_join(F.transform("r", lambda x: x["text"]), ", ").alias("changes"))


_CODES = ", ".join(f"'{c}'" for c in CODE_FIELDS)
_FLAGS = f"""{STATES}, f AS (SELECT evidence_id, field, seq, timestamp_us, CASE WHEN lower(trim(new_value)) IN ('true', '1', '1.0') THEN true WHEN lower(trim(new_value)) IN ('false', '0', '0.0') THEN false END AS flag
  FROM s WHERE timestamp_us IS NOT NULL AND field NOT IN ({_CODES}))"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.trim("new_value"))
    flag = F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
    s = table(spark, d, "state_reconstruction").where(~F.col("field").isin(*CODE_FIELDS)).select("evidence_id", "field", "seq", "timestamp_us", flag.alias("flag"))
    return sequenced(s, FIELD, "timestamp_us")


@REGISTRY.add("flag_edges", f"""
WITH {_FLAGS}, w AS (SELECT *, lag(flag) OVER (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq) AS before FROM f WHERE flag IS NOT NULL)
SELECT evidence_id, field, seq, timestamp_us, CASE WHEN flag THEN 'ASSERTED' ELSE 'CLEARED' END AS edge FROM w WHERE before <> flag""")
def flag_edges(spark: SparkSession, d: str) -> DataFrame:
    """When each flag was asserted and cleared."""
    return changes.edges(_flags(spark, d), FIELD, ["timestamp_us", "seq"], "flag").select("evidence_id", "field", "seq", "timestamp_us", "edge")


@REGISTRY.add("flag_intervals", f"""
WITH {_FLAGS}, w AS (SELECT *, lag(flag) OVER l AS before FROM f WHERE flag IS NOT NULL WINDOW l AS (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq)),
i AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq ROWS UNBOUNDED PRECEDING) AS "interval" FROM w)
SELECT evidence_id, field, CAST("interval" AS BIGINT) AS "interval", min(CASE WHEN flag THEN timestamp_us END) AS start,
  CASE WHEN count_if(flag) > 1 THEN max(CASE WHEN flag THEN timestamp_us END) END AS last_true,
  coalesce(min(CASE WHEN NOT flag THEN timestamp_us END), max(CASE WHEN flag THEN timestamp_us END)) AS "end",
  min(CASE WHEN NOT flag THEN timestamp_us END) IS NULL AS open, CAST(count_if(flag) AS BIGINT) AS samples
FROM i WHERE "interval" > 0 AND (flag OR before) GROUP BY evidence_id, field, "interval" """)
def flag_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Periods in which each flag held; unknown values neither open nor close one."""
    return changes.flag_intervals(_flags(spark, d), FIELD, ["timestamp_us", "seq"], "flag", "timestamp_us").drop("first_seq")


@REGISTRY.add("flag_severities", f"""
WITH {_FLAGS}, w AS (SELECT *, lag(flag) OVER (PARTITION BY evidence_id, field ORDER BY timestamp_us, seq) AS before FROM f WHERE flag IS NOT NULL)
SELECT field, CASE field WHEN 'gcs_connection_lost' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(count_if(flag AND NOT coalesce(before, false)) AS BIGINT) AS intervals, CAST(count_if(flag) AS BIGINT) AS samples FROM w GROUP BY field HAVING count_if(flag) > 0""")
def flag_severities(spark: SparkSession, d: str) -> DataFrame:
    """Periods in which each flag held, with how much it matters; of the flags of the tables one
    is of medium weight, the others are low."""
    i = flag_intervals(spark, d)
    return i.groupBy("field", indicators.flag_severity(F.col("field")).alias("severity")).agg(F.count(F.lit(1)).alias("intervals"), F.sum("samples").alias("samples"))


@REGISTRY.add("flag_counts", f"""
WITH {_FLAGS} SELECT field, CAST(count_if(flag) AS BIGINT) AS asserted, CAST(count_if(NOT flag) AS BIGINT) AS clear, count(*) - count(flag) AS unknown FROM f GROUP BY field""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    f = _flags(spark, d)
    return f.groupBy("field").agg(F.count_if("flag").alias("asserted"), F.count_if(~F.col("flag")).alias("clear"), F.count_if(F.col("flag").isNull()).alias("unknown"))


# --- trajectory ----------------------------------------------------------------------------


def _trajectory(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return sequenced(table(spark, d, "trajectory").select("evidence_id", "seq", "timestamp", *columns), LOG, "timestamp")


@REGISTRY.add("position_validity_change", f"""
WITH {TRAJECTORY}, w AS (SELECT evidence_id, seq, position_valid, lag(position_valid) OVER (PARTITION BY evidence_id ORDER BY "timestamp", seq) AS before FROM t WHERE position_valid IS NOT NULL)
SELECT evidence_id, seq, position_valid FROM w WHERE before <> position_valid""")
def position_validity_change(spark: SparkSession, d: str) -> DataFrame:
    return changes.changes(_trajectory(spark, d, "position_valid"), LOG, TIME, "position_valid", "skip").select("evidence_id", "seq", "position_valid")


_SEGMENTS = f"""{TRAJECTORY}, w AS (SELECT evidence_id, seq, "timestamp" AS ts, coalesce(position_valid, false) AS ok, lag(coalesce(position_valid, false)) OVER l AS was_ok, vertical_reset_counter AS n,
    last_value(vertical_reset_counter IGNORE NULLS) OVER (PARTITION BY evidence_id ORDER BY "timestamp", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_n
  FROM t WINDOW l AS (PARTITION BY evidence_id ORDER BY "timestamp", seq)),
s AS (SELECT evidence_id, seq, ts, ok, CAST(sum(CASE WHEN NOT was_ok OR coalesce(n <> last_n, false) THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM w)"""


@REGISTRY.add("trajectory_segments", f"""
WITH {_SEGMENTS} SELECT evidence_id, segment, count(*) AS records, CAST(count_if(ok) AS BIGINT) AS valid_records, min(seq) AS least_seq, max(seq) AS greatest_seq FROM s GROUP BY evidence_id, segment""")
def trajectory_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments: a new one after an invalid record and at a reset."""
    rows = changes.segmented(_trajectory(spark, d, "position_valid", "vertical_reset_counter"), LOG, TIME, F.col("position_valid"), ["vertical_reset_counter"])
    return rows.groupBy("evidence_id", F.col("segment").cast("bigint").alias("segment")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce("position_valid", F.lit(False))).alias("valid_records"), F.min("seq").alias("least_seq"), F.max("seq").alias("greatest_seq")
    )


MAX_GAP_S = 2.5


@REGISTRY.add("continuity_chunks", f"""
WITH {_SEGMENTS}, k AS (SELECT *, lag(ts) OVER l AS pt, lag(ok) OVER l AS pok, lag(segment) OVER l AS ps FROM s WINDOW l AS (PARTITION BY evidence_id ORDER BY ts, seq)),
n AS (SELECT *, sum(CASE WHEN pt IS NULL OR NOT pok OR NOT ok OR ts - pt <= 0 OR ts - pt > {MAX_GAP_S} OR segment <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS chunk FROM k)
SELECT evidence_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS records, min(ts) AS start_s, max(ts) AS end_s FROM n WHERE ok GROUP BY evidence_id, chunk HAVING count(*) >= 2""")
def continuity_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Continuous stretches of at least two valid records."""
    rows = changes.segmented(_trajectory(spark, d, "position_valid", "vertical_reset_counter"), LOG, TIME, F.col("position_valid"), ["vertical_reset_counter"])
    rows = changes.chunked(rows, LOG, TIME, "timestamp", F.col("position_valid"), MAX_GAP_S)
    out = rows.groupBy("evidence_id", F.col("chunk").cast("bigint").alias("chunk")).agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s"))
    return out.where("records >= 2")


@REGISTRY.add("backward_velocity", f"""
WITH {TRAJECTORY}, p AS (SELECT evidence_id, seq, "timestamp" AS ts, x_m, y_m, z_m FROM t WHERE x_m IS NOT NULL AND y_m IS NOT NULL AND z_m IS NOT NULL),
w AS (SELECT *, ts - lag(ts) OVER l AS dt, x_m - lag(x_m) OVER l AS dx, y_m - lag(y_m) OVER l AS dy, z_m - lag(z_m) OVER l AS dz FROM p WINDOW l AS (PARTITION BY evidence_id ORDER BY ts, seq)),
m AS (SELECT *, min(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY evidence_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS least FROM w),
b AS (SELECT *, dt > 0 AND dt <= greatest(0.25, 2.5 * least) AS near FROM m)
SELECT evidence_id, seq, CASE WHEN near THEN {floored("dx / dt", 4)} ELSE 0.0 END AS vx_m_s, CASE WHEN near THEN {floored("dy / dt", 4)} ELSE 0.0 END AS vy_m_s, CASE WHEN near THEN {floored("dz / dt", 4)} ELSE 0.0 END AS vz_m_s FROM b""")
def backward_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity from the record before, zero across gaps: the limit follows the smallest time
    step seen so far."""
    axes = ("x_m", "y_m", "z_m")
    rows = _trajectory(spark, d, *axes).where(" and ".join(f"{a} is not null" for a in axes))
    rows = changes.with_previous(rows, LOG, TIME, {"timestamp": F.col("timestamp"), **{a: F.col(a) for a in axes}})
    rows = rows.withColumn("dt", F.col("timestamp") - F.col("prev.timestamp"))
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    rows = changes.carried(rows, LOG, TIME, positive, "least", F.min)
    near = (F.col("dt") > 0) & (F.col("dt") <= F.greatest(F.lit(0.25), 2.5 * F.least("least", positive)))
    return rows.select("evidence_id", "seq", *[F.when(near, quantised((F.col(a) - F.col(f"prev.{a}")) / F.col("dt"), 4)).otherwise(0.0).alias(f"v{a[0]}_m_s") for a in axes])


@REGISTRY.add("time_quality", f"""
WITH {TRAJECTORY}, w AS (SELECT evidence_id, CAST(round("timestamp" * 1e6) AS BIGINT) - lag(CAST(round("timestamp" * 1e6) AS BIGINT)) OVER (PARTITION BY evidence_id ORDER BY seq) AS dt FROM t)
SELECT evidence_id, count(dt) AS steps, CAST(count_if(dt = 0) AS BIGINT) AS repeated, CAST(count_if(dt < 0) AS BIGINT) AS backward, min(dt) AS min_us, max(dt) AS max_us,
  CAST(sum(dt) AS DOUBLE) / count(dt) AS mean_us, CAST(floor(quantile_cont(dt, 0.5) + 0.5) AS BIGINT) AS median_us, CAST(floor(quantile_cont(dt, 0.95) + 0.5) AS BIGINT) AS p95_us FROM w GROUP BY evidence_id HAVING count(dt) > 0""")
def time_quality(spark: SparkSession, d: str) -> DataFrame:
    """Time steps in order of emission: repeated, backward, and their spread."""
    rows = sequenced(table(spark, d, "trajectory").select("evidence_id", "seq", F.round(F.col("timestamp") * 1e6).cast("bigint").alias("at_us")).where("at_us is not null"), LOG, "seq")
    rows = changes.with_previous(rows, LOG, ["seq"], {"at_us": F.col("at_us")})
    dt = rows.select("evidence_id", (F.col("at_us") - F.col("prev.at_us")).alias("dt")).where("dt is not null")
    spread = trajectories.exact_quantiles(dt, LOG, ["dt"], {"median": 0.5, "p95": 0.95})
    odd = dt.where("dt <= 0").groupBy("evidence_id").agg(F.count_if(F.col("dt") == 0).alias("repeated"), F.count_if(F.col("dt") < 0).alias("backward"))
    zero = F.lit(0).cast("bigint")
    return spread.join(odd, "evidence_id", "left").select(
        "evidence_id", F.col("count").alias("steps"), F.coalesce("repeated", zero).alias("repeated"), F.coalesce("backward", zero).alias("backward"), F.col("least").alias("min_us"), F.col("greatest").alias("max_us"),
        (F.col("total").cast("double") / F.col("count")).alias("mean_us"), F.floor(F.col("median") + 0.5).cast("bigint").alias("median_us"), F.floor(F.col("p95") + 0.5).cast("bigint").alias("p95_us"),
    )


@REGISTRY.add("motion_regimes", f"""
WITH {TRAJECTORY}, v AS (SELECT evidence_id, sqrt(vx_m_s * vx_m_s + vy_m_s * vy_m_s + vz_m_s * vz_m_s) AS speed FROM t WHERE velocity_valid)
SELECT evidence_id, CASE WHEN speed < 0.1 THEN 'stationary' WHEN speed >= 0.5 THEN 'moving' ELSE 'intermediate' END AS motion, count(*) AS records FROM v WHERE speed IS NOT NULL GROUP BY ALL""")
def motion_regimes(spark: SparkSession, d: str) -> DataFrame:
    v = once(table(spark, d, "trajectory").where("evidence_id is not null and timestamp is not null and velocity_valid").select("evidence_id", "seq", "vx_m_s", "vy_m_s", "vz_m_s"), "seq")
    speed = F.sqrt(F.col("vx_m_s") * F.col("vx_m_s") + F.col("vy_m_s") * F.col("vy_m_s") + F.col("vz_m_s") * F.col("vz_m_s"))
    motion = F.when(speed < 0.1, "stationary").when(speed >= 0.5, "moving").otherwise("intermediate")
    return v.where(speed.isNotNull()).groupBy("evidence_id", motion.alias("motion")).agg(F.count(F.lit(1)).alias("records"))


# --- samples, their grid and forecasts -------------------------------------------------------

HISTORY, HORIZON, STEP_US = 5, 5, 1_000_000
_L = "(PARTITION BY evidence_id ORDER BY ts, seq)"
_LU = "(PARTITION BY evidence_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
_SAMPLES = f"""{TRAJECTORY},
r AS (SELECT evidence_id, seq, "timestamp" AS ts, CAST(round("timestamp" * 1e6) AS BIGINT) AS at_us, x_m, y_m, z_m, vx_m_s, vy_m_s, vz_m_s, vertical_reset_counter AS n, coalesce(position_valid, false) AND x_m IS NOT NULL AND y_m IS NOT NULL AND z_m IS NOT NULL AS ok,
  coalesce(velocity_valid, false) AND vx_m_s IS NOT NULL AND vy_m_s IS NOT NULL AND vz_m_s IS NOT NULL AS given FROM t),
rl AS (SELECT *, lag(ok) OVER {_L} AS was_ok, last_value(n IGNORE NULLS) OVER (PARTITION BY evidence_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_n FROM r),
rs AS (SELECT *, CAST(sum(CASE WHEN NOT was_ok OR coalesce(n <> last_n, false) THEN 1 ELSE 0 END) OVER {_LU} AS BIGINT) AS segment FROM rl),
ru AS (SELECT *, ts - lag(ts) OVER {_L} AS dt, segment = lag(segment) OVER {_L} AS same, x_m - lag(x_m) OVER {_L} AS dx, y_m - lag(y_m) OVER {_L} AS dy, z_m - lag(z_m) OVER {_L} AS dz FROM rs WHERE ok),
rv AS (SELECT *, min(CASE WHEN dt > 0 THEN dt END) OVER {_LU} AS least FROM ru),
rn AS (SELECT *, coalesce(dt > 0 AND dt <= greatest(0.25, 2.5 * least) AND same, false) AS near FROM rv),
rw AS (SELECT evidence_id, seq, ts, at_us, x_m, y_m, z_m, segment, CASE WHEN given THEN vx_m_s WHEN near THEN dx / dt ELSE 0.0 END AS vx_m_s, CASE WHEN given THEN vy_m_s WHEN near THEN dy / dt ELSE 0.0 END AS vy_m_s,
  CASE WHEN given THEN vz_m_s WHEN near THEN dz / dt ELSE 0.0 END AS vz_m_s, CAST(sum(CASE WHEN coalesce(dt > 0 AND dt <= 2.5 AND same, false) THEN 0 ELSE 1 END) OVER {_LU} AS BIGINT) AS chunk FROM rn)"""
_STATE = ("x_m", "y_m", "z_m", "vx_m_s", "vy_m_s", "vz_m_s")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.samples(table(spark, d, "trajectory"), STEP_US / 1e6)


@REGISTRY.add("trajectory_samples", f"""
WITH {_SAMPLES}, f AS (SELECT *, sqrt(vx_m_s * vx_m_s + vy_m_s * vy_m_s + vz_m_s * vz_m_s) AS speed, atan2(vy_m_s, vx_m_s) AS course FROM rw)
SELECT evidence_id, seq, at_us, segment, chunk, x_m, y_m, z_m, {", ".join(f"{floored(v, 4)} AS {v}" for v in _STATE[3:])}, {floored("speed", 4)} AS speed_m_s, {floored("sin(course)", 4)} AS heading_sin, {floored("cos(course)", 4)} AS heading_cos FROM f""")
def trajectory_samples(spark: SparkSession, d: str) -> DataFrame:
    """Usable samples with segment, chunk, velocities (reported or derived), speed and course."""
    f = trajectories.features(_samples(spark, d))
    derived = ("vx_m_s", "vy_m_s", "vz_m_s", "speed_m_s", "heading_sin", "heading_cos")
    return f.select("evidence_id", "seq", "at_us", "segment", "chunk", "x_m", "y_m", "z_m", *[quantised(F.col(c), 4).alias(c) for c in derived])


_GRID = f"""{_SAMPLES},
ch AS (SELECT evidence_id, chunk, min(at_us) AS a, max(at_us) AS z FROM rw GROUP BY evidence_id, chunk),
gp AS (SELECT evidence_id, chunk, k, a + k * {STEP_US} AS g FROM ch, generate_series(0, (z - a) // {STEP_US}) AS x(k)),
sl AS (SELECT evidence_id, chunk, at_us, {", ".join(_STATE)}, lead(at_us) OVER w AS n_us, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny, lead(z_m) OVER w AS nz FROM rw WINDOW w AS (PARTITION BY evidence_id, chunk ORDER BY at_us)),
h AS (SELECT gp.evidence_id, gp.chunk, gp.k, gp.g AS at_us, {", ".join(f"sl.{c}" for c in _STATE)},
  {", ".join(f"CASE WHEN gp.g = sl.at_us THEN sl.{a}_m ELSE sl.{a}_m + (sl.n{a} - sl.{a}_m) * (CAST(gp.g - sl.at_us AS DOUBLE) / (sl.n_us - sl.at_us)) END AS t{a}" for a in "xyz")}
  FROM gp ASOF JOIN sl ON gp.evidence_id = sl.evidence_id AND gp.chunk = sl.chunk AND gp.g >= sl.at_us)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.on_grid(_samples(spark, d), STEP_US)


@REGISTRY.add("held_grid", f"""WITH {_GRID} SELECT evidence_id, chunk, k, at_us, {", ".join(f"{floored(c, 4)} AS {c}" for c in _STATE)}, {", ".join(f"{floored('t' + a, 4)} AS target_{a}_m" for a in "xyz")} FROM h""")
def held_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk on a grid of whole seconds from its start: the state held from the latest
    sample, and the interpolated position."""
    g = _grid(spark, d)
    return g.select("evidence_id", "chunk", "k", "at_us", *[quantised(F.col(c), 4).alias(c) for c in (*_STATE, "target_x_m", "target_y_m", "target_z_m")])


_WINDOWS = f"""{_GRID},
w AS (SELECT *, count(*) OVER p AS b, count(*) OVER (PARTITION BY evidence_id, chunk ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS f, sum(CAST(floor(sqrt(vx_m_s * vx_m_s + vy_m_s * vy_m_s + vz_m_s * vz_m_s) * 1000.0 + 0.5) AS BIGINT)) OVER p / {HISTORY} / 1000.0 AS mean_speed,
  last_value(CASE WHEN sqrt(vx_m_s * vx_m_s + vy_m_s * vy_m_s) >= 0.1 THEN atan2(vy_m_s, vx_m_s) END IGNORE NULLS) OVER p AS course, vx_m_s - lag(vx_m_s) OVER q AS ax, vy_m_s - lag(vy_m_s) OVER q AS ay, vz_m_s - lag(vz_m_s) OVER q AS az
  FROM h WINDOW q AS (PARTITION BY evidence_id, chunk ORDER BY k), p AS (PARTITION BY evidence_id, chunk ORDER BY k ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW)),
e AS (SELECT w.*, CASE WHEN mean_speed < 0.1 THEN 'stationary' WHEN mean_speed >= 0.5 THEN 'moving' ELSE 'intermediate' END AS motion, CAST(m.k - w.k AS INTEGER) AS step, CAST(m.k - w.k AS DOUBLE) AS tau, m.tx AS gx, m.ty AS gy, m.tz AS gz
  FROM w JOIN h m ON m.evidence_id = w.evidence_id AND m.chunk = w.chunk AND m.k BETWEEN w.k + 1 AND w.k + {HORIZON} WHERE b = {HISTORY} AND f = {HORIZON}),
d AS (SELECT evidence_id, chunk, k, at_us, motion, course, step, m.model, gx - (x_m + vx_m_s * tau + ax * (m.half * tau * tau)) AS dx, gy - (y_m + vy_m_s * tau + ay * (m.half * tau * tau)) AS dy, gz - (z_m + vz_m_s * tau + az * (m.half * tau * tau)) AS dz
  FROM e CROSS JOIN (VALUES ('constant_velocity', CAST(0.0 AS DOUBLE)), ('constant_acceleration', CAST(0.5 AS DOUBLE))) m(model, half)),
o AS (SELECT evidence_id, chunk, k, at_us, motion, step, model, CAST(floor(sqrt(dx * dx + dy * dy + dz * dz) * 1000.0 + 0.5) AS BIGINT) AS mm FROM d)"""
_BLOCK = f"""count(CASE WHEN step = {HORIZON} THEN 1 END) AS windows, CAST(sum(mm) AS DOUBLE) / count(*) / 1000.0 AS ade_m, CAST(sum(CASE WHEN step = {HORIZON} THEN mm END) AS DOUBLE) / count(CASE WHEN step = {HORIZON} THEN 1 END) / 1000.0 AS fde_m"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return forecasts.forecast_errors(forecasts.forecast_windows(_grid(spark, d), HISTORY, HORIZON, STEP_US), STEP_US)


@REGISTRY.add("forecast_metrics", f"WITH {_WINDOWS} SELECT model, evidence_id, {_BLOCK} FROM o GROUP BY GROUPING SETS ((model, evidence_id), (model))")
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of constant velocity and constant acceleration over all windows, by log and by
    model."""
    return forecasts.forecast_metrics(_errors(spark, d), HORIZON)


@REGISTRY.add("forecast_by_motion", f"WITH {_WINDOWS} SELECT model, motion, {_BLOCK} FROM o GROUP BY model, motion")
def forecast_by_motion(spark: SparkSession, d: str) -> DataFrame:
    """Errors of windows at rest, moving and in between."""
    return forecasts.metrics_by(_errors(spark, d), HORIZON, ["motion"])


@REGISTRY.add("forecast_by_step", f"WITH {_WINDOWS} SELECT model, step, count(*) AS windows, CAST(sum(mm) AS DOUBLE) / count(*) / 1000.0 AS ade_m FROM o GROUP BY model, step")
def forecast_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Mean error at each step of the horizon."""
    mm = F.floor(F.col("error_m") * 1000.0 + 0.5).cast("bigint")
    return _errors(spark, d).groupBy("model", "step").agg(F.count(F.lit(1)).alias("windows"), (F.sum(mm) / F.count(F.lit(1)) / 1000.0).alias("ade_m"))


_PLATFORM = "pf AS (SELECT evidence_id, min(source_platform) AS platform FROM t GROUP BY evidence_id)"


@REGISTRY.add("forecast_by_platform", f"WITH {_WINDOWS}, {_PLATFORM} SELECT model, platform, {_BLOCK} FROM o JOIN pf USING (evidence_id) GROUP BY model, platform")
def forecast_by_platform(spark: SparkSession, d: str) -> DataFrame:
    """Errors by the platform of the log."""
    per = table(spark, d, "trajectory").where("evidence_id is not null and timestamp is not null").groupBy("evidence_id").agg(F.min("source_platform").alias("platform"))
    return forecasts.metrics_by(_errors(spark, d).join(per, "evidence_id"), HORIZON, ["platform"])


_PARTS = f"""{_WINDOWS}, sp AS (SELECT evidence_id, min(at_us) AS a, max(at_us) AS z FROM rw GROUP BY evidence_id),
op AS (SELECT o.*, at_us - {(HISTORY - 1) * STEP_US} AS low, at_us + {HORIZON * STEP_US} AS high, a, z, a + (z - a) * CAST(0.7 AS DOUBLE) AS c1, a + (z - a) * CAST(0.85 AS DOUBLE) AS c2 FROM o JOIN sp USING (evidence_id)),
ob AS (SELECT *, CASE WHEN high < c1 THEN 'train' WHEN low >= c1 AND high < c2 THEN 'validation' WHEN low >= c2 THEN 'test' END AS part FROM op),
fm AS (SELECT part AS run, model, evidence_id AS flight, CAST(sum(mm) AS DOUBLE) / count(*) / 1000.0 AS "value" FROM ob WHERE part IS NOT NULL GROUP BY part, model, evidence_id)"""


def _part_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean errors by part of the log's time (70, 15 and 15 %), model and log; a window counts
    in the part that holds all of it."""
    span = _samples(spark, d).groupBy("evidence_id").agg(F.min("at_us").alias("a"), F.max("at_us").alias("z"))
    rows = _errors(spark, d).join(span, "evidence_id")
    c1, c2 = (F.col("a") + (F.col("z") - F.col("a")) * share for share in (0.7, 0.85))
    low, high = F.col("at_us") - (HISTORY - 1) * STEP_US, F.col("at_us") + HORIZON * STEP_US
    part = F.when(high < c1, "train").when((low >= c1) & (high < c2), "validation").when(low >= c2, "test")
    mm = F.floor(F.col("error_m") * 1000.0 + 0.5).cast("bigint")
    rows = rows.select(part.alias("run"), "model", F.col("evidence_id").alias("flight"), mm.alias("mm")).where("run is not null")
    return rows.groupBy("run", "model", "flight").agg((F.sum("mm") / F.count("mm") / 1000.0).alias("value"))


@REGISTRY.add("forecast_predictor", f"""
WITH {_PARTS}, m AS (SELECT model, CAST(sum(CAST(floor("value" * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS macro_ade_m, count(*) AS logs FROM fm WHERE run = 'validation' GROUP BY model)
SELECT model, macro_ade_m, logs, macro_ade_m = min(macro_ade_m) OVER () AS selected FROM m""")
def forecast_predictor(spark: SparkSession, d: str) -> DataFrame:
    """Mean over logs of their mean errors in the validation part, and the model with the lowest."""
    per = _part_metrics(spark, d).where("run = 'validation'")
    macro = per.groupBy("model").agg((F.sum(F.floor(F.col("value") * 1e6 + 0.5).cast("bigint")).cast("double") / F.count(F.lit(1)) / 1e6).alias("macro_ade_m"), F.count(F.lit(1)).alias("logs"))
    # a row per model: two
    both = macro.agg(F.collect_list(F.struct("model", "macro_ade_m", "logs")).alias("models"), F.min("macro_ade_m").alias("least"))
    return both.select(F.explode("models").alias("m"), "least").select("m.*", (F.col("m.macro_ade_m") == F.col("least")).alias("selected"))


@REGISTRY.add("forecast_runs", f"""
WITH {_PARTS}, v AS (SELECT *, CAST(floor("value" * 1e6 + 0.5) AS BIGINT) AS v FROM fm),
a AS (SELECT model, flight, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS m FROM v GROUP BY model, flight), b AS (SELECT model, count(*) AS flights, CAST(sum(m) AS DOUBLE) / count(*) / 1e6 AS macro_m FROM a GROUP BY model),
c AS (SELECT model, run, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS m FROM v GROUP BY model, run), x AS (SELECT model, count(*) AS runs, CAST(count(*) AS DOUBLE) AS n, CAST(sum(m) AS DOUBLE) AS s, CAST(sum(CAST(m AS HUGEINT) * m) AS DOUBLE) AS q FROM c GROUP BY model)
SELECT model, flights, runs, macro_m, CASE WHEN runs > 1 THEN {floored('sqrt(greatest((q - s * s / n) / (n - 1), 0.0)) / 1e6')} END AS deviation_m FROM b JOIN x USING (model)""")
def forecast_runs(spark: SparkSession, d: str) -> DataFrame:
    """The three parts of time as runs: mean over logs of their means over runs, and how much
    the runs differ."""
    return statistics.over_runs(_part_metrics(spark, d))


def _bootstrap_sql(source: str, value: str) -> str:
    """Resampled means; ``source`` has the columns id and the value."""
    steps, p, total = [], statistics.POISSON_0, statistics.POISSON_0
    for k in range(1, 9):
        steps.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        p /= k
        total += p
    return f"""bv AS (SELECT CAST(id AS VARCHAR) AS id, CAST(floor({value} * 1e6 + 0.5) AS BIGINT) AS v FROM {source} WHERE {value} IS NOT NULL),
bu AS (SELECT v, s, CAST(('0x' || substr(md5(id || '/' || CAST(s AS VARCHAR) || '/42'), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS u FROM bv, generate_series(1, 2000) AS x(s)),
bm AS (SELECT s, CAST(sum(v * n) AS DOUBLE) / sum(n) / 1e6 AS m FROM (SELECT v, s, {" + ".join(steps)} AS n FROM bu) GROUP BY s HAVING sum(n) > 0),
bi AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm)
SELECT count(*) AS groups, {floored("CAST(sum(v) AS DOUBLE) / count(*) / 1e6", 9)} AS mean, CASE WHEN count(*) > 1 THEN {floored("any_value(low)", 9)} END AS low, CASE WHEN count(*) > 1 THEN {floored("any_value(high)", 9)} END AS high FROM bv, bi"""


@REGISTRY.add("forecast_interval", f"WITH {_WINDOWS}, fi AS (SELECT evidence_id AS id, {_BLOCK} FROM o WHERE model = 'constant_velocity' GROUP BY evidence_id), {_bootstrap_sql('fi', 'ade_m')}")
def forecast_interval(spark: SparkSession, d: str) -> DataFrame:
    """Mean and 95 % interval of the logs' mean errors under constant velocity, resampled."""
    per = forecast_metrics(spark, d).where("evidence_id is not null and model = 'constant_velocity'").select(F.col("evidence_id").alias("id"), "ade_m")
    return statistics.bootstrap_interval(per, "ade_m")


@REGISTRY.add("forecast_paired", f"""WITH {_PARTS}, pr AS (SELECT flight AS id, (avg(CASE WHEN model = 'constant_acceleration' THEN floor("value" * 1e6 + 0.5) END) - avg(CASE WHEN model = 'constant_velocity' THEN floor("value" * 1e6 + 0.5) END)) / 1e6 AS difference_m FROM fm GROUP BY flight),
{_bootstrap_sql('pr', 'difference_m')}""")
def forecast_paired(spark: SparkSession, d: str) -> DataFrame:
    """By how much constant acceleration errs more than constant velocity, log by log; negative
    means favour it. Mean and resampled interval."""
    pairs = statistics.paired(_part_metrics(spark, d), "constant_acceleration", "constant_velocity")
    return statistics.bootstrap_interval(pairs, "difference_m")


@REGISTRY.add("window_targets", f"""WITH {_WINDOWS} SELECT evidence_id, chunk, k, step, {floored("coalesce(course, 0.0)", 4)} AS angle, {floored("dx * cos(-coalesce(course, 0.0)) - dy * sin(-coalesce(course, 0.0))", 3)} AS dx_m,
  {floored("dx * sin(-coalesce(course, 0.0)) + dy * cos(-coalesce(course, 0.0))", 3)} AS dy_m, {floored("dz", 3)} AS dz_m FROM d WHERE model = 'constant_velocity'""")
def window_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of all windows as differences from constant velocity, turned into the course."""
    rows = forecasts.transformed(forecasts.forecast_windows(_grid(spark, d), HISTORY, HORIZON, STEP_US), "heading", "residual_velocity", STEP_US)
    return rows.select("evidence_id", "chunk", "k", "step", quantised(F.col("angle"), 4).alias("angle"), *[quantised(F.col(c), 3).alias(c) for c in ("dx_m", "dy_m", "dz_m")])


@REGISTRY.add("latest_history", f"""
WITH {_SAMPLES}, lr AS (SELECT evidence_id, arg_max(seq, (ts, seq)) AS seq FROM r GROUP BY evidence_id),
lc AS (SELECT rw.evidence_id, rw.chunk, rw.at_us AS z FROM rw JOIN lr ON lr.evidence_id = rw.evidence_id AND lr.seq = rw.seq), ls AS (SELECT lc.*, (SELECT min(at_us) FROM rw WHERE rw.evidence_id = lc.evidence_id AND rw.chunk = lc.chunk) AS a FROM lc),
lg AS (SELECT evidence_id, chunk, CAST(s AS INTEGER) AS step, z - s * {STEP_US} AS g FROM ls, generate_series(0, {HISTORY - 1}) AS x(s) WHERE z - {(HISTORY - 1) * STEP_US} >= a)
SELECT lg.evidence_id, lg.step, lg.g AS at_us, {", ".join(f"{floored('rw.' + c, 4)} AS {c}" for c in _STATE)} FROM lg ASOF JOIN rw ON lg.evidence_id = rw.evidence_id AND lg.chunk = rw.chunk AND lg.g >= rw.at_us""")
def latest_history(spark: SparkSession, d: str) -> DataFrame:
    """The last seconds of each log, as input of a forecast."""
    rows = trajectories.latest_history(_samples(spark, d), table(spark, d, "trajectory"), HISTORY, STEP_US)
    return rows.select("evidence_id", "step", "at_us", *[quantised(F.col(c), 4).alias(c) for c in _STATE])


_MOTION = ("speed_mm", "step_mm", "acceleration_mm", "climb_mm")


@REGISTRY.add("motion_quality", f"""
WITH {_SAMPLES}, p AS (SELECT *, ts - lag(ts) OVER c AS h, x_m - lag(x_m) OVER c AS sx, y_m - lag(y_m) OVER c AS sy, z_m - lag(z_m) OVER c AS sz, vx_m_s - lag(vx_m_s) OVER c AS ux, vy_m_s - lag(vy_m_s) OVER c AS uy, vz_m_s - lag(vz_m_s) OVER c AS uz
  FROM rw WINDOW c AS (PARTITION BY evidence_id, chunk ORDER BY ts, seq)),
q AS (SELECT evidence_id, CAST(floor(sqrt(vx_m_s * vx_m_s + vy_m_s * vy_m_s + vz_m_s * vz_m_s) * 1000.0 + 0.5) AS BIGINT) AS speed_mm, CAST(floor(sqrt(sx * sx + sy * sy + sz * sz) * 1000.0 + 0.5) AS BIGINT) AS step_mm,
  coalesce(CAST(floor(sqrt((ux / h) * (ux / h) + (uy / h) * (uy / h) + (uz / h) * (uz / h)) * 1000.0 + 0.5) AS BIGINT), 0) AS acceleration_mm, coalesce(CAST(floor((sz / h) * 1000.0 + 0.5) AS BIGINT), 0) AS climb_mm FROM p)
""" + "\nUNION ALL ".join(f"SELECT evidence_id, '{c}' AS field, count({c}) AS \"count\", min({c}) AS minimum, max({c}) AS maximum, CAST(sum({c}) AS DOUBLE) / count({c}) AS mean, {floored(f'quantile_cont({c}, 0.5)', 4)} AS median, {floored(f'quantile_cont({c}, 0.95)', 4)} AS p95, {floored(f'quantile_cont({c}, 0.99)', 4)} AS p99 FROM q WHERE {c} IS NOT NULL GROUP BY evidence_id" for c in _MOTION))
def motion_quality(spark: SparkSession, d: str) -> DataFrame:
    """Speeds, lengths of steps, accelerations and climbs of each log, in thousandths."""
    q = trajectories.exact_quantiles(trajectories.steps(_samples(spark, d)), LOG, list(_MOTION), {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("evidence_id", "field", "count", F.col("least").alias("minimum"), F.col("greatest").alias("maximum"), (F.col("total").cast("double") / F.col("count")).alias("mean"), *[quantised(F.col(c), 4).alias(c) for c in ("median", "p95", "p99")])


@REGISTRY.add("motion_extremes", f"""
WITH {_SAMPLES}, p AS (SELECT *, ts - lag(ts) OVER c AS h, x_m - lag(x_m) OVER c AS sx, y_m - lag(y_m) OVER c AS sy, z_m - lag(z_m) OVER c AS sz, vx_m_s - lag(vx_m_s) OVER c AS ux, vy_m_s - lag(vy_m_s) OVER c AS uy, vz_m_s - lag(vz_m_s) OVER c AS uz
  FROM rw WINDOW c AS (PARTITION BY evidence_id, chunk ORDER BY ts, seq)),
q AS (SELECT evidence_id, at_us, CAST(floor(sqrt(sx * sx + sy * sy + sz * sz) * 1000.0 + 0.5) AS BIGINT) AS step_mm, coalesce(CAST(floor(sqrt((ux / h) * (ux / h) + (uy / h) * (uy / h) + (uz / h) * (uz / h)) * 1000.0 + 0.5) AS BIGINT), 0) AS acceleration_mm,
  coalesce(CAST(floor((sz / h) * 1000.0 + 0.5) AS BIGINT), 0) AS climb_mm FROM p)
SELECT evidence_id, CAST(count_if(step_mm > 1000) AS BIGINT) AS jumps_over_1m, arg_max(at_us, (acceleration_mm, -at_us)) AS max_acceleration_us, arg_max(at_us, (climb_mm, -at_us)) AS max_climb_us, arg_min(at_us, (climb_mm, at_us)) AS max_descent_us FROM q GROUP BY evidence_id""")
def motion_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Steps over a metre, and when acceleration, climb and descent were greatest (the first
    time, of equals)."""
    s, at = trajectories.steps(_samples(spark, d)), F.col("at_us")
    return s.groupBy("evidence_id").agg(
        F.count_if(F.col("step_mm") > 1000).alias("jumps_over_1m"), F.max_by("at_us", F.struct("acceleration_mm", -at)).alias("max_acceleration_us"), F.max_by("at_us", F.struct("climb_mm", -at)).alias("max_climb_us"),
        F.min_by("at_us", F.struct("climb_mm", at)).alias("max_descent_us"),
    )


@REGISTRY.add("trajectory_sources", f"""
WITH {TRAJECTORY}, {GPS}, n AS (SELECT evidence_id, seq, CAST(round("timestamp" * 1e6) AS BIGINT) AS at_us, x_m, y_m, z_m FROM t WHERE position_valid AND x_m IS NOT NULL AND y_m IS NOT NULL AND z_m IS NOT NULL),
v AS (SELECT evidence_id, seq, "timestamp" AS ts, latitude, longitude, altitude_m FROM g WHERE "timestamp" IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND altitude_m IS NOT NULL AND coalesce(fix_type, 3) >= 3 AND evidence_id NOT IN (SELECT evidence_id FROM n)),
k AS (SELECT evidence_id, arg_min({{'a': latitude, 'b': longitude, 'c': altitude_m}}, (ts, seq)) AS o FROM v GROUP BY evidence_id),
u AS (SELECT evidence_id, 'native' AS source, seq, at_us, x_m, y_m, z_m FROM n UNION ALL SELECT v.evidence_id, 'derived', seq, CAST(round(ts * 1e6) AS BIGINT), radians(longitude - o.b) * 6378137.0 * cos(radians(o.a)), radians(latitude - o.a) * 6378137.0, altitude_m - o.c FROM v JOIN k USING (evidence_id))
SELECT evidence_id, source, seq, at_us, {floored("x_m", 2)} AS x_m, {floored("y_m", 2)} AS y_m, {floored("z_m", 2)} AS z_m FROM u""")
def trajectory_sources(spark: SparkSession, d: str) -> DataFrame:
    """Positions of each log from its own trajectory, else from its receiver."""
    p = trajectories.positions(table(spark, d, "trajectory"), table(spark, d, "gps"))
    return p.select("evidence_id", "source", "seq", "at_us", *[quantised(F.col(c), 2).alias(c) for c in ("x_m", "y_m", "z_m")])


_FIELDS = ("x_m", "y_m", "z_m", "vx_m_s", "vy_m_s", "vz_m_s")


@REGISTRY.add("trajectory_standardizer", "WITH t AS (SELECT DISTINCT * FROM trajectory WHERE evidence_id IS NOT NULL)\n" + "\nUNION ALL ".join(f"""
SELECT '{c}' AS field, s / n / 1000.0 AS mean, CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END AS deviation FROM (
  SELECT n, s, sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) / 1000.0 AS sd FROM (
    SELECT CAST(count(k) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS s, CAST(sum(CAST(k AS HUGEINT) * k) AS DOUBLE) AS q FROM (SELECT CAST(floor({c} * 1000.0 + 0.5) AS BIGINT) AS k FROM t)))""" for c in _FIELDS))
def trajectory_standardizer(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of each quantity, for scaling."""
    return statistics.standardizer(once(table(spark, d, "trajectory").where("evidence_id is not null").select("seq", *_FIELDS), "seq"), list(_FIELDS))
