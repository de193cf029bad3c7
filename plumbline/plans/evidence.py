"""Queries over commands, events, custody and whole tables of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.clocks import irregular_offset
from plumbline.operators import changes, indicators, matching, statistics, timestamps
from plumbline.operators.pieces import sequenced
from plumbline.plans import flight, problems
from plumbline.plans.flight import ACKS, COMMANDS, GPS, STATES, TRAJECTORY
from plumbline.plans.registry import Registry
from plumbline.sources import sidecars
from plumbline.sources.tables import once, table

REGISTRY = Registry()
WINDOW = 5_000_000


def _commands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "commands"), table(spark, d, "command_acks")


# --- commands and acknowledgements ---------------------------------------------------------

_EXACT = f"e AS (SELECT c.evidence_id, c.seq AS command_seq, a.seq AS ack_seq, a.at_us - c.at_us AS delta_us FROM c JOIN a ON a.evidence_id = c.evidence_id AND a.command_id = c.command_id AND a.at_us BETWEEN c.at_us - {WINDOW} AND c.at_us + {WINDOW})"


@REGISTRY.add("command_ack_pairs", f"WITH {COMMANDS}, {ACKS}, {_EXACT} SELECT * FROM e")
def command_ack_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every command with every acknowledgement of its id at most 5 s away."""
    p = matching.exact_pairs(*_commands(spark, d), WINDOW)
    return p.select("evidence_id", F.col("left_seq").alias("command_seq"), F.col("right_seq").alias("ack_seq"), (F.col("right_us") - F.col("left_us")).alias("delta_us"))


_LONE = f"""{_EXACT}, lone AS (SELECT * FROM c WHERE command_id IS NOT NULL AND seq NOT IN (SELECT command_seq FROM e)),
n AS (SELECT l.seq, a.seq AS ack_seq, a.command_id AS ack_id, a.at_us - l.at_us AS delta_us FROM lone l JOIN a ON a.evidence_id = l.evidence_id AND a.command_id <> l.command_id AND a.at_us BETWEEN l.at_us - {WINDOW} AND l.at_us + {WINDOW}),
b AS (SELECT seq, arg_min(n, (abs(delta_us), ack_seq)) AS n, count(*) AS candidates FROM n GROUP BY seq)"""


@REGISTRY.add("command_without_ack", f"""
WITH {COMMANDS}, {ACKS}, {_LONE}
SELECT l.evidence_id, l.seq AS command_seq, l.command_id, b.n.ack_seq AS nearest_ack_seq, b.n.ack_id AS nearest_ack_id, b.n.delta_us AS delta_us, coalesce(b.candidates, 0) AS candidates FROM lone l LEFT JOIN b ON b.seq = l.seq""")
def command_without_ack(spark: SparkSession, d: str) -> DataFrame:
    """Commands with no acknowledgement of their id, and the nearest of another id."""
    return matching.commands_without_ack(*_commands(spark, d), WINDOW).drop("command_us")


@REGISTRY.add("command_ack_mismatches", f"""
WITH {COMMANDS}, {ACKS}, {_LONE} SELECT l.evidence_id, n.seq AS command_seq, l.command_id, n.ack_seq, n.ack_id, n.delta_us FROM n JOIN lone l ON l.seq = n.seq""")
def command_ack_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """All acknowledgements of another id near each command without one of its own."""
    p = matching.mismatched_pairs(*_commands(spark, d), WINDOW)
    return p.select("evidence_id", F.col("left_seq").alias("command_seq"), "command_id", F.col("right_seq").alias("ack_seq"), "ack_id", (F.col("right_us") - F.col("left_us")).alias("delta_us"))


@REGISTRY.add("acks_of_no_command_id", f"""
WITH {COMMANDS}, {ACKS} SELECT evidence_id, seq AS ack_seq, command_id, at_us FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.evidence_id = a.evidence_id AND c.command_id = a.command_id)""")
def acks_of_no_command_id(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements that are no command's candidate, however far: their id has no command
    in the log, or is missing."""
    c, a = matching.sides(*_commands(spark, d))
    return a.join(c.select("evidence_id", "command_id").distinct(), ["evidence_id", "command_id"], "left_anti").select("evidence_id", F.col("right_seq").alias("ack_seq"), "command_id", "at_us")


@REGISTRY.add("ack_without_command", f"""
WITH {COMMANDS}, {ACKS}, {_LONE}
SELECT evidence_id, seq AS ack_seq, command_id, at_us FROM a WHERE command_id IS NOT NULL AND seq NOT IN (SELECT ack_seq FROM e) AND seq NOT IN (SELECT ack_seq FROM n)""")
def ack_without_command(spark: SparkSession, d: str) -> DataFrame:
    return matching.acks_without_command(*_commands(spark, d), WINDOW)


@REGISTRY.add("command_following_ack", f"""
WITH {COMMANDS}, {ACKS}, k AS (SELECT c.seq, arg_min(a, (a.at_us, a.seq)) AS a FROM c JOIN a ON a.evidence_id = c.evidence_id AND a.command_id = c.command_id AND a.at_us BETWEEN c.at_us AND c.at_us + {WINDOW} GROUP BY c.seq)
SELECT c.evidence_id, c.seq AS command_seq, c.command_id, k.a.seq AS ack_seq, k.a.result AS ack_result, k.a.at_us - c.at_us AS delta_us FROM c LEFT JOIN k ON k.seq = c.seq""")
def command_following_ack(spark: SparkSession, d: str) -> DataFrame:
    """Each command with the earliest acknowledgement that follows within 5 s."""
    return matching.following_ack(*_commands(spark, d), WINDOW)


@REGISTRY.add("command_closest_ack", f"""
WITH {COMMANDS}, {ACKS}, k AS (SELECT c.seq, arg_min(a, (abs(a.at_us - c.at_us), a.seq)) AS a, count(*) AS n FROM c JOIN a ON a.evidence_id = c.evidence_id AND a.command_id = c.command_id GROUP BY c.seq)
SELECT c.evidence_id, c.seq AS command_seq, c.command_id, k.a.seq AS ack_seq, k.a.at_us - c.at_us AS delta_us, coalesce(k.n, 0) AS candidates FROM c LEFT JOIN k ON k.seq = c.seq""")
def command_closest_ack(spark: SparkSession, d: str) -> DataFrame:
    """Each command with the closest acknowledgement of its id, however far."""
    return matching.closest_ack(*_commands(spark, d))


@REGISTRY.add("command_id_sets", f"""
WITH {COMMANDS}, {ACKS}, x AS (SELECT DISTINCT evidence_id, command_id FROM c WHERE command_id IS NOT NULL), y AS (SELECT DISTINCT evidence_id, command_id FROM a WHERE command_id IS NOT NULL)
SELECT coalesce(x.evidence_id, y.evidence_id) AS evidence_id, coalesce(x.command_id, y.command_id) AS command_id, CASE WHEN y.evidence_id IS NULL THEN 'command_only' WHEN x.evidence_id IS NULL THEN 'ack_only' ELSE 'both' END AS side
FROM x FULL JOIN y ON x.evidence_id = y.evidence_id AND x.command_id = y.command_id""")
def command_id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Ids with commands, with acknowledgements, and with both, per log."""
    c, a = (t.where("evidence_id is not null and command_id is not null").select("evidence_id", "command_id").distinct() for t in _commands(spark, d))
    both = c.withColumn("_c", F.lit(1)).join(a.withColumn("_a", F.lit(1)), ["evidence_id", "command_id"], "full_outer")
    return both.select("evidence_id", "command_id", F.when(F.col("_a").isNull(), "command_only").when(F.col("_c").isNull(), "ack_only").otherwise("both").alias("side"))


@REGISTRY.add("command_ids_never_acknowledged", f"""
WITH {COMMANDS}, {ACKS} SELECT evidence_id, seq AS command_seq, command_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.evidence_id = c.evidence_id AND a.command_id = c.command_id)""")
def command_ids_never_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """Commands whose id has no acknowledgement anywhere in the log."""
    c, a = matching.sides(*_commands(spark, d))
    return c.join(a.select("evidence_id", "command_id").distinct(), ["evidence_id", "command_id"], "left_anti").select("evidence_id", F.col("left_seq").alias("command_seq"), "command_id")


@REGISTRY.add("repeated_commands", f"""
WITH {COMMANDS} SELECT evidence_id, command_id, count(*) AS commands, min(at_us) AS first_us, max(at_us) AS last_us, min(seq) AS least_seq FROM c WHERE command_id IS NOT NULL GROUP BY evidence_id, command_id HAVING count(*) > 1""")
def repeated_commands(spark: SparkSession, d: str) -> DataFrame:
    return matching.repeated(matching.sides(*_commands(spark, d))[0])


@REGISTRY.add("command_histogram", f"""
WITH {COMMANDS}, {ACKS}, u AS (SELECT command_id, 1 AS c, 0 AS a FROM c UNION ALL SELECT command_id, 0, 1 FROM a)
SELECT command_id, CAST(sum(c) AS BIGINT) AS commands, CAST(sum(a) AS BIGINT) AS acks FROM u WHERE command_id IS NOT NULL GROUP BY command_id""")
def command_histogram(spark: SparkSession, d: str) -> DataFrame:
    c, a = matching.sides(*_commands(spark, d))
    u = c.select("command_id", F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(a.select("command_id", F.lit(0).alias("c"), F.lit(1).alias("a")))
    return u.where("command_id is not null").groupBy("command_id").agg(F.sum("c").alias("commands"), F.sum("a").alias("acks"))


# --- one timeline of events ----------------------------------------------------------------

_TIMELINE = f"""{COMMANDS}, {ACKS}, {STATES}, e AS (
  SELECT evidence_id, at_us, seq, 'VEHICLE_COMMAND' AS event_type, concat('command ', coalesce(CAST(command_id AS VARCHAR), 'unknown')) AS description FROM c
  UNION ALL SELECT evidence_id, at_us, seq, 'COMMAND_ACK', concat('ack ', coalesce(CAST(command_id AS VARCHAR), 'unknown'), ' result ', coalesce(CAST(result AS VARCHAR), 'unknown')) FROM a
  UNION ALL SELECT evidence_id, timestamp_us, seq, event_type, concat(field, ': ', coalesce(previous_value, 'unknown'), ' -> ', coalesce(new_value, 'unknown')) FROM s
    WHERE timestamp_us IS NOT NULL AND event_type IS NOT NULL AND event_type NOT IN ('INITIAL_STATE', 'STATE_SNAPSHOT'))"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return indicators.timeline(*_commands(spark, d), table(spark, d, "state_reconstruction"))


@REGISTRY.add("timeline_events", f"WITH {_TIMELINE} SELECT evidence_id, at_us, seq, event_type, description FROM e")
def timeline_events(spark: SparkSession, d: str) -> DataFrame:
    """Commands, acknowledgements and state changes as events of one form."""
    return _timeline(spark, d)


SPANS = {"tight": 100_000, "short": 500_000, "medium": 1_000_000, "wide": 5_000_000}
_NEAR = f"""{_TIMELINE}, w(span, width) AS (VALUES {", ".join(f"('{w}', {n})" for w, n in SPANS.items())}),
x AS (SELECT t.evidence_id, t.seq, t.event_type, o.seq AS near_seq, o.event_type AS near_type, o.at_us, o.at_us - t.at_us AS delta_us
  FROM e t JOIN e o ON o.evidence_id = t.evidence_id AND o.at_us BETWEEN t.at_us - 5000000 AND t.at_us + 5000000 AND (o.seq <> t.seq OR o.event_type <> t.event_type)
  WHERE t.event_type IN ('GCS_CONNECTION_STATE_CHANGE', 'GPS_STATE_CHANGE', 'GPS_INTEGRITY_EVENT', 'PREFLIGHT_CHECK_STATE_CHANGE', 'FAILSAFE_STATE_CHANGE', 'NAVIGATION_STATE_CHANGE', 'ARMING_STATE_CHANGE',
    'LAND_DETECTION_STATE_CHANGE', 'DESCEND_STATE_CHANGE', 'VEHICLE_COMMAND', 'COMMAND_ACK', 'POWER_INPUT_STATE_CHANGE', 'SAFETY_STATE_CHANGE'))"""
_CORRELATED = f"""{_NEAR}, k AS (SELECT x.evidence_id, x.seq, x.event_type, w.span, count(*) AS nearby, list(DISTINCT x.near_type) AS kinds FROM x JOIN w ON abs(x.delta_us) <= w.width GROUP BY x.evidence_id, x.seq, x.event_type, w.span),
r AS (SELECT evidence_id, seq, event_type, span, nearby, CASE
  WHEN event_type = 'GCS_CONNECTION_STATE_CHANGE' AND list_contains(kinds, 'DESCEND_STATE_CHANGE') THEN 'GCS_AND_DESCEND_TEMPORAL_PROXIMITY'
  WHEN event_type = 'GCS_CONNECTION_STATE_CHANGE' AND (list_contains(kinds, 'FAILSAFE_STATE_CHANGE') OR list_contains(kinds, 'NAVIGATION_STATE_CHANGE')) THEN 'GCS_AND_FLIGHT_STATE_TEMPORAL_PROXIMITY'
  WHEN event_type = 'VEHICLE_COMMAND' AND list_contains(kinds, 'COMMAND_ACK') THEN 'COMMAND_ACK_TEMPORAL_PROXIMITY'
  WHEN event_type = 'PREFLIGHT_CHECK_STATE_CHANGE' AND (list_contains(kinds, 'GPS_STATE_CHANGE') OR list_contains(kinds, 'GPS_INTEGRITY_EVENT')) THEN 'PREFLIGHT_AND_GPS_TEMPORAL_PROXIMITY'
  ELSE 'GENERAL_TEMPORAL_PROXIMITY' END AS relationship FROM k)"""


@REGISTRY.add("event_correlation", f"WITH {_CORRELATED} SELECT * FROM r")
def event_correlation(spark: SparkSession, d: str) -> DataFrame:
    """For each target event and each of four windows how many other events of its log lie
    near, and the relationship that the target and their kinds suggest."""
    return indicators.correlations(_timeline(spark, d), SPANS)


@REGISTRY.add("event_neighbours", f"""
WITH {_NEAR} SELECT evidence_id, seq, event_type, CAST(row_number() OVER (PARTITION BY evidence_id, event_type, seq ORDER BY abs(delta_us), at_us, near_type, near_seq) AS INTEGER) AS place, near_seq, near_type, delta_us,
  CASE WHEN abs(delta_us) <= 100000 THEN 'tight' WHEN abs(delta_us) <= 500000 THEN 'short' WHEN abs(delta_us) <= 1000000 THEN 'medium' ELSE 'wide' END AS span FROM x""")
def event_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The events near each target, by distance in time."""
    return indicators.neighbours(_timeline(spark, d), SPANS)


@REGISTRY.add("event_relationships", f"""
WITH {_CORRELATED} SELECT span, relationship, count(*) AS correlations, count(DISTINCT evidence_id) AS logs FROM r GROUP BY span, relationship""")
def event_relationships(spark: SparkSession, d: str) -> DataFrame:
    """How often each relationship occurs in each window."""
    r = event_correlation(spark, d)
    return r.groupBy("span", "relationship").agg(F.count(F.lit(1)).alias("correlations"), F.count_distinct("evidence_id").alias("logs"))


@REGISTRY.add("timeline_summary", f"""
WITH {_TIMELINE} SELECT evidence_id, event_type, count(*) AS events, min(at_us) AS first_us, max(at_us) AS last_us FROM e GROUP BY evidence_id, event_type""")
def timeline_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind in each log and the time from the first to the last."""
    return _timeline(spark, d).groupBy("evidence_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


@REGISTRY.add("event_counts", """
WITH f AS (SELECT DISTINCT * FROM forensic_timeline) SELECT event_type, severity, source_dataset, count(*) AS events FROM f GROUP BY event_type, severity, source_dataset""")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    f = once(table(spark, d, "forensic_timeline").select("seq", "event_type", "severity", "source_dataset"), "seq")
    return f.groupBy("event_type", "severity", "source_dataset").agg(F.count(F.lit(1)).alias("events"))


@REGISTRY.add("event_details", """
WITH f AS (SELECT DISTINCT seq, event_type, CAST(details ->> '$.k' AS INTEGER) AS k FROM forensic_timeline WHERE details IS NOT NULL)
SELECT event_type, count(k) AS details, count(DISTINCT k) AS distinct_details, min(k) AS least, max(k) AS greatest FROM f GROUP BY event_type""")
def event_details(spark: SparkSession, d: str) -> DataFrame:
    """What the details of each kind of event hold."""
    f = once(table(spark, d, "forensic_timeline").where("details is not null").select("seq", "event_type", F.get_json_object("details", "$.k").cast("int").alias("k")), "seq")
    return f.groupBy("event_type").agg(F.count("k").alias("details"), F.count_distinct("k").alias("distinct_details"), F.min("k").alias("least"), F.max("k").alias("greatest"))


# --- indicators and findings ---------------------------------------------------------------

_GPS_CHANGE = """SELECT evidence_id, '{kind}', 'gps', seq, us, NULL, seq FROM (
  SELECT evidence_id, seq, us, {column} AS v, lag({column}) OVER (PARTITION BY evidence_id ORDER BY seq) AS p FROM gt WHERE {column} IS NOT NULL) WHERE p <> v"""
_TABLES = ("gps", "trajectory", "state_reconstruction", "commands", "command_acks", "telemetry_frames", "chain_of_custody", "forensic_timeline")
_INDICATORS = f"""{GPS}, {TRAJECTORY}, {STATES}, {COMMANDS}, {ACKS}, {_LONE},
gt AS (SELECT *, CAST(round("timestamp" * 1e6) AS BIGINT) AS us FROM g),
gj AS (SELECT evidence_id, seq, us, "timestamp" AS ts, latitude, longitude, lag(latitude) OVER l AS plat, lag(longitude) OVER l AS plon, lag("timestamp") OVER l AS pts FROM gt WINDOW l AS (PARTITION BY evidence_id ORDER BY seq)),
gh AS (SELECT evidence_id, seq, us, {flight.HAVERSINE_PART} AS h FROM gj WHERE ts > pts),
tv AS (SELECT evidence_id, seq, CAST(round("timestamp" * 1e6) AS BIGINT) AS us, position_valid AS v, lag(position_valid) OVER (PARTITION BY evidence_id ORDER BY "timestamp", seq) AS p FROM t WHERE position_valid IS NOT NULL),
sv AS (SELECT evidence_id, field, seq, timestamp_us AS us, CASE WHEN field = 'arming_state' THEN try_cast(new_value AS DOUBLE) = 2 WHEN lower(trim(new_value)) IN ('true', '1', '1.0') THEN true WHEN lower(trim(new_value)) IN ('false', '0', '0.0') THEN false END AS v
  FROM s WHERE timestamp_us IS NOT NULL AND field IN ('failsafe', 'gcs_connection_lost', 'arming_state', 'landed')),
sl AS (SELECT *, lag(v) OVER (PARTITION BY evidence_id, field ORDER BY us, seq) AS p FROM sv WHERE v IS NOT NULL),
si AS (SELECT *, sum(CASE WHEN NOT v THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM sl WHERE field = 'gcs_connection_lost'),
logs AS ({" UNION ".join(f"SELECT evidence_id FROM {t} WHERE evidence_id IS NOT NULL" for t in _TABLES)}),
i0(evidence_id, indicator_type, source, seq, at_us, end_us, place) AS (
  SELECT evidence_id, 'GPS_SPOOFING_STATE', 'gps', seq, us, CAST(NULL AS BIGINT), seq FROM gt WHERE spoofing_state <> 0
  UNION ALL SELECT evidence_id, 'GPS_JAMMING_STATE', 'gps', seq, us, NULL, seq FROM gt WHERE jamming_state <> 0
  UNION ALL {_GPS_CHANGE.format(kind="GPS_FIX_TYPE_CHANGE", column="fix_type")}
  UNION ALL {_GPS_CHANGE.format(kind="GPS_SATELLITE_COUNT_CHANGE", column="satellites")}
  UNION ALL SELECT evidence_id, 'GPS_POSITION_DISCONTINUITY', 'gps', seq, us, NULL, seq FROM gh WHERE {flight.HAVERSINE} >= 100.0
  UNION ALL SELECT evidence_id, 'NAVIGATION_POSITION_VALIDITY_CHANGE', 'trajectory', seq, us, NULL, us FROM tv WHERE p <> v AND evidence_id IN (SELECT evidence_id FROM g)
  UNION ALL SELECT evidence_id, 'COMMAND_WITHOUT_EXACT_ACK', 'commands', seq, at_us, NULL, seq FROM lone
  UNION ALL SELECT evidence_id, 'ACK_WITHOUT_COMMAND', 'command_acks', seq, at_us, NULL, seq FROM a WHERE command_id IS NOT NULL AND seq NOT IN (SELECT ack_seq FROM e) AND seq NOT IN (SELECT ack_seq FROM n)
  UNION ALL SELECT evidence_id, 'REPEATED_COMMAND_ID', 'commands', min(seq), min(at_us), max(at_us), min(seq) FROM c WHERE command_id IS NOT NULL GROUP BY evidence_id, command_id HAVING count(*) > 1
  UNION ALL SELECT evidence_id, 'GCS_CONNECTION_LOST', 'state_reconstruction', arg_min(seq, (us, seq)), min(us), CASE WHEN count(*) > 1 THEN max(us) END, min(us) FROM si WHERE v GROUP BY evidence_id, run
  UNION ALL SELECT evidence_id, CASE field WHEN 'failsafe' THEN 'FAILSAFE_STATE_CHANGE' WHEN 'gcs_connection_lost' THEN 'GCS_CONNECTION_STATE_CHANGE' WHEN 'arming_state' THEN 'ARMED_STATE_CHANGE' ELSE 'LANDED_STATE_CHANGE' END, 'state_reconstruction', seq, us, NULL, us FROM sl WHERE p <> v
  UNION ALL SELECT evidence_id, 'NO_GPS_RECORDS', NULL, NULL, NULL, NULL, NULL FROM logs WHERE evidence_id NOT IN (SELECT evidence_id FROM g)
  UNION ALL SELECT evidence_id, 'NO_STATE_RECORDS', NULL, NULL, NULL, NULL, NULL FROM logs WHERE evidence_id NOT IN (SELECT evidence_id FROM state_reconstruction WHERE evidence_id IS NOT NULL)
  UNION ALL SELECT evidence_id, 'NO_COMMAND_RECORDS', NULL, NULL, NULL, NULL, NULL FROM logs WHERE evidence_id NOT IN (SELECT evidence_id FROM commands WHERE evidence_id IS NOT NULL)),
kinds(indicator_type, rank, category, severity, confidence) AS (VALUES ('GPS_SPOOFING_STATE', 1, 'navigation', 'HIGH', 'HIGH'), ('GPS_JAMMING_STATE', 2, 'navigation', 'HIGH', 'HIGH'), ('GPS_FIX_TYPE_CHANGE', 3, 'navigation', 'MEDIUM', 'MEDIUM'),
  ('GPS_SATELLITE_COUNT_CHANGE', 4, 'navigation', 'LOW', 'MEDIUM'), ('GPS_POSITION_DISCONTINUITY', 5, 'navigation', 'MEDIUM', 'MEDIUM'), ('NAVIGATION_POSITION_VALIDITY_CHANGE', 6, 'navigation', 'MEDIUM', 'MEDIUM'),
  ('COMMAND_WITHOUT_EXACT_ACK', 7, 'command_and_control', 'LOW', 'MEDIUM'), ('ACK_WITHOUT_COMMAND', 8, 'command_and_control', 'LOW', 'MEDIUM'), ('REPEATED_COMMAND_ID', 9, 'command_and_control', 'LOW', 'HIGH'),
  ('GCS_CONNECTION_LOST', 10, 'flight_control', 'MEDIUM', 'HIGH'), ('FAILSAFE_STATE_CHANGE', 11, 'flight_control', 'MEDIUM', 'MEDIUM'), ('GCS_CONNECTION_STATE_CHANGE', 12, 'flight_control', 'MEDIUM', 'MEDIUM'),
  ('ARMED_STATE_CHANGE', 13, 'flight_control', 'LOW', 'MEDIUM'), ('LANDED_STATE_CHANGE', 14, 'flight_control', 'LOW', 'MEDIUM'),
  ('NO_GPS_RECORDS', 15, 'evidence_quality', 'INFO', 'HIGH'), ('NO_STATE_RECORDS', 16, 'evidence_quality', 'INFO', 'HIGH'), ('NO_COMMAND_RECORDS', 17, 'evidence_quality', 'INFO', 'HIGH')),
i AS (SELECT * FROM i0 JOIN kinds USING (indicator_type))"""


def _indicators(spark: SparkSession, d: str) -> DataFrame:
    of = {t: table(spark, d, t) for t in _TABLES}
    gps = sequenced(of["gps"].select("evidence_id", "seq", "timestamp", "latitude", "longitude", "fix_type", "satellites", "jamming_state", "spoofing_state"), ["evidence_id"], "seq")
    valid = sequenced(of["trajectory"].select("evidence_id", "seq", "timestamp", "position_valid"), ["evidence_id"], "timestamp")
    text = F.lower(F.trim("new_value"))
    flag = F.when(F.col("field") == "arming_state", F.expr("try_cast(new_value as double)") == 2).when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
    states = of["state_reconstruction"].where(F.col("field").isin(*indicators.STATE_KINDS)).select("evidence_id", "field", "seq", "timestamp_us", flag.alias("flag"))
    commands = matching.sides(of["commands"], of["command_acks"])[0]
    parts = (
        indicators.receiver_indicators(gps),
        indicators.validity_indicators(valid, of["gps"].select("evidence_id").distinct()),
        indicators.command_indicators(matching.commands_without_ack(of["commands"], of["command_acks"], WINDOW), matching.acks_without_command(of["commands"], of["command_acks"], WINDOW), matching.repeated(commands)),
        indicators.state_indicators(sequenced(states, ["evidence_id", "field"], "timestamp_us")),
        indicators.quality_indicators(of, {"NO_GPS_RECORDS": "gps", "NO_STATE_RECORDS": "state_reconstruction", "NO_COMMAND_RECORDS": "commands"}),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@REGISTRY.add("indicator_catalogue", f"WITH {_INDICATORS} SELECT evidence_id, category, indicator_type, severity, confidence, source, seq, at_us, end_us FROM i")
def indicator_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """All indicators that the tables allow, in one form."""
    return indicators.described(_indicators(spark, d)).select("evidence_id", "category", "indicator_type", "severity", "confidence", "source", "seq", "at_us", "end_us")


@REGISTRY.add("indicator_counts", f"WITH {_INDICATORS} SELECT category, indicator_type, severity, count(*) AS indicators, count(DISTINCT evidence_id) AS logs FROM i GROUP BY category, indicator_type, severity")
def indicator_counts(spark: SparkSession, d: str) -> DataFrame:
    return indicators.described(_indicators(spark, d)).groupBy("category", "indicator_type", "severity").agg(F.count(F.lit(1)).alias("indicators"), F.count_distinct("evidence_id").alias("logs"))


@REGISTRY.add("findings", f"""
WITH {_INDICATORS}, m AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY rank, place, seq) AS k FROM i)
SELECT evidence_id, 'FINDING-' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS finding_id, category, severity, confidence, CASE indicator_type
  WHEN 'GPS_SPOOFING_STATE' THEN 'GPS spoofing state was reported' WHEN 'GPS_JAMMING_STATE' THEN 'GPS jamming state was reported' WHEN 'GPS_FIX_TYPE_CHANGE' THEN 'GPS fix type changed'
  WHEN 'GPS_SATELLITE_COUNT_CHANGE' THEN 'GPS satellite count changed' WHEN 'GPS_POSITION_DISCONTINUITY' THEN 'GPS position discontinuity detected' WHEN 'NAVIGATION_POSITION_VALIDITY_CHANGE' THEN 'Navigation position validity changed'
  WHEN 'COMMAND_WITHOUT_EXACT_ACK' THEN 'Command did not receive a matching acknowledgement' WHEN 'ACK_WITHOUT_COMMAND' THEN 'Command acknowledgement has no matching command' WHEN 'REPEATED_COMMAND_ID' THEN 'Command ID was repeated'
  WHEN 'NO_GPS_RECORDS' THEN 'No GPS records were available' WHEN 'NO_STATE_RECORDS' THEN 'No flight-state records were available' WHEN 'NO_COMMAND_RECORDS' THEN 'No command records were available'
  ELSE upper(indicator_type[1]) || lower(replace(indicator_type[2:], '_', ' ')) END AS title,
  CASE WHEN rank IN (1, 2, 5, 6) THEN 'navigation' WHEN rank IN (7, 8, 9) THEN 'command_and_control' WHEN starts_with(indicator_type, 'FAILSAFE_') THEN 'failsafe' END AS caveat, at_us, end_us, source || ':' || CAST(seq AS VARCHAR) AS evidence_ref FROM m""")
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the ids that their order in the catalogue gives them, per log."""
    return indicators.findings(_indicators(spark, d), table(spark, d, "gps"))


@REGISTRY.add("indicator_agreement", """
WITH j AS (SELECT DISTINCT evidence_id FROM gps WHERE jamming_state <> 0 AND evidence_id IS NOT NULL), k AS (SELECT DISTINCT evidence_id FROM gps WHERE spoofing_state <> 0 AND evidence_id IS NOT NULL), u AS (SELECT DISTINCT evidence_id FROM gps WHERE evidence_id IS NOT NULL),
n AS (SELECT count(CASE WHEN j.evidence_id IS NOT NULL AND k.evidence_id IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN j.evidence_id IS NULL AND k.evidence_id IS NOT NULL THEN 1 END) AS fp, count(CASE WHEN k.evidence_id IS NULL AND j.evidence_id IS NOT NULL THEN 1 END) AS fn,
  count(CASE WHEN j.evidence_id IS NULL AND k.evidence_id IS NULL THEN 1 END) AS tn FROM u LEFT JOIN j ON j.evidence_id = u.evidence_id LEFT JOIN k ON k.evidence_id = u.evidence_id)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS "precision", coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
  coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0.0) AS false_positive_rate FROM n""")
def indicator_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the logs with a spoofing state are those with a jamming state, among all logs."""
    g = table(spark, d, "gps").where("evidence_id is not null")
    return statistics.confusion(g.where("jamming_state <> 0"), g.where("spoofing_state <> 0"), ["evidence_id"], g)


@REGISTRY.add("receiver_samples", f"""
WITH {GPS}, u AS (SELECT evidence_id, 'GPS_JAMMING_STATE' AS indicator, seq FROM g WHERE jamming_state <> 0 UNION ALL SELECT evidence_id, 'GPS_SPOOFING_STATE', seq FROM g WHERE spoofing_state <> 0)
SELECT evidence_id, indicator, seq, CAST(row_number() OVER (PARTITION BY evidence_id, indicator ORDER BY seq) AS INTEGER) AS place FROM u QUALIFY place <= 20""")
def receiver_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty records of each log with a jamming or spoofing state."""
    rows = flight.gps_state_asserted(spark, d).select("evidence_id", "indicator", "seq")
    return statistics.first_and_last(rows, ["evidence_id", "indicator"], ["seq"], 20)


@REGISTRY.add("timeline_ends", f"""
WITH {_TIMELINE}, te AS (SELECT *, CAST(row_number() OVER (PARTITION BY evidence_id ORDER BY at_us, event_type, seq) AS INTEGER) AS f, CAST(row_number() OVER (PARTITION BY evidence_id ORDER BY at_us DESC, event_type DESC, seq DESC) AS INTEGER) AS l FROM e)
SELECT evidence_id, at_us, seq, event_type, f AS place FROM te WHERE f <= 10 UNION ALL SELECT evidence_id, at_us, seq, event_type, -l FROM te WHERE l <= 10""")
def timeline_ends(spark: SparkSession, d: str) -> DataFrame:
    """The first and last ten events of each log."""
    rows = _timeline(spark, d).select("evidence_id", "at_us", "seq", "event_type")
    return statistics.first_and_last(rows, ["evidence_id"], ["at_us", "event_type", "seq"], 10, 10)


@REGISTRY.add("initial_states", f"""
WITH {STATES} SELECT evidence_id, field, arg_min(seq, (timestamp_us, seq)) AS seq, min(timestamp_us) AS at_us, arg_min({{'v': new_value}}, (timestamp_us, seq)).v AS value FROM s WHERE timestamp_us IS NOT NULL GROUP BY evidence_id, field""")
def initial_states(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each state field of each log, with what it holds, null included."""
    s = table(spark, d, "state_reconstruction").where("evidence_id is not null and field is not null and timestamp_us is not null")
    first = F.min(F.struct("timestamp_us", "seq", "new_value"))
    return s.groupBy("evidence_id", "field").agg(first.alias("r")).select("evidence_id", "field", F.col("r.seq").alias("seq"), F.col("r.timestamp_us").alias("at_us"), F.col("r.new_value").alias("value"))


# Names of commands.
COMMAND_NAMES = {211: "VEHICLE_CMD_DO_GRIPPER", 512: "VEHICLE_CMD_REQUEST_MESSAGE", 521: "VEHICLE_CMD_REQUEST_CAMERA_INFORMATION"}


@REGISTRY.add("command_names", f"""
WITH {COMMANDS} SELECT command_id, CASE command_id WHEN 211 THEN 'VEHICLE_CMD_DO_GRIPPER' WHEN 512 THEN 'VEHICLE_CMD_REQUEST_MESSAGE' WHEN 521 THEN 'VEHICLE_CMD_REQUEST_CAMERA_INFORMATION' ELSE 'UNKNOWN_COMMAND_' || CAST(command_id AS VARCHAR) END AS name,
  count(*) AS commands, count(DISTINCT evidence_id) AS logs FROM c WHERE command_id IS NOT NULL GROUP BY command_id""")
def command_names(spark: SparkSession, d: str) -> DataFrame:
    """Commands by id and name; ids without a name have one made of the id."""
    c = matching.sides(*_commands(spark, d))[0].where("command_id is not null")
    names = F.create_map(*[F.lit(x) for kv in COMMAND_NAMES.items() for x in kv])
    name = F.coalesce(F.try_element_at(names, F.col("command_id")), F.concat(F.lit("UNKNOWN_COMMAND_"), F.col("command_id").cast("string")))
    return c.groupBy("command_id", name.alias("name")).agg(F.count(F.lit(1)).alias("commands"), F.count_distinct("evidence_id").alias("logs"))


_FRAME_TIMES = f"""f AS (SELECT DISTINCT evidence_id, video_id, seq, latitude, longitude, log_offset_s + start_s AS log_s FROM telemetry_frames WHERE evidence_id IS NOT NULL AND video_id IS NOT NULL AND seq IS NOT NULL),
u AS (SELECT row_no, utc_us FROM ({problems.instants_sql()}) WHERE table_name = 'telemetry_frames'), j AS (SELECT f.*, u.utc_us, latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AS ok FROM f LEFT JOIN u ON u.row_no = f.seq)"""


def _frame_times(spark: SparkSession, d: str) -> DataFrame:
    f = once(table(spark, d, "telemetry_frames").where("evidence_id is not null and video_id is not null and seq is not null"), "seq")
    utc = timestamps.frame_instants(table(spark, d, "telemetry_frames"), table(spark, d, "clock_sources"))
    return f.join(utc, F.col("seq") == F.col("row_no"), "left").withColumns({"ok": sidecars.valid(F.col("latitude"), F.col("longitude")), "log_s": F.col("log_offset_s") + F.col("start_s")})


@REGISTRY.add("frame_positions", f"WITH {_FRAME_TIMES} SELECT evidence_id, video_id, seq, utc_us, latitude, longitude FROM j WHERE ok AND utc_us IS NOT NULL")
def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of video frames as records of a receiver, where the frame's instant is known."""
    return _frame_times(spark, d).where("ok and utc_us is not null").select("evidence_id", "video_id", "seq", "utc_us", "latitude", "longitude")


@REGISTRY.add("frame_position_counts", f"""
WITH {_FRAME_TIMES} SELECT evidence_id, video_id, count(*) AS frames, CAST(count_if(ok) AS BIGINT) AS positions, CAST(count_if(ok AND utc_us IS NULL) AS BIGINT) AS skipped_without_utc FROM j GROUP BY evidence_id, video_id""")
def frame_position_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each video, those with a position, and of these those without an instant."""
    return _frame_times(spark, d).groupBy("evidence_id", "video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ok").alias("positions"), F.count_if(F.col("ok") & F.col("utc_us").isNull()).alias("skipped_without_utc"))


@REGISTRY.add("clock_offsets", f"""
WITH {_FRAME_TIMES}, o AS (SELECT *, floor(utc_us / 1000000.0 - log_s + 0.5) AS off FROM j WHERE utc_us IS NOT NULL AND log_s >= 1e9),
p AS (SELECT *, off - 900.0 * floor(off / 900.0) AS rest FROM o)
SELECT evidence_id, video_id, count(*) AS frames, CAST(min(off) AS BIGINT) AS least_s, CAST(max(off) AS BIGINT) AS greatest_s, CAST(count_if(least(rest, 900.0 - rest) > 60 OR abs(off) > 50400) AS BIGINT) AS irregular FROM p GROUP BY evidence_id, video_id""")
def clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    """By how many seconds the recorder's clock is ahead of the log's, in logs that count from
    1970, and how many frames have an offset that no time zone explains."""
    off = F.floor(F.col("utc_us") / 1_000_000.0 - F.col("log_s") + 0.5)
    o = _frame_times(spark, d).where("utc_us is not null and log_s >= 1e9").select("evidence_id", "video_id", off.cast("bigint").alias("off"))
    return o.groupBy("evidence_id", "video_id").agg(F.count(F.lit(1)).alias("frames"), F.min("off").alias("least_s"), F.max("off").alias("greatest_s"), F.count_if(irregular_offset(F.col("off"))).alias("irregular"))


# --- statistics of tables ------------------------------------------------------------------


def _range_sql(cte: str, alias: str, fields: list[str]) -> str:
    return f"WITH {cte}\n" + "\nUNION ALL ".join(
        f"SELECT evidence_id, '{c}' AS field, count({c}) AS \"count\", min({c}) AS minimum, max({c}) AS maximum, CASE WHEN count({c}) > 0 THEN CAST(sum(CAST(floor({c} * 1000.0 + 0.5) AS BIGINT)) AS DOUBLE) / count({c}) / 1000.0 END AS average FROM {alias} GROUP BY evidence_id"
        for c in fields
    )


_GPS_FIELDS = ["altitude_m", "speed_m_s", "hdop", "vdop", "heading_deg"]
_TRAJECTORY_FIELDS = ["x_m", "y_m", "z_m", "vx_m_s", "vy_m_s", "vz_m_s"]


@REGISTRY.add("gps_statistics", _range_sql(GPS, "g", _GPS_FIELDS))
def gps_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Count, range and average of the receiver's quantities per log."""
    return statistics.range_statistics(once(table(spark, d, "gps").where("evidence_id is not null").select("evidence_id", "seq", *_GPS_FIELDS), "seq"), ["evidence_id"], _GPS_FIELDS)


@REGISTRY.add("trajectory_statistics", _range_sql(TRAJECTORY, "t", _TRAJECTORY_FIELDS))
def trajectory_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "trajectory").where("evidence_id is not null and timestamp is not null").select("evidence_id", "seq", *_TRAJECTORY_FIELDS), "seq")
    return statistics.range_statistics(t, ["evidence_id"], _TRAJECTORY_FIELDS)


@REGISTRY.add("gps_time_range", f"""
WITH {GPS} SELECT evidence_id, count(*) AS records, arg_min("timestamp", seq) AS first_s, arg_max("timestamp", seq) AS last_s, count(DISTINCT fix_type) AS fix_types FROM g GROUP BY evidence_id""")
def gps_time_range(spark: SparkSession, d: str) -> DataFrame:
    """Times of the first and last record emitted, which need not be the least and greatest."""
    g = once(table(spark, d, "gps").where("evidence_id is not null").select("evidence_id", "seq", "timestamp", "fix_type"), "seq")
    return g.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("records"), F.min_by("timestamp", "seq").alias("first_s"), F.max_by("timestamp", "seq").alias("last_s"), F.count_distinct("fix_type").alias("fix_types"))


@REGISTRY.add("state_histogram", f"WITH {STATES} SELECT field, lower(trim(new_value)) AS value, count(*) AS records FROM s WHERE new_value IS NOT NULL GROUP BY ALL")
def state_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = once(table(spark, d, "state_reconstruction").where("evidence_id is not null and field is not null and new_value is not null").select("seq", "field", F.lower(F.trim("new_value")).alias("value")), "seq")
    return s.groupBy("field", "value").agg(F.count(F.lit(1)).alias("records"))


@REGISTRY.add("receiver_histogram", f"""
WITH {GPS}, u AS (SELECT 'fix_type' AS field, CAST(fix_type AS VARCHAR) AS value FROM g UNION ALL SELECT 'jamming_state', CAST(jamming_state AS VARCHAR) FROM g UNION ALL SELECT 'spoofing_state', CAST(spoofing_state AS VARCHAR) FROM g UNION ALL SELECT 'source_platform', source_platform FROM g)
SELECT field, value, count(*) AS records FROM u WHERE value IS NOT NULL GROUP BY field, value""")
def receiver_histogram(spark: SparkSession, d: str) -> DataFrame:
    columns = ["fix_type", "jamming_state", "spoofing_state", "source_platform"]
    return statistics.histogram(once(table(spark, d, "gps").where("evidence_id is not null").select("seq", *columns), "seq"), [], columns)


# The categories of records, and the tables given for them.
_CATEGORIES = {
    "gps": "gps", "trajectory": "trajectory", "states": "state_reconstruction", "commands": "commands", "command_acks": "command_acks", "telemetry": "telemetry_frames",
    "events": "forensic_timeline",
}
_ALL = ("gps", "navigation", "trajectory", "battery", "telemetry", "failsafe", "commands", "command_acks", "states", "parameters", "events")
_KEYS = ("evidence_id", "seq")
_FIELDS_OF = {
    "gps": ("vehicle_id", "timestamp", "latitude", "longitude", "altitude_m", "speed_m_s", "fix_type", "satellites", "hdop", "vdop", "heading_deg", "jamming_state", "spoofing_state", "source_platform"),
    "trajectory": ("vehicle_id", "timestamp", "x_m", "y_m", "z_m", "vx_m_s", "vy_m_s", "vz_m_s", "position_valid", "velocity_valid", "vertical_reset_counter", "coordinate_frame", "source_platform"),
    "states": ("vehicle_id", "field", "previous_value", "new_value", "timestamp_us", "timestamp_seconds", "event_type", "source_dataset"),
    "commands": ("vehicle_id", "command_timestamp_us", "command_id", "source_system", "source_component", "target_system", "source_platform"),
    "command_acks": ("vehicle_id", "timestamp_us", "command_id", "result", "source_system", "target_system", "source_platform"),
    "telemetry": ("video_id", "recorder_id", "frame_index", "start_s", "end_s", "log_offset_s", "device_time", "latitude", "longitude", "relative_altitude_m", "height_m", "horizontal_speed_m_s"),
    "events": ("timestamp_us", "boot_utc_us", "event_type", "source_dataset", "severity", "details"),
}
_STATUS = "CASE WHEN records > 0 AND populated > 0 THEN 'extracted' WHEN records > 0 THEN 'source_present_no_normalized_records' ELSE 'not_recorded' END"


@REGISTRY.add("extraction_coverage", "WITH u AS (" + "\nUNION ALL ".join(
    [f"SELECT '{k}' AS category, '{c}' AS field, count(*) AS records, count(\"{c}\") AS populated FROM (SELECT DISTINCT * FROM {t})" for k, t in _CATEGORIES.items() for c in _FIELDS_OF[k]]
    + [f"SELECT '{c}', NULL, 0, 0" for c in _ALL if c not in _CATEGORIES]) + f") SELECT *, {_STATUS} AS status FROM u")
def extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each category have each field, and what that says of it;
    categories without a table too."""
    tables = {}
    for k, t in _CATEGORIES.items():
        df = table(spark, d, t)
        tables[k] = once(df, "seq").select(*[c for c in df.columns if c not in _KEYS])
    out = statistics.coverage(tables, list(_ALL))
    status = F.when((F.col("records") > 0) & (F.col("populated") > 0), "extracted").when(F.col("records") > 0, "source_present_no_normalized_records").otherwise("not_recorded")
    return out.withColumn("status", status)


@REGISTRY.add("message_fields", "\nUNION ALL ".join(
    f"SELECT '{t}' AS source, count(*) AS records, count(DISTINCT evidence_id) AS logs, concat_ws(',', {', '.join(f'CASE WHEN count({chr(34)}{c}{chr(34)}) > 0 THEN {chr(39)}{c}{chr(39)} END' for c in sorted(_FIELDS_OF[k]))}) AS fields FROM (SELECT DISTINCT * FROM {t})"
    for k, t in _CATEGORIES.items()))
def message_fields(spark: SparkSession, d: str) -> DataFrame:
    """Of each source its records, its logs and the union of the fields that they have."""
    out = None
    for k, t in _CATEGORIES.items():
        df = once(table(spark, d, t), "seq")
        fields = sorted(c for c in df.columns if c not in _KEYS)
        n = df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("evidence_id").alias("logs"), F.concat_ws(",", *[F.when(F.count(c) > 0, c) for c in fields]).alias("fields"))
        n = n.select(F.lit(t).alias("source"), "records", "logs", "fields")
        out = n if out is None else out.unionByName(n)
    return out


# Prefixes of names, in the order in which they are tried.
_PREFIXES = ("BAT", "CBRK", "COM", "GF", "MAV", "MIS", "NAV", "RC", "SYS")


@REGISTRY.add("event_prefixes", "WITH f AS (SELECT DISTINCT * FROM forensic_timeline WHERE event_type IS NOT NULL) SELECT CASE " + " ".join(f"WHEN starts_with(event_type, '{p}') THEN '{p}'" for p in _PREFIXES)
    + " ELSE 'OTHER' END AS category, count(*) AS records, count(DISTINCT event_type) AS names FROM f GROUP BY ALL")
def event_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Names by the first fitting prefix of a fixed list."""
    f = once(table(spark, d, "forensic_timeline").where("event_type is not null").select("seq", "event_type"), "seq")
    return f.groupBy(statistics.prefix_category(F.col("event_type"), _PREFIXES).alias("category")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("event_type").alias("names"))


@REGISTRY.add("primary_platform", """
WITH g AS (SELECT DISTINCT seq, vehicle_id, source_platform FROM gps WHERE vehicle_id IS NOT NULL AND source_platform IS NOT NULL), n AS (SELECT vehicle_id, source_platform, count(*) AS records FROM g GROUP BY ALL)
SELECT vehicle_id, arg_min(source_platform, (-records, source_platform)) AS source_platform, max(records) AS records FROM n GROUP BY vehicle_id""")
def primary_platform(spark: SparkSession, d: str) -> DataFrame:
    """Each aircraft's platform with the most records; ties go to the first name."""
    g = once(table(spark, d, "gps").where("vehicle_id is not null and source_platform is not null").select("seq", "vehicle_id", "source_platform"), "seq")
    n = g.groupBy("vehicle_id", "source_platform").agg(F.count(F.lit(1)).alias("records"))
    return n.groupBy("vehicle_id").agg(F.min_by("source_platform", F.struct(-F.col("records"), F.col("source_platform"))).alias("source_platform"), F.max("records").alias("records"))


# --- media and provenance ------------------------------------------------------------------


@REGISTRY.add("frame_overlaps", """
WITH f AS (SELECT DISTINCT evidence_id, video_id, seq, start_s, end_s FROM telemetry_frames WHERE evidence_id IS NOT NULL AND video_id IS NOT NULL AND start_s IS NOT NULL),
w AS (SELECT *, max(end_s) OVER (PARTITION BY evidence_id, video_id ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end FROM f)
SELECT evidence_id, video_id, seq FROM w WHERE start_s < latest_end""")
def frame_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Frames that begin before an earlier frame of their video has ended."""
    rows = sequenced(table(spark, d, "telemetry_frames").select("evidence_id", "video_id", "seq", "start_s", "end_s"), ["evidence_id", "video_id"], "start_s")
    return changes.overlaps(rows, ["evidence_id", "video_id"], "start_s", "end_s").select("evidence_id", "video_id", "seq")


_N = r"[-+]?\d+(?:\.\d+)?"


def _part(pattern: str, group: int = 1, cast: str | None = "DOUBLE") -> str:
    got = f"nullif(regexp_extract(body, '{pattern}', {group}), '')"
    return f"try_cast({got} AS {cast})" if cast else got


def _in_brackets(key: str) -> str:
    return _part(rf"(?i)\[(?:[^\]]*[^A-Za-z_\]])?{key}\s*:\s*([^\s\]]+)")


_PAIR = rf"\bGPS\s*\(\s*({_N})\s*,\s*({_N})\s*(?:,\s*({_N})\s*([Mm])?)?\s*\)"
_HOME = rf"\bHOME\s*\(\s*({_N})\s*,\s*({_N})\s*(?:,\s*({_N})\s*m)?\s*\)"
_CLOCK = r"(\d{4})[-.](\d{1,2})[-.](\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?"
_CUE = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"


def _attitude(letter: str, group: int) -> str:
    return _part(rf"{letter}\.PRY\s*\(\s*({_N})°?\s*,\s*({_N})°?\s*,\s*({_N})°?\s*\)", group)


def _cue_seconds(first: int) -> str:
    g = [f"try_cast(nullif(regexp_extract(line, '{_CUE}', {first + k}), '') AS BIGINT)" for k in range(4)]
    return f"(({g[0]} * 3600 + {g[1]} * 60 + {g[2]}) * 1000 + {g[3]}) / 1000.0"


def _km(lat: str, lon: str) -> str:
    return f"CASE WHEN {lat} BETWEEN -90 AND 90 THEN 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(klat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(klat)) * pow(sin(radians(klon - {lon}) / 2), 2)))) ELSE 'inf'::DOUBLE END"


_FRAMES_SQL = rf"""
x AS (SELECT doc_id, string_split_regex(regexp_replace(ltrim(text, chr(65279)), '\r\n?', chr(10), 'g'), '\n\s*\n') AS blocks FROM documents WHERE source = 'drone_sidecar' AND text IS NOT NULL),
y AS (SELECT doc_id, unnest(list_filter(blocks, lambda b: regexp_matches(b, '\S'))) AS block, generate_subscripts(list_filter(blocks, lambda b: regexp_matches(b, '\S')), 1) AS frame FROM x),
z AS (SELECT *, try_cast(nullif(regexp_extract(block, '^\s*(\d+)[ \t]*(?:\n|$)', 1), '') AS INTEGER) AS number, regexp_replace(block, '^\s*\d+[ \t]*(?:\n\s*|$)', '') AS rest FROM y),
l AS (SELECT *, regexp_extract(trim(rest), '^[^\n]*') AS line FROM z),
w AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN regexp_matches(line, '{_CUE}') THEN regexp_replace(rest, '^\s*[^\n]*', '') ELSE rest END, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') AS body FROM l),
v AS (SELECT doc_id, CAST(frame AS INTEGER) AS frame, coalesce(number, CAST(frame AS INTEGER)) AS cue, {_cue_seconds(1)} AS start_s, {_cue_seconds(5)} AS end_s,
  CASE WHEN regexp_matches(body, '{_CLOCK}') THEN regexp_extract(body, '{_CLOCK}', 1) || '-' || lpad(regexp_extract(body, '{_CLOCK}', 2), 2, '0') || '-' || lpad(regexp_extract(body, '{_CLOCK}', 3), 2, '0') || 'T' || lpad(regexp_extract(body, '{_CLOCK}', 4), 2, '0') || ':'
    || regexp_extract(body, '{_CLOCK}', 5) || ':' || regexp_extract(body, '{_CLOCK}', 6) || CASE WHEN regexp_extract(body, '{_CLOCK}', 7) <> '' THEN '.' || rpad(regexp_extract(body, '{_CLOCK}', 7), 3, '0') ELSE '' END END AS device_time,
  regexp_matches(body, '\[[^\]]*[A-Za-z_]+\s*:\s*[^\s\]]+') AS keyed, {_in_brackets("latitude")} AS nlat, coalesce({_in_brackets("longitude")}, {_in_brackets("longtitude")}) AS nlon,
  {_in_brackets("rel_alt")} AS relative_altitude_m, {_in_brackets("abs_alt")} AS absolute_altitude_m, {_part(_PAIR, 3, None)} AS third_text, {_part(_PAIR, 4, None)} IS NOT NULL AS unit, {_in_brackets("altitude")} AS named_altitude,
  {_part(rf"BAROMETER\s*:\s*({_N})")} AS barometric_height_m, {_part(rf"(?:^|[^\w.])H\s+({_N})m")} AS height_m, {_part(rf"(?:^|[^\w.])D\s+({_N})m")} AS distance_from_home_m,
  {_part(rf"H\.S\s+({_N})m/s")} AS horizontal_speed_m_s, {_part(rf"V\.S\s+({_N})m/s")} AS vertical_speed_m_s, {_part(_PAIR, 1)} AS "first", {_part(_PAIR, 2)} AS "second", {_part(_HOME, 1)} AS home_first, {_part(_HOME, 2)} AS home_second,
  {_part(r"(?i)\biso\s*:\s*(\d+)")} AS iso, {", ".join(f"{_attitude(c, k)} AS {n}_{axis}" for n, c in (("aircraft", "F"), ("gimbal", "G")) for k, axis in enumerate(("pitch", "roll", "yaw"), 1))} FROM w),
u AS (SELECT *, CASE WHEN nlat BETWEEN -90 AND 90 AND nlon BETWEEN -180 AND 180 AND NOT (nlat = 0 AND nlon = 0) THEN nlat END AS olat, CASE WHEN nlat BETWEEN -90 AND 90 AND nlon BETWEEN -180 AND 180 AND NOT (nlat = 0 AND nlon = 0) THEN nlon END AS olon FROM v),
o AS (SELECT doc_id, bool_or("first" IS NOT NULL OR home_first IS NOT NULL) AS pairs, bool_or(keyed) AS keyed, coalesce(bool_or(abs("first") > 90), false) OR coalesce(bool_or(abs(home_first) > 90), false) AS a,
  coalesce(bool_or(abs("second") > 90), false) OR coalesce(bool_or(abs(home_second) > 90), false) AS b, arg_min(olat, frame) FILTER (olat IS NOT NULL AND "first" IS NULL) AS klat, arg_min(olon, frame) FILTER (olat IS NOT NULL AND "first" IS NULL) AS klon,
  arg_min("first", frame) FILTER ("first" IS NOT NULL) AS p1, arg_min("second", frame) FILTER ("first" IS NOT NULL) AS p2, bool_or("first" IS NOT NULL) AS positional FROM u GROUP BY doc_id),
q AS (SELECT *, {_km("p2", "p1")} AS one, {_km("p1", "p2")} AS other FROM o),
d AS (SELECT *, CASE WHEN NOT pairs THEN CASE WHEN keyed THEN 'keyed' ELSE 'not_applicable' END WHEN a AND b THEN 'inconsistent' WHEN a THEN 'lon_lat' WHEN b THEN 'lat_lon' WHEN one < 1 AND other > 100 THEN 'lon_lat' WHEN other < 1 AND one > 100 THEN 'lat_lon' ELSE 'ambiguous' END AS axis_order,
  CASE WHEN NOT pairs THEN NULL WHEN a OR b THEN 'value_range' WHEN (one < 1 AND other > 100) OR (other < 1 AND one > 100) THEN 'keyed_frames_in_same_file' END AS axis_source FROM q),
f0 AS (SELECT u.*, d.axis_order, d.axis_source, CASE axis_order WHEN 'lon_lat' THEN "second" WHEN 'lat_lon' THEN "first" END AS plat, CASE axis_order WHEN 'lon_lat' THEN "first" WHEN 'lat_lon' THEN "second" END AS plon FROM u JOIN d USING (doc_id)),
r AS (SELECT *, olat IS NULL AND coalesce(plat BETWEEN -90 AND 90 AND plon BETWEEN -180 AND 180 AND NOT (plat = 0 AND plon = 0), false) AS paired FROM f0)"""
_OF_CUES = "start_s, end_s, device_time, relative_altitude_m, absolute_altitude_m, barometric_height_m, height_m, distance_from_home_m, horizontal_speed_m_s, vertical_speed_m_s, \"first\", \"second\", home_first, home_second, iso, aircraft_pitch, aircraft_roll, aircraft_yaw, gimbal_pitch, gimbal_roll, gimbal_yaw"


@REGISTRY.add("sidecar_frames", f"""WITH {_FRAMES_SQL} SELECT doc_id, axis_order, CASE WHEN paired THEN plat ELSE olat END AS latitude, CASE WHEN paired THEN plon ELSE olon END AS longitude, frame, cue, {_OF_CUES},
  CASE WHEN unit THEN try_cast(third_text AS DOUBLE) ELSE named_altitude END AS altitude_m, CASE WHEN NOT unit THEN third_text END AS third FROM r""")
def sidecar_frames(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry in the cues of drone sidecars."""
    return sidecars.frames(table(spark, d, "documents"))


@REGISTRY.add("sidecar_summary", f"""
WITH {_FRAMES_SQL}, s AS (SELECT *, CASE WHEN paired THEN plat ELSE olat END AS lat, CASE WHEN paired THEN plon ELSE olon END AS lon FROM r)
SELECT doc_id, count(*) AS frames, count(lat) AS with_position, concat_ws(',', CASE WHEN bool_or(keyed) THEN 'keyed' END, CASE WHEN bool_or("first" IS NOT NULL) THEN 'positional' END) AS formats, any_value(axis_order) AS axis_order, any_value(axis_source) AS axis_source,
  arg_min(device_time, frame) FILTER (device_time IS NOT NULL) AS first_device_time, arg_max(device_time, frame) FILTER (device_time IS NOT NULL) AS last_device_time,
  arg_min(lat, frame) FILTER (lat IS NOT NULL) AS first_latitude, arg_min(lon, frame) FILTER (lat IS NOT NULL) AS first_longitude FROM s GROUP BY doc_id""")
def sidecar_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cues, positions, formats, order of pairs and device times of each file."""
    return sidecars.summaries(table(spark, d, "documents")).where("frames > 0")


@REGISTRY.add("content_copies", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc_id, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def content_copies(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored more than once, by their hash."""
    h = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id", "source")
    return h.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"), F.count_distinct("source").alias("sources")).where("copies > 1")


@REGISTRY.add("custody_integrity", """
WITH c AS (SELECT DISTINCT * FROM chain_of_custody WHERE evidence_id IS NOT NULL)
SELECT evidence_id, count(*) AS events, count(DISTINCT original_hash) AS hashes, count(DISTINCT original_hash) <= 1 AS hashes_agree, bool_or(event = 'EVIDENCE_ACQUIRED') AS acquired, bool_or(event = 'INTEGRITY_VERIFIED') AS verified, arg_max(event, event_id) AS last_event FROM c GROUP BY evidence_id""")
def custody_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the custody of each log is whole: its hashes agree, it was acquired and verified."""
    c = once(table(spark, d, "chain_of_custody").where("evidence_id is not null").select("evidence_id", "event_id", "event", "original_hash"), "event_id")
    return c.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("original_hash").alias("hashes"), (F.count_distinct("original_hash") <= 1).alias("hashes_agree"),
        F.bool_or(F.col("event") == "EVIDENCE_ACQUIRED").alias("acquired"), F.bool_or(F.col("event") == "INTEGRITY_VERIFIED").alias("verified"), F.max_by("event", "event_id").alias("last_event"),
    )


@REGISTRY.add("split_disjointness", """
WITH k AS (SELECT DISTINCT vehicle_id, evidence_id, CAST(substr(evidence_id, 14) AS BIGINT) AS n FROM gps WHERE vehicle_id IS NOT NULL AND evidence_id IS NOT NULL),
s AS (SELECT vehicle_id, CASE WHEN n % 20 < 14 THEN 'train' WHEN n % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM k)
SELECT vehicle_id, count(*) AS logs, count(DISTINCT split) AS splits FROM s GROUP BY vehicle_id HAVING count(DISTINCT split) > 1""")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Aircraft whose logs a split by log number into 70, 15 and 15 % would spread over more
    than one part, so that the parts aren't disjoint by aircraft."""
    k = table(spark, d, "gps").where("vehicle_id is not null and evidence_id is not null").select("vehicle_id", "evidence_id").distinct()
    n = F.substring("evidence_id", 14, 20).cast("bigint") % 20
    s = k.select("vehicle_id", F.when(n < 14, "train").when(n < 17, "validation").otherwise("test").alias("split"))
    return s.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("logs"), F.count_distinct("split").alias("splits")).where("splits > 1")


@REGISTRY.add("chronological_split", """
WITH t AS (SELECT DISTINCT evidence_id, seq, "timestamp" AS ts FROM trajectory WHERE evidence_id IS NOT NULL AND "timestamp" IS NOT NULL), b AS (SELECT evidence_id, min(ts) AS a, max(ts) AS z FROM t GROUP BY evidence_id)
SELECT t.evidence_id, CASE WHEN ts < a + (z - a) * 0.7 THEN 'train' WHEN ts < a + (z - a) * 0.85 THEN 'validation' ELSE 'test' END AS part, count(*) AS records, min(ts) AS start_s, max(ts) AS end_s FROM t JOIN b USING (evidence_id) GROUP BY ALL""")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    """Each log's time cut into 70, 15 and 15 %; ranges are half open, the last one closed."""
    t = once(table(spark, d, "trajectory").where("evidence_id is not null and timestamp is not null").select("evidence_id", "seq", "timestamp"), "seq")
    b = t.groupBy("evidence_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    span = F.col("z") - F.col("a")
    part = F.when(F.col("timestamp") < F.col("a") + span * 0.7, "train").when(F.col("timestamp") < F.col("a") + span * 0.85, "validation").otherwise("test")
    return t.join(b, "evidence_id").groupBy("evidence_id", part.alias("part")).agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s"))


@REGISTRY.add("frame_last_ping", """
WITH f AS (SELECT DISTINCT evidence_id, seq, CAST(round((log_offset_s + start_s) * 1e6) AS BIGINT) AS t FROM telemetry_frames WHERE evidence_id IS NOT NULL AND log_offset_s + start_s IS NOT NULL),
p AS (SELECT evidence_id, CAST(round("timestamp" * 1e6) AS BIGINT) AS t, min(seq) AS ping_seq FROM gps WHERE evidence_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY ALL)
SELECT f.evidence_id, f.seq AS frame_seq, p.ping_seq, f.t - p.t AS age_us FROM f ASOF LEFT JOIN p ON f.evidence_id = p.evidence_id AND f.t >= p.t""")
def frame_last_ping(spark: SparkSession, d: str) -> DataFrame:
    """Each video frame with the last position record at or before it, however old."""
    f = table(spark, d, "telemetry_frames").select("evidence_id", "seq", F.round((F.col("log_offset_s") + F.col("start_s")) * 1e6).cast("bigint").alias("at_us")).where("evidence_id is not null and at_us is not null")
    p = table(spark, d, "gps").select("evidence_id", "seq", F.round(F.col("timestamp") * 1e6).cast("bigint").alias("at_us"))
    out = matching.as_of(once(f, "seq"), p, ["evidence_id"], F.struct("seq", "at_us"), "ping")
    return out.select("evidence_id", F.col("seq").alias("frame_seq"), F.col("ping.seq").alias("ping_seq"), (F.col("at_us") - F.col("ping.at_us")).alias("age_us"))
