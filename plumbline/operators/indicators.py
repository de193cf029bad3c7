"""Indicators, findings and one timeline from the evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import geo
from plumbline.operators.changes import burst_counts, changes, flag_intervals, numbered, with_previous
from plumbline.operators.matching import band_pairs
from plumbline.operators.pieces import carried, split_hot

# Category, severity and confidence of each indicator, in the order in which
# findings are numbered.
CATALOGUE = {
    "GPS_SPOOFING_STATE": ("navigation", "HIGH", "HIGH"),
    "GPS_JAMMING_STATE": ("navigation", "HIGH", "HIGH"),
    "GPS_FIX_TYPE_CHANGE": ("navigation", "MEDIUM", "MEDIUM"),
    "GPS_SATELLITE_COUNT_CHANGE": ("navigation", "LOW", "MEDIUM"),
    "GPS_POSITION_DISCONTINUITY": ("navigation", "MEDIUM", "MEDIUM"),
    "NAVIGATION_POSITION_VALIDITY_CHANGE": ("navigation", "MEDIUM", "MEDIUM"),
    "COMMAND_WITHOUT_EXACT_ACK": ("command_and_control", "LOW", "MEDIUM"),
    "ACK_WITHOUT_COMMAND": ("command_and_control", "LOW", "MEDIUM"),
    "REPEATED_COMMAND_ID": ("command_and_control", "LOW", "HIGH"),
    "GCS_CONNECTION_LOST": ("flight_control", "MEDIUM", "HIGH"),
    "FAILSAFE_STATE_CHANGE": ("flight_control", "MEDIUM", "MEDIUM"),
    "GCS_CONNECTION_STATE_CHANGE": ("flight_control", "MEDIUM", "MEDIUM"),
    "ARMED_STATE_CHANGE": ("flight_control", "LOW", "MEDIUM"),
    "LANDED_STATE_CHANGE": ("flight_control", "LOW", "MEDIUM"),
    "NO_GPS_RECORDS": ("evidence_quality", "INFO", "HIGH"),
    "NO_STATE_RECORDS": ("evidence_quality", "INFO", "HIGH"),
    "NO_COMMAND_RECORDS": ("evidence_quality", "INFO", "HIGH"),
}
# Titles of findings; other kinds have their name as title.
TITLES = {
    "GPS_SPOOFING_STATE": "GPS spoofing state was reported",
    "GPS_JAMMING_STATE": "GPS jamming state was reported",
    "GPS_FIX_TYPE_CHANGE": "GPS fix type changed",
    "GPS_SATELLITE_COUNT_CHANGE": "GPS satellite count changed",
    "GPS_POSITION_DISCONTINUITY": "GPS position discontinuity detected",
    "NAVIGATION_POSITION_VALIDITY_CHANGE": "Navigation position validity changed",
    "COMMAND_WITHOUT_EXACT_ACK": "Command did not receive a matching acknowledgement",
    "ACK_WITHOUT_COMMAND": "Command acknowledgement has no matching command",
    "REPEATED_COMMAND_ID": "Command ID was repeated",
    "NO_GPS_RECORDS": "No GPS records were available",
    "NO_STATE_RECORDS": "No flight-state records were available",
    "NO_COMMAND_RECORDS": "No command records were available",
}
#: What a finding of these kinds does not establish, by family.
CAVEATS = {
    "navigation": ("GPS_SPOOFING_STATE", "GPS_JAMMING_STATE", "GPS_POSITION_DISCONTINUITY", "NAVIGATION_POSITION_VALIDITY_CHANGE"),
    "command_and_control": ("COMMAND_WITHOUT_EXACT_ACK", "ACK_WITHOUT_COMMAND", "REPEATED_COMMAND_ID"),
    "failsafe": ("FAILSAFE_STATE_CHANGE",),
}
# Severity of the conditions that flags report; all others are LOW.
HIGH_FLAGS = (
    "critical_failure", "motor_failure", "geofence_breached", "mission_failure", "navigator_failure", "battery_unhealthy", "attitude_invalid",
    "global_position_invalid",
)
MEDIUM_FLAGS = (
    "offboard_control_signal_lost", "manual_control_signal_lost", "gcs_connection_lost", "position_accuracy_low", "local_position_invalid",
    "local_velocity_invalid", "home_position_invalid", "auto_mission_missing",
)
JUMP_M = 100.0
LOG = ["evidence_id"]


def flag_severity(field: Column) -> Column:
    """How much an asserted flag matters."""
    return F.when(field.isin(*HIGH_FLAGS), "HIGH").when(field.isin(*MEDIUM_FLAGS), "MEDIUM").when(field.isNotNull(), "LOW")


def _row(kind: str, source: str, seq: Column, at: Column, end: Column | None = None, place: Column | None = None) -> Column:
    """One indicator; ``place`` orders those of one kind, the sequence number if not given."""
    return F.struct(
        F.lit(kind).alias("indicator_type"), F.lit(source).alias("source"), seq.cast("bigint").alias("seq"), at.cast("bigint").alias("at_us"),
        (F.lit(None) if end is None else end).cast("bigint").alias("end_us"), (seq if place is None else place).cast("bigint").alias("place"),
    )


def receiver_indicators(gps: DataFrame) -> DataFrame:
    """States asserted by the receiver, changes of fix and satellites against the last known
    value, and steps of 100 m and more from the record before, all in one pass over records
    that :func:`sequenced` has put in order of emission."""
    rows = with_previous(gps, LOG, ["seq"], {c: F.col(c) for c in ("latitude", "longitude", "timestamp")})
    for c in ("fix_type", "satellites"):
        rows = carried(rows, LOG, "seq", F.col(c), f"last_{c}")
    at = F.round(F.col("timestamp") * 1e6)
    step = geo.haversine(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    marks = {
        "GPS_SPOOFING_STATE": F.col("spoofing_state") != 0,
        "GPS_JAMMING_STATE": F.col("jamming_state") != 0,
        "GPS_FIX_TYPE_CHANGE": F.col("fix_type") != F.col("last_fix_type"),
        "GPS_SATELLITE_COUNT_CHANGE": F.col("satellites") != F.col("last_satellites"),
        "GPS_POSITION_DISCONTINUITY": (F.col("timestamp") > F.col("prev.timestamp")) & (step >= JUMP_M),
    }
    found = F.array_compact(F.array(*[F.when(m, _row(k, "gps", F.col("seq"), at)) for k, m in marks.items()]))
    return rows.select("evidence_id", F.explode(found).alias("r")).select("evidence_id", "r.*")


def validity_indicators(trajectory: DataFrame, gps_logs: DataFrame) -> DataFrame:
    """Changes of the position's validity, in logs that have a receiver at all."""
    rows = changes(trajectory, LOG, ["timestamp", "seq"], "position_valid").join(gps_logs, LOG, "left_semi")
    at = F.round(F.col("timestamp") * 1e6)
    return rows.select("evidence_id", _row("NAVIGATION_POSITION_VALIDITY_CHANGE", "trajectory", F.col("seq"), at, place=at).alias("r")).select("evidence_id", "r.*")


def command_indicators(lone: DataFrame, unasked: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of the results of :mod:`plumbline.operators.matching`."""
    c = lone.select("evidence_id", _row("COMMAND_WITHOUT_EXACT_ACK", "commands", F.col("command_seq"), F.col("command_us")).alias("r"))
    a = unasked.select("evidence_id", _row("ACK_WITHOUT_COMMAND", "command_acks", F.col("ack_seq"), F.col("at_us")).alias("r"))
    r = repeated.select("evidence_id", _row("REPEATED_COMMAND_ID", "commands", F.col("least_seq"), F.col("first_us"), F.col("last_us")).alias("r"))
    return c.unionByName(a).unionByName(r).select("evidence_id", "r.*")


STATE_KINDS = {"failsafe": "FAILSAFE_STATE_CHANGE", "gcs_connection_lost": "GCS_CONNECTION_STATE_CHANGE", "arming_state": "ARMED_STATE_CHANGE", "landed": "LANDED_STATE_CHANGE"}


def state_indicators(flags: DataFrame) -> DataFrame:
    """Changes of four states and the periods without a ground station. ``flags`` has one
    three-valued ``flag`` per record of a field, in order."""
    keys, order = ["evidence_id", "field"], ["timestamp_us", "seq"]
    moved = changes(flags, keys, order, "flag")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in STATE_KINDS.items() for x in kv]), F.col("field"))
    turned = moved.select("evidence_id", kind.alias("indicator_type"), F.lit("state_reconstruction").alias("source"), "seq", F.col("timestamp_us").alias("at_us"), F.lit(None).cast("bigint").alias("end_us"), F.col("timestamp_us").alias("place"))
    lost = flag_intervals(flags.where("field = 'gcs_connection_lost'"), keys, order, "flag", "timestamp_us")
    lost = lost.select("evidence_id", _row("GCS_CONNECTION_LOST", "state_reconstruction", F.col("first_seq"), F.col("start"), F.col("last_true"), F.col("start")).alias("r")).select("evidence_id", "r.*")
    return turned.unionByName(lost)


def quality_indicators(tables: dict[str, DataFrame], kinds: dict[str, str]) -> DataFrame:
    """Logs that occur in one of the tables and have no record at all in another; ``kinds`` maps
    each kind to its table. One pass over the logs' names."""
    names = None
    for name, table in tables.items():
        rows = table.select("evidence_id", F.lit(name).alias("table")).where("evidence_id is not null")
        names = rows if names is None else names.unionByName(rows)
    seen = names.groupBy("evidence_id").agg(*[F.max(F.col("table") == t).alias(k) for k, t in kinds.items()])
    nothing = F.lit(None)
    lacking = F.array_compact(F.array(*[F.when(~F.col(k), _row(k, "", nothing, nothing)) for k in kinds]))
    return seen.select("evidence_id", F.explode(lacking).alias("r")).select("evidence_id", "r.*").withColumn("source", F.lit(None).cast("string"))


def described(rows: DataFrame) -> DataFrame:
    """Adds category, severity and confidence of each kind."""
    table = F.create_map(*[x for k, v in CATALOGUE.items() for x in (F.lit(k), F.struct(*[F.lit(c).alias(n) for n, c in zip(("category", "severity", "confidence"), v, strict=True)]))])
    return rows.withColumn("_of", F.element_at(table, F.col("indicator_type"))).select("*", "_of.*").drop("_of")


def findings(rows: DataFrame, counted: DataFrame, **hot: int) -> DataFrame:
    """Numbered in each log by kind in the order of the catalogue, then as recorded. Numbers of
    logs of any size are counts of the pieces before plus ranks within the piece; ``counted`` is
    a table that says which logs are large."""
    rank = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(CATALOGUE) for x in (k, n)]), F.col("indicator_type"))
    rows = described(rows).withColumn("_rank", rank)
    rows = rows.withColumn("_order", F.col("_rank") * 1e17 + F.coalesce("place", F.lit(0)).cast("double"))
    rows = split_hot(rows, LOG, "_order", counted=counted, **hot).drop("cut")
    rows = numbered(rows, LOG, ["_rank", "place", "seq"], F.lit(True), "number")
    digits, kind = F.col("number").cast("string"), F.col("indicator_type")
    plain = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.replace(F.substring(kind, 2, 100), F.lit("_"), F.lit(" "))))
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    caveat = F.lit(None).cast("string")
    for family, kinds in CAVEATS.items():
        caveat = F.when(kind.isin(*kinds), family).otherwise(caveat)
    return rows.select(
        "evidence_id", F.concat(F.lit("FINDING-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))).alias("finding_id"), "category", "severity", "confidence",
        F.coalesce(F.try_element_at(titles, kind), plain).alias("title"), caveat.alias("caveat"), "at_us", "end_us", F.concat(F.col("source"), F.lit(":"), F.col("seq").cast("string")).alias("evidence_ref"),
    )


def timeline(commands: DataFrame, acks: DataFrame, states: DataFrame) -> DataFrame:
    """``(evidence_id, at_us, seq, event_type, description)`` of commands, acknowledgements
    and changes of state; snapshots are no events. Rows without log or time are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    c = commands.select("evidence_id", F.col("command_timestamp_us").alias("at_us"), "seq", F.lit("VEHICLE_COMMAND").alias("event_type"), F.concat(F.lit("command "), text("command_id")).alias("description"))
    a = acks.select("evidence_id", F.col("timestamp_us").alias("at_us"), "seq", F.lit("COMMAND_ACK").alias("event_type"), F.concat(F.lit("ack "), text("command_id"), F.lit(" result "), text("result")).alias("description"))
    s = states.where("field is not null and event_type is not null and event_type not in ('INITIAL_STATE', 'STATE_SNAPSHOT')").select(
        "evidence_id", F.col("timestamp_us").alias("at_us"), "seq", "event_type", F.concat(F.col("field"), F.lit(": "), text("previous_value"), F.lit(" -> "), text("new_value")).alias("description")
    )
    rows = c.unionByName(a).unionByName(s).where("evidence_id is not null and at_us is not null")
    return rows.dropDuplicates(["event_type", "seq"])


# Kinds of events whose surroundings are looked at.
TARGETS = (
    "GCS_CONNECTION_STATE_CHANGE", "GPS_STATE_CHANGE", "GPS_INTEGRITY_EVENT", "PREFLIGHT_CHECK_STATE_CHANGE", "FAILSAFE_STATE_CHANGE",
    "NAVIGATION_STATE_CHANGE", "ARMING_STATE_CHANGE", "LAND_DETECTION_STATE_CHANGE", "DESCEND_STATE_CHANGE", "VEHICLE_COMMAND", "COMMAND_ACK",
    "POWER_INPUT_STATE_CHANGE", "SAFETY_STATE_CHANGE",
)
#: What a target and the kinds of events near it suggest, the first that fits. No cause is claimed.
RELATIONSHIPS = (
    ("GCS_AND_DESCEND_TEMPORAL_PROXIMITY", "GCS_CONNECTION_STATE_CHANGE", ("DESCEND_STATE_CHANGE",)),
    ("GCS_AND_FLIGHT_STATE_TEMPORAL_PROXIMITY", "GCS_CONNECTION_STATE_CHANGE", ("FAILSAFE_STATE_CHANGE", "NAVIGATION_STATE_CHANGE")),
    ("COMMAND_ACK_TEMPORAL_PROXIMITY", "VEHICLE_COMMAND", ("COMMAND_ACK",)),
    ("PREFLIGHT_AND_GPS_TEMPORAL_PROXIMITY", "PREFLIGHT_CHECK_STATE_CHANGE", ("GPS_STATE_CHANGE", "GPS_INTEGRITY_EVENT")),
)


def relationship(target: Column, near: dict[str, Column]) -> Column:
    """``near`` tells for each of RELATIONSHIPS whether an event of its kinds is near."""
    out = F.lit("GENERAL_TEMPORAL_PROXIMITY")
    for name, of, _ in reversed(RELATIONSHIPS):
        out = F.when((target == of) & near[name], name).otherwise(out)
    return out


def correlations(events: DataFrame, spans: dict[str, int]) -> DataFrame:
    """``(evidence_id, seq, event_type, span, nearby, relationship)``: for each target and each
    window around it how many other events of its log are in it, where there are any, and what
    they suggest. Range frames count without forming pairs."""
    flags = {name: F.col("event_type").isin(*kinds) for name, _, kinds in RELATIONSHIPS}
    rows = burst_counts(events, LOG, "at_us", spans, flags).where(F.col("event_type").isin(*TARGETS))
    each = [
        F.struct(F.lit(w).alias("span"), F.col(f"{w}_nearby").alias("nearby"), relationship(F.col("event_type"), {n: F.col(f"{w}_{n}") > 0 for n in flags}).alias("relationship"))
        for w in spans
    ]
    return rows.select("evidence_id", "seq", "event_type", F.explode(F.array(*each)).alias("r")).select("evidence_id", "seq", "event_type", "r.*").where("nearby > 0")


def neighbours(events: DataFrame, spans: dict[str, int]) -> DataFrame:
    """``(evidence_id, seq, event_type, place, near_seq, near_type, delta_us, span)``: the other
    events in the widest window around each target, by distance in time; ``span`` is the
    narrowest window that holds it. A band join: only pairs within the window are formed."""
    widest = max(spans.values())
    left = events.where(F.col("event_type").isin(*TARGETS)).select("evidence_id", "at_us", "seq", "event_type")
    right = events.select("evidence_id", "at_us", F.col("seq").alias("near_seq"), F.col("event_type").alias("near_type"))
    pairs = band_pairs(left, right, LOG, -widest, widest).where((F.col("seq") != F.col("near_seq")) | (F.col("event_type") != F.col("near_type")))
    delta = F.col("right_us") - F.col("left_us")
    span = F.lit(None).cast("string")
    for w, n in sorted(spans.items(), key=lambda x: -x[1]):
        span = F.when(F.abs(delta) <= n, w).otherwise(span)
    target = Window.partitionBy("evidence_id", "event_type", "seq").orderBy(F.abs(delta), "right_us", "near_type", "near_seq")
    return pairs.select("evidence_id", "seq", "event_type", F.row_number().over(target).alias("place"), "near_seq", "near_type", delta.alias("delta_us"), span.alias("span"))
