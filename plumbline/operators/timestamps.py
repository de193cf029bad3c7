"""Instants written in many ways, as microseconds since 1970 UTC.

A text passes an ordered cascade of anchored patterns; the first that fits gives its parts,
which are then checked strictly (no rolling over of a 13th month). A zone in the text (an
offset, ``Z``, an abbreviation) decides; else the zone that a lookup names for the source.
Numbers are told apart by magnitude. Digits below a microsecond are dropped.

Policies for local times: one that occurs twice is the first of the two, unless the order of
records settles it (:func:`settle_folds`); one that a change skipped is read with the offset
in force before the change. Null, empty, unreadable and impossible texts, and texts without a
zone whose source has no known zone, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.pieces import carried, piece_keys, split_hot

# Minutes east of UTC of zone abbreviations.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s?([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*\(?([Zz]|[A-Za-z]{3,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?\)?"
#: Pattern and the order of its groups as year, month, day, hour, minute, second, fraction,
#: half of day, zone; tried from the top.
CASCADE = (
    (rf"^(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}})(?:[Tt_]|\s+){_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(?:[A-Za-z]{{2,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?[\s-](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:[A-Za-z]{{2,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
)
_EPOCH = r"^[0-9]{9,20}$"
#: What is cut off at both ends of a text.
BLANKS = " \t\n\v\f\r\x00\u00a0"
#: Clock changes put a local time back by one of these, in minutes.
SHIFTS = (60, 30, 120)


def epoch_micros(number: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970, by magnitude (bigint); numbers
    below a thousand million, and so all not above zero, are no instants."""
    n = number.cast("bigint")
    return (
        F.when(n < 1_000_000_000, None).when(n < 100_000_000_000, n * 1_000_000).when(n < 100_000_000_000_000, n * 1_000)
        .when(n < 100_000_000_000_000_000, n).otherwise((n.cast("decimal(20,0)") / 1_000).cast("bigint"))
        )


def parse_local(df: DataFrame, text: str) -> DataFrame:
    """Adds ``local_us`` (the clock reading as if it were UTC), ``zone_min`` (minutes east
    that the text states, else null) and ``told_us`` (an instant that needs no zone)."""
    df = df.withColumn("_t", F.btrim(F.col(text), F.lit(BLANKS)))
    # a text that a pattern fits becomes its parts, one that it doesn't stays as it is
    df = df.withColumn("_p", F.col("_t"))
    for pattern, order in CASCADE:
        to = "|".join(f"${g}" if g else "" for g in order)
        df = df.withColumn("_p", F.when(F.col("_p") == F.col("_t"), F.regexp_replace("_t", pattern, to)).otherwise(F.col("_p")))
    df = df.withColumn("_p", F.when(F.col("_p") != F.col("_t"), F.split("_p", r"\|")))

    def part(k: int) -> Column:
        return F.element_at("_p", k + 1)

    def number(k: int) -> Column:
        return F.expr(f"try_cast(element_at(_p, {k + 1}) as int)")

    month = F.coalesce(number(1), *[F.when(F.lower(F.substring(part(1), 1, 3)) == m, k) for k, m in enumerate(MONTHS, 1)])
    half = F.lower(F.substring(part(7), 1, 1))
    hour = F.when(half == "", number(3)).when((number(3) < 1) | (number(3) > 12), None).otherwise(number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.coalesce(number(5), F.lit(0))
    micro = F.expr("try_cast(rpad(substring(element_at(_p, 7), 1, 6), 6, '0') as bigint)")
    whole = F.try_make_timestamp(number(0), month, number(2), hour, number(4), second.cast("decimal(8,6)"), F.lit("UTC"))
    df = df.withColumn("local_us", F.when(F.col("_p").isNotNull() & (second < 60) & (number(0) >= 1970), F.unix_micros(whole) + micro))
    zone = F.upper(part(8))
    offset = F.when(zone.isNull() | (zone == ""), "").otherwise(F.regexp_extract(zone, r"([+-]\d{1,2}):?(\d{2})?$", 1))
    minutes = F.when(zone.isNull() | (zone == ""), "").otherwise(F.regexp_extract(zone, r"([+-]\d{1,2}):?(\d{2})?$", 2))
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    stated = F.expr("try_cast(_o as int)")
    table = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    df = df.withColumn("_o", F.regexp_replace(offset, r"[+-]", "")).withColumn("_m", minutes)
    by_offset = sign * (stated * 60 + F.coalesce(F.expr("try_cast(_m as int)"), F.lit(0)))
    df = df.withColumn("zone_min", F.when(F.col("_o") != "", by_offset).otherwise(F.try_element_at(table, zone)))
    # letters that are no known zone make the text unreadable
    df = df.withColumn("local_us", F.when((zone == "") | F.col("zone_min").isNotNull(), F.col("local_us")))
    epoch = F.when(F.col("_t").rlike(_EPOCH), epoch_micros(F.expr("try_cast(_t as bigint)")))
    df = df.withColumn("told_us", F.coalesce(epoch, F.col("local_us") - F.col("zone_min").cast("bigint") * 60_000_000))
    return df.drop("_t", "_p", "_o", "_m")


def with_folds(df: DataFrame, zone: str) -> DataFrame:
    """Adds ``first_us`` and, where the local time occurs twice in the zone, ``second_us``."""
    known = F.col("told_us").isNull() & F.col("local_us").isNotNull() & F.col(zone).isNotNull()
    # the session's zone plays no part: both functions shift the count of microseconds
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local_us"), F.col(zone)))
    df = df.withColumn("first_us", F.when(known, first))
    # most times are far from a change: two hours on the offset is still the same
    ahead = max(SHIFTS) * 60_000_000
    moves = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("first_us") + ahead), F.col(zone))) != F.col("local_us") + ahead
    second = F.coalesce(*[
        F.when(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("first_us") + s * 60_000_000), F.col(zone))) == F.col("local_us"), F.col("first_us") + s * 60_000_000)
        for s in SHIFTS
    ])
    return df.withColumn("second_us", F.when(moves, second))


#: Clocks of neighbouring frames go back by up to so much without a change of the clock.
JITTER_US = 5_000_000


def settle_folds(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``utc_us`` of records in sequence, partitioned into pieces by :func:`split_hot`: from
    where the clock has gone back within the hour that occurs twice, its readings of that hour
    are the second of the two. Only ambiguous records are compared."""
    twice = F.col("second_us").isNotNull()
    shift = F.col("second_us") - F.col("first_us")
    # records at one place in the sequence, in the order of their clock
    line = [order, "local_us"]
    df = carried(df, keys, line, F.when(twice, F.col("local_us")), "previous_us")
    fell = F.col("previous_us") - F.col("local_us")
    df = df.withColumn("fell", F.coalesce(twice & (fell > JITTER_US) & (fell < shift), F.lit(False)))
    # where it last went back; that of another hour is farther off than the shift
    df = carried(df, keys, line, F.when(F.col("fell"), F.col("local_us")), "fell_us")
    back = F.col("fell") | (F.abs(F.col("local_us") - F.col("fell_us")) < shift)
    return df.withColumn("utc_us", F.when(twice & back, F.col("second_us")).otherwise(F.coalesce("told_us", "first_us")))


def _zones(sources: DataFrame) -> DataFrame:
    """One zone per source; a source with several is unknown. Names that the runtime doesn't
    know would fail the query, so only names of the usual form pass."""
    z = F.trim("clock_zone")
    named = sources.select("source_id", F.when(z.rlike(r"^(UTC|GMT|[A-Z][A-Za-z_]+(/[A-Za-z0-9_+-]+)+)$"), z).alias("zone"))
    return named.where("source_id is not null").groupBy("source_id").agg(F.when(F.count_distinct("zone") == 1, F.min("zone")).alias("zone"))


def texts_to_utc(records: DataFrame, text: str, source: str, sources: DataFrame) -> DataFrame:
    """Parsed records with ``first_us``, ``second_us`` and ``told_us``. The lookup has one
    row per recorder or station; the optimizer picks broadcast by its size."""
    zones = _zones(sources).withColumnRenamed("source_id", source)
    return with_folds(parse_local(records, text).join(zones, source, "left"), "zone")


def frame_instants(frames: DataFrame, sources: DataFrame, **hot: int) -> DataFrame:
    """``(row_no, utc_us)`` of the recorder's clock texts. A frame without log, video or place
    in it stands alone."""
    keys = ["evidence_id", "video_id"]
    alone = F.col("evidence_id").isNull() | F.col("video_id").isNull() | F.col("frame_index").isNull()
    rows = frames.where("seq is not null and device_time is not null").select(
        F.coalesce("evidence_id", F.lit("")).alias("evidence_id"), F.when(alone, F.concat(F.lit("seq "), F.col("seq").cast("string"))).otherwise(F.col("video_id")).alias("video_id"),
        F.coalesce("frame_index", F.lit(0)).alias("frame_index"), "recorder_id", "device_time", F.col("seq").alias("row_no"),
    )
    rows = split_hot(rows, keys, "frame_index", counted=frames, **hot).drop("cut")
    about, at = rows.schema["piece"].metadata, piece_keys(rows, keys)
    rows = rows.repartition(*at).dropDuplicates([*at, "row_no"])
    parsed = texts_to_utc(rows, "device_time", "recorder_id", sources).withMetadata("piece", about)
    return settle_folds(parsed, keys, "frame_index").select("row_no", "utc_us").where("utc_us is not null")


def custody_instants(custody: DataFrame, sources: DataFrame) -> DataFrame:
    rows = custody.select("station_id", "timestamp_utc", F.col("event_id").alias("row_no")).where("row_no is not null and timestamp_utc is not null").dropDuplicates(["row_no"])
    parsed = texts_to_utc(rows, "timestamp_utc", "station_id", sources)
    return parsed.select("row_no", F.coalesce("told_us", "first_us").alias("utc_us")).where("utc_us is not null")


def timeline_instants(timeline: DataFrame) -> DataFrame:
    """Counts of microseconds from a boot instant, or since 1970 in any unit."""
    t = F.when(F.col("timestamp_us") > 0, F.col("timestamp_us"))
    utc = F.when(F.col("boot_utc_us").isNotNull(), F.col("boot_utc_us") + t).otherwise(epoch_micros(t))
    return timeline.select(F.col("seq").alias("row_no"), utc.alias("utc_us")).where("row_no is not null and utc_us is not null").dropDuplicates(["row_no"])


def all_instants(frames: DataFrame, custody: DataFrame, timeline: DataFrame, sources: DataFrame) -> DataFrame:
    """``(table_name, row_no, utc_us)``, one row per record of the three tables whose
    instant can be told."""
    named = [
        ("telemetry_frames", frame_instants(frames, sources)), ("chain_of_custody", custody_instants(custody, sources)), ("forensic_timeline", timeline_instants(timeline)),
    ]
    out = [df.select(F.lit(n).alias("table_name"), "row_no", "utc_us") for n, df in named]
    return out[0].unionByName(out[1]).unionByName(out[2])
