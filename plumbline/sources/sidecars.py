"""Telemetry in subtitle sidecars of drone videos: one row per cue, by column expressions.

A file's cues are parsed within its row, so nothing is shuffled. Positions are written with
their names (``[latitude: 41.6]``) or as a pair ``GPS(a,b,c)``, whose order differs between
models. The order of a file is told by its values: one beyond 90 is a longitude; else cues of
the same file that name their position prove it, if the pairs lie within 1 km of them in one
order and over 100 km away in the other. In files that prove nothing the pairs stay as they are
and give no position; a caller who knows the order may state it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.geo import haversine_asin

_NUM = r"[-+]?\d+(?:\.\d+)?"
_DEGREES = "\u00b0?"
# How sidecar formats write their fields.
TIMES = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
DEVICE_TIME = r"(\d{4})[-.](\d{1,2})[-.](\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?"
GPS = rf"\bGPS\s*\(\s*({_NUM})\s*,\s*({_NUM})\s*(?:,\s*({_NUM})\s*([Mm])?)?\s*\)"
HOME = rf"\bHOME\s*\(\s*({_NUM})\s*,\s*({_NUM})\s*(?:,\s*({_NUM})\s*m)?\s*\)"
DISTANCE = rf"(?:^|[^\w.])D\s+({_NUM})m"
HEIGHT = rf"(?:^|[^\w.])H\s+({_NUM})m"
SPEED_H = rf"H\.S\s+({_NUM})m/s"
SPEED_V = rf"V\.S\s+({_NUM})m/s"
BAROMETER = rf"BAROMETER\s*:\s*({_NUM})"
ISO = r"(?i)\biso\s*:\s*(\d+)"
ORDERS = ("lon_lat", "lat_lon")


def attitude_pattern(kind: str) -> str:
    """``F.PRY(...)`` of the aircraft or ``G.PRY(...)`` of the gimbal."""
    return rf"{kind}\.PRY\s*\(\s*({_NUM}){_DEGREES}\s*,\s*({_NUM}){_DEGREES}\s*,\s*({_NUM}){_DEGREES}\s*\)"


def keyed_pattern(key: str) -> str:
    """The value of a name in square brackets."""
    return rf"(?i)\[(?:[^\]]*[^A-Za-z_\]])?{key}\s*:\s*([^\s\]]+)"


def _text(body: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))


def _number(body: Column, pattern: str, group: int = 1) -> Column:
    return _text(body, pattern, group).try_cast("double")


def _seconds(times: Column, first: int) -> Column:
    part = [F.regexp_extract(times, TIMES, first + k).try_cast("bigint") for k in range(4)]
    return ((part[0] * 3600 + part[1] * 60 + part[2]) * 1000 + part[3]) / 1000.0


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _read(block: Column, place: Column) -> Column:
    """Number, line of times and text of a block, computed once for all its fields."""
    number = F.regexp_extract(block, r"^\s*(\d+)[ \t]*(?:\n|$)", 1)
    rest = F.regexp_replace(block, r"^\s*\d+[ \t]*(?:\n\s*|$)", "")
    line = F.regexp_extract(F.trim(rest), r"^[^\n]*", 0)
    timed = line.rlike(TIMES)
    body = F.regexp_replace(F.regexp_replace(F.when(timed, F.regexp_replace(rest, r"^\s*[^\n]*", "")).otherwise(rest), r"<[^>]+>", " "), r"\s+", " ")
    return F.struct(place.alias("place"), number.alias("number"), F.when(timed, line).alias("times"), body.alias("body"))


def _cue(block: Column) -> Column:
    """All fields of a block that is read."""
    place, number, line, body = (block[c] for c in ("place", "number", "times", "body"))
    at = [F.regexp_extract(body, DEVICE_TIME, k) for k in range(1, 8)]
    day = F.concat_ws("-", at[0], F.lpad(at[1], 2, "0"), F.lpad(at[2], 2, "0"))
    clock = F.concat(F.concat_ws(":", F.lpad(at[3], 2, "0"), at[4], at[5]), F.when(at[6] != "", F.concat(F.lit("."), F.rpad(at[6], 3, "0"))).otherwise(""))
    lat = _number(body, keyed_pattern("latitude"))
    lon = F.coalesce(_number(body, keyed_pattern("longitude")), _number(body, keyed_pattern("longtitude")))
    ok = valid(lat, lon)
    unit = _text(body, GPS, 4).isNotNull()
    third = _text(body, GPS, 3)
    fields = {
        "frame": place + 1, "cue": F.coalesce(number.try_cast("int"), place + 1), "start_s": _seconds(line, 1), "end_s": _seconds(line, 5),
        "device_time": F.when(at[0] != "", F.concat(day, F.lit("T"), clock)), "keyed": body.rlike(r"\[[^\]]*[A-Za-z_]+\s*:\s*[^\s\]]+"), "latitude": F.when(ok, lat), "longitude": F.when(ok, lon),
        "relative_altitude_m": _number(body, keyed_pattern("rel_alt")), "absolute_altitude_m": _number(body, keyed_pattern("abs_alt")),
        "altitude_m": F.coalesce(F.when(unit, third.try_cast("double")), _number(body, keyed_pattern("altitude"))), "barometric_height_m": _number(body, BAROMETER),
        "height_m": _number(body, HEIGHT), "distance_from_home_m": _number(body, DISTANCE), "horizontal_speed_m_s": _number(body, SPEED_H), "vertical_speed_m_s": _number(body, SPEED_V),
        "first": _number(body, GPS, 1), "second": _number(body, GPS, 2), "third": F.when(~unit, third), "home_first": _number(body, HOME, 1), "home_second": _number(body, HOME, 2), "iso": _number(body, ISO),
    }
    for name, kind in (("aircraft", "F"), ("gimbal", "G")):
        fields |= {f"{name}_{axis}": _number(body, attitude_pattern(kind), k) for k, axis in enumerate(("pitch", "roll", "yaw"), 1)}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _order(cues: Column, stated: str | None) -> tuple[Column, Column]:
    """Order of the pairs of a file, and what tells it."""
    beyond = lambda name: F.exists(cues, lambda c: F.coalesce(F.abs(c[name]) > 90, F.lit(False)))
    pairs = F.exists(cues, lambda c: c["first"].isNotNull() | c["home_first"].isNotNull())
    first, second = beyond("first") | beyond("home_first"), beyond("second") | beyond("home_second")
    known = F.try_element_at(F.filter(cues, lambda c: c["latitude"].isNotNull() & c["first"].isNull()), F.lit(1))
    pair = F.try_element_at(F.filter(cues, lambda c: c["first"].isNotNull()), F.lit(1))
    far = F.lit(float("inf"))

    def km(lat: Column, lon: Column) -> Column:
        return F.when(lat.between(-90, 90), haversine_asin(lat, lon, known["latitude"], known["longitude"], 6_371.0)).otherwise(far)

    one, other = km(pair["second"], pair["first"]), km(pair["first"], pair["second"])
    shown = F.when((one < 1) & (other > 100), "lon_lat").when((other < 1) & (one > 100), "lat_lon")
    by_value = F.when(first & second, "inconsistent").when(first, "lon_lat").when(second, "lat_lon")
    if stated:
        return F.when(pairs, stated).otherwise(_unpaired(cues)), F.when(pairs, "stated")
    order = F.when(~pairs, _unpaired(cues)).otherwise(F.coalesce(by_value, shown, F.lit("ambiguous")))
    return order, F.when(~pairs, None).when(by_value.isNotNull(), "value_range").when(shown.isNotNull(), "keyed_frames_in_same_file")


def _unpaired(cues: Column) -> Column:
    return F.when(F.exists(cues, lambda c: c["keyed"]), "keyed").otherwise("not_applicable")


def _files(documents: DataFrame, source: str, stated: str | None) -> DataFrame:
    if stated is not None and stated not in ORDERS:
        raise ValueError(f"the order is one of {ORDERS}")
    text = F.regexp_replace(F.regexp_replace("text", "^\ufeff+", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: b.rlike(r"\S"))
    files = documents.where((F.col("source") == source) & F.col("text").isNotNull()).select("doc_id", F.transform(F.transform(blocks, _read), _cue).alias("cues"))
    order, why = _order(F.col("cues"), stated)
    return files.select("doc_id", "cues", order.alias("axis_order"), why.alias("axis_source"))


def _placed(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cue, by name or by the pair in the file's order."""
    swap = F.col("axis_order") == "lon_lat"
    lat, lon = F.when(swap, c["second"]).otherwise(c["first"]), F.when(swap, c["first"]).otherwise(c["second"])
    use = c["latitude"].isNull() & F.col("axis_order").isin(*ORDERS) & valid(lat, lon)
    return F.when(use, lat).otherwise(c["latitude"]), F.when(use, lon).otherwise(c["longitude"])


def frames(documents: DataFrame, source: str = "drone_sidecar", order: str | None = None) -> DataFrame:
    """One row per block of text: ``frame`` counts them, ``cue`` is the number written there (or
    the count), then times, the device's own time as text, position, heights, speeds, raw pairs
    and attitudes. ``order`` states the order of pairs for all files. Positions at (0, 0) and out
    of range are null. Null and empty texts, and texts of blanks, give no rows."""
    rows = _files(documents, source, order).select("doc_id", "axis_order", F.explode("cues").alias("c"))
    lat, lon = _placed(F.col("c"))
    names = [f.name for f in rows.schema["c"].dataType.fields if f.name not in ("latitude", "longitude", "keyed")]
    return rows.select("doc_id", "axis_order", lat.alias("latitude"), lon.alias("longitude"), *[F.col(f"c.{n}") for n in names])


def summaries(documents: DataFrame, source: str = "drone_sidecar", order: str | None = None) -> DataFrame:
    """One row per file: cues, cues with a position, formats, order of pairs and what tells it,
    first and last device time, first position."""
    files = _files(documents, source, order)
    cues = F.col("cues")
    places = F.filter(F.transform(cues, lambda c: F.struct(_placed(c)[0].alias("latitude"), _placed(c)[1].alias("longitude"))), lambda p: p["latitude"].isNotNull())
    files = files.withColumns({"places": places, "times": F.array_compact(F.transform(cues, lambda c: c["device_time"]))})
    formats = F.concat_ws(",", F.when(F.exists(cues, lambda c: c["keyed"]), "keyed"), F.when(F.exists(cues, lambda c: c["first"].isNotNull()), "positional"))
    start, end = (F.try_element_at("times", F.lit(k)) for k in (1, -1))
    place = F.try_element_at("places", F.lit(1))
    return files.select(
        "doc_id", F.size("cues").cast("bigint").alias("frames"), F.size("places").cast("bigint").alias("with_position"), formats.alias("formats"), "axis_order", "axis_source",
        start.alias("first_device_time"), end.alias("last_device_time"), place["latitude"].alias("first_latitude"), place["longitude"].alias("first_longitude"),
    )
