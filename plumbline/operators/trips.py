"""Stops and trips from position pings, by stay points.

Per log the usable pings (a position that is no case of :mod:`plumbline.operators.spikes`)
are taken in order of time. An anchor window is extended while all its positions lie within
``radius`` metres of each other; a window that lasts ``least`` seconds is a stop, and the
next anchor follows it. What lies between the stops of a stretch without silence is trips.

No window reaches over a silence or over a step longer than the radius, so these cut a log
into islands whose stops don't depend on each other. Within an island, what came before stops
to matter where the windows have been shorter than ``least`` for as long as one of them
reaches (:func:`settled`). So a piece of a cut log is solved from there on by itself, and hands
on its pings up to there and the window that is open at its end. These rims of neighbouring
pieces are solved together. An aircraft that stays in place for whole pieces gives no such
point; its pings pass through one task, in blocks that cost no more than their corners.

Defined results: pings without time or position are unusable; records with the same ``seq``
count once; pings at one instant are taken in order of ``seq``; a log without usable pings
gives no rows; a stretch of a single ping is a trip of no length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.pieces import floats, is_whole, sorted_groups
from plumbline.operators.written import written
from plumbline.operators.spikes import METRES_PER_DEGREE, POSITION, fresh, in_pieces, judge_positions, normals

RADIUS_M, LEAST_S, SILENCE_S = 15.0, 60.0, 180.0
PARTS = (
    "evidence_id string, piece int, kind string, first_seq bigint, last_seq bigint, first_s double, last_s double,"
    " first_lat double, first_lon double, last_lat double, last_lon double, first_m double, last_m double, rim int"
)
#: Kinds of rows that a piece hands on: a stretch (or part of one at a rim), a stop, an open ping.
STRETCH, STOP, OPEN = "stretch", "stop", "open"
#: Of open pings: they start their piece, they end it, or both.
STARTS, ENDS, WHOLE = 1, 2, 3


#: Pings that are compared with a window at once.
BLOCK = 64


class Windows:
    """The anchor window as it grows over pings that arrive in blocks.

    If ping ``j`` is too far from ping ``c`` of the window, no window from an anchor up to
    ``c`` reaches ``j``; all of them end before it and the longest of these is the current
    one. So the anchor moves behind the last such ``c`` and each ping is looked at once.
    A window that lasts ``least`` seconds is a stop, and only its corners matter: the ping of
    a set that is farthest from any other is a corner of its convex hull.

    Places are ``(x, y)``; ``width`` and ``height`` are the metres of their units, the former
    for each ping. With ``least`` infinite the windows are those without stops."""

    def __init__(self, radius: float, least: float, height: float = 1.0) -> None:
        self.r2, self.least, self.height = radius * radius, least, height
        self.clear()

    def clear(self) -> None:
        self.anchor = self.end = 0  # the window are pings anchor .. end - 1 since clear()
        self.t = np.zeros(0)  # times, from number ``base`` on
        self.xy = np.zeros((0, 2))
        self.base = 0
        self.corners: np.ndarray | None = None
        self.outline: np.ndarray | None = None  # corners of a window whose pings are held
        self.first = self.last = 0.0
        self.stopped = False

    def lasts(self) -> bool:
        return self.end > self.anchor and self.last - self.first >= self.least

    def add(self, x: np.ndarray, y: np.ndarray, t: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Takes up to BLOCK pings; gives ``(ping, anchor before, anchor from it on)`` at each
        ping that ends a window; ``stopped`` tells whether that window was a stop."""
        n, start = len(t), self.end
        if start == self.anchor:
            self.first = float(t[0])
        own = self.xy if self.corners is None else self.corners
        new = np.c_[x, y]
        wide = len(own) > 4 * BLOCK
        if wide and self.outline is None:
            self.outline = own[hull(own)]
        far = self._far(new, width, self.outline if wide else own)
        if wide and far.any():  # which of them is the last needs all of the window
            some = np.flatnonzero(far.any(1))
            all_far = np.zeros((n, len(own)), bool)
            all_far[some] = self._far(new[some], width[some], own)
            far = all_far
        inner = self._far(new, width, new) & (np.arange(n)[None, :] < np.arange(n)[:, None])
        # the last ping that each is too far from, by number; -1 for none
        latest = np.full(n, -1)
        hit = far.any(1)
        if hit.any():
            latest[hit] = self.anchor if self.corners is not None else self.base + far.shape[1] - 1 - np.argmax(far[hit][:, ::-1], 1)
        near = inner.any(1)
        if near.any():
            latest[near] = start + n - 1 - np.argmax(inner[near][:, ::-1], 1)
        times = np.r_[self.t, t]
        before, moved = float(self.last), False
        for i in np.flatnonzero(latest >= self.anchor).tolist():
            if latest[i] < self.anchor:
                continue
            j, was = start + i, self.anchor
            before = float(t[i - 1]) if i else float(self.last)
            self.stopped = before - self.first >= self.least
            self.anchor = j if self.stopped else int(latest[i]) + 1
            self.first = float(times[self.anchor - self.base]) if self.anchor >= self.base else self.first
            moved = True
            yield j, was, self.anchor
        self.end, self.last = start + n, float(t[-1])
        if moved:
            self.outline = None
        elif self.outline is not None:
            points = np.r_[self.outline, new]
            self.outline = points[hull(points)]
        if moved or self.corners is None:
            keep = self.anchor - self.base
            self.t, self.xy, self.base, self.corners = times[keep:], np.r_[self.xy, new][keep:], self.anchor, None
        else:
            self.corners = np.r_[self.corners, new]
            self.base, self.t, self.xy = self.end, self.t[:0], self.xy[:0]
        if self.lasts():
            points = self.xy if self.corners is None else self.corners
            self.corners = points[hull(points)]
            self.base, self.t, self.xy = self.end, self.t[:0], self.xy[:0]

    def _far(self, new: np.ndarray, width: np.ndarray, own: np.ndarray) -> np.ndarray:
        dx = (own[None, :, 0] - new[:, None, 0]) * width[:, None]
        dy = (own[None, :, 1] - new[:, None, 1]) * self.height
        return dx * dx + dy * dy > self.r2


def hull(points: np.ndarray) -> np.ndarray:
    """Numbers of the corners of the convex hull, by monotone chains."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(order) < 3:
        return order
    xs, ys = points[:, 0].tolist(), points[:, 1].tolist()

    def chain(numbers: list[int]) -> list[int]:
        out: list[int] = []
        for p in numbers:
            while len(out) > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[p] - ys[out[-2]]) <= (ys[out[-1]] - ys[out[-2]]) * (xs[p] - xs[out[-2]]):
                out.pop()
            out.append(p)
        return out

    numbers = order.tolist()
    return np.array(chain(numbers)[:-1] + chain(numbers[::-1])[:-1])


def stay_points(x: np.ndarray, y: np.ndarray, t: np.ndarray, radius: float, least: float, width: np.ndarray | None = None, height: float = 1.0, close: bool = True) -> tuple[list[tuple[int, int]], int]:
    """First and last index of each stop in one island, and the anchor of the window at its
    end; ``close`` tells that the island ends there, so that this window may be a stop."""
    width = np.ones(len(t)) if width is None else width
    w, stops = Windows(radius, least, height), []
    for k in range(0, len(t), BLOCK):
        part = slice(k, k + BLOCK)
        for j, was, _ in w.add(x[part], y[part], t[part], width[part]):
            if w.stopped:
                stops.append((was, j - 1))
    if close and w.lasts():
        stops.append((w.anchor, w.end - 1))
    return stops, w.anchor


def settled(x: np.ndarray, y: np.ndarray, t: np.ndarray, radius: float, least: float, width: np.ndarray, height: float) -> tuple[int, int] | None:
    """``(ping, anchor)`` of the first ping at which the anchor is known, whatever came before
    the first; None if there is none.

    Windows without stops are the longest that any anchor can have. Once they begin after the
    first ping they are known, and if from some ping on none of them lasts ``least``, no stop
    ends there; when one of them begins there too, it is the window whatever came before."""
    w, since, anchor, done = Windows(radius, float("inf"), height), -1, 0, 0
    for k in range(0, len(t), BLOCK):
        part = slice(k, k + BLOCK)
        for j, _, now in w.add(x[part], y[part], t[part], width[part]):
            if since >= 0:
                # the windows up to here have the anchor before
                lasting = np.flatnonzero(t[done:j] - t[anchor] >= least)
                since = done + int(lasting[-1]) + 1 if len(lasting) else since
            else:
                since = j
            anchor, done = now, j
            if anchor >= since:
                return j, anchor
    return None


def steps_m(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres from each position to the one before; 0 for the first."""
    east = (np.diff(lon) + 180.0) % 360.0 - 180.0
    mid = np.radians((lat[1:] + lat[:-1]) / 2)
    return np.r_[0.0, np.hypot(east * METRES_PER_DEGREE * np.cos(mid), np.diff(lat) * METRES_PER_DEGREE)]


def _degrees(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude without a jump at 180 degrees, latitude, and metres of a degree of longitude."""
    x = lon[0] + (lon - lon[0] + 180.0) % 360.0 - 180.0 if lon.max() - lon.min() > 180.0 else lon
    return x, lat, METRES_PER_DEGREE * np.cos(np.radians(lat))


def _rows(evidence: list, piece: list, kind: list, a: np.ndarray, b: np.ndarray, seq: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, m: np.ndarray, rim: list) -> pa.Table:
    return pa.table({
        "evidence_id": pa.array(evidence, pa.string()), "piece": pa.array(piece, pa.int32()), "kind": pa.array(kind, pa.string()),
        "first_seq": pa.array(seq[a], pa.int64()), "last_seq": pa.array(seq[b], pa.int64()),
        "first_s": t[a], "last_s": t[b], "first_lat": lat[a], "first_lon": lon[a], "last_lat": lat[b], "last_lon": lon[b],
        "first_m": m[a], "last_m": m[b], "rim": pa.array(rim, pa.int32()),
    })


def _piece_parts(radius: float, least: float, silence: float):
    def parts(table: pa.Table, group: np.ndarray) -> pa.Table:
        new = fresh(table, group)
        table, group = table.filter(pa.array(new)), group[new]
        t, lat, lon = (floats(table, c) for c in ("timestamp", "latitude", "longitude"))
        bad = judge_positions(t, lat, lon, floats(table, "speed_m_s"), group, normal=normals(table, "position"))
        use = ~bad & np.isfinite(lat) & np.isfinite(lon) & table.column("core").to_numpy(zero_copy_only=False)
        table, group, t, lat, lon = table.filter(pa.array(use)), group[use], t[use], lat[use], lon[use]
        seq = table.column("seq").to_numpy()
        names, cut, piece = (table.column(c) for c in ("evidence_id", "cut", "piece"))
        cut, piece = cut.to_numpy(zero_copy_only=False), piece.to_numpy()
        n = len(t)
        if not n:
            return _rows([], [], [], *(np.zeros(0, int),) * 2, *(np.zeros(0),) * 5, [])
        step = steps_m(lat, lon)
        start = np.r_[True, group[1:] != group[:-1]]
        step[start] = 0.0
        broken = start | (np.r_[0.0, np.diff(t)] > silence)
        metres = np.cumsum(step)
        hard = broken | (step > radius)
        first = np.flatnonzero(hard)
        last = np.r_[first[1:], n] - 1
        # an island at the rim of a piece may go on in the next piece
        ends = np.r_[start[1:], True]
        rim = cut[first] & (start[first] | ends[last])
        kinds, a, b, rims = [], [], [], []

        def add(kind: str, i: int, j: int, at: int = 0) -> None:
            kinds.append(kind), a.append(i), b.append(j), rims.append(at)

        for i, j, open_ in zip(first.tolist(), last.tolist(), rim.tolist(), strict=True):
            if not open_ and t[j] - t[i] < least:
                continue
            x, y, width = _degrees(lat[i : j + 1], lon[i : j + 1])
            u, known = t[i : j + 1], 0
            if open_ and start[i]:
                at = settled(x, y, u, radius, least, width, METRES_PER_DEGREE)
                for k in range(i, j + 1 if at is None else i + at[0]):
                    add(OPEN, k, k, WHOLE if at is None and ends[j] else STARTS)
                if at is None:
                    continue
                known = at[1]
            goes_on = bool(open_ and ends[j])
            stops, anchor = stay_points(x[known:], y[known:], u[known:], radius, least, width[known:], METRES_PER_DEGREE, not goes_on)
            for p, q in stops:
                add(STOP, i + known + p, i + known + q)
            if goes_on:
                a0 = i + known + anchor
                window = np.arange(a0, j + 1)
                if t[j] - t[a0] >= least and len(window) > 3:
                    # a stop already: its ends and corners are all that matters
                    inside = window[hull(np.c_[x[a0 - i :], y[a0 - i :]])]
                    window = np.unique(np.r_[a0, inside, j])
                for k in window.tolist():
                    add(OPEN, k, k, ENDS)
        s = np.flatnonzero(broken)
        for i, j in zip(s.tolist(), (np.r_[s[1:], n] - 1).tolist(), strict=True):
            add(STRETCH, i, j)
        a, b = np.array(a, int), np.array(b, int)
        return _rows(names.take(pa.array(a)).combine_chunks(), piece[a], kinds, a, b, seq, t, lat, lon, metres, rims)

    return parts


ISLAND_STOPS = "evidence_id string, piece int, last_piece int, first_seq bigint, last_seq bigint, first_s double, last_s double, first_m double, last_m double"


def _solve_open(radius: float, least: float):
    """Stops of the rims of pieces that go together; a partition's pings pass in order, and
    of the open window their numbers' first and last are held, not the pings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, island, lon0 = Windows(radius, least, METRES_PER_DEGREE), None, 0.0
        held: dict[int, tuple] = {}  # pings of the open window that may begin the next one
        found: list[tuple] = []

        def close() -> None:
            if w.lasts():
                found.append((island[0], held[w.anchor], held[w.end - 1]))
            w.clear()
            held.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            names, number = t.column("evidence_id").to_pylist(), t.column("island").to_numpy()
            at, lat, lon, m = (floats(t, c) for c in ("first_s", "first_lat", "first_lon", "first_m"))
            piece, seq = t.column("piece").to_numpy(), t.column("first_seq").to_numpy()
            new = np.r_[True, (number[1:] != number[:-1]) | np.array([a != b for a, b in zip(names[1:], names[:-1], strict=True)], bool)]
            edges = np.r_[np.flatnonzero(new), len(t)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (names[a], int(number[a])) != island:
                    if island is not None:
                        close()
                    island, lon0 = (names[a], int(number[a])), float(lon[a])
                x = lon0 + (lon[a:b] - lon0 + 180.0) % 360.0 - 180.0 if np.abs(lon[a:b] - lon0).max() > 180.0 else lon[a:b]
                width = METRES_PER_DEGREE * np.cos(np.radians(lat[a:b]))
                for k in range(0, b - a, BLOCK):
                    part = slice(k, min(k + BLOCK, b - a))
                    for n in range(part.start, part.stop):
                        held[w.end + n - k] = (float(at[a + n]), int(seq[a + n]), float(m[a + n]), int(piece[a + n]))
                    for j, was, _ in w.add(x[part], lat[a:b][part], at[a:b][part], width[part]):
                        if w.stopped:
                            found.append((island[0], held[was], held[j - 1]))
                    if w.corners is not None:
                        held = {n: held[n] for n in (w.anchor, w.end - 1)}
                    elif len(held) > w.end - w.anchor + 1024:
                        held = {n: v for n, v in held.items() if n >= w.anchor}
                if len(found) > 1000:
                    yield _island_stops(found)
                    found.clear()
        if island is not None:
            close()
        yield _island_stops(found)

    return run


def _island_stops(found: list[tuple]) -> pa.RecordBatch:
    names, f, b = [r[0] for r in found], [r[1] for r in found], [r[2] for r in found]
    kinds = {"s": pa.float64(), "seq": pa.int64(), "m": pa.float64(), "piece": pa.int32()}
    at = {c: (pa.array([r[k] for r in f], kind), pa.array([r[k] for r in b], kind)) for k, (c, kind) in enumerate(kinds.items())}
    return pa.record_batch({
        "evidence_id": pa.array(names, pa.string()), "piece": at["piece"][0], "last_piece": at["piece"][1], "first_seq": at["seq"][0], "last_seq": at["seq"][1],
        "first_s": at["s"][0], "last_s": at["s"][1], "first_m": at["m"][0], "last_m": at["m"][1],
    })


def _open_islands(open_pings: DataFrame, radius: float, silence: float) -> DataFrame:
    """Numbers the rims that go together: the end of a piece with the start of the next, if
    they are close in time and place. That takes one row per rim, not per ping."""
    rims = open_pings.groupBy("evidence_id", "piece", "rim").agg(
        F.min(F.struct("first_s", "first_seq", "first_lat", "first_lon")).alias("a"), F.max(F.struct("first_s", "first_seq", "first_lat", "first_lon")).alias("b")
    )
    along = Window.partitionBy("evidence_id").orderBy("a")
    before = F.lag("b").over(along)
    follows = (F.col("rim") != ENDS) & (F.lag("rim").over(along) != STARTS)
    rims = rims.withColumn("joined", follows & (F.col("a.first_s") - before["first_s"] <= silence) & (metres(before["first_lat"], before["first_lon"], F.col("a.first_lat"), F.col("a.first_lon")) <= radius))
    rims = rims.withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(along).cast("bigint"))
    return open_pings.join(rims.select("evidence_id", "piece", "rim", "island"), ["evidence_id", "piece", "rim"])


def metres(lat1, lon1, lat2, lon2):
    """Distance on the plane through the mean latitude, as a column."""
    east = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.hypot(east * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * METRES_PER_DEGREE)


def stops_and_trips(gps: DataFrame, radius: float = RADIUS_M, least: float = LEAST_S, silence: float = SILENCE_S, **hot: int) -> DataFrame:
    """``(evidence_id, kind, first_seq, last_seq, start_s, end_s, duration_s, distance_m)``,
    kind 'stop' or 'trip'; ``distance_m`` is the length of the path over the usable pings."""
    rows = gps.select("evidence_id", "seq", "timestamp", "latitude", "longitude", "speed_m_s").where("timestamp is not null and seq is not null")
    cut = in_pieces(rows, {"position": POSITION}, **hot)
    parts = sorted_groups(cut, ["evidence_id", "piece"], ["timestamp", "seq"], _piece_parts(radius, least, silence), PARTS)
    whole = is_whole(cut)  # then nothing spans pieces
    if not whole:
        parts = written(parts)
    events = parts.where(F.col("kind") != OPEN).withColumn("last_piece", F.col("piece"))
    if not whole:
        islands = _open_islands(parts.where(F.col("kind") == OPEN), radius, silence)
        solved = islands.repartition("evidence_id", "island").sortWithinPartitions("evidence_id", "island", "first_s", "first_seq").mapInArrow(_solve_open(radius, least), ISLAND_STOPS)
        events = events.unionByName(solved.withColumn("kind", F.lit(STOP)), allowMissingColumns=True)

    # a log has some ten of these rows, a cut one some hundreds for each piece
    log = Window.partitionBy("evidence_id")
    order = log.orderBy("first_s", F.col("kind") == STOP, "first_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.when(F.col("kind") == STRETCH, F.struct("piece", "last_s", "last_m", "last_lat", "last_lon"))
    events = events.withColumn("prev", F.last(stretch, ignorenulls=True).over(before))
    begins = (F.col("kind") == STRETCH) & (F.col("prev").isNull() | (F.col("first_s") - F.col("prev.last_s") > silence))
    link = F.when(
        (F.col("kind") == STRETCH) & F.col("prev").isNotNull() & (F.col("prev.piece") != F.col("piece")),
        F.col("prev.last_m") + metres(F.col("prev.last_lat"), F.col("prev.last_lon"), F.col("first_lat"), F.col("first_lon")) - F.col("first_m"),
    ).otherwise(0.0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("no", F.sum(begins.cast("int")).over(upto)).withColumn("offset", F.sum(link).over(upto))
    if whole:
        events = events.withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0)})
    else:
        # path length from the log's start, over the borders of its pieces: one row per piece
        enters = (F.col("kind") == STRETCH) & (F.col("prev").isNull() | (F.col("prev.piece") != F.col("piece")))
        offsets = events.where(enters).select(F.col("evidence_id").alias("_e"), F.col("piece").alias("_p"), F.col("offset").alias("_o"))
        for name, at in (("_a", "piece"), ("_b", "last_piece")):
            to = offsets.withColumnRenamed("_o", name)
            events = events.join(to, (F.col("evidence_id") == F.col("_e")) & (F.col(at) == F.col("_p")), "left").drop("_e", "_p")
    first = F.struct(F.col("first_s").alias("s"), F.col("first_seq").alias("seq"), (F.col("first_m") + F.col("_a")).alias("m"))
    last = F.struct(F.col("last_s").alias("s"), F.col("last_seq").alias("seq"), (F.col("last_m") + F.col("_b")).alias("m"))
    events = events.select("evidence_id", "no", "kind", "first_s", "first_seq", first.alias("a"), last.alias("b"))

    one = Window.partitionBy("evidence_id", "no")
    line = one.orderBy("first_s", F.col("kind") == STOP, "first_seq")
    stop, start = F.col("kind") == STOP, F.col("kind") == STRETCH
    events = events.select(
        "*",
        F.min(F.when(start, F.col("a"))).over(one).alias("head"), F.max(F.when(start, F.col("b"))).over(one).alias("tail"),
        F.count(F.when(stop, 1)).over(one).alias("stops"), F.row_number().over(line).alias("rank"),
        F.last(F.when(stop, F.col("b")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.count(F.when(stop, 1)).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"),
    )

    def row(kind: str, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    nothing = F.lit(None)
    c = F.col
    out = F.array(
        F.when(stop, row("stop", c("a"), c("b"))).otherwise(nothing),
        F.when(stop & c("left").isNotNull(), row("trip", c("left"), c("a"))).otherwise(nothing),
        F.when(stop & c("left").isNull() & (c("head.seq") != c("a.seq")), row("trip", c("head"), c("a"))).otherwise(nothing),
        F.when(stop & (c("nth") == c("stops")) & (c("tail.seq") != c("b.seq")), row("trip", c("b"), c("tail"))).otherwise(nothing),
        F.when(start & (c("stops") == 0) & (c("rank") == 1), row("trip", c("head"), c("tail"))).otherwise(nothing),
    )
    got = events.select("evidence_id", F.explode(F.array_compact(out)).alias("r"))
    return got.select(
        "evidence_id", "r.kind", c("r.a.seq").alias("first_seq"), c("r.b.seq").alias("last_seq"), c("r.a.s").alias("start_s"), c("r.b.s").alias("end_s"),
        (c("r.b.s") - c("r.a.s")).alias("duration_s"), (c("r.b.m") - c("r.a.m")).alias("distance_m"),
    )
