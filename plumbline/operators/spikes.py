"""Implausible readings: impossible values, stuck runs and spikes, judged per source.

Three tests run on each source's own readings in time order:

* bounds: a value no aircraft can report (a sentinel, an angle out of range);
* stuck: a run of zero wavelet details, i.e. one value repeated, in a source whose
  readings normally differ; the first reading of the run is genuine;
* spike: an undecimated second-generation (lifting) wavelet on the irregular time axis
  predicts each reading from its neighbours at dilations 1, 2 and 4. Details above a
  multiple of the source's robust scale (median absolute detail) mark candidates. A
  candidate is confirmed exactly: it must start or end a short burst that leaves the
  course by more than the reported rate of change allows, while the readings around
  the burst agree with each other.

Work is spread by ``(source, piece)``; see :mod:`plumbline.operators.pieces`. One rule holds
for sources of any size. A piece of a cut source gets its surroundings from the pieces next to
it (:func:`with_surroundings`): so many readings that none farther off bears on its own, with
long runs of equal values shortened in the middle, so that these reach over any border. What
is normal in the source (its shares of repeats, its scales, its usual interval) are medians of
numbers kept to ten bits, so they come exactly from counts per number that all pieces add to
(:func:`with_normals`). Distances are taken on the plane at the reading itself.

Defined results: null or NaN values and null times are never flagged and take no part; records
with the same ``seq`` count once; an empty table gives an empty result; a source with
fewer than four readings is only tested against the bounds; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.pieces import BROADCAST_GROUPS, floats, is_whole, sorted_groups, split_hot
from plumbline.operators.written import written

METRES_PER_DEGREE = 111_320.0


@dataclass(frozen=True)
class SpikeRule:
    """What is plausible for one quantity.

    ``low``/``high`` bound the stored value. A step of ``d`` in ``dt`` seconds is
    plausible if ``d <= slack * rate * dt + max(k * noise, floor)``; ``rate`` is the
    reported rate around the step, or ``rate`` where none is reported.
    """

    low: float
    high: float
    rate: float
    floor: float
    k: float = 8.0
    slack: float = 1.25
    noise_floor: float = 0.05
    burst: int = 4
    stuck: int = 6
    repeat_share: float = 0.06
    held_share: float = 0.5
    wavelet_k: float = 4.0


POSITION = SpikeRule(low=-180.0, high=180.0, rate=22.0, floor=9.0)
ALTITUDE = SpikeRule(low=-600.0, high=25_000.0, rate=2.0, floor=4.0, k=7.0, slack=1.0)
HEIGHT = SpikeRule(low=-2_000.0, high=20_000.0, rate=4.0, floor=2.5)
DILATIONS = (1, 2, 4)
#: What is normal in a source: whether its readings differ, the median detail at each
#: dilation, the median interval.
NORMAL = ("differ", *(f"detail_{d}" for d in DILATIONS), "interval")


#: Bits of a double that :func:`short` keeps besides sign and exponent.
KEPT_BITS = 10


def short(values: np.ndarray) -> np.ndarray:
    """Numbers from zero on, kept to ten bits, as whole numbers of the same order."""
    return values.astype(np.float32).view(np.int32) >> (23 - KEPT_BITS)


def long(keys: np.ndarray) -> np.ndarray:
    """The numbers that :func:`short` stands for."""
    return (keys.astype(np.int32) << (23 - KEPT_BITS)).view(np.float32).astype(float)


def group_median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Lower median of the finite values of each group, kept to ten bits; NaN where there is
    none."""
    out = np.full(groups, np.nan)
    ok = np.isfinite(values)
    k, g = short(values[ok]), group[ok]
    order = np.lexsort((k, g))
    n = np.bincount(g, minlength=groups)
    some = np.flatnonzero(n)
    at = (np.cumsum(n) - n + (n - 1) // 2)[some]
    out[some] = long(k[order[at]])
    return out


def between(a: np.ndarray, b: np.ndarray, unit: np.ndarray | None) -> np.ndarray:
    """From ``a`` to ``b``. With ``unit``, both are longitude and latitude, and the result is
    metres east and north; ``unit`` are the metres of a degree of longitude."""
    d = b - a
    if unit is None:
        return d
    return np.c_[((d[:, 0] + 180.0) % 360.0 - 180.0) * unit, d[:, 1] * METRES_PER_DEGREE]


def wavelet_details(v: np.ndarray, t: np.ndarray, group: np.ndarray, dilation: int, unit: np.ndarray | None = None) -> np.ndarray:
    """Lifting-wavelet detail of each reading: its distance from the straight line
    between the readings ``dilation`` places before and after; NaN at the ends.

    ``v`` is ``(n, dims)``; the result is the length of the detail vector."""
    n, s = len(t), dilation
    out = np.full(n, np.nan)
    if n <= 2 * s:
        return out
    span = t[2 * s :] - t[: -2 * s]
    w = np.where(span > 0, (t[s:-s] - t[: -2 * s]) / np.where(span > 0, span, 1), 0.5)[:, None]
    u = None if unit is None else unit[s:-s]
    before = v[: -2 * s]
    d = np.sqrt(((between(before, v[s:-s], u) - between(before, v[2 * s :], u) * w) ** 2).sum(1))
    d[group[2 * s :] != group[: -2 * s]] = np.nan
    out[s:-s] = d
    return out


def haar_details(v: np.ndarray, group: np.ndarray, unit: np.ndarray | None = None) -> np.ndarray:
    """Undecimated Haar detail of each reading: half its distance from the one before; NaN for
    the first of a group."""
    out = np.full(len(v), np.nan)
    if len(v) > 1:
        out[1:] = np.sqrt((between(v[:-1], v[1:], None if unit is None else unit[1:]) ** 2).sum(1)) / 2
        out[1:][group[1:] != group[:-1]] = np.nan
    return out


def zero_runs(v: np.ndarray, group: np.ndarray, rule: SpikeRule, unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Readings with a Haar detail of zero, and readings of long runs of these (with the one
    that such a run repeats)."""
    zero = haar_details(v, group, unit) == 0
    starts = np.flatnonzero(~zero)
    length = np.diff(np.r_[starts, len(v)])
    return zero, np.repeat(length, length) > rule.stuck


def zero_detail_runs(v: np.ndarray, group: np.ndarray, groups: int, rule: SpikeRule, normal: np.ndarray | None = None, unit: np.ndarray | None = None) -> np.ndarray:
    """Readings with a zero detail as part of a long run of these, in groups whose other
    readings normally differ."""
    zero, held = zero_runs(v, group, rule, unit)
    others = np.bincount(group[~held], minlength=groups)
    repeats = np.bincount(group[~held & zero], minlength=groups)
    # a source that spends most of its readings in such runs repeats by nature
    inside = np.bincount(group[held], minlength=groups)
    differ = (repeats <= rule.repeat_share * np.maximum(others, 1)) & (inside <= rule.held_share * np.maximum(inside + others, 1))
    return held & zero & (_known(normal, 0, differ.astype(float)) > 0)[group]


def intervals(t: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Seconds since the reading before; NaN for the first of a group."""
    return np.where(np.r_[False, group[1:] == group[:-1]], np.diff(t, prepend=t[:1]), np.nan)


def _known(normal: np.ndarray | None, column: int, own: np.ndarray) -> np.ndarray:
    """What is normal in the whole source, for groups that are pieces of one; else ``own``."""
    return own if normal is None else np.where(np.isnan(normal[:, 0]), own, normal[:, column])


def off_course(
    v: np.ndarray, t: np.ndarray, rate: np.ndarray, stretch: np.ndarray, noise: np.ndarray,
    candidate: np.ndarray, rule: SpikeRule, unit: np.ndarray | None = None,
) -> np.ndarray:
    """Readings in short bursts that leave the course, by exact test.

    ``stretch`` numbers the stretches without gap or reset. A burst is one or two runs of
    at most ``rule.burst`` readings in all, cut off by implausible steps, whose
    surroundings agree with each other, or which ends its stretch. A burst that opens a
    stretch is never flagged: nothing before it says what the course was."""
    bad = np.zeros(len(t), bool)
    margin = np.maximum(rule.k * noise, rule.floor)

    def agrees(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = np.sqrt((between(v[i], v[j], None if unit is None else unit[j]) ** 2).sum(1))
        return step <= rule.slack * np.fmax(rate[i], rate[j]) * (t[j] - t[i]) + margin[j]

    keep = np.arange(len(t))
    for _ in range(4):
        if len(keep) < 3:
            break
        i, j = keep[:-1], keep[1:]
        together = stretch[i] == stretch[j]
        jump = together & ~agrees(i, j) & (candidate[i] | candidate[j])
        if not jump.any():
            break
        first = np.flatnonzero(np.r_[True, jump | ~together])
        last = np.r_[first[1:], len(keep)] - 1
        size, of = last - first + 1, stretch[keep[first]]
        m = len(first)
        gone = np.zeros(m, bool)
        k = np.arange(m)
        for width in (1, 2):
            a = k[1 : m - width]  # runs a .. a + width - 1 form the burst
            if not len(a):
                continue
            total = sum(size[a + w] for w in range(width))
            inside = (of[a - 1] == of[a]) & (of[a + width] == of[a]) & (total <= rule.burst)
            a = a[inside]
            a = a[agrees(keep[last[a - 1]], keep[first[a + width]])]
            a = a[~gone[a - 1] & ~gone[np.minimum(a + width, m - 1)]]
            for w in range(width):
                gone[a + w] = True
        # two neighbouring bursts can't both be judged against each other: keep the larger
        both = np.flatnonzero(gone[1:] & gone[:-1] & (of[1:] == of[:-1]))
        for b in both:
            if size[b] != size[b + 1] and not (b and gone[b - 1]):
                gone[b if size[b] > size[b + 1] else b + 1] = False
        end = np.r_[of[1:] != of[:-1], True]
        opens = np.r_[True, of[1:] != of[:-1]]
        tail = end & ~opens & (size < rule.burst) & (size < np.r_[0, size[:-1]])
        gone |= tail & ~np.r_[False, gone[:-1]]
        if not gone.any():
            break
        hit = np.repeat(gone, size)
        bad[keep[hit]] = True
        keep = keep[~hit]
    return bad


def judge(
    v: np.ndarray, t: np.ndarray, group: np.ndarray, rule: SpikeRule,
    rate: np.ndarray | None = None, reset: np.ndarray | None = None, normal: np.ndarray | None = None, unit: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stuck, spike and noise of readings already inside the bounds, sorted by
    ``(group, t)``; ``group`` is 0, 1, 2, ... without holes, ``v`` is ``(n, dims)``, ``unit`` as
    in :func:`between`. ``normal`` has the columns of NORMAL for each reading, NaN in groups that are whole."""
    n, groups = len(t), int(group[-1]) + 1 if len(group) else 0
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0)
    if normal is not None:
        normal = normal[np.r_[True, group[1:] != group[:-1]]]
    stuck = zero_detail_runs(v, group, groups, rule, normal, unit)
    keep = np.flatnonzero(~stuck)
    kv, kt, kg, ku = v[keep], t[keep], group[keep], None if unit is None else unit[keep]
    candidate = np.zeros(len(keep), bool)
    noise = None
    for k, dilation in enumerate(DILATIONS, 1):
        detail = wavelet_details(kv, kt, kg, dilation, ku)
        scale = _known(normal, k, group_median(detail, kg, groups))
        if noise is None:
            # a detail of white noise has 1.22 times its spread; its median length is
            # 0.82 (one dimension) or 1.44 (two) times the noise of one coordinate
            noise = np.nan_to_num(scale / (0.82 if v.shape[1] == 1 else 1.44), nan=0.0)
            noise = np.maximum(noise, rule.noise_floor)
        limit = rule.wavelet_k * np.maximum(np.nan_to_num(scale, nan=0.0), rule.noise_floor)[kg]
        candidate |= detail > limit
        if dilation == 1:
            # the first and last reading have a neighbour on one side only
            one = 2 * haar_details(kv, kg, ku)
            candidate |= np.isnan(detail) & (np.fmax(one, np.r_[one[1:], np.nan]) > limit)
    dt = np.diff(kt, prepend=kt[:1])
    usual = _known(normal, 4, group_median(intervals(kt, kg), kg, groups))
    limit = np.maximum(4.5 * np.nan_to_num(usual, nan=1.0), 0.5)
    # a silence counts as a gap unless stuck readings fill it
    before = np.r_[keep[:1], keep[:-1]]
    filled = keep - before > 1
    broken = (np.r_[False, kg[1:] != kg[:-1]]) | ((dt > limit[kg]) & ~filled)
    if reset is not None:
        r = reset[keep]
        broken |= np.r_[False, r[1:] != r[:-1]]
    stretch = np.cumsum(broken)
    kr = np.full(len(keep), rule.rate) if rate is None else rate[keep]
    spike = np.zeros(n, bool)
    spike[keep] = off_course(kv, kt, kr, stretch, noise[kg], candidate, rule, ku)
    return stuck, spike, noise


def nearby_rate(rate: np.ndarray, group: np.ndarray, default: float) -> np.ndarray:
    """The reported rate; where it is missing, the larger one of the readings next to it."""
    out = np.abs(rate)
    missing = np.isnan(out)
    if missing.any():
        prev = np.r_[np.nan, np.where(group[1:] == group[:-1], out[:-1], np.nan)]
        nxt = np.r_[np.where(group[1:] == group[:-1], out[1:], np.nan), np.nan]
        out = np.where(missing, np.fmax(prev, nxt) + 1.0, out)
        out = np.where(np.isnan(out), default, out)
    return out


def dense(group: np.ndarray) -> np.ndarray:
    """Group numbers without holes, for a subset of rows in order."""
    return np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(group) else group


def usable_positions(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions out of bounds; which of the others are whole; their groups, longitude and
    latitude, and metres of a degree of longitude."""
    bad = (np.abs(lat) > 90.0) | (np.abs(lon) > 180.0) | ((lat == 0.0) & (lon == 0.0))
    use = np.flatnonzero(~bad & np.isfinite(lat) & np.isfinite(lon) & np.isfinite(t))
    return bad, use, dense(group[use]), np.c_[lon[use], lat[use]], METRES_PER_DEGREE * np.cos(np.radians(lat[use]))


def usable_values(t: np.ndarray, value: np.ndarray, group: np.ndarray, rule: SpikeRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, None]:
    """Values out of bounds; which of the others are given; their groups and values."""
    bad = (value < rule.low) | (value > rule.high)
    use = np.flatnonzero(~bad & np.isfinite(value) & np.isfinite(t))
    return bad, use, dense(group[use]), value[use][:, None], None


def judge_positions(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, group: np.ndarray, rule: SpikeRule = POSITION, normal: np.ndarray | None = None) -> np.ndarray:
    """True for each wrong position. A reading with one component missing is judged by the
    bounds of the other one only."""
    bad, use, g, v, unit = usable_positions(t, lat, lon, group)
    if len(use):
        stuck, spike, _ = judge(v, t[use], g, rule, nearby_rate(speed[use], g, rule.rate), None, None if normal is None else normal[use], unit)
        bad[use] |= stuck | spike
    return bad


def judge_values(t: np.ndarray, value: np.ndarray, group: np.ndarray, rule: SpikeRule, rate: np.ndarray | None = None, reset: np.ndarray | None = None, normal: np.ndarray | None = None) -> np.ndarray:
    """True for each wrong value of one quantity."""
    bad, use, g, v, _ = usable_values(t, value, group, rule)
    if len(use):
        r = None if rate is None else nearby_rate(rate[use], g, rule.rate)
        stuck, spike, _ = judge(v, t[use], g, rule, r, None if reset is None else reset[use], None if normal is None else normal[use])
        bad[use] |= stuck | spike
    return bad


#: Columns that a field needs besides log, time and seq.
COLUMNS = {"position": ("latitude", "longitude", "speed_m_s"), "altitude_m": ("altitude_m",), "z_m": ("z_m", "vz_m_s", "vertical_reset_counter")}


def usable(t: pa.Table, field: str, rule: SpikeRule, at: np.ndarray, group: np.ndarray) -> tuple:
    if field == "position":
        return usable_positions(at, floats(t, "latitude"), floats(t, "longitude"), group)
    return usable_values(at, floats(t, field), group, rule)


#: Readings that a piece sees on either side, and readings that are kept at either end of a
#: longer run of equal values among them: such a run stays long, and what lies next to it keeps
#: its neighbours at the widest dilation. Four rounds over bursts of at most four readings
#: reach no farther than some fifty readings that are no repeats of a long run.
SURROUNDINGS, RUN_ENDS = 2_048, 8


def shortened(v: np.ndarray, group: np.ndarray, rule: SpikeRule, unit: np.ndarray | None) -> np.ndarray:
    """Which readings stay if long runs of equal values lose their middle."""
    zero, _ = zero_runs(v, group, rule, unit)
    starts = np.flatnonzero(~zero)
    length = np.diff(np.r_[starts, len(v)])
    k = np.arange(len(v)) - np.repeat(starts, length)
    return (k < RUN_ENDS) | (k >= np.repeat(length, length) - RUN_ENDS)


def with_surroundings(cut: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """Adds ``core``, true for all rows of the table, and to the pieces of cut sources the
    readings around them, with ``core`` false and the columns of one field each. Every piece
    gives its first and last readings; where a piece has few (it holds one value, or none), its
    neighbour's neighbours reach over it. One row per piece and field says how far."""
    if is_whole(cut):
        return cut.withColumn("core", F.lit(True))
    cut = cut.withColumn("core", F.lit(True))
    names = list(dict.fromkeys(c for f in rules for c in COLUMNS[f]))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    rim = ["field string", "side int", "place int", "evidence_id string", "piece int", "timestamp double", "seq bigint", *[f"{c} {kinds[c]}" for c in names]]

    def rims(t: pa.Table, group: np.ndarray) -> pa.Table:
        new = fresh(t, group)
        t, group = t.filter(pa.array(new)), group[new]
        at = floats(t, "timestamp")
        parts = []
        for field, rule in rules.items():
            _, use, g, v, unit = usable(t, field, rule, at, group)
            keep = use[shortened(v, g, rule, unit)] if len(use) else use
            number = dense(group[keep])
            size = np.bincount(number) if len(keep) else np.zeros(0, int)
            place = np.arange(len(keep)) - np.repeat(np.cumsum(size) - size, size)
            for side, from_rim in ((0, place), (1, np.repeat(size, size) - 1 - place)):
                near = from_rim < SURROUNDINGS
                rows = t.take(pa.array(keep[near]))
                n = len(rows)
                own = {c: rows.column(c) if c in COLUMNS[field] else pa.nulls(n, rows.schema.field(c).type) for c in names}
                parts.append(pa.table({
                    "field": pa.array([field] * n, pa.string()), "side": pa.array(np.full(n, side, np.int32)), "place": pa.array(from_rim[near].astype(np.int32)),
                    **{c: rows.column(c) for c in ("evidence_id", "piece", "timestamp", "seq")}, **own,
                }))
        return pa.concat_tables(parts)

    # some thousand rows a piece, used twice
    rows = written(sorted_groups(cut.where("cut").select("evidence_id", "piece", "timestamp", "seq", *names), ["evidence_id", "piece"], ["timestamp", "seq"], rims, ", ".join(rim)))
    # up to this piece (or from it on) there are so many readings; the piece farthest off that
    # still sees some of it is the first with fewer than SURROUNDINGS in between
    sizes = rows.groupBy("evidence_id", "field", "side", "piece").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("evidence_id", "field", "side").orderBy(F.when(F.col("side") == 0, F.col("piece")).otherwise(-F.col("piece")))
    sizes = sizes.withColumn("upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    seen = Window.partitionBy("evidence_id", "field", "side").orderBy("upto").rangeBetween(-(SURROUNDINGS - 1), 0)
    far = F.when(F.col("side") == 0, F.min("piece").over(seen)).otherwise(F.max("piece").over(seen))
    sizes = sizes.withColumn("far", far).select("evidence_id", "field", "side", "piece", F.lag("far").over(line).alias("far")).where("far is not null")
    around = rows.join(sizes, ["evidence_id", "field", "side", "piece"])
    step = F.when(F.col("side") == 0, -1).otherwise(1)
    around = around.withColumn("piece", F.explode(F.sequence(F.col("piece") + step, F.col("far"), step)))
    around = around.select("evidence_id", "piece", "timestamp", "seq", *names, F.lit(True).alias("cut"), F.lit(False).alias("core"))
    return cut.unionByName(around, allowMissingColumns=True).withMetadata("piece", cut.schema["piece"].metadata)


MEASURES = "evidence_id string, field string, measure string, key int, n bigint"


def measures(v: np.ndarray, t: np.ndarray, group: np.ndarray, core: np.ndarray, rule: SpikeRule, unit: np.ndarray | None) -> list[tuple[str, np.ndarray]]:
    """Numbers of usable readings that are the piece's own: the shares of repeats, details and
    intervals without the repeats of long runs and with them."""
    zero, held = zero_runs(v, group, rule, unit)
    out = [("n", np.zeros(int(core.sum()), int)), ("held", np.zeros(int((held & core).sum()), int)), ("repeats", np.zeros(int((zero & ~held & core).sum()), int))]
    for name, keep in (("without", ~(held & zero)), ("with", np.ones(len(t), bool))):
        k = np.flatnonzero(keep)
        u = None if unit is None else unit[k]
        for c, values in [*((f"detail_{d}", wavelet_details(v[k], t[k], group[k], d, u)) for d in DILATIONS), ("interval", intervals(t[k], group[k]))]:
            out.append((f"{name}_{c}", short(values[core[k] & np.isfinite(values)])))
    return out


def with_normals(cut: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """Adds what is normal in each source that is cut, as ``<field>_<column of NORMAL>``, null
    in sources that are whole. Pieces count their numbers, kept to ten bits; of the counts of a
    source, some ten thousand rows whatever its size, the medians are exact."""
    if is_whole(cut):
        return cut
    about = cut.schema["piece"].metadata

    def counted(t: pa.Table, group: np.ndarray) -> pa.Table:
        new = fresh(t, group)
        t, group = t.filter(pa.array(new)), group[new]
        at, core, names = floats(t, "timestamp"), t.column("core").to_numpy(zero_copy_only=False), t.column("evidence_id")
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out: list[tuple] = []
        for field, rule in rules.items():
            _, use, g, v, unit = usable(t, field, rule, at, group)
            own = group[use]
            for k in np.unique(own).tolist():
                m = np.flatnonzero(own == k)
                name = names[int(first[k])].as_py()
                for measure, numbers in measures(v[m], at[use[m]], np.zeros(len(m), int), core[use[m]], rule, None if unit is None else unit[m]):
                    keys, n = np.unique(numbers, return_counts=True)
                    out += [(name, field, measure, *x) for x in zip(keys.tolist(), n.tolist(), strict=True)]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(("evidence_id", "field", "measure", "key", "n"), kinds, strict=True))})

    names = list(dict.fromkeys(c for f in rules for c in COLUMNS[f]))
    rows = sorted_groups(cut.where("cut").select("evidence_id", "piece", "timestamp", "seq", "core", *names), ["evidence_id", "piece"], ["timestamp", "seq"], counted, MEASURES)
    counts = rows.groupBy("evidence_id", "field", "measure", "key").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("evidence_id", "field", "measure")
    counts = counts.withColumns({"upto": F.sum("n").over(of.orderBy("key")), "all": F.sum("n").over(of)})
    found = counts.groupBy("evidence_id", "field", "measure").agg(F.first("all").alias("all"), F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("key"))).alias("median"))
    columns = []
    for field, rule in rules.items():

        def of_measure(name: str, column: str, field: str = field):
            return F.max(F.when((F.col("field") == field) & (F.col("measure") == name), F.col(column)))

        n, held, repeats = (F.coalesce(of_measure(m, "all"), F.lit(0)) for m in ("n", "held", "repeats"))
        differ = (repeats <= rule.repeat_share * F.greatest(n - held, F.lit(1))) & (held <= rule.held_share * F.greatest(n, F.lit(1)))
        columns.append(differ.cast("double").alias(f"{field}_differ"))
        columns += [F.when(differ, of_measure(f"without_{c}", "median")).otherwise(of_measure(f"with_{c}", "median")).alias(f"{field}_{c}") for c in NORMAL[1:]]
    normals = found.groupBy("evidence_id").agg(*columns)
    return cut.join(F.broadcast(normals) if about["hot"] <= BROADCAST_GROUPS else normals, "evidence_id", "left").withMetadata("piece", about)


def normals(t: pa.Table, field: str) -> np.ndarray | None:
    """What :func:`with_normals` added for a field; None if no source is cut."""
    names = [f"{field}_{c}" for c in NORMAL]
    if names[0] not in t.column_names:
        return None
    out = np.stack([floats(t, c) for c in names], 1)
    some = np.isfinite(out[:, 1:])
    out[:, 1:][some] = long(out[:, 1:][some])
    return out


FOUND = "table_name string, seq bigint, field string"


def fresh(t: pa.Table, group: np.ndarray) -> np.ndarray:
    """Rows that are no stored repeat of the row before; surroundings have none."""
    seq = t.column("seq").to_numpy()
    out = np.r_[True, (seq[1:] != seq[:-1]) | (group[1:] != group[:-1])]
    if "core" in t.column_names:
        out |= ~t.column("core").to_numpy(zero_copy_only=False)
    return out


def _found(name: str, marks: dict[str, np.ndarray], seq: np.ndarray, core: np.ndarray) -> pa.Table:
    hits = {f: seq[m & core] for f, m in marks.items()}
    return pa.table({
        "table_name": pa.array([name] * sum(map(len, hits.values())), pa.string()),
        "seq": pa.array(np.concatenate([*hits.values()]), pa.int64()),
        "field": pa.array([f for f, s in hits.items() for _ in range(len(s))], pa.string()),
    })


def in_pieces(rows: DataFrame, rules: dict[str, SpikeRule], **hot: int) -> DataFrame:
    """Rows of sources cut into pieces, with their surroundings and what is normal."""
    return with_normals(with_surroundings(split_hot(rows, ["evidence_id"], "timestamp", **hot), rules), rules)


def gps_outliers(gps: DataFrame, position: SpikeRule = POSITION, altitude: SpikeRule = ALTITUDE, **hot: int) -> DataFrame:
    """``(table_name, seq, field)`` of the wrong positions and altitudes of ``gps``."""

    def wrong(t: pa.Table, group: np.ndarray) -> pa.Table:
        new = fresh(t, group)
        t, group = t.filter(pa.array(new)), group[new]
        at = floats(t, "timestamp")
        marks = {
            "position": judge_positions(at, floats(t, "latitude"), floats(t, "longitude"), floats(t, "speed_m_s"), group, position, normals(t, "position")),
            "altitude_m": judge_values(at, floats(t, "altitude_m"), group, altitude, normal=normals(t, "altitude_m")),
        }
        return _found("gps", marks, t.column("seq").to_numpy(), t.column("core").to_numpy(zero_copy_only=False))

    rows = gps.select("evidence_id", "seq", "timestamp", "latitude", "longitude", "altitude_m", "speed_m_s").where("timestamp is not null and seq is not null")
    cut = in_pieces(rows, {"position": position, "altitude_m": altitude}, **hot)
    return sorted_groups(cut, ["evidence_id", "piece"], ["timestamp", "seq"], wrong, FOUND)


def trajectory_outliers(trajectory: DataFrame, height: SpikeRule = HEIGHT, **hot: int) -> DataFrame:
    """``(table_name, seq, field)`` of the wrong heights of ``trajectory``. A change of
    the vertical reset counter starts a new reference, so no step across it is judged."""

    def wrong(t: pa.Table, group: np.ndarray) -> pa.Table:
        new = fresh(t, group)
        t, group = t.filter(pa.array(new)), group[new]
        marks = {"z_m": judge_values(
            floats(t, "timestamp"), floats(t, "z_m"), group, height, floats(t, "vz_m_s"),
            np.nan_to_num(floats(t, "vertical_reset_counter"), nan=-1.0), normals(t, "z_m"),
        )}
        return _found("trajectory", marks, t.column("seq").to_numpy(), t.column("core").to_numpy(zero_copy_only=False))

    rows = trajectory.select("evidence_id", "seq", "timestamp", "z_m", "vz_m_s", "vertical_reset_counter").where("timestamp is not null and seq is not null")
    cut = in_pieces(rows, {"z_m": height}, **hot)
    return sorted_groups(cut, ["evidence_id", "piece"], ["timestamp", "seq"], wrong, FOUND)


def implausible_readings(gps: DataFrame, trajectory: DataFrame) -> DataFrame:
    """All wrong readings of both tables, one row each."""
    return gps_outliers(gps).unionByName(trajectory_outliers(trajectory))
