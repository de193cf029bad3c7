"""Windows over gridded trajectories, kinematic forecasts and their errors.

A window needs neighbours at most history plus horizon steps away, so grid rows are spread
over bins of log, chunk and step with that margin; no window is gathered per log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.geo import turned
from plumbline.operators.trajectories import AXES, RELIABLE_M_S, VELOCITIES

BIN = 512
#: Mean speeds of a window that is at rest, and from which on it moves.
STILL_M_S, MOVING_M_S = 0.1, 0.5


def forecast_windows(grid: DataFrame, history: int, horizon: int, interval_us: int) -> DataFrame:
    """One row per window within a chunk: where its history ends (``k``, ``at_us``), the state
    there, the acceleration over its last two points, its mean speed and last reliable course
    (0 if there is none), and the targets as an array. ``grid`` comes from ``on_grid``."""
    span, seconds = history + horizon, interval_us / 1e6
    speed = F.sqrt(F.col("vx_m_s") * F.col("vx_m_s") + F.col("vy_m_s") * F.col("vy_m_s") + F.col("vz_m_s") * F.col("vz_m_s"))
    flat = F.sqrt(F.col("vx_m_s") * F.col("vx_m_s") + F.col("vy_m_s") * F.col("vy_m_s"))
    rows = grid.withColumn("_home", F.floor(F.col("k") / F.lit(BIN))).withColumn("_mm", F.floor(speed * 1000.0 + 0.5).cast("bigint"))
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("k") - span) / F.lit(BIN)), F.floor((F.col("k") + span) / F.lit(BIN)))))
    line = Window.partitionBy("evidence_id", "chunk", "_bin").orderBy("k")
    past = line.rangeBetween(-(history - 1), 0)
    rows = rows.select(
        "*", F.count(F.lit(1)).over(past).alias("_before"), F.sum("_mm").over(past).alias("_speeds"),
        F.last(F.when(flat >= RELIABLE_M_S, F.struct("vx_m_s", "vy_m_s")), ignorenulls=True).over(past).alias("_course"),
        F.collect_list(F.struct(*[F.col(f"target_{a}").alias(a) for a in AXES])).over(line.rangeBetween(1, horizon)).alias("targets"),
        *[F.lag(v).over(line).alias(f"_{v}") for v in VELOCITIES],
    )
    rows = rows.where((F.col("_home") == F.col("_bin")) & (F.col("_before") == history) & (F.size("targets") == horizon))
    return rows.select(
        "evidence_id", "chunk", "k", "at_us", *AXES, *VELOCITIES, *[((F.col(v) - F.col(f"_{v}")) / seconds).alias(f"a{v[1:]}") for v in VELOCITIES],
        (F.col("_speeds") / history / 1000.0).alias("mean_speed_m_s"), F.coalesce(F.atan2(F.col("_course.vy_m_s"), F.col("_course.vx_m_s")), F.lit(0.0)).alias("course"), "targets",
    )


def motion(speed: str):
    """How the aircraft moves in a window."""
    return F.when(F.col(speed) < STILL_M_S, "stationary").when(F.col(speed) >= MOVING_M_S, "moving").otherwise("intermediate")


def predicted(windows: DataFrame, interval_us: int) -> DataFrame:
    """One row per window, step and model: the target and the position that constant velocity,
    or constant acceleration, predicts; ``(..., model, step, t, p)``."""
    rows = windows.select("*", F.posexplode("targets").alias("_k", "t")).withColumn("step", F.col("_k") + 1).drop("targets", "_k")
    tau = F.col("step").cast("double") * (interval_us / 1e6)
    models = []
    for model, half in (("constant_velocity", 0.0), ("constant_acceleration", 0.5)):
        at = [(F.col(x) + F.col(v) * tau + F.col(f"a{v[1:]}") * (half * tau * tau)).alias(x) for x, v in zip(AXES, VELOCITIES, strict=True)]
        models.append(F.struct(F.lit(model).alias("model"), F.struct(*at).alias("p")))
    return rows.select("*", F.explode(F.array(*models)).alias("m")).select("*", "m.model", "m.p").drop("m")


def forecast_errors(windows: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """``(evidence_id, chunk, k, at_us, motion, model, step, error_m)`` of both models."""
    rows = predicted(windows, interval_us)
    d = [F.col(f"t.{x}") - F.col(f"p.{x}") for x in AXES]
    return rows.select("evidence_id", "chunk", "k", "at_us", motion("mean_speed_m_s").alias("motion"), "model", "step", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("error_m"))


def transformed(windows: DataFrame, frame: str = "heading", target: str = "residual_velocity", interval_us: int = 1_000_000) -> DataFrame:
    """Targets as a learner sees them: ``(evidence_id, chunk, k, step, angle, dx_m, dy_m,
    dz_m)``. They are positions ('absolute', in the global frame only), or differences from the
    last position ('relative') or from what constant velocity or acceleration predicts
    ('residual_velocity', 'residual_acceleration'), turned so that the last reliable course
    points along x ('heading') or not ('centered', 'global')."""
    if frame not in ("global", "centered", "heading") or target not in ("absolute", "relative", "residual_velocity", "residual_acceleration"):
        raise ValueError("unknown frame or target")
    if target == "absolute" and frame != "global":
        raise ValueError("absolute targets need the global frame")
    model = "constant_acceleration" if target == "residual_acceleration" else "constant_velocity"
    rows = predicted(windows, interval_us).where(F.col("model") == model)
    from_where = {"absolute": lambda a: F.lit(0.0), "relative": lambda a: F.col(a)}.get(target, lambda a: F.col(f"p.{a}"))
    x, y, z = (F.col(f"t.{a}") - from_where(a) for a in AXES)
    angle = F.col("course") if frame == "heading" else F.lit(0.0)
    east, north = turned(x, y, -angle)
    return rows.select("evidence_id", "chunk", "k", "step", angle.alias("angle"), east.alias("dx_m"), north.alias("dy_m"), z.alias("dz_m"))


def restored(rows: DataFrame, windows: DataFrame, target: str = "residual_velocity", interval_us: int = 1_000_000) -> DataFrame:
    """:func:`transformed` targets as positions again: ``(evidence_id, chunk, k, step, axes)``."""
    model = "constant_acceleration" if target == "residual_acceleration" else "constant_velocity"
    base = predicted(windows, interval_us).where(F.col("model") == model).select("evidence_id", "chunk", "k", "step", *[F.col(a).alias(f"_{a}") for a in AXES], "p")
    both = rows.join(base, ["evidence_id", "chunk", "k", "step"])
    x, y = turned(F.col("dx_m"), F.col("dy_m"), F.col("angle"))
    from_where = {"absolute": lambda a: F.lit(0.0), "relative": lambda a: F.col(f"_{a}")}.get(target, lambda a: F.col(f"p.{a}"))
    return both.select("evidence_id", "chunk", "k", "step", *[(d + from_where(a)).alias(a) for a, d in zip(AXES, (x, y, F.col("dz_m")), strict=True)])


def metrics_by(errors: DataFrame, horizon: int, groups: list[str]) -> DataFrame:
    """Mean error over all steps and at the last step, by model and groups, in whole
    millimetres per step."""
    mm = F.floor(F.col("error_m") * 1000.0 + 0.5).cast("bigint")
    last = F.when(F.col("step") == horizon, mm)
    out = errors.groupBy("model", *groups).agg(F.count(F.lit(1)).alias("_n"), F.sum(mm).alias("_s"), F.count(last).alias("windows"), F.sum(last).alias("_l"))
    return out.select("model", *groups, "windows", (F.col("_s") / F.col("_n") / 1000.0).alias("ade_m"), (F.col("_l") / F.col("windows") / 1000.0).alias("fde_m"))


def forecast_metrics(errors: DataFrame, horizon: int) -> DataFrame:
    """Mean error over all steps and at the last step, in whole millimetres per window step,
    by log, by model, and over all (grouping sets)."""
    mm = F.floor(F.col("error_m") * 1000.0 + 0.5).cast("bigint")
    rows = errors.withColumn("mm", mm)
    last = F.when(F.col("step") == horizon, F.col("mm"))
    out = rows.rollup("model", "evidence_id").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("steps"), F.sum("mm").alias("sum_mm"), F.count(last).alias("windows"), F.sum(last).alias("last_mm")
    )
    return out.where("level < 3").select(
        "model", "evidence_id", "windows", (F.col("sum_mm") / F.col("steps") / 1000.0).alias("ade_m"), (F.col("last_mm") / F.col("windows") / 1000.0).alias("fde_m")
    )
