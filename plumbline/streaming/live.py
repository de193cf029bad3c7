"""Structured Streaming forms of the batch operators, for logs that arrive live.

Times in the streams are timestamps (event time). Late records are bounded by a watermark;
what is later is dropped, as the sinks then have their results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each record once; the state of a key is kept for as long as repeats may come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, keys: list[str], time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records per key and tumbling window."""
    return stream.withWatermark(time, late).groupBy(*keys, F.window(time, width)).agg(F.count(F.lit(1)).alias("records"))


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches without a silence longer than the gap: the live form of continuity."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("records"), F.min(time).alias("start"), F.max(time).alias("end"))


def command_acks(commands: DataFrame, acks: DataFrame, tolerance: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Pairs of command and acknowledgement of one log and id within the tolerance, either way.
    Both have ``evidence_id, command_id, seq, at``; the time range lets Spark drop old state."""
    c = commands.select("evidence_id", "command_id", F.col("seq").alias("command_seq"), F.col("at").alias("command_at")).withWatermark("command_at", late)
    a = acks.select(F.col("evidence_id").alias("_e"), F.col("command_id").alias("_i"), F.col("seq").alias("ack_seq"), F.col("at").alias("ack_at")).withWatermark("ack_at", late)
    near = F.expr(f"evidence_id = _e AND command_id = _i AND ack_at >= command_at - INTERVAL {tolerance} AND ack_at <= command_at + INTERVAL {tolerance}")
    return c.join(a, near).select("evidence_id", "command_id", "command_seq", "ack_seq", "command_at", "ack_at")


CHANGE = "evidence_id string, field string, at timestamp, previous_value string, new_value string"


def state_changes(stream: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Changes of each field of each log, with the last value as state. The stream has
    ``evidence_id, field, at, value``; nulls say nothing. Records of a batch are taken in order
    of time; one that is earlier than what the state has seen is late and changes nothing. A
    group without records for ``idle_ms`` is forgotten."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, seen = state.get if state.exists else (None, None)
        parts = []
        for f in frames:
            rows = f.dropna(subset=["value"]).sort_values("at", kind="stable")
            us = rows["at"].astype("datetime64[us]").astype("int64")
            rows = rows if seen is None else rows[us >= seen]
            if not len(rows):
                continue
            before = rows["value"].shift().where(np.arange(len(rows)) > 0, value)
            moved = before.notna() & (rows["value"] != before)
            parts.append(pd.DataFrame({"evidence_id": key[0], "field": key[1], "at": rows["at"][moved], "previous_value": before[moved], "new_value": rows["value"][moved]}))
            value, seen = rows["value"].iloc[-1], int(us.max() if seen is None else max(seen, us.max()))
        if value is not None:
            state.update((value, seen))
            state.setTimeoutDuration(idle_ms)
        yield pd.concat(parts) if parts else pd.DataFrame(columns=["evidence_id", "field", "at", "previous_value", "new_value"])

    rows = stream.select("evidence_id", "field", "at", "value").where("evidence_id is not null and field is not null and at is not null")
    return rows.withWatermark("at", late).groupBy("evidence_id", "field").applyInPandasWithState(step, CHANGE, "value string, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)
