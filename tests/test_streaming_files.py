from __future__ import annotations

import json
import tempfile
from datetime import datetime
from pathlib import Path

import pytest

from plumbline.sources import files, sidecars
from plumbline.streaming import live


def run(stream, mode="append"):
    name = f"t{abs(hash(stream)) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


@pytest.fixture()
def states(spark, tmp_path):
    rows = [("a", "armed", datetime(2026, 1, 1, 0, 0, s), v) for s, v in ((1, "0"), (2, None), (3, "1"), (5, "1"), (6, "0"))] + [("b", "armed", datetime(2026, 1, 1), "0")]
    spark.createDataFrame(rows, "evidence_id string, field string, at timestamp, value string").write.parquet(str(tmp_path / "s"))
    return spark.readStream.schema("evidence_id string, field string, at timestamp, value string").parquet(str(tmp_path / "s"))


def test_changes_with_state(states):
    assert sorted((r["previous_value"], r["new_value"], r["at"].second) for r in run(live.state_changes(states))) == [("0", "1", 3), ("1", "0", 6)]


def test_windows(states):
    assert sum(r["records"] for r in run(live.counts(states, ["evidence_id"], "at"), "complete")) == 6
    assert len(run(live.deduplicated(states, ["evidence_id"], "at"))) == 2


def test_files_and_reports(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.jpg").write_bytes(bytes.fromhex("FFD8FFE0") + b"x" * 90)
    (d / "b.png").write_bytes(b"no picture")
    (d / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nGPS(8.5,47.25,500) BAROMETER:12.5\nISO:100\n\n2\n00:00:02,000 --> 00:00:03,000\nGPS(0,0,1)\n\n3\nno times\n")
    (d / "e.bin").write_bytes(b"")
    got = {Path(r["path"]).name: (r["kind"], r["extension_matches"]) for r in files.evidence_files(spark, str(d)).collect()}
    assert got["a.jpg"] == ("JPEG", True) and got["b.png"] == (None, None) and got["c.srt"] == ("SRT", True) and "e.bin" not in got
    # the pair may be either way round, so it gives no position unless the caller knows the order
    cues = lambda **k: [(r["start_s"], r["latitude"], r["longitude"], r["third"], r["barometric_height_m"], r["iso"], r["axis_order"]) for r in sidecars.frames(files.sidecar_files(spark, str(d)), **k).orderBy("frame").collect()]
    assert cues() == [(1.0, None, None, "500", 12.5, 100.0, "ambiguous"), (2.0, None, None, "1", None, None, "ambiguous"), (None, None, None, None, None, None, "ambiguous")]
    assert cues(order="lon_lat")[0][:3] == (1.0, 47.25, 8.5) and cues(order="lon_lat")[1][1] is None
    manifest = files.write_manifest(spark, str(d))
    assert sum(len(p.read_text().splitlines()) for p in Path(manifest).glob("part-*")) == 3
    files.write_report(spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "k string, v double"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["k"], x.get("v")) for x in lines) == [("a", None), ("b", 1.0)]
    with pytest.raises(ValueError):
        files.write_report(spark.range(1), str(tmp_path / "x"), "xml")


def test_intermediate_tables_are_cleared(spark):
    from plumbline.operators.written import clear_written, written

    clear_written(spark)
    t = written(spark.range(3))
    assert t.count() == 3 and clear_written(spark) == 1 and clear_written(spark) == 0
