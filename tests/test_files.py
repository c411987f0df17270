"""Drawn plans: the two levels of a document, odd documents, and the sink."""

from __future__ import annotations

import json

import pytest

from siteview.sources import files


def test_plans_are_read_and_written_back(spark, tmp_path):
    one = {
        "stage": 3, "building": "b", "osm_id": 7, "home": [43.0, -80.0], "poi_regions": [{"id": "poi_001", "center": [43.001, -80.0], "enu": [0, 111.32], "radius_m": 16, "extra_loops": 2}, {"id": "poi_000", "center": [43.0, -80.001], "enu": [0, 0], "radius_m": 8.5, "extra_loops": 0}],
        "paths": [{"id": "cine_1", "mode": "waypoints", "altitude_m": 14, "duration_s": 8, "control_points": [[43.0, -80.0], [43.001, -80.0]], "smoothed": [[43.0, -80.0], [43.0005, -80.0], [43.001, -80.0]]}],
    }
    bare = {"stage": 3, "building": "c", "osm_id": 8, "home": [0.0, 0.0], "poi_regions": [], "paths": []}
    (tmp_path / "plans.json").write_text("\n".join(map(json.dumps, (one, bare, {"building": "d"}))))
    plans = files.read_plans(spark, str(tmp_path / "plans.json"))
    regions, tracks = files.plan_regions(plans), files.plan_tracks(plans)
    got = {r.region_id: r for r in regions.collect()}
    assert set(got) == {"poi_000", "poi_001"} and got["poi_001"].n == pytest.approx(111.32, abs=1e-6) and got["poi_001"].extra_loops == 2
    assert got["poi_000"].e == pytest.approx(-111.32 * 0.7313537, abs=1e-3) and got["poi_000"].home_lat == 43.0
    assert sorted((r.kind, r.seq, r.lat) for r in tracks.collect()) == [("control", 0, 43.0), ("control", 1, 43.001), ("smoothed", 0, 43.0), ("smoothed", 1, 43.0005), ("smoothed", 2, 43.001)]
    homes = plans.where("home IS NOT NULL").selectExpr("building", "osm_id", "home[0] AS home_lat", "home[1] AS home_lon")
    files.write_plans(files.plans(homes, regions, tracks), str(tmp_path / "out"))
    back = files.read_plans(spark, str(tmp_path / "out"))
    assert {r.building: (r.poi_regions, r.paths) for r in back.collect()}["c"] == ([], [])
    assert sorted(map(tuple, files.plan_tracks(back).collect())) == sorted(map(tuple, tracks.collect()))
    assert sorted(map(tuple, files.plan_regions(back).collect())) == sorted(map(tuple, regions.collect()))
    assert [p["enu"] for p in back.where("osm_id = 7").first().poi_regions] == [[-81.41, 0.0], [0.0, 111.32]]
