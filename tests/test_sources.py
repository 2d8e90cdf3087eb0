"""Files read and written: features, roads, records, manifests and masks."""

import hashlib
import json

import pytest

from orograph.sources import geojson


def test_features_and_roads(spark, tmp_path):
    line = lambda *c: {"type": "LineString", "coordinates": [list(p) for p in c]}
    docs = {
        "many": {"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"highway": "Primary"}, "geometry": line((0, 0), (1, 1))},
            {"type": "Feature", "properties": {"class": "track", "highway": "primary"}, "geometry": line((0, 0), (2, 1))},
            {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
            {"type": "Feature", "properties": {}, "geometry": None},
        ]},
        "one": {"type": "Feature", "properties": {"road_class": "lane"}, "geometry": line((3, 3), (4, 4))},
        "bare": line((5, 5), (6, 6)),
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))
    found = geojson.features(spark, str(tmp_path))
    assert sorted(r["kind"] for r in found.collect()) == ["LineString"] * 4 + ["Point"]
    roads = geojson.roads(found, {"primary": 1.6, "track": 0.8})
    assert sorted((r["road_class"], r["factor"]) for r in roads.collect()) == [("", 1.2), ("lane", 1.2), ("primary", 1.6), ("track", 0.8)]
    assert {r["factor"] for r in geojson.roads(found, {}).collect()} == {1.2}


def test_broken_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"task_id": "t1", "progress": 3}')
    (tmp_path / "b.json").write_text('{"task_id": ')
    rows = {r["task_id"]: r for r in geojson.records(spark, str(tmp_path), "task_id string, progress int").collect()}
    assert rows["t1"]["progress"] == 3 and rows["t1"]["_corrupt"] is None and rows[None]["_corrupt"].startswith('{"task_id"')


def test_written_features_and_their_manifest(spark, tmp_path):
    points = spark.createDataFrame([(1, 2, "a"), (3, 4, 'quo"te')], "x int, y int, name string")
    path = str(tmp_path / "out")
    geojson.write_features(points.select(geojson.point_feature(points["x"], points["y"], __import__("pyspark").sql.functions.struct("name")).alias("value")).coalesce(1), path)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((f["geometry"]["coordinates"], f["properties"]["name"]) for f in lines) == [([1, 2], "a"), ([3, 4], 'quo"te')]
    with pytest.raises(Exception, match="already exists"):
        geojson.write_features(points.select("name").withColumnRenamed("name", "value"), path)
    listed = {r["filename"]: r for r in geojson.manifest(spark, path).collect()}
    for p in (tmp_path / "out").glob("part-*"):
        assert listed[p.name]["size"] == p.stat().st_size and listed[p.name]["sha256"] == hashlib.sha256(p.read_bytes()).hexdigest()


def test_masks_by_station(spark, tmp_path):
    masks = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, False), (2, 5, 5, True)], "station_id int, r int, c int, visible boolean")
    path = str(tmp_path / "masks")
    geojson.write_masks(masks, path)
    one = geojson.masks_of(spark, path, 1)
    assert sorted((r["r"], r["c"], r["visible"]) for r in one.collect()) == [(0, 0, True), (0, 1, False)]
    assert "PartitionFilters: [isnotnull(station_id" in one._jdf.queryExecution().executedPlan().toString()


def test_quantiles_equal_those_of_all_values(spark):
    import numpy as np

    from orograph.plans.grid import quantiles

    values = [float(v) for v in np.random.default_rng(3).normal(50, 20, 999).round(1)] + [50.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share, got in zip((0.0, 0.02, 0.5, 0.98, 1.0), quantiles(df, (0.0, 0.02, 0.5, 0.98, 1.0))):
        assert got.first()["q"] == pytest.approx(np.quantile(values, share))
