"""Feature collections read by many tasks against a JSON parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cityportrait.sources import features, scans

SCHEMA = "type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>"
ODD = ['a{b', 'a}b}', 'quote " and }', 'back\\slash\\', '\\"', '{"type":"Feature"}', "é😀}", "[{]}", "", "line\nbreak", '"}', '\\}"{']


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def collection(n, seed, indent=None, ring=3):
    rng = random.Random(seed)
    fs = []
    for i in range(n):
        p = {"parcel_id": f"p{i}", "assessed_value": i * 10, rng.choice(ODD) or "k": rng.choice(ODD)}
        if rng.random() < 0.1:
            p["nested"] = {"type": "Feature", "a": {"b": [{}, {"c": "}"}]}}
        f = {"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": [[[rng.random(), rng.random()] for _ in range(ring)]]}}
        if rng.random() < 0.3:
            f = dict(reversed(f.items()))
        if rng.random() < 0.1:
            f["geometry"], f["id"] = None, i
        fs.append(f)
    whole = {"type": "FeatureCollection", "name": 'odd "{" name', "crs": {"type": "name", "properties": {"name": "x}"}}, "features": fs, "bbox": [1, 2], "end": {"x": {}}}
    return whole, json.dumps(whole, indent=indent, ensure_ascii=seed % 2 == 0)


@pytest.mark.parametrize(("seed", "indent", "split"), [(1, None, 601), (2, 2, 1500)])
def test_features_cut_anywhere_equal_a_parser(spark, tmp_path, small_splits, seed, indent, split):
    whole, text = collection(40, seed, indent)
    (tmp_path / "a.geojson").write_text(text, encoding="utf-8")
    other, text = collection(7, seed + 10, indent)
    (tmp_path / "b.geojson").write_text(text, encoding="utf-8")
    small_splits(split)
    got = features.feature_texts(spark, str(tmp_path))
    found = sorted(json.dumps(json.loads(r.text), sort_keys=True) for r in got.collect() if json.loads(r.text).get("type") == "Feature")
    assert found == sorted(json.dumps(f, sort_keys=True) for f in whole["features"] + other["features"])


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    n = 200_000
    with (tmp_path / "parcels_offset0.geojson").open("w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i in range(n):
            odd = json.dumps(ODD[i % len(ODD)])
            f.write(("," if i else "") + f'{{"type":"Feature","properties":{{"PIN":"{i}","sev":{i % 900},"note":{odd}}},"geometry":{{"type":"Polygon","coordinates":[[[0,0],[{i % 90},1],[1,1]]]}}}}')
        f.write("]}")
    (tmp_path / "parcels_offset1.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    small = scans.parcels(spark, str(tmp_path))
    small_splits(2 << 20)
    large = scans.parcels(spark, str(tmp_path), one_task_bytes=1 << 20)
    raw = spark.read.option("lineSep", "}").text(str(tmp_path / "parcels_offset0.geojson"))
    assert raw.rdd.getNumPartitions() >= 8
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("parcel_id", "assessed_value", "part", "ring").cast("decimal(38,0)"))).first()
    assert digest(small) == digest(large) and small.count() == n


def test_files_are_read_once(spark, tmp_path):
    """A file's bytes are read about once (and its length asked for), however many features it has."""
    n = 3000
    one = '{"type":"Feature","properties":{"PIN":"%d","SEV":"7"},"geometry":{"type":"Polygon","coordinates":[[[0.5,1],[2,1],[2,3]]]}}'
    for i in range(3):
        text = '{"type":"FeatureCollection","features":[' + ",".join(one % (i * n + j) for j in range(n)) + "]}"
        (tmp_path / f"parcels_offset{i}.geojson").write_text(("\ufeff" if i == 2 else "") + text, encoding="utf-8")
    whole = sum(f.stat().st_size for f in tmp_path.glob("*.geojson"))
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    rows = scans.parcels(spark, str(tmp_path)).collect()
    assert read() - before < 3 * whole
    assert sorted(int(r.parcel_id) for r in rows) == list(range(3 * n)) and {r.ring[0].x for r in rows} == {0.5}
