"""Collections read in pieces give the features of the whole-file reader."""

import json
import random

import pytest

from geoloom.sources import geojson

WORDS = ['plain', 'a "quoted" {brace}', "}{][", "back\\slash\\\\", 'end\\"', "é 日本", "line\nbreak", "", "}" * 30]


def collection(rng, n):
    features = []
    for i in range(n):
        props = {rng.choice("abcd"): rng.choice([rng.choice(WORDS), rng.random(), None, True, {"x": [1, {"y": "}"}]}, [rng.choice(WORDS)]]) for _ in range(rng.randrange(4))}
        kind = rng.choice(["Point", "LineString", "none"])
        at = [[round(rng.random() * 90, 6), round(rng.random() * 60, 6)] for _ in range(rng.choice([2, 5, 40]))]
        geometry = None if kind == "none" else {"type": kind, "coordinates": at[0] if kind == "Point" else at}
        f = {"type": "Feature", "geometry": geometry, "properties": props} | ({"id": i} if rng.random() < 0.5 else {})
        features.append(dict(sorted(f.items(), key=lambda _: rng.random())))
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:}x{"}}, "features": features, "links": [{"href": "a}b"}]}


@pytest.mark.parametrize("indent,size", [(None, 700), (1, 300), (None, 97), (None, 1 << 20)])
def test_pieces(spark, tmp_path, indent, size):
    path = str(tmp_path / "a.geojson")
    doc = collection(random.Random(size), 120)
    with open(path, "w") as f:
        json.dump(doc, f, indent=indent, ensure_ascii=bool(indent))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = sorted(map(str, geojson.read_collection(spark, path).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(map(str, geojson.read(spark, path).collect()))
    assert got == want and len(got) == sum(f["geometry"] is not None for f in doc["features"])


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b.geojson")
    with open(path, "w") as f:
        json.dump(collection(random.Random(1), 30), f)
    want = sorted(map(str, geojson.read(spark, path).collect()))
    monkeypatch.setattr(geojson, "LARGE", 10)
    assert sorted(map(str, geojson.read(spark, path).collect())) == want
