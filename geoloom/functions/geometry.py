"""The feature frame's geometry column, GeoJSON and (Geo)WKB."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

POINT = "struct<x:double,y:double>"
#: type and polygons of lines of points; simpler geometries fill the inner arrays.
GEOM = f"struct<type:string,coords:array<array<array<{POINT}>>>>"
FEATURES = f"idx bigint, fid string, props map<string,string>, geom {GEOM}"


def corners(geom: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of a geometry."""
    flat = F.flatten(F.flatten(geom["coords"]))
    return [f(F.transform(flat, _side(c))).alias(n) for n, f, c in (("xmin", F.array_min, "x"), ("ymin", F.array_min, "y"), ("xmax", F.array_max, "x"), ("ymax", F.array_max, "y"))]


def _side(c: str):
    return lambda p: p[c]


def from_geojson(document: Column) -> Column:
    """Array of (id, properties, geometry) JSON texts of a FeatureCollection, a Feature or a bare geometry."""
    kind = F.get_json_object(document, "$.type")
    item = "struct<id:string,properties:map<string,string>,geometry:string>"
    raw = F.from_json(document, f"struct<features:array<{item}>,id:string,properties:map<string,string>,geometry:string>")
    one = F.struct(raw["id"].alias("id"), raw["properties"].alias("properties"), raw["geometry"].alias("geometry"))
    none = F.lit(None).cast("map<string,string>")
    bare = F.struct(F.lit(None).cast("string").alias("id"), none.alias("properties"), document.alias("geometry"))
    return F.when(kind == "FeatureCollection", raw["features"]).when(kind == "Feature", F.array(one)).otherwise(F.array(bare))


def geometry_of(text: Column) -> Column:
    """The geometry column of a GeoJSON geometry text."""
    kind = F.get_json_object(text, "$.type")
    level = lambda n: F.from_json(F.get_json_object(text, "$.coordinates"), "array<" * n + "double" + ">" * n)
    pt = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    coords = (
        F.when(kind == "Point", F.array(F.array(F.array(pt(level(1))))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(F.transform(level(2), pt))))
        .when(kind.isin("MultiLineString", "Polygon"), F.array(F.transform(level(3), lambda l: F.transform(l, pt))))
        .when(kind == "MultiPolygon", F.transform(level(4), lambda g: F.transform(g, lambda l: F.transform(l, pt))))
    )
    return F.when(coords.isNotNull(), F.struct(kind.alias("type"), coords.alias("coords")))


def kinds(props: Column) -> Column:
    """Property texts with strings quoted, as ``functions.props`` reads them."""
    return F.transform_values(props, lambda k, v: F.when(v.isNull(), v).when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") | v.isin("true", "false"), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))))


def features(rows: DataFrame) -> DataFrame:
    """A feature frame with corners from rows of (idx, fid, props, geom); features without a geometry are left out and
    those without an id get their place."""
    rows = rows.where("geom is not null")
    return rows.select("idx", F.coalesce("fid", F.col("idx").cast("string")).alias("fid"), "props", "geom", *corners(F.col("geom")))


# --- WKB and the GeoPackage header -------------------------------------------------------------------------------

_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
_CODES = {v: k for k, v in _TYPES.items()}


def read_wkb(data: bytes) -> tuple[str, list]:
    """(type, polygons of lines of (x, y)); ISO and extended codes, heights and measures left out."""

    def read(at: int):
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = _TYPES.get(code % 1000)
        if kind is None:
            raise ValueError(f"unsupported geometry type {code}")

        def count():
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return n

        def points(n: int):
            nonlocal at
            out = []
            for _ in range(n):
                v = struct.unpack_from(order + "d" * dims, data, at)
                out.append((v[0], v[1]))
                at += 8 * dims
            return out

        if kind == "Point":
            return kind, [[points(1)]], at
        if kind == "LineString":
            return kind, [[points(count())]], at
        if kind == "Polygon":
            return kind, [[points(count()) for _ in range(count())]], at
        parts = []
        for _ in range(count()):
            _, coords, at = read(at)
            parts += coords
        if kind == "MultiPoint":
            return kind, [[[p for part in parts for line in part for p in line]]], at
        if kind == "MultiLineString":
            return kind, [[line for part in parts for line in part]], at
        return kind, parts, at

    kind, coords, _ = read(0)
    return kind, coords


def write_wkb(kind: str, coords: list) -> bytes:
    line = lambda points: struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)
    head = lambda k: b"\x01" + struct.pack("<I", _CODES[k])
    polygon = lambda rings: struct.pack("<I", len(rings)) + b"".join(map(line, rings))
    if kind == "Point":
        return head(kind) + struct.pack("<dd", *coords[0][0][0])
    if kind == "LineString":
        return head(kind) + line(coords[0][0])
    if kind == "Polygon":
        return head(kind) + polygon(coords[0])
    if kind == "MultiPoint":
        return head(kind) + struct.pack("<I", len(coords[0][0])) + b"".join(head("Point") + struct.pack("<dd", *p) for p in coords[0][0])
    if kind == "MultiLineString":
        return head(kind) + struct.pack("<I", len(coords[0])) + b"".join(head("LineString") + line(x) for x in coords[0])
    return head(kind) + struct.pack("<I", len(coords)) + b"".join(head("Polygon") + polygon(x) for x in coords)


#: Bytes of the envelope by the code in the header's flags.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def parse_gpb(blob: bytes | None) -> tuple[int, bool, bytes] | None:
    """(srs id, empty, WKB) of a GeoPackage geometry; ValueError if it isn't one."""
    if blob is None:
        return None
    if len(blob) < 8 or blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 0x20:
        raise ValueError("extended GeoPackage geometries aren't supported")
    envelope = ENVELOPES.get(flags >> 1 & 7)
    if envelope is None or len(blob) < 8 + envelope:
        raise ValueError("bad GeoPackage envelope")
    (srs,) = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)
    return srs, bool(flags & 0x10), blob[8 + envelope :]


def as_geom(kind: str, coords: list) -> dict:
    return {"type": kind, "coords": [[[{"x": x, "y": y} for x, y in line] for line in part] for part in coords]}


def _read_blobs(blobs: pd.Series) -> pd.DataFrame:
    out = []
    for b in blobs:
        try:
            got = parse_gpb(bytes(b) if b is not None else None)
            out.append((True, None, None) if got is None else (True, got[0], None if got[1] else as_geom(*read_wkb(got[2]))))
        except (ValueError, struct.error):
            out.append((False, None, None))
    return pd.DataFrame(out, columns=["ok", "srs", "geom"])


def gpb_geometry(blob: Column | str) -> Column:
    """ok, srs, geom of GeoPackage geometries; broken ones are not ok, null and empty ones have no geom."""
    return pandas_udf(_read_blobs, f"struct<ok:boolean,srs:int,geom:{GEOM}>")(blob)
