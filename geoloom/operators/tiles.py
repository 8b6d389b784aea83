"""Vector tiles: features to tile keys relationally, tile bytes by a grouped kernel (Mapbox Vector Tile 2.1)."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import mercator

from . import components as cc
from .raster import simplify

EXTENT = 4096
#: Tile units that geometry is clipped to on both axes.
CLIP_LOW, CLIP_HIGH = -4096, 8191
#: Degrees that no position reaches.
BEYOND = 1e9


def tile_features(features: DataFrame, minzoom: int, maxzoom: int, margin: float = mercator.TILE_MARGIN) -> DataFrame:
    """features with z, x, y of each tile whose bounds, grown by the margin, their corners' box meets."""
    zoomed = features.withColumn("z", F.explode(F.sequence(F.lit(minzoom), F.lit(maxzoom))))
    x0, y1 = mercator.tile_fraction(F.col("xmin"), F.col("ymin"), F.col("z"))
    x1, y0 = mercator.tile_fraction(F.col("xmax"), F.col("ymax"), F.col("z"))
    # a tile t covers t - margin to t + 1 + margin
    span = lambda low, high: F.sequence(mercator.clamp_tile(F.ceil(low - (1 + margin)), F.col("z")), mercator.clamp_tile(high + margin, F.col("z")))
    return zoomed.withColumn("x", F.explode(span(x0, x1))).withColumn("y", F.explode(span(y0, y1)))


def margin_box(z: int, x: int, y: int, margin: float = mercator.TILE_MARGIN) -> tuple[float, float, float, float]:
    """Degrees west, south, east, north of a tile grown by the margin, a little more for rounding; the edge of the world
    takes all that lies beyond it."""
    n = 1 << z
    grown = margin + 1e-6

    def lat(row: float) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))

    west = -BEYOND if x - grown <= 0 else (x - grown) / n * 360 - 180
    east = BEYOND if x + 1 + grown >= n else (x + 1 + grown) / n * 360 - 180
    north = BEYOND if y - grown <= 0 else lat(y - grown)
    south = -BEYOND if y + 1 + grown >= n else lat(y + 1 + grown)
    return west, south, east, north


def tile_counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


def flip_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Stored tiles (zoom_level, tile_column, tile_row from the south, tile_data) of requests (z, x, y from the north)."""
    asked = requests.withColumn("tile_row", mercator.flip_y(F.col("z"), F.col("y")))
    return asked.join(store.select(F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"), "tile_row", "tile_data"), ["z", "x", "tile_row"])


# --- geometry in tile units -------------------------------------------------------------------------------------


def project(points, z: int, x: int, y: int):
    n = 1 << z
    out = []
    for lon, lat in points:
        lat = max(-mercator.MAX_LAT, min(mercator.MAX_LAT, lat))
        fx = (lon + 180.0) / 360.0 * n
        fy = (1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n
        out.append((math.floor((fx - x) * EXTENT), math.floor((fy - y) * EXTENT)))
    return out


def clip_line(points, low=CLIP_LOW, high=CLIP_HIGH):
    """Parts of a line inside the square, by Liang-Barsky."""
    parts, now = [], []
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        t0, t1, dx, dy = 0.0, 1.0, x2 - x1, y2 - y1
        out = False
        for p, q in ((-dx, x1 - low), (dx, high - x1), (-dy, y1 - low), (dy, high - y1)):
            if p == 0:
                out |= q < 0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if out or t0 > t1:
            if len(now) > 1:
                parts.append(now)
            now = []
            continue
        a, b = (x1 + t0 * dx, y1 + t0 * dy), (x1 + t1 * dx, y1 + t1 * dy)
        if not now or now[-1] != a:
            if len(now) > 1:
                parts.append(now)
            now = [a]
        now.append(b)
        if t1 < 1.0:
            parts.append(now)
            now = []
    if len(now) > 1:
        parts.append(now)
    return parts


def clip_ring(ring, low=CLIP_LOW, high=CLIP_HIGH):
    """A closed ring inside the square, by Sutherland-Hodgman."""
    points = list(ring[:-1]) if ring and ring[0] == ring[-1] else list(ring)
    for axis, bound, keep_below in ((0, low, False), (0, high, True), (1, low, False), (1, high, True)):
        if not points:
            return []
        inside = (lambda p: p[axis] <= bound) if keep_below else (lambda p: p[axis] >= bound)
        out = []
        for a, b in zip([points[-1], *points[:-1]], points):
            if inside(a) != inside(b):
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if inside(b):
                out.append(b)
        points = out
    return [*points, points[0]] if len(points) > 2 else []


def _length(points) -> float:
    return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(points, points[1:]))


def _area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def cut(kind: str, coords, z: int, x: int, y: int, tolerance: float | None = 1.0):
    """(MVT geometry type, parts in tile units) of a geometry in a tile, or None if nothing is left. coords: polygons of
    lines of points, as in the feature frame."""
    if kind in ("Point", "MultiPoint"):
        points = [p for part in coords for line in part for p in project(line, z, x, y)]
        points = [p for p in points if CLIP_LOW <= p[0] <= CLIP_HIGH and CLIP_LOW <= p[1] <= CLIP_HIGH]
        return (1, [points]) if points else None
    if kind in ("LineString", "MultiLineString"):
        lines = [c for part in coords for line in part for c in clip_line(project(line, z, x, y))]
        lines = [simplify(line, tolerance) if tolerance else line for line in lines]
        lines = [line for line in lines if _length(line) >= 1.0]
        return (2, lines) if lines else None
    rings = []
    for polygon in coords:
        own = [clip_ring(project(ring, z, x, y)) for ring in polygon]
        own = [simplify(r, tolerance) if tolerance and len(r) > 4 else r for r in own]
        own = [r for r in own if len(r) >= 4]
        if own and abs(_area(own[0])) >= 2.0:
            # outer rings turn clockwise on the screen (positive area with y down), holes the other way
            rings += [r if (_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(own) if abs(_area(r)) >= 2.0]
    return (3, rings) if rings else None


# --- encoding ----------------------------------------------------------------------------------------------------


#: Places in the input whose features make a part of a tile.
PART_FEATURES = 1 << 14
#: Bytes of a tile that are zipped or unzipped at once.
ZIP_BYTES = 1 << 16


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _commands(kind: int, parts) -> bytes:
    at, out = (0, 0), []

    def move(p):
        nonlocal at
        p = (round(p[0]), round(p[1]))
        out.extend((_zigzag(p[0] - at[0]), _zigzag(p[1] - at[1])))
        at = p

    if kind == 1:
        out.append(1 | len(parts[0]) << 3)
        for p in parts[0]:
            move(p)
    else:
        for part in parts:
            body = part[:-1] if kind == 3 else part
            out.append(1 | 1 << 3)
            move(body[0])
            out.append(2 | (len(body) - 1) << 3)
            for p in body[1:]:
                move(p)
            if kind == 3:
                out.append(7 | 1 << 3)
    return b"".join(map(_varint, out))


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, (int, float)):
        return _varint(3 << 3 | 1) + struct.pack("<d", float(v))
    return _field(1, str(v).encode())


def _id(fid: int | None) -> bytes:
    return _varint(1 << 3) + _varint(fid) if isinstance(fid, int) and fid >= 0 else b""


def _shape(kind: int, commands: bytes) -> bytes:
    return _varint(3 << 3) + _varint(kind) + _field(4, commands)


def _feature(own: bytes, tags: bytes, rest: bytes) -> bytes:
    return _field(2, own + (_field(2, tags) if tags else b"") + rest)


_LAYER_END = _varint(5 << 3) + _varint(EXTENT) + _varint(15 << 3) + _varint(2)


def encode_layer(name: str, features: list[tuple]) -> bytes:
    """A tile with one layer of features (id or None, properties, (type, parts or their encoded commands))."""
    part = Part()
    for fid, props, (kind, parts) in features:
        own = {k: _value(v) for k, v in props.items() if v is not None}
        part.add(fid, list(own), list(own.values()), kind, parts if isinstance(parts, bytes) else _commands(kind, parts))
    return part.layer(name)


class Part:
    """Some features of a tile's layer with key and value dictionaries of their own; parts merge by new tags."""

    def __init__(self, keys: list[str] = (), values: list[bytes] = (), features: list[tuple] = ()):
        self.keys, self.values = {k: i for i, k in enumerate(keys)}, {v: i for i, v in enumerate(values)}
        self.features = list(features)  # (encoded id, tags, encoded type and geometry)

    def add(self, fid: int | None, keys: list[str], values: list[bytes], kind: int, commands: bytes) -> None:
        tags = [t for k, v in zip(keys, values) for t in (self.keys.setdefault(k, len(self.keys)), self.values.setdefault(v, len(self.values)))]
        self.features.append((_id(fid), tags, _shape(kind, commands)))

    def merge(self, other: "Part") -> None:
        """Appends the other part's features."""
        keys = [self.keys.setdefault(k, len(self.keys)) for k in other.keys]
        values = [self.values.setdefault(v, len(self.values)) for v in other.values]
        for own, tags, rest in other.features:
            self.features.append((own, [(values if i % 2 else keys)[t] for i, t in enumerate(tags)], rest))

    def layer(self, name: str) -> bytes:
        body = b"".join(_feature(own, b"".join(map(_varint, tags)), rest) for own, tags, rest in self.features)
        layer = _field(1, name.encode()) + body + b"".join(_field(3, k.encode()) for k in self.keys) + b"".join(_field(4, v) for v in self.values)
        return _field(3, layer + _LAYER_END)


def _plain(v):
    return v if v is None or isinstance(v, (bool, int, float, str)) else json.dumps(v)


class _Zipped:
    """gzip of what is added, in chunks of one size: the bytes don't depend on how it was cut, and only zipped ones are held."""

    def __init__(self):
        self.zip, self.held, self.out = zlib.compressobj(6, zlib.DEFLATED, 31), bytearray(), []

    def add(self, data: bytes) -> None:
        self.held += data
        whole = len(self.held) // ZIP_BYTES * ZIP_BYTES
        for at in range(0, whole, ZIP_BYTES):
            self.out.append(self.zip.compress(self.held[at : at + ZIP_BYTES]))
        del self.held[:whole]

    def end(self) -> bytes:
        return b"".join([*self.out, self.zip.compress(self.held), self.zip.flush()])


def _tags(features: DataFrame) -> DataFrame:
    """(z, x, y, part, kind, v, tag, fresh) of the keys (kind 0) and values (kind 1) in each part of a tile: their place in the
    tile's dictionary, which is in order of first use, and whether this part is the first to use them. No dictionary is
    gathered: places are counted in the parts, and each part's first place is the sum of the counts before it."""
    tile = ["z", "x", "y"]
    both = F.concat(F.transform("keys", lambda k: F.struct(F.lit(0).alias("kind"), k.cast("binary").alias("v"))), F.transform("vals", lambda v: F.struct(F.lit(1).alias("kind"), v.alias("v"))))
    each = features.select(*tile, "part", "idx", F.posexplode(both).alias("pos", "e")).select(*tile, "part", "e.kind", "e.v", F.struct("idx", "pos").alias("f"))
    used = each.groupBy(*tile, "part", "kind", "v").agg(F.min("f").alias("f"))
    first = used.groupBy(*tile, "kind", "v").agg(F.min(F.struct("f", "part")).alias("s")).select(*tile, "kind", "v", "s.f", F.col("s.part").alias("home"))
    place = F.row_number().over(Window.partitionBy(*tile, "kind", "home").orderBy("f", "v")) - 1
    before = Window.partitionBy(*tile, "kind").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.groupBy(*tile, "kind", "home").agg(F.count("*").alias("m")).select(*tile, "kind", "home", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    placed = first.select(*tile, "kind", "v", "home", place.alias("place")).join(starts, [*tile, "kind", "home"])
    placed = placed.select(*tile, "kind", "v", "home", (F.col("start") + F.col("place")).alias("tag"))
    tags = used.join(placed, [*tile, "kind", "v"]).select(*tile, "part", "kind", "v", "tag", (F.col("part") == F.col("home")).alias("fresh"))
    return tags.toDF(*tags.columns)  # names of its own beside features


def build(keyed: DataFrame, layer: str, props: list[str] | None = None, tolerance: float | None = 1.0) -> DataFrame:
    """(z, x, y, n, tile): gzipped bytes of each tile with content, from tile_features of a frame with idx, fid, geom
    (type, coords) and property columns, or with a map column props of JSON texts if none are named.

    Geometries are clipped, simplified and encoded where the features are; only what is left of them in a tile travels.
    The dictionaries of a tile are numbered by joins (``_tags``). Features are encoded in parts by ranges of PART_FEATURES
    places in the input (idx), so that a crowded tile is encoded in many tasks; the task that joins a tile's parts reads
    them one after the other and holds no more than its zipped bytes."""
    cols = props if props is not None else ["props"]

    def encode(batches):
        for pdf in batches:
            out = []
            for z, x, y, idx, fid, geom, *own in pdf.itertuples(index=False, name=None):
                coords = [[[(p["x"], p["y"]) for p in line] for line in part] for part in geom["coords"]]
                got = cut(geom["type"], coords, int(z), int(x), int(y), tolerance)
                if got:
                    if props is None:
                        values = {k: _plain(json.loads(v)) for k, v in dict(own[0] or {}).items() if v is not None}
                    else:
                        values = {p: v.item() if hasattr(v, "item") else v for p, v in zip(props, own) if not pd.isna(v)}
                    values = {k: _value(v) for k, v in values.items() if v is not None}
                    out.append((z, x, y, idx, idx // PART_FEATURES, _id(int(fid) if str(fid).isdigit() else None), _shape(got[0], _commands(*got)), list(values), list(values.values())))
            yield pd.DataFrame(out, columns=["z", "x", "y", "idx", "part", "own", "rest", "keys", "vals"])

    def pieces(key, rows, tags):
        known = ({}, {})
        for kind, v, tag in zip(tags["kind"].tolist(), tags["v"], tags["tag"].tolist()):
            known[kind][bytes(v)] = _varint(tag)
        rows = rows.sort_values("idx", kind="stable")
        body = bytearray()
        for own, rest, keys, vals in zip(rows["own"], rows["rest"], rows["keys"], rows["vals"]):
            body += _feature(own, b"".join(known[0][k.encode()] + known[1][bytes(v)] for k, v in zip(keys, vals)), rest)
        fresh = tags[tags["fresh"]].sort_values("tag")
        out = [(*key, 0, len(rows), bytes(body))]
        for kind in (0, 1):
            own = b"".join(_field(3 + kind, bytes(v)) for v in fresh.loc[fresh["kind"] == kind, "v"])
            out += [(*key, 1 + kind, 0, own)] if own else []
        return pd.DataFrame(out, columns=["z", "x", "y", "part", "section", "n", "data"])

    def join(batches):
        out, held, now, zipped, total = [], 0, None, None, 0

        def ended():
            zipped.add(_LAYER_END)
            out.append((*now, total, zipped.end()))
            return len(out[-1][-1])

        for pdf in batches:
            for z, x, y, data, size, n in pdf.itertuples(index=False, name=None):
                if (z, x, y) != now:
                    held += ended() if now else 0
                    if len(out) == 100 or held > 1 << 22:
                        yield pd.DataFrame(out, columns=["z", "x", "y", "n", "tile"])
                        out, held = [], 0
                    now, zipped, total = (z, x, y), _Zipped(), n
                    name = _field(1, layer.encode())
                    zipped.add(_varint(3 << 3 | 2) + _varint(len(name) + int(size) + len(_LAYER_END)) + name)
                zipped.add(data)
        if now:
            ended()
        yield pd.DataFrame(out, columns=["z", "x", "y", "n", "tile"])

    rows = keyed.select("z", "x", "y", "idx", "fid", "geom", *cols)
    tile, spread = "z int, x bigint, y bigint", int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cc.cut(rows.mapInPandas(encode, f"{tile}, idx bigint, part bigint, own binary, rest binary, keys array<string>, vals array<binary>"), "features")
    by = ["z", "x", "y", "part"]
    made = rows.groupBy(*by).cogroup(_tags(rows).groupBy(*by)).applyInPandas(pieces, f"{tile}, part bigint, section int, n int, data binary")
    made = cc.cut(made, "pieces")
    # a tile's sums come before its pieces as a row of their own: after a join by the same columns the optimizer leaves the
    # repartition out, and adaptive execution may then read a tile's pieces in many tasks
    pieces_ = made.select("z", "x", "y", "section", "part", "data", F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("n"))
    sums = made.groupBy("z", "x", "y").agg(F.sum(F.octet_length("data")).alias("size"), F.sum("n").cast("int").alias("n"))
    sums = sums.select("z", "x", "y", F.lit(-1).alias("section"), F.lit(0).cast("bigint").alias("part"), F.lit(b"").alias("data"), "size", "n")
    rows = sums.unionByName(pieces_).repartition(spread, "z", "x", "y").sortWithinPartitions("z", "x", "y", "section", "part")
    return rows.select("z", "x", "y", "data", "size", "n").mapInPandas(join, f"{tile}, n int, tile binary")


def write_store(tiles: DataFrame, path: str, layer: str) -> None:
    """Adds tiles (z, x, y, tile) to a stored pyramid: Parquet by layer and zoom; a zoom that it has already is replaced."""
    rows = tiles.select(F.lit(layer).alias("layer"), "z", "x", "y", "tile").repartition("z", F.shiftright("x", 6), F.shiftright("y", 6)).sortWithinPartitions("z", "x", "y")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z").parquet(path)


def read_store(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """The tiles of a layer in a store; zoom, x and y of a lookup reach the scan."""
    return spark.read.parquet(path).where(F.col("layer") == layer).select("z", "x", "y", "tile")


EXTENSIONS = {"mvt": ("pbf", "mvt"), "png": ("png",), "jpg": ("jpg", "jpeg"), "webp": ("webp",)}


def matches_extension(extension: str, kind: str) -> bool:
    """Whether a file extension fits a tile format."""
    return extension.lower() in EXTENSIONS.get(kind, ())


def delivered(data: bytes, content_type: str, accept: str = "", known: str | None = None) -> tuple[int, dict, bytes]:
    """(status, headers, body) of a tile: 304 where the client knows its tag; zipped as stored if the client takes gzip,
    else unzipped. A body that can't be unzipped is a 500."""
    tag = etag(data)
    if known == tag:
        return 304, {}, b""
    headers = {"Content-Type": content_type, "ETag": tag, "Cache-Control": "public, max-age=3600"}
    if data[:2] == b"\x1f\x8b":
        if "gzip" in accept:
            headers["Content-Encoding"] = "gzip"
        else:
            try:
                data = gzip.decompress(data)
            except (OSError, EOFError):
                return 500, {}, b"the stored tile can't be unzipped"
    return 200, headers | {"Content-Length": str(len(data))}, data


def etag(data: bytes) -> str:
    """64-bit FNV-1a of the bytes, quoted."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f'"{h:x}"'


# --- an independent reader, for tests and lookups ------------------------------------------------------------------


def decode(tile: bytes) -> dict:
    """{layer: [{id, type, properties, geometry (list of parts of points)}]}."""
    if tile[:2] == b"\x1f\x8b":
        tile = gzip.decompress(tile)

    def fields(data: bytes):
        at = 0

        def varint():
            nonlocal at
            n = shift = 0
            while True:
                b = data[at]
                at += 1
                n |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    return n

        while at < len(data):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            elif key & 7 == 2:
                n = varint()
                yield key >> 3, data[at : at + n]
                at += n
            else:
                n = 8 if key & 7 == 1 else 4
                yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
                at += n

    def varints(data: bytes):
        n = shift = 0
        for b in data:
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                yield n
                n = shift = 0

    out = {}
    for number, layer in fields(tile):
        if number != 3:
            continue
        got = list(fields(layer))
        name = next(v for k, v in got if k == 1).decode()
        keys = [v.decode() for k, v in got if k == 3]
        values = []
        for k, v in got:
            if k == 4:
                kind, x = next(iter(fields(v)))
                values.append(x.decode() if kind == 1 else bool(x) if kind == 7 else x)
        out[name] = []
        for k, v in got:
            if k != 2:
                continue
            f = dict(fields(v))
            tags = list(varints(f.get(2, b"")))
            todo = varints(f[4])
            parts, x, y = [], 0, 0
            for command in todo:
                if command & 7 == 7:
                    parts[-1].append(parts[-1][0])
                    continue
                for _ in range(command >> 3):
                    a, b = next(todo), next(todo)
                    x, y = x + (a >> 1 ^ -(a & 1)), y + (b >> 1 ^ -(b & 1))
                    if command & 7 == 1 and not (f[3] == 1 and parts):
                        parts.append([])
                    parts[-1].append((x, y))
            out[name].append({"id": f.get(1), "type": f[3], "properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, "geometry": parts})
    return out


def _varint_at(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _layer_fields(tile: bytes):
    """(number of the layer in the tile, field, payload or number) of a tile's layers in order, unzipped chunk by chunk."""
    zipped = zlib.decompressobj(31) if tile[:2] == b"\x1f\x8b" else None
    view, data, at, read, layer, left = memoryview(tile), b"", 0, 0, -1, 0

    def more(least: int) -> None:
        nonlocal data, at, read
        parts, size = [data[at:]], len(data) - at
        while size < least and read < len(view):
            part = view[read : read + ZIP_BYTES]
            read += ZIP_BYTES
            parts.append(zipped.decompress(part) if zipped else bytes(part))
            size += len(parts[-1])
        data, at = b"".join(parts), 0

    while True:
        if len(data) - at < 32:
            more(32)
        if at == len(data):
            return
        start = at
        key, at = _varint_at(data, at)
        n, after = _varint_at(data, at) if key & 7 in (0, 2) else (8 if key & 7 == 1 else 4, at)
        at = after
        if left == 0 and key == 3 << 3 | 2:
            layer, left = layer + 1, n
            continue
        inside = left > 0
        taken = at - start
        got = n
        if key & 7:
            if len(data) - at < n:
                more(n)
            got = data[at : at + n]
            at += n
            taken += n
        if inside:
            left -= taken
            yield layer, key >> 3, got


def properties(tile: bytes, layer: str):
    """(id, properties) of the features of a tile's layer in order, without their geometry. Only the dictionaries are held,
    as bytes, beside a chunk of the unzipped tile."""
    names, keys, values, ends = {}, {}, {}, {}
    for k, field, got in _layer_fields(tile):
        if field == 1:
            names[k] = got.decode()
        elif field == 3:
            keys.setdefault(k, []).append(got.decode())
        elif field == 4:
            values.setdefault(k, bytearray()).extend(got)
            ends.setdefault(k, array("q", [0])).append(len(values[k]))

    def value(k: int, i: int):
        data = bytes(values[k][ends[k][i] : ends[k][i + 1]])
        kind, at = _varint_at(data, 0)
        if kind & 7 == 1:
            return struct.unpack("<d", data[at:])[0]
        n, at = _varint_at(data, at)
        return data[at:].decode() if kind & 7 == 2 else bool(n)

    for k, field, got in _layer_fields(tile):
        if field != 2 or names[k] != layer:
            continue
        fid, own, at = None, {}, 0
        while at < len(got):
            key, at = _varint_at(got, at)
            n, at = _varint_at(got, at)
            if key == 1 << 3:
                fid = n
            elif key == 2 << 3 | 2:
                end = at + n
                while at < end:
                    a, at = _varint_at(got, at)
                    b, at = _varint_at(got, at)
                    own[keys[k][a]] = value(k, b)
            elif key & 7 == 2:
                at += n
        yield fid, own
