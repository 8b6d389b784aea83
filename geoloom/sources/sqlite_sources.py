"""GeoPackage and MBTiles files as Spark data sources (``spark.read.format("gpkg")`` and ``"mbtiles"``)."""

from __future__ import annotations

import json
import math
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from geoloom.functions import geometry
from geoloom.functions.mercator import to_degrees
from geoloom.operators.features import UserError, bbox_filter

SRS = (0, 3857, 4326)
FORMATS = {"pbf": "application/vnd.mapbox-vector-tile", "mvt": "application/vnd.mapbox-vector-tile", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
#: Rows of a table that one task reads.
ROWS_PER_TASK = 100_000


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def pick_layer(path: str, want: str | None = None) -> tuple[str, str, int]:
    """(table, geometry column, srs) of the wanted feature table, or of the only one."""
    with _open(path) as db:
        found = db.execute("SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.table_name").fetchall()
    if want:
        found = [r for r in found if r[0] == want]
    if len(found) != 1:
        raise UserError(f"{path} has {len(found)} feature tables{f' named {want}' if want else ''}; one is needed")
    if found[0][2] not in SRS:
        raise UserError(f"reference system {found[0][2]} isn't supported")
    return found[0]


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _SqliteReader(DataSourceReader):
    """Reads a table by ranges of its rowids; filters on some whole-number columns become conditions of the query, which
    an index of the table or the rowids themselves then answer."""

    #: columns of the rows that filters are taken over for, and their names in the table
    pushed: dict[str, str] = {}

    def __init__(self, path: str, table: str):
        self.path, self.table, self.conditions, self.values, self.exact = path, table, [], [], set()

    def pushFilters(self, filters):
        for f in filters:
            column = self.pushed.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in _SIGNS and isinstance(f.value, int):
                self.conditions.append(f"{column} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
                if isinstance(f, EqualTo):
                    self.exact.add(f.attribute[0])
            elif column and isinstance(f, In) and 0 < len(f.value) <= 500 and all(isinstance(v, int) for v in f.value):
                self.conditions.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def partitions(self):
        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        if self.exact and self.exact == set(self.pushed):
            return [Range(-(1 << 63), (1 << 63) - 1)]  # one row, by the index
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}{where}", self.values).fetchone()
        return [Range(a, a + ROWS_PER_TASK) for a in range(low, high + 1, ROWS_PER_TASK)] if low is not None else [Range(0, 0)]

    def query(self, what: str, partition: Range) -> tuple[str, list]:
        """The query of a range, and its values."""
        conditions, values = list(self.conditions), list(self.values)
        if partition.low > -(1 << 63):
            conditions += ["rowid >= ?", "rowid < ?"]
            values += [partition.low, partition.high]
        return f"SELECT {what} FROM {quoted(self.table)} WHERE {' AND '.join(conditions)}", values


class _GpkgReader(_SqliteReader):
    pushed = {"idx": "rowid"}

    def __init__(self, options):
        table, self.column, self.srs = pick_layer(options["path"], options.get("layer"))
        super().__init__(options["path"], table)
        if options.get("box"):
            self._within([float(v) for v in options["box"].split(",")])

    def _within(self, box: list[float]) -> None:
        """Rows whose boxes in the table's R-tree, if it has one, meet a box in degrees."""
        tree = f"rtree_{self.table}_{self.column}"
        with _open(self.path) as db:
            if not db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (tree,)).fetchone():
                return
        west, south, east, north = box if self.srs != 3857 else [*_metres(box[0], box[1]), *_metres(box[2], box[3])]
        self.conditions.append(f"rowid IN (SELECT id FROM {quoted(tree)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)")
        self.values += [west, east, south, north]

    def read(self, partition: Range) -> Iterator[tuple]:
        with _open(self.path) as db:
            query, values = self.query("rowid, *", partition)
            rows = db.execute(f"{query} ORDER BY rowid", values)
            names = [c[0] for c in rows.description][1:]
            for rowid, *values in rows:
                props, fid, blob = {}, None, None
                for name, v in zip(names, values):
                    if name == self.column:
                        blob = v
                    elif v is not None:
                        v = v.decode("utf-8", "replace") if isinstance(v, bytes) else v
                        props[name] = json.dumps(v, ensure_ascii=False)
                        if name.lower() in ("fid", "id") and fid is None:
                            fid = str(v)
                if blob is not None:
                    yield rowid, fid, props, blob, self.srs


class GeoPackage(DataSource):
    """Rows (idx, fid, props, blob, srs) of a GeoPackage's feature table; options path, layer, and a box in degrees that rows
    beyond may be left out of by the table's R-tree."""

    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        return "idx bigint, fid string, props map<string,string>, blob binary, srs int"

    def reader(self, schema):
        return _GpkgReader(self.options)


class _MbtilesReader(_SqliteReader):
    pushed = {c: c for c in ("zoom_level", "tile_column", "tile_row")}

    def __init__(self, options):
        super().__init__(options["path"], "tiles")

    def read(self, partition: Range) -> Iterator[tuple]:
        with _open(self.path) as db:
            yield from db.execute(*self.query("zoom_level, tile_column, tile_row, tile_data", partition))


class Mbtiles(DataSource):
    """Rows (zoom_level, tile_column, tile_row, tile_data) of an MBTiles file; option path."""

    @classmethod
    def name(cls):
        return "mbtiles"

    def schema(self):
        return "zoom_level int, tile_column bigint, tile_row bigint, tile_data binary"

    def reader(self, schema):
        return _MbtilesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackage)
    spark.dataSource.register(Mbtiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _metres(lon: float, lat: float) -> tuple[float, float]:
    """Web Mercator of a position; the poles are cut off where the projection ends."""
    lat = max(-85.05112877980659, min(85.05112877980659, lat))
    return math.radians(lon) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137.0


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, box: tuple | None = None) -> DataFrame:
    """Feature frame of a GeoPackage's feature table, in degrees; a broken geometry fails the read. With a box only the
    features whose boxes meet it, which the table's R-tree finds if it has one."""
    register(spark)
    pick_layer(path, layer)
    options = {**({"layer": layer} if layer else {}), **({"box": ",".join(map(repr, map(float, box)))} if box else {})}
    rows = spark.read.format("gpkg").options(path=path, **options).load()
    got = rows.withColumn("g", geometry.gpb_geometry("blob"))
    geom = F.when(F.col("g.ok"), F.col("g.geom")).otherwise(F.raise_error(F.lit("not a GeoPackage geometry")).cast(geometry.GEOM))
    moved = F.struct(geom["type"].alias("type"), F.transform(geom["coords"], lambda part: F.transform(part, lambda line: F.transform(line, _degrees))).alias("coords"))
    geom = F.when(F.col("srs") == 3857, F.when(geom.isNotNull(), moved)).otherwise(geom)
    out = geometry.features(got.select("idx", "fid", "props", geom.alias("geom")))
    return bbox_filter(out, *box) if box else out


def _degrees(p):
    x, y = to_degrees(p["x"], p["y"])
    return F.struct(x.alias("x"), y.alias("y"))


def read_mbtiles(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("mbtiles").options(path=path).load()


def mbtiles_metadata(path: str) -> dict:
    """name, format, content_type, minzoom, maxzoom, bounds, center, vector_layers of an MBTiles file, with defaults."""
    with _open(path) as db:
        got = dict(db.execute("SELECT name, value FROM metadata"))
    form = (got.get("format") or "pbf").lower()
    if form not in FORMATS:
        raise UserError(f"tile format {form} isn't supported")
    numbers = lambda text: [float(v) for v in text.split(",")] if text else None
    out = {"name": got.get("name", ""), "description": got.get("description", ""), "attribution": got.get("attribution", ""), "format": form, "content_type": FORMATS[form], "minzoom": int(got.get("minzoom") or 0), "maxzoom": int(got.get("maxzoom") or 22)}
    bounds = numbers(got.get("bounds"))
    out["bounds"] = bounds if bounds and len(bounds) == 4 else [-180.0, -85.05112877980659, 180.0, 85.05112877980659]
    out["center"] = numbers(got.get("center"))
    out["vector_layers"] = json.loads(got["json"]).get("vector_layers", []) if got.get("json") else []
    return out
