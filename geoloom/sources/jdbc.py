"""PostGIS tables over JDBC. A driver jar is needed at run time; the statements are built here so that boxes, ids and
columns are filtered by the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.operators import components as cc
from geoloom.operators.features import UserError

from .sqlite_sources import quoted


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def split_table(table: str) -> tuple[str, str]:
    """(schema, name); public without a schema."""
    schema, dot, name = table.partition(".")
    return (schema, name) if dot else ("public", table)


def relation(table: str) -> str:
    return ".".join(map(quoted, split_table(table)))


def _where(geom: str, srid: int, bbox: tuple | None) -> list[str]:
    out = [f"{quoted(geom)} IS NOT NULL"]
    if bbox:
        out.append(f"{quoted(geom)} && ST_Transform(ST_MakeEnvelope({', '.join(repr(float(v)) for v in bbox)}, 4326), {int(srid)})")
    return out


def statement(table: str, geom: str, srid: int, id_column: str | None, fields: list[str], bbox: tuple | None = None, fid: str | None = None, limit: int | None = None, offset: int = 0) -> str:
    """SQL of the features of a table (schema.table or table in public): degrees as WKB, the id always selected. With a
    limit (10 if it isn't positive) one page in the order of the ids, or in the table's own order without an id column."""
    columns = list(dict.fromkeys([*([id_column] if id_column else []), *fields]))
    where = _where(geom, srid, bbox)
    if fid is not None:
        if not id_column:
            raise UserError("the table has no id column")
        where.append(f"{quoted(id_column)}::text = {literal(fid)}")
    listed = "".join(f", {quoted(c)}" for c in columns)
    order = f" ORDER BY {quoted(id_column)}" if limit is not None and id_column else ""
    page = f" LIMIT {int(limit) if limit > 0 else 10} OFFSET {max(0, int(offset))}" if limit is not None else ""
    return f"SELECT ST_AsBinary(ST_Transform({quoted(geom)}, 4326)) AS __wkb{listed} FROM {relation(table)} WHERE {' AND '.join(where)}{order}{page}"


def count_statement(table: str, geom: str, srid: int, bbox: tuple | None = None) -> str:
    """SQL of the number of features, in a box if one is given."""
    return f"SELECT count(*) AS n FROM {relation(table)} WHERE {' AND '.join(_where(geom, srid, bbox))}"


def tile_statement(name: str, table: str, geom: str, srid: int, id_column: str | None, fields: list[str], z: int, x: int, y: int, extent: int = 4096, buffer: int = 64, margin: float = 0.03125) -> str:
    """SQL of a vector tile that the database encodes."""
    listed = "".join(f", t.{quoted(c)}" for c in dict.fromkeys([*([id_column] if id_column else []), *fields]))
    shape = f"t.{quoted(geom)}" if srid == 3857 else f"ST_Transform(t.{quoted(geom)}, 3857)"
    envelope = f"{int(z)}, {int(x)}, {int(y)}"
    own = f", {literal(id_column)}" if id_column else ""
    return (
        f"SELECT ST_AsMVT(m.*, {literal(name)}, {int(extent)}, 'geom'{own}) AS tile FROM (SELECT ST_AsMVTGeom({shape}, ST_TileEnvelope({envelope}), {int(extent)}, {int(buffer)}, true) AS geom{listed}"
        f" FROM {relation(table)} t WHERE t.{quoted(geom)} && ST_Transform(ST_TileEnvelope({envelope}, margin => {margin!r}), {int(srid)})) m WHERE m.geom IS NOT NULL"
    )


def introspection(table: str, geom: str) -> dict[str, str]:
    """SQL by what it tells of a table: srid; columns (name, type) in order, without geometries; the first column of the
    primary key; and an estimate of the extent in degrees, for the srid in place of {srid}."""
    schema, name = split_table(table)
    at = f"{literal(schema)}, {literal(name)}, {literal(geom)}"
    return {
        "srid": f"SELECT srid FROM geometry_columns WHERE (f_table_schema, f_table_name, f_geometry_column) = ({at})",
        "columns": f"SELECT column_name, udt_name FROM information_schema.columns WHERE table_schema = {literal(schema)} AND table_name = {literal(name)} AND column_name <> {literal(geom)} AND udt_name NOT IN ('geometry', 'geography') ORDER BY ordinal_position",
        "key": f"SELECT a.attname AS name FROM pg_index i JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = ANY (i.indkey) WHERE i.indisprimary AND i.indrelid = {literal(relation(table))}::regclass LIMIT 1",
        "extent": f"SELECT ST_XMin(e) AS west, ST_YMin(e) AS south, ST_XMax(e) AS east, ST_YMax(e) AS north FROM (SELECT ST_Transform(ST_SetSRID(ST_EstimatedExtent({at}), {{srid}}), 4326) AS e) q",
    }


#: Bounds of a table that the database has no statistics of.
WORLD = (-180.0, -85.05112877980659, 180.0, 85.05112877980659)


class Table:
    """A PostGIS table: what isn't configured is asked of the database. ``rows`` runs a statement and gives its rows as
    dicts; it defaults to Spark's JDBC reader."""

    def __init__(self, spark: SparkSession, url: str, table: str, geom: str = "geom", srid: int = 0, id_column: str = "", fields: list[str] = (), rows=None, **options):
        self.spark, self.url, self.table, self.geom, self.options = spark, url, table, geom, options
        self.rows = rows or (lambda sql: [r.asDict() for r in self._load(sql).collect()])
        ask = introspection(table, geom)
        self.srid = srid or next((r["srid"] for r in self._try(ask["srid"])), 0) or 4326
        self.fields = list(fields) or [r["column_name"] for r in self.rows(ask["columns"])]
        self.id_column = id_column or next((r["name"] for r in self._try(ask["key"])), "") or None
        extent = next(iter(self._try(ask["extent"].format(srid=int(self.srid)))), {})
        box = tuple(extent.get(k) for k in ("west", "south", "east", "north"))
        self.bounds = WORLD if None in box else box

    def _load(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({sql}) AS q", **self.options).load()

    def _try(self, sql: str) -> list[dict]:
        """No rows where the database can't tell."""
        try:
            return self.rows(sql)
        except Exception:
            return []

    def count(self, bbox: tuple | None = None) -> int:
        return int(self.rows(count_statement(self.table, self.geom, self.srid, bbox))[0]["n"])

    def page(self, limit: int, offset: int = 0, bbox: tuple | None = None) -> DataFrame:
        """Feature frame of one page, ordered and cut by the database."""
        return read(self.spark, self.url, self.table, self.geom, self.srid, self.id_column, self.fields, bbox, limit=limit, offset=offset, **self.options)

    def features(self, bbox: tuple | None = None, fid: str | None = None) -> DataFrame:
        return read(self.spark, self.url, self.table, self.geom, self.srid, self.id_column, self.fields, bbox, fid, **self.options)

    def tile(self, name: str, z: int, x: int, y: int) -> bytes | None:
        got = self.rows(tile_statement(name, self.table, self.geom, self.srid, self.id_column, self.fields, z, x, y))
        return bytes(got[0]["tile"]) if got and got[0]["tile"] else None


def read(spark: SparkSession, url: str, table: str, geom: str = "geom", srid: int = 4326, id_column: str | None = None, fields: list[str] = (), bbox: tuple | None = None, fid: str | None = None, limit: int | None = None, offset: int = 0, **options) -> DataFrame:
    """Feature frame of a PostGIS table; features are numbered in the order of their ids, so that pages are stable."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=f"({statement(table, geom, srid, id_column, list(fields), bbox, fid, limit, offset)}) AS f", **options).load()
    blob = F.concat(F.unhex(F.lit("475000010000000000"[:16])), F.col("__wkb"))
    props = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.to_json(F.struct(F.col(f"`{f}`").alias("v"))) for f in fields])) if fields else F.create_map().cast("map<string,string>")
    props = F.transform_values(props, lambda k, v: F.regexp_extract(v, r'^\{"v":(.*)\}$', 1)) if fields else props
    key = F.col(f"`{id_column}`").cast("string") if id_column else F.lit(None).cast("string")
    rows = cc.dense(rows, [f"`{id_column}`"], "__idx") if id_column else rows.withColumn("__idx", F.monotonically_increasing_id())
    return geometry.features(rows.select(F.col("__idx").alias("idx"), key.alias("fid"), props.alias("props"), geometry.gpb_geometry(blob)["geom"].alias("geom")))
