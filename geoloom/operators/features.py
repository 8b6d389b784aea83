"""Feature queries: filters, pages, lookups and layer metadata over frames of features.

A feature frame has ``idx`` (input order), ``fid`` (text), ``props`` and the corners ``xmin, ymin, xmax, ymax``; plain
DOUBLE corners let Parquet's statistics prune row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
TOOL_DEFAULT_LIMIT, TOOL_MAX_LIMIT = 10, 1_000


class UserError(ValueError):
    """A mistake in a request, found before any job runs."""


def bbox_filter(features: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features whose corners' box meets the box; touching counts."""
    if not (west <= east and south <= north and all(abs(v) < float("inf") for v in (west, south, east, north))):
        raise UserError("a box must have finite sides in order")
    return features.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))


def normalize_limit(requested: Column, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Column:
    """Limit that a request gets; null if it is invalid (below 1)."""
    return F.when(requested.isNull(), F.lit(default)).when(requested >= 1, F.least(requested, F.lit(most)))


def page(features: DataFrame, offset: int = 0, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Rows offset to offset + limit by idx, with number_matched, number_returned and has_next. The count runs beside the
    top-n of the page, so that nothing but the page is sorted as a whole."""
    if offset < 0 or (limit is not None and limit < 1):
        raise UserError("limit must be positive and offset not negative")
    matched = features.agg(F.count("*").alias("number_matched"))
    rows = features.orderBy("idx").offset(offset)
    rows = rows.limit(limit) if limit is not None else rows
    returned = F.count("*").over(Window.partitionBy())  # of the page
    rows = rows.withColumn("number_returned", returned).crossJoin(F.broadcast(matched))
    return rows.withColumn("has_next", F.col("number_matched") > F.lit(offset) + F.col("number_returned"))


def by_id(features: DataFrame, fid: str) -> DataFrame:
    """The feature with this id; of several the first."""
    return features.where(F.col("fid") == fid).orderBy("idx").limit(1)


def project_fields(features: DataFrame, fields: list[str]) -> DataFrame:
    """Features with these properties alone (the id always stays)."""
    return features.select("fid", *[F.col(f"`{f}`") for f in fields if f != "fid"])


def extent(features: DataFrame) -> DataFrame:
    """One row: west, south, east, north, n."""
    return features.agg(F.min("xmin").alias("west"), F.min("ymin").alias("south"), F.max("xmax").alias("east"), F.max("ymax").alias("north"), F.count("*").alias("n"))


def field_kinds(features: DataFrame, kind) -> DataFrame:
    """key, kind: the kind that each property's first value has; props is a map of JSON texts."""
    each = features.select("idx", F.explode("props").alias("key", "value"))
    return each.groupBy("key").agg(F.min_by(kind(F.col("value")), "idx").alias("kind"))


def grid_bin(features: DataFrame, cells: int = 64) -> DataFrame:
    """features with the cells (x0, y0, x1, y1) of a grid over the extent that their boxes cover; an axis without width
    has one cell."""
    e = extent(features)

    def cell(v: str, low: str, high: str) -> Column:
        width = F.col(high) - F.col(low)
        at = F.when(width > 0, ((F.col(v) - F.col(low)) / width * cells).cast("int")).otherwise(F.lit(0))
        return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1))

    out = features.crossJoin(F.broadcast(e.drop("n")))
    return out.select(*features.columns, cell("xmin", "west", "east").alias("x0"), cell("ymin", "south", "north").alias("y0"), cell("xmax", "west", "east").alias("x1"), cell("ymax", "south", "north").alias("y1"))
