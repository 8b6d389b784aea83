"""Features stored along a space-filling curve: neighbours on the map lie together in the files.

Rows are sorted by the Morton number of their boxes' centres in ranges, so that each Parquet row group and page covers a
small box. The boxes of a filter are compared with the least and greatest corners that Parquet keeps of each; only row
groups and pages that may meet the box are read. Features that are larger than their neighbourhood are kept apart, by the
size of their boxes, so that they don't widen the boxes of small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import bbox_filter

#: Bits of each coordinate in a Morton number, and bytes of a row group.
BITS, GROUP_BYTES = 20, 4 << 20
#: Spreading of bits: shift to the left, then keep (fixed values of the usual interleaving of 32 bits).
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(lon: Column, lat: Column) -> Column:
    """The place of a position in degrees on the curve: bits of both coordinates in turn. Positions off the map count as
    at its edge, unknown ones as at its corner."""
    def whole(c: Column, most: float) -> Column:
        cell = F.floor((c + most) / (2 * most) * (1 << BITS)).cast("long")
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), cell)), F.lit(0)).cast("long")

    return _spread(whole(lon, 180.0)).bitwiseOR(F.shiftleft(_spread(whole(lat, 90.0)), 1))


def _size(w: Column, h: Column) -> Column:
    """0 for boxes below a hundredth of a degree, one more for each ten times."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.ceil(F.log10(F.greatest(w, h)) + 2), F.lit(0)))).cast("int")


def write(features: DataFrame, path: str, partitions: int | None = None) -> None:
    """Stores a feature frame (with xmin, ymin, xmax, ymax), a folder for each size of boxes (``size``)."""
    rows = features.withColumns({"size": _size(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), "curve": morton((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)})
    order = ["size", "curve"]
    rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", GROUP_BYTES // 64).option("parquet.page.row.count.limit", 1000).partitionBy("size").parquet(path)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The stored features, or those whose boxes meet a box; Parquet leaves out what can't."""
    rows = spark.read.parquet(path).drop("size", "curve")
    return bbox_filter(rows, *box) if box else rows
