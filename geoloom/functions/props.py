"""Typed access to properties held as JSON texts, so that numbers, booleans and strings stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def prop_float(value: Column) -> Column:
    """Number of a JSON value; null for strings, even those that spell numbers."""
    return F.when(value.rlike(_NUMBER), value.cast("double"))


def prop_bool(value: Column) -> Column:
    """True for true, non-zero numbers and the strings yes, true, 1 and -1."""
    number = prop_float(value)
    return F.coalesce(F.when(value == "true", True).when(number.isNotNull(), number != 0).otherwise(value.isin('"yes"', '"true"', '"1"', '"-1"')), F.lit(False))


def prop_string(value: Column) -> Column:
    """Text of a JSON value; empty if absent."""
    return F.coalesce(F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value), F.lit(""))


def field_kind(value: Column) -> Column:
    """Number, Boolean or String (everything else, null included)."""
    return F.when(value.rlike(_NUMBER), "Number").when(value.isin("true", "false"), "Boolean").otherwise("String")


def safe_key(key: Column) -> Column:
    """Whether a cache key stays inside its folder: parts of plain characters, none of them a dot or two."""
    return key.rlike(r"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$") & ~key.rlike(r"(^|/)\.{1,2}(/|$)")


def parse_bbox(text: Column) -> Column:
    """Struct (valid, west, south, east, north) of 4 or 6 comma-separated numbers; of 6 the heights are left out.
    Empty means no box: valid with null sides. Non-finite or inverted boxes are invalid."""
    parts = F.split(F.coalesce(text, F.lit("")), ",", -1)
    numbers = F.transform(parts, lambda p: F.when(F.trim(p).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(p).cast("double")))
    n = F.size(parts)
    east = F.when(n == 6, 3).otherwise(2)
    w, s, e, north = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.get(numbers, east), F.get(numbers, east + 1)
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    ok = n.isin(4, 6) & F.forall(numbers, lambda v: v.isNotNull()) & (w <= e) & (s <= north)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct((empty | ok).alias("valid"), *[F.when(ok, v).alias(k) for k, v in (("west", w), ("south", s), ("east", e), ("north", north))])
