"""GeoJSON files as feature frames, and feature frames as GeoJSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.operators import components as cc

#: Bytes of a file from which on it is read in pieces.
LARGE = 64 << 20
#: Open brackets inside a feature: of the collection, its features and the feature.
_INSIDE = 3
#: Number of the feature that is open at a block's end: one at most.
_LAST = 1 << 40


def features_of(documents: DataFrame, column: str = "value") -> DataFrame:
    """Feature frame of GeoJSON documents, one a row; ids are kept as texts, whole numbers without exponent. A column idx
    gives the places of documents that are a feature each."""
    place = F.col("idx") if "idx" in documents.columns else F.lit(0)
    each = documents.select(place.alias("first"), F.posexplode(geometry.from_geojson(F.col(column))).alias("pos", "f")).withColumn("pos", F.col("first") + F.col("pos"))
    fid = F.when(F.col("f.id").rlike(r"^-?[0-9]+\.0+$"), F.split("f.id", r"\.")[0]).otherwise(F.col("f.id"))
    rows = each.select(F.col("pos").cast("bigint").alias("idx"), fid.alias("fid"), geometry.kinds(F.coalesce("f.properties", F.create_map().cast("map<string,string>"))).alias("props"), geometry.geometry_of(F.col("f.geometry")).alias("geom"))
    return geometry.features(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Feature frame of one GeoJSON file; a large one has to be a collection, and is read in pieces."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"] or 0
    return read_collection(spark, path) if size > LARGE else features_of(spark.read.text(path, wholetext=True))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Feature frame of a GeoJSON collection of any size, which many tasks read.

    Spark cuts the file at closing braces, in blocks. A task can't know whether its block starts inside a string and how
    deep; it says what the block does to either state. These few numbers a block give the state at each block's start, and
    with it every task finds the features that begin in its block and the rest of the one that began before. A feature's
    parts are put together by the block that it began in."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    told = rows.mapInPandas(_effects, "file string, block bigint, flips boolean, plain bigint, plain_least bigint, quoted bigint, quoted_least bigint").collect()  # a row a block
    starts, state = {}, {}
    for r in sorted(told, key=lambda r: (r["file"], r["block"])):
        inside, depth, began = state.get(r["file"], (False, 0, -1))
        starts[r["file"], r["block"]] = (inside, depth, began)
        change, least = (r["quoted"], r["quoted_least"]) if inside else (r["plain"], r["plain_least"])
        # what is open at the end began in this block if all was closed somewhere in it
        began = r["block"] if depth < _INSIDE or depth + least < _INSIDE else began
        state[r["file"]] = (inside != r["flips"], depth + change, began)
    shared = spark.sparkContext.broadcast(starts)
    parts = rows.mapInPandas(lambda batches: _features(batches, shared.value), "file string, block bigint, nth bigint, part bigint, whole boolean, text string")
    parts = cc.cut(parts, "parts")
    joined = parts.where("not whole").groupBy("file", "block", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("value"))
    found = parts.where("whole").select("file", "block", "nth", F.col("text").alias("value")).unionByName(joined)
    found = found.where(F.get_json_object("value", "$.type") == "Feature")
    return features_of(cc.dense(found, ["file", "block", "nth"], "idx"))


_ESCAPED, _MARKS = re.compile(r"\\.", re.S), re.compile(r"\\.|[\"{\[\]]", re.S)


def _pieces(batches):
    """(file, block, values) of consecutive rows of a block."""
    for pdf in batches:
        cut = (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
        for _, own in pdf.groupby(cut.cumsum(), sort=False):
            yield own["file"].iloc[0], int(own["block"].iloc[0]), own["value"].tolist()


def _change(outside: list[str]) -> int:
    text = "".join(outside)
    return text.count("{") + text.count("[") - text.count("]")


def _effects(batches):
    """What each block does to a text outside a string, and to one inside: the change in depth, and the least depth after
    a closing brace."""
    found: dict[tuple, list] = {}
    for file, block, values in _pieces(batches):
        own = found.setdefault((file, block), [False, 0, 0, 0, 0])
        for value in values:
            parts = _ESCAPED.sub("", value).split('"')
            for k in (0, 1):  # outside at the block's start, inside
                inside = own[0] != bool(k)
                own[1 + 2 * k] += _change(parts[inside::2]) - (inside == (len(parts) % 2 == 0))
                own[2 + 2 * k] = min(own[2 + 2 * k], own[1 + 2 * k])
            own[0] ^= len(parts) % 2 == 0
    yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["file", "block", "flips", "plain", "plain_least", "quoted", "quoted_least"])


def _features(batches, starts: dict):
    """The features, or parts of them, in each block."""
    now, open_, rows = None, [], []
    inside, depth, began, nth = False, 0, -1, 0

    def frame(rows):
        return pd.DataFrame(rows, columns=["file", "block", "nth", "part", "whole", "text"])

    for file, block, values in _pieces(batches):
        if (file, block) != now:
            if open_:
                rows.append((now[0], began, _LAST, now[1], False, "".join(open_)))
            now, open_, nth = (file, block), [], 0
            inside, depth, began = starts[file, block]
        for value in values:
            at = 0
            if depth < _INSIDE:  # a feature may begin here
                for m in _MARKS.finditer(value):
                    mark = m[0]
                    if mark == '"':
                        inside = not inside
                    elif not inside and len(mark) == 1:
                        depth += 1 if mark != "]" else -1
                        if depth == _INSIDE and mark == "{":
                            at, began = m.start(), block
                            nth += 1
                            parts = _ESCAPED.sub("", value[m.end() :]).split('"')
                            depth += _change(parts[0::2])
                            inside = len(parts) % 2 == 0
                            break
                else:
                    depth -= not inside
                    continue
            else:
                parts = _ESCAPED.sub("", value).split('"')
                depth += _change(parts[inside::2])
                inside ^= len(parts) % 2 == 0
            open_.append(value[at:] + "}")
            if not inside:
                depth -= 1
                if depth < _INSIDE:
                    whole = began == block
                    rows.append((file, began, nth if whole else _LAST, block, whole, "".join(open_)))
                    open_ = []
        if len(rows) > 1000:
            yield frame(rows)
            rows = []
    if open_:
        rows.append((now[0], began, _LAST, now[1], False, "".join(open_)))
    yield frame(rows)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feature frame of newline-delimited GeoJSON, which Spark splits; ids by content where there is none."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    out = features_of(rows)
    return out.withColumn("idx", F.xxhash64("fid", "geom"))


def geometry_json(geom: Column) -> Column:
    """GeoJSON text of a geometry column."""
    pt = lambda p: F.array(p["x"], p["y"])
    c = geom["coords"]
    line = F.transform(c[0][0], pt)
    parts = F.transform(c[0], lambda l: F.transform(l, pt))
    coords = (
        F.when(geom["type"] == "Point", F.to_json(pt(c[0][0][0])))
        .when(geom["type"].isin("LineString", "MultiPoint"), F.to_json(line))
        .when(geom["type"].isin("MultiLineString", "Polygon"), F.to_json(parts))
        .otherwise(F.to_json(F.transform(c, lambda g: F.transform(g, lambda l: F.transform(l, pt)))))
    )
    return F.concat(F.lit('{"type":"'), geom["type"], F.lit('","coordinates":'), coords, F.lit("}"))


def feature_json(fid: Column, props: Column, geom: Column) -> Column:
    """GeoJSON text of a feature; props is a map of JSON texts."""
    pairs = F.transform(F.map_entries(props), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit('{"type":"Feature","id":'), F.when(fid.rlike("^(0|-?[1-9][0-9]{0,17})$"), fid).otherwise(F.concat(F.lit('"'), fid, F.lit('"'))), F.lit(',"properties":{'), F.array_join(pairs, ","), F.lit('},"geometry":'), geometry_json(geom), F.lit("}"))


def collection_json(page: DataFrame) -> DataFrame:
    """One row, one document of a page of features (idx, fid, props, geom, number_matched, number_returned)."""
    body = page.select("idx", feature_json(F.col("fid"), F.col("props"), F.col("geom")).alias("f"), "number_matched", "number_returned")
    return body.agg(F.array_sort(F.collect_list(F.struct("idx", "f"))).alias("fs"), F.coalesce(F.first("number_matched"), F.lit(0)).alias("m"), F.coalesce(F.first("number_returned"), F.lit(0)).alias("r")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit('],"numberMatched":'), F.col("m").cast("string"), F.lit(',"numberReturned":'), F.col("r").cast("string"), F.lit("}")).alias("value")
    )
