"""Nested JSON values of any depth: every object and array of a document as a row, in the document's own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions.text import trimmed
from tallyrook.session import materialize


def kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT, VOID, ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def string(value: Column) -> Column:
    """A variant's text if it is a string, else null."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def text_value(value: Column) -> Column:
    """The trimmed text of a string, or of the `text` of an object; null if there is none."""
    own = F.coalesce(string(value), string(F.try_variant_get(value, "$.text", "variant")))
    return F.nullif(trimmed(own), F.lit(""))


def _children(json: Column) -> Column:
    """The values of an object, or elements of an array, in order: array of struct(json, kind)."""
    pair = lambda text, value: F.struct(text.alias("json"), kind(value).alias("kind"))
    values = F.zip_with(F.map_values(F.from_json(json, "map<string,string>")), F.map_values(F.from_json(json, "map<string,variant>")), pair)
    elements = F.zip_with(F.from_json(json, "array<string>"), F.from_json(json, "array<variant>"), pair)
    return F.when(F.substring(trimmed(json), 1, 1) == "[", elements).otherwise(values)


def walk(documents: DataFrame, key: str, json: str, name: str | None = None) -> DataFrame:
    """(key, json text) -> key, path, json: the document itself and every object and array in it, of any depth.

    path is the place of each value on the way from the root, so its order is depth first, parents before children.
    A level of nesting is a pass over that level's values alone; what isn't JSON has its root only, a null document none.
    With a name, values in which no field can have it are left out, and so is all below them: their text has neither the name
    nor an escape by which it might be written.
    """
    holds = F.lit(True) if name is None else F.col("json").contains(name) | F.col("json").contains("\\u")
    level = documents.select(F.col(key), F.array().cast("array<int>").alias("path"), F.col(json).alias("json")).where("json is not null").where(holds)
    levels = []
    while True:
        level, _ = materialize(level, "nested")
        if level.isEmpty():
            break
        levels.append(level)
        below = level.select(key, "path", F.posexplode(_children(F.col("json"))).alias("at", "x")).where("x.kind in ('OBJECT', 'ARRAY')")
        level = below.select(key, F.concat("path", F.array("at")).alias("path"), F.col("x.json").alias("json")).where(holds)
    out = levels[0] if levels else level
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
