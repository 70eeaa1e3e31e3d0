"""JSON of any depth as rows: every value with its path, level by level, by VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.staging import staged


def json_nodes(rows: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """id, path, depth, kind (object, array, string, number, boolean or null), value (JSON text), parent (path).

    Each level explodes the objects and arrays of the one before and is written, until there are none; text that is no JSON
    has no rows.  A key that holds a dot or a bracket is quoted in its path.
    """
    none = F.lit(None).cast("string")
    level = rows.select(F.col(key).alias("id"), F.lit("$").alias("path"), none.alias("parent"), F.to_json(F.try_parse_json(F.col(json).cast("string"))).alias("value")).where("value is not null")
    levels, depth = [], 0
    while True:
        first = F.substring("value", 1, 1)
        kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
        level = staged(level.withColumn("kind", kind), "json-level")
        levels.append(level.withColumn("depth", F.lit(depth)))
        open_ = level.where("kind in ('object', 'array') and value not in ('{}', '[]')")
        if not open_.limit(1).count():
            break
        depth += 1
        inner = open_.select("id", F.col("path").alias("parent"), F.parse_json("value").alias("tree"))
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("tree").outer()))
        name = F.when(F.col("key").rlike(r"^[^.\[\]\"']+$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']")))
        step = F.when(F.col("key").isNotNull(), name).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = each.select("id", F.concat("parent", step).alias("path"), "parent", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))
    return reduce(DataFrame.union, levels).select("id", "path", "depth", "kind", "value", "parent")


def typed_nodes(nodes: DataFrame, types: str) -> DataFrame:
    """id, path and fields (name: JSON text) of every object, however deep, whose @type, or one of them, matches the pattern.

    An object's own text holds its fields, so each is read where it lies and no row leaves its task.
    """
    shown = lambda tree: F.coalesce(F.to_json(tree), F.lit("null"))
    own = F.to_json(F.try_variant_get(F.parse_json("value"), "$['@type']", "variant"))
    many = lambda kind: F.when(kind.startswith("["), F.transform(F.from_json(kind, "array<variant>"), shown)).otherwise(F.array(kind))
    fits = F.exists(once(own, many), lambda kind: kind.startswith('"') & F.trim(kind, F.lit('"')).rlike(types))
    typed = nodes.where((F.col("kind") == "object") & F.col("value").contains('"@type"') & fits)
    return typed.select("id", "path", F.transform_values(F.from_json("value", "map<string,variant>"), lambda _, tree: shown(tree)).alias("fields"))
