"""JSON of any shape: leaves of values that nest to any depth, and rounding that touches nothing but floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import rounded
from .staging import written

#: Characters that JSON text can't hold as they are; they stand for an escaped backslash and an escaped quote.
_SLASH, _QUOTE = "\x01", "\x02"
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def rounded_json(text: Column, places: int = 2) -> Column:
    """JSON text with every float rounded, at any depth; names, strings, whole numbers, order and blanks stay as they are.

    Numbers are found outside strings only. A float is a number with a point or an exponent.
    """
    safe = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    number = lambda t: F.when(t.rlike(r"^-?[0-9]") & t.rlike("[.eE]"), rounded(t.cast("double"), places).cast("string")).otherwise(t)
    outside = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit(_NUMBER + "|[^0-9-]+|-"), F.lit(0)), number), "")
    parts = F.transform(F.split(safe, '"', -1), lambda part, i: F.when(i % 2 == 0, outside(part)).otherwise(part))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def json_leaves(rows: DataFrame, json: str) -> DataFrame:
    """rows, without the JSON column, for each of its leaves: path (names, and places in arrays as text) and value as text.

    Objects and arrays are opened level by level while there are any, so the depth need not be known. Names
    that no schema foresees are there like others; null leaves have a null value, and empty objects and
    arrays, and text that is no JSON, give no row.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c != json]
    left = rows.select(*keep, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    parts = []
    while True:
        kind = F.schema_of_variant("v")
        left = left.withColumn("nests", F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")))
        left = written(left.withColumn("value", F.when(~F.col("nests"), F.variant_get("v", "$", "string"))).withColumn("v", F.when(F.col("nests"), F.to_json("v"))), "json-levels")
        parts.append(left.where("not nests").select(*keep, "path", "value"))
        left = left.where("nests").select(*keep, "path", F.parse_json("v").alias("v"))
        if left.isEmpty():
            break
        opened = left.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("at"), F.col("key").alias("name"), F.col("value").alias("inner")))
        left = opened.select(*keep, F.array_append("path", F.coalesce("name", F.col("at").cast("string"))).alias("path"), F.col("inner").alias("v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
