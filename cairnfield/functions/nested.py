"""Nested values: flattened to key and value rows, made JSON-like, canonical text and its hash.

JSON is parsed once into Spark's variant; fields come in the order of their names."""

from __future__ import annotations

import json as _json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, MapType, NumericType, StructType, VariantType

#: Fixed values of the field list: levels opened, children shown of one value, numbers shown in one row.
MAX_DEPTH, MAX_ITEMS, MAX_INLINE = 6, 50, 12
#: Levels below which ``json_like`` gives null.
MAX_LEVELS = 12


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _scalar(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null"))


def _number(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def _opened(rows: DataFrame, depth: int) -> DataFrame:
    """The rows (id, key, at, text, v) of the next level: a row whose ``text`` is set stays, a value that isn't to be opened gets its text,
    others give way to their children.

    What a value holds is a column of its own, so it is taken out once, however often it is asked for."""
    key, at, v, items, fields, n = (F.col(c) for c in ("key", "at", "v", "items", "fields", "n"))
    new, is_array = F.col("text").isNull(), items.isNotNull()
    rows = rows.withColumn("items", F.when(new, _items(v)))
    rows = rows.withColumn("fields", F.when(new & ~is_array, F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))))
    rows = rows.withColumns({"n": F.coalesce(F.array_size(items), F.array_size(fields)), "numbers": is_array & (F.size(items) > 0) & F.forall(items, _number)})
    shown = F.array_join(F.transform(F.slice(items, 1, MAX_INLINE), _scalar), ", ")
    inline = F.concat(F.lit("["), shown, F.when(n > MAX_INLINE, F.concat(F.lit(", … "), n.cast("string"), F.lit(" numbers]"))).otherwise("]"))
    told = F.when(~new, F.col("text")).when(n.isNull(), _scalar(v)).when(F.col("numbers"), inline)
    rows = rows.withColumn("told", told.otherwise(F.to_json(v)) if depth >= MAX_DEPTH else told.when(n == 0, F.when(is_array, "[]").otherwise("{}")))
    # one child more than is shown stands for the rest; the arrays are columns, as those are exploded fastest
    some = lambda c: F.when(F.col("told").isNull(), F.slice(c, 1, MAX_ITEMS + 1))
    rows = rows.select("id", "key", "at", "told", "n", some(items).alias("items"), some(fields).alias("fields"))
    rows = rows.select("id", "key", "at", "told", "n", "fields", F.posexplode_outer("items").alias("i", "item"))
    rows = rows.select("id", "key", "at", "told", "n", "i", "item", F.posexplode_outer("fields").alias("f", "field")).withColumn("pos", F.coalesce("i", "f"))
    pos, name, none = F.col("pos"), F.when(key == "", "(value)").otherwise(key), F.lit(None)
    child = F.when(F.col("i").isNotNull(), F.concat(key, F.lit("["), pos.cast("string"), F.lit("]"))).when(key == "", F.col("field.key")).otherwise(F.concat(key, F.lit("."), F.col("field.key")))
    return rows.select(
        "id",
        F.when(pos.isNull(), name).when(pos == MAX_ITEMS, F.concat(name, F.lit(" …"))).otherwise(child).alias("key"),
        F.when(pos.isNull(), at).otherwise(F.concat(at, F.array(pos))).alias("at"),
        F.when(pos == MAX_ITEMS, F.concat((n - MAX_ITEMS).cast("string"), F.lit(" more not shown"))).when(pos.isNull(), F.col("told")).alias("text"),
        F.when(pos.isNull() | (pos == MAX_ITEMS), none.cast("variant")).when(F.col("i").isNotNull(), F.col("item")).otherwise(F.col("field.value")).alias("v"),
    )


def flattened(df: DataFrame, id_col: str, value: Column) -> DataFrame:
    """(id, n, key, value): the fields of a variant as rows in order, n from 0.

    A short list of numbers is one row, nested values have keys with '.name' or '[i]'. Below MAX_DEPTH levels a value is JSON
    text; of more than MAX_ITEMS children the rest is counted in one row. The key of a bare value is '(value)'; null is 'null'. A row's
    fields stay in one task; rows whose JSON is null give none."""
    rows = df.select(F.col(id_col).alias("id"), F.lit("").alias("key"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("text"), value.alias("v")).where("v IS NOT NULL")
    for depth in range(MAX_DEPTH + 1):
        rows = _opened(rows, depth)
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "key", "text"))).alias("l"))
    return listed.select("id", F.posexplode("l").alias("n", "e")).select("id", "n", "e.key", F.col("e.text").alias("value"))


def canonical(json: Column) -> Column:
    """JSON text with the keys of all objects in order, so that equal values have equal texts; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def canonical_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def json_like(c: Column, kind: DataType, depth: int = 0) -> Column:
    """A typed column as JSON text: maps become lists of entries, bytes lists of numbers, numbers that aren't finite text; below
    MAX_LEVELS levels all is null."""
    null = F.lit("null")
    if depth > MAX_LEVELS:
        return null
    if isinstance(kind, (DoubleType, FloatType)):
        text = F.when(F.isnan(c), F.lit('"NaN"')).when(F.abs(c) == float("inf"), F.when(c > 0, F.lit('"Infinity"')).otherwise(F.lit('"-Infinity"'))).otherwise(c.cast("string"))
    elif isinstance(kind, (NumericType, BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, VariantType):
        text = F.to_json(c)
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10)), ","), F.lit("]"))
        text = F.when(F.length(c) == 0, F.lit("[]")).otherwise(text)
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_like(x, kind.elementType, depth + 1)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(F.lit("["), json_like(e["key"], kind.keyType, depth + 2), F.lit(","), json_like(e["value"], kind.valueType, depth + 2), F.lit("]"))
        text = F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("]"))
    elif isinstance(kind, StructType):
        parts = [F.concat(F.lit(_json.dumps(f.name, ensure_ascii=False) + ":"), json_like(c[f.name], f.dataType, depth + 1)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        text = F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
    return F.coalesce(F.when(c.isNotNull(), text), null)

