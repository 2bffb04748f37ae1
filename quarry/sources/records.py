"""A4 JSON records (list, envelope or single object) and A5 flattening."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Envelope keys looked up in this order.
ENVELOPE_KEYS = ["data", "results", "items"]


def flatten_json(df: DataFrame, sep: str = ".") -> DataFrame:
    """A5 (``json_normalize``): nested structs become dotted columns
    ``a.b.c``; arrays and maps are kept whole; one row per object."""
    cols = []

    def walk(prefix, path, dt):
        if isinstance(dt, T.StructType) and len(dt.fields) > 0:
            for f in dt.fields:
                walk(prefix + [f.name], path + [f.name], f.dataType)
        else:
            ref = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
            cols.append(ref.alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], [f.name], f.dataType)
    return df.select(*cols)


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON documents (one a line, or with ``multi_line`` one a file) as a column ``doc`` of type variant: each
    keeps its own shape, none is inferred."""
    return spark.read.format("json").option("singleVariantColumn", "doc").option("multiLine", multi_line).load(path)


def _at(name: str) -> str | None:
    """Variant path of a key; None if it needs another way."""
    return f"$['{name}']" if re.fullmatch(r"[\w .:/@#+-]+", name) else None


def _field(value: Column, name: str, ddl: str) -> Column:
    path = _at(name)
    if path:
        return F.try_variant_get(value, path, ddl)
    return F.try_variant_get(F.try_variant_get(value, "$", "map<string,variant>")[name], "$", ddl)


def document_records(docs: DataFrame) -> DataFrame:
    """One row ``record`` (variant) per record.  A document that is a list holds its elements; an object holds
    the list under the first of the envelope keys that has one, else it is a record itself."""
    lists = [F.try_variant_get("doc", "$", "array<variant>"), *[F.try_variant_get("doc", f"$.{k}", "array<variant>") for k in ENVELOPE_KEYS]]
    single = F.when(F.try_variant_get("doc", "$", "map<string,variant>").isNotNull(), F.array("doc"))
    held = F.coalesce(*lists, single)
    # a scalar or a malformed document is an error in whatever task meets it
    wrong = F.raise_error(F.lit("JSON payload is not an object or a list of objects")).cast("array<variant>")
    return docs.select(F.explode(F.when(held.isNull(), wrong).otherwise(held)).alias("record"))


def _ddl(dt: T.DataType) -> str:
    """The type in which a value of a variant's schema is returned: fractions as double, whole numbers beyond
    a long as decimal, values of several types and empty objects as JSON text."""
    if isinstance(dt, T.ArrayType):
        return f"array<{_ddl(dt.elementType)}>"
    if isinstance(dt, T.StructType) and dt.fields:
        return "struct<" + ", ".join("`" + f.name.replace("`", "``") + "`: " + _ddl(f.dataType) for f in dt.fields) + ">"
    if isinstance(dt, T.DecimalType):
        return "double" if dt.scale else "decimal(38,0)"
    if isinstance(dt, (T.StructType, T.VariantType, T.NullType)):
        return "string"
    return dt.simpleString()


def _schema(text: str | None) -> T.DataType:
    """Spark's type of a variant schema; both are written alike, but for objects."""
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text or "VOID")
    return T.DataType.fromDDL(ddl)


def flatten_records(records: DataFrame) -> DataFrame:
    """A5 on variants: one aggregate merges the records' schemas (one row), then every leaf is a column
    ``a.b.c``.  Arrays are kept whole; a key that holds values of several types is text.  Elements that are no
    objects are text in column ``0``."""
    is_object = F.try_variant_get("record", "$", "map<string,variant>").isNotNull()
    no_object = ~is_object & ~F.is_variant_null("record")
    found = records.agg(F.schema_of_variant_agg(F.when(is_object, F.col("record"))).alias("s"), F.max(no_object).alias("plain")).first()
    columns = []

    def walk(prefix: list[str], value: Column, dt: T.StructType) -> None:
        for f in dt.fields:
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                walk([*prefix, f.name], _field(value, f.name, "variant"), f.dataType)
            else:
                columns.append(_field(value, f.name, _ddl(f.dataType)).alias(".".join([*prefix, f.name])))

    schema = _schema(found["s"])
    if isinstance(schema, T.StructType):
        walk([], F.col("record"), schema)
    if found["plain"]:
        columns.append(F.when(no_object, F.try_variant_get("record", "$", "string")).alias("0"))
    return records.select(*columns)


def read_json_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A4: JSON documents (JSON Lines by default; ``multi_line`` for whole-file documents) as flat records.
    Every document decides for itself by its shape, so one folder may hold lists, envelopes and bare objects."""
    return flatten_records(document_records(read_documents(spark, path, multi_line)))
