"""Checked queries for A1, A3-A7: driver tables are written to a fresh
folder under the shared checkpoint directory and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.parsing import CSV_NULL_TOKENS
from quarry.plans.clean_plan import smart_clean
from quarry.registry import register
from quarry.session import read_table, scratch_path
from quarry.sources.catalog import list_tables, sql_source, table_row_counts
from quarry.sources.records import read_json_records
from quarry.sources.text import export_table, read_csv_text

_TABLES = ("region nation customer supplier part orders lineitem events documents "
           "embeddings pages benchmark labels conversations").split()


@register("csv_text_scan", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_acctbal, c_mktsegment FROM customer""")
def csv_text_scan(spark, sf):
    path = scratch_path(spark, "csv")
    export_table(read_table(spark, sf, "customer"), path, "csv")
    full, _, _ = smart_clean(read_csv_text(spark, path))
    return full


@register("csv_text_raw", """SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name,
  CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation""")
def csv_text_raw(spark, sf):
    path = scratch_path(spark, "csvraw")
    export_table(read_table(spark, sf, "nation"), path, "csv")
    return read_csv_text(spark, path)


@register("csv_headers_mixed", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CASE WHEN c_custkey % 3 < 2 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
  CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS segment FROM customer""")
def csv_headers_mixed(spark, sf):
    # one folder, three headers: other orders of the columns, and other columns
    path = scratch_path(spark, "csvmixed")
    c = read_table(spark, sf, "customer")
    for kind, columns in enumerate((["c_custkey", "c_name", "c_nationkey"], ["c_nationkey", "c_custkey", "c_name"],
                                    ["c_name", "c_mktsegment AS segment", "c_custkey"])):
        export_table(c.where(F.col("c_custkey") % 3 == kind).selectExpr(*columns), path, "csv", "append")
    return read_csv_text(spark, path)


_TOKENS_SQL = ", ".join("'" + t + "'" for t in CSV_NULL_TOKENS)


@register("csv_multiline_parallel", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
  CASE WHEN text IN ({_TOKENS_SQL}) THEN NULL ELSE text END AS text,
  'a "quoted"' || chr(10) || chr(10) || '"' || source || '",' AS note, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_multiline_parallel(spark, sf):
    # texts of many lines, quotes that double, and a field that ends in a comma
    path = scratch_path(spark, "csvlines")
    note = F.concat(F.lit('a "quoted"\n\n"'), "source", F.lit('",'))
    export_table(read_table(spark, sf, "documents").select("doc_id", "lang", "text", note.alias("note"), "n_chars"), path, "csv")
    return read_csv_text(spark, path)


@register("json_records", """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
  CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def json_records(spark, sf):
    path = scratch_path(spark, "jsonl")
    export_table(read_table(spark, sf, "nation"), path, "json")
    return read_json_records(spark, path)


@register("json_envelope", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_acctbal, c_mktsegment FROM customer""")
def json_envelope(spark, sf):
    # one {"data": [...]} document per block of 100 customer keys
    path = scratch_path(spark, "envelope")
    c = read_table(spark, sf, "customer")
    env = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("blk")).agg(
        F.collect_list(F.struct(*c.columns)).alias("data")).select("data")
    env.write.json(path)
    return read_json_records(spark, path)


@register("json_mixed", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer")
def json_mixed(spark, sf):
    # one folder with three kinds of documents: {"data": [...]}, {"results": [...]} and bare records
    path = scratch_path(spark, "mixed")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    for kind, key in enumerate(("data", "results")):
        c.where(F.col("c_custkey") % 3 == kind).groupBy(F.floor(F.col("c_custkey") / 100).alias("blk")).agg(
            F.collect_list(F.struct(*c.columns)).alias(key)).select(key).write.mode("append").json(path)
    c.where(F.col("c_custkey") % 3 == 2).write.mode("append").json(path)
    return read_json_records(spark, path)


@register("json_shapes", """SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS "who.name", c_acctbal AS "who.balance",
  CASE WHEN c_custkey % 5 = 3 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS tag FROM customer""")
def json_shapes(spark, sf):
    # `data` is a list, an object beside a list of items, absent; the document is a list, or the record
    path = scratch_path(spark, "shapes")
    kind = (F.col("c_custkey") % 5).alias("kind")
    tag = F.when(F.col("c_custkey") % 5 == 3, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment"))
    record = F.struct(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("who"),
                      tag.alias("tag"))
    c = read_table(spark, sf, "customer").select(kind, F.floor(F.col("c_custkey") / 40).alias("block"), record.alias("r"))
    lists = c.where("kind < 4").groupBy("kind", "block").agg(F.collect_list("r").alias("l"))
    shapes = F.when(F.col("kind") == 0, F.to_json(F.struct(F.col("l").alias("data")))).when(
        F.col("kind") == 1, F.to_json(F.struct(F.struct(F.col("block").alias("x")).alias("data"), F.col("l").alias("items")))).when(
        F.col("kind") == 2, F.to_json(F.struct(F.col("l").alias("results"), F.col("block").alias("page")))).otherwise(F.to_json("l"))
    lists.select(shapes.alias("value")).unionByName(c.where("kind = 4").select(F.to_json("r").alias("value"))).write.text(path)
    return read_json_records(spark, path)


@register("json_flatten", """SELECT o_orderkey, o_custkey AS "cust.key",
  o_orderpriority AS "cust.info.priority", o_orderstatus AS "cust.info.status",
  o_totalprice FROM orders""")
def json_flatten(spark, sf):
    path = scratch_path(spark, "nested")
    o = read_table(spark, sf, "orders")
    nested = o.select("o_orderkey", F.struct(
        F.col("o_custkey").alias("key"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.col("o_orderpriority").alias("priority")).alias("info")).alias("cust"),
        "o_totalprice")
    nested.write.json(path)
    return read_json_records(spark, path)


@register("export_roundtrip", "SELECT * FROM orders")
def export_roundtrip(spark, sf):
    path = scratch_path(spark, "export")
    export_table(read_table(spark, sf, "orders"), path, "parquet")
    return spark.read.parquet(path)


@register("export_csv_clean", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  o_orderdate, o_orderpriority FROM orders""")
def export_csv_clean(spark, sf):
    path = scratch_path(spark, "exportcsv")
    export_table(read_table(spark, sf, "orders"), path, "csv")
    full, _, _ = smart_clean(read_csv_text(spark, path))
    return full


_SEG_SQL = """SELECT c.c_mktsegment, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment"""


@register("sql_source_join_agg", _SEG_SQL)
def sql_source_join_agg(spark, sf):
    return sql_source(spark, _SEG_SQL, {"orders": read_table(spark, sf, "orders"),
                                        "customer": read_table(spark, sf, "customer")})


@register("list_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS name, 'view' AS type, '{t}' AS tbl_name, count(*) AS rows FROM {t}" for t in _TABLES))
def list_tables_q(spark, sf):
    """Registers every driver table as a view and lists it with its row count."""
    for t in _TABLES:
        read_table(spark, sf, t).createOrReplaceTempView(t)
    listing = list_tables(spark).where(F.col("name").isin(_TABLES))
    return listing.join(table_row_counts(spark, _TABLES), "name")
