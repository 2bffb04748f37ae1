"""A3 SQL source and A7 table listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sql_source(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None,
               label: str | None = None) -> DataFrame:
    """A3: run SQL over registered views; an empty result is an error (as
    the reference's 400).  ``isEmpty`` stops at the first row found."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    out = spark.sql(query)
    if out.isEmpty():
        raise ValueError("SQL query returned no rows")
    return out


def jdbc_source(spark: SparkSession, url: str, query: str, properties: dict | None = None,
                partition_column: str | None = None, lower: int | None = None,
                upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A3 against an external database when its JDBC driver jar is on the
    classpath; a partition column splits the read over the executors.
    Empty results are an error, as for ``sql_source``."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper)
             .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism))
    else:
        r = r.option("query", query)
    out = r.load()
    if out.isEmpty():
        raise ValueError("SQL query returned no rows")
    return out


def list_tables(spark: SparkSession) -> DataFrame:
    """The schema listing as a DataFrame ``(type, name, tbl_name)``."""
    rows = [("view" if t.tableType in ("TEMPORARY", "VIEW") else "table", t.name, t.name)
            for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "type string, name string, tbl_name string")


def table_row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """Row count per listed table, as one union of aggregates (one job)."""
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("name"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
