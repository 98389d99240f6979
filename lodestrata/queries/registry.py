"""Where queries register, and the shapes they share: facts, records, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, long: str = "") -> Callable:
    """Register a query under its function's name. Columns named in ``long`` are 64-bit on both
    sides: row numbers are narrower in Spark, integer sums wider in DuckDB."""
    columns = long.split()

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in columns}) if columns else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
            SQL[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if columns else sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts from the order tables: exact values with dimensions. Nation and region are a
    fixed 25 and 5 rows; the large joins are left to Spark's measured sizes."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    rows = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        (F.col("l_linenumber") % 3).cast("string").alias("revision_id"),
        F.lit(2).alias("table_number"),
        F.concat("l_returnflag", "l_linestatus").alias("metric_name"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value_numeric"),
        F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("line_type"),
        F.lit("dollars").alias("unit"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("nation"), F.col("n_name")).alias("dimensions"),
    )


FACTS = """facts AS (
SELECT l_orderkey * 10 + l_linenumber AS fact_id, CAST(l_linenumber % 3 AS VARCHAR) AS revision_id, l_returnflag || l_linestatus AS metric_name,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS value_numeric, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
 r_name AS region, c_mktsegment AS line_type, o_orderpriority AS priority, n_name AS nation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def registry_rows(spark: SparkSession) -> DataFrame:
    """Revision states of the facts' three revisions."""
    return spark.createDataFrame([("0", "superseded"), ("1", "active"), ("2", "active")], "revision_id string, state string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_key"),
        F.col("o_orderkey").alias("record_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("revision_id"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(13).alias("table_number"),
        F.create_map(F.lit("exact_duplicate_index"), (F.col("o_custkey") % 3).cast("string")).alias("attributes"),
    )


CONTENT_TYPES = {"en": "narrative", "fr": "table", "de": "figure", "es": "excel_card"}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence chunks from documents: type by language, caption of six words, section by source,
    for figures the next six words as a hint."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv)), F.col("lang"))
    words = F.split("text", " ", 13)  # twelve words and the rest
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.coalesce(kind, F.lit("narrative")).alias("content_type"),
        F.array_join(F.slice(words, 1, 6), " ").alias("caption"),
        F.col("source").alias("breadcrumb"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 100).alias("page"),
        F.when(F.col("lang") == "de", F.array_join(F.slice(words, 7, 6), " ")).alias("hint"),
    )


CHUNKS = """chunks AS (
SELECT doc_id AS chunk_id, CASE lang WHEN 'fr' THEN 'table' WHEN 'de' THEN 'figure' WHEN 'es' THEN 'excel_card' ELSE 'narrative' END AS content_type,
 array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS caption, source AS breadcrumb, text AS content, doc_id % 100 AS page,
 CASE WHEN lang = 'de' THEN array_to_string(list_slice(string_split(text, ' '), 7, 12), ' ') END AS hint
FROM documents)"""
