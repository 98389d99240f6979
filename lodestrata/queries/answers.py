"""Answer side: citations, adapters, verified rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, read


@query("""WITH c AS (SELECT DISTINCT conv_id, turn * 3 % 7 AS cited FROM conversations), k AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT c.conv_id, cited, CASE WHEN k.turn IS NULL THEN 'unknown' ELSE 'valid' END AS status, max(CASE WHEN k.turn IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY c.conv_id) = 0 AS no_valid FROM c LEFT JOIN k ON c.conv_id = k.conv_id AND c.cited = k.turn""")
def q_citation_validate(spark, sf_dir):
    """Cited ids, once each, against the ids that were given; an answer without a valid one is an error."""
    t = read(spark, sf_dir, "conversations")
    given = t.groupBy("conv_id").agg(F.collect_set("turn").alias("given"), F.array_distinct(F.collect_list(F.col("turn") * 3 % 7)).alias("cited"))
    none = F.size(F.array_intersect("cited", "given")) == 0
    x = given.select("conv_id", "given", none.alias("no_valid"), F.explode("cited").alias("cited"))
    return x.select("conv_id", "cited", F.when(F.array_contains("given", F.col("cited")), F.lit("valid")).otherwise(F.lit("unknown")).alias("status"), "no_valid")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS origin FROM events""")
def q_adapt(spark, sf_dir):
    """Nested metadata with a fallback."""
    nested = F.get_json_object("props", "$.k").try_cast("int")
    origin = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("event_type")), F.get_json_object("props", "$.origin"), F.lit("none"))
    return read(spark, sf_dir, "events").select("event_id", nested.alias("k"), origin.alias("origin"))


@query("""SELECT o_custkey, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row, string_agg(CAST(o_orderkey AS VARCHAR) || '=' || o_orderstatus, '; ' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1""")
def q_verified_chunk(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit("="), r["o_orderstatus"])), "; ")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"), body.alias("body"))


@query("""SELECT p_brand, 'Concept: ' || p_brand || chr(10) || 'Rows: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'Types: ' || string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS card FROM part GROUP BY p_brand""")
def q_cards_concept(spark, sf_dir):
    types = F.array_join(F.sort_array(F.collect_set("p_type")), "; ")
    card = F.concat_ws("\n", F.concat(F.lit("Concept: "), "p_brand"), F.concat(F.lit("Rows: "), F.count(F.lit(1)).cast("string")), F.concat(F.lit("Types: "), types))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(card.alias("card"))


@query("""SELECT 'Orders ' || CAST(min(year(o_orderdate)) AS VARCHAR) || ' to ' || CAST(max(year(o_orderdate)) AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) || ' rows, ' || CAST(count(DISTINCT o_custkey) AS VARCHAR) || ' customers' AS card FROM orders""")
def q_cards_overview(spark, sf_dir):
    y = F.year("o_orderdate")
    text = lambda c: c.cast("string")
    return read(spark, sf_dir, "orders").agg(F.concat(F.lit("Orders "), text(F.min(y)), F.lit(" to "), text(F.max(y)), F.lit(": "), text(F.count(F.lit(1))), F.lit(" rows, "), text(F.count_distinct("o_custkey")), F.lit(" customers")).alias("card"))


@query("""SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, 'Work orders ' || o_orderstatus || ' ' || CAST(year(o_orderdate) AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) AS card FROM orders GROUP BY 1, 2, year(o_orderdate)""")
def q_cards_work_order(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("status", "year", F.concat(F.lit("Work orders "), "status", F.lit(" "), F.col("year").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("card"))


@query("""SELECT d.source, count(*) AS orphans FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL GROUP BY 1""")
def q_orphan_cards(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))
