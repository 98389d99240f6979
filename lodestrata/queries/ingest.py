"""Sources, sinks, revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import values as V
from lodestrata.operators import ingest as I
from lodestrata.operators.publish import ObjectStore, Publisher
from lodestrata.sources.jdbc import embedded
from lodestrata.sources.scratch import new_path
from lodestrata.sources.tables import cleaned, is_safe_key, object_uri, read_csv, read_jsonl, write_csv
from lodestrata.sources.workbook import register

from .registry import query, read


@query("""SELECT source, quarter, max(revision) AS revision, arg_max(path, revision) AS path FROM (SELECT source, doc_id % 4 + 1 AS quarter, doc_id AS revision, source || '_Q' || CAST(doc_id % 4 + 1 AS VARCHAR) || '_R' || CAST(doc_id AS VARCHAR) || '.xlsx' AS path FROM documents) GROUP BY ALL""")
def q_latest_revision(spark, sf_dir):
    """Newest revision per source and quarter, all parsed from file names."""
    path = F.concat("source", F.lit("_Q"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("_R"), F.col("doc_id").cast("string"), F.lit(".xlsx"))
    f = read(spark, sf_dir, "documents").select(path.alias("path"))
    part = lambda n: F.regexp_extract("path", r"^(.*)_Q([1-4])_R([0-9]+)\.xlsx$", n)
    f = f.select("path", part(1).alias("source"), part(2).cast("long").alias("quarter"), part(3).cast("long").alias("revision"))
    return f.groupBy("source", "quarter").agg(F.max("revision").alias("revision"), F.max_by("path", F.struct("revision", "path")).alias("path"))


@query("""SELECT c_custkey, c_acctbal + 5 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0""")
def q_upsert_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return I.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 5), "c_custkey")


@query("""SELECT source, doc_id, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT source, doc_id, 0 FROM documents WHERE source = 'src1' AND doc_id % 10 < 5""")
def q_replace_partition(spark, sf_dir):
    """Dynamic overwrite as a plan: partitions of the new rows replace the old ones whole."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    new = d.where("source = 'src1' and doc_id % 10 < 5").withColumn("n_chars", F.lit(0).cast("long"))
    return d.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


@query("""WITH r AS (SELECT source, doc_id AS revision, CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'active' ELSE 'staging' END AS state FROM documents), n AS (SELECT source, max(revision) AS newest FROM r WHERE state <> 'failed' GROUP BY 1)
SELECT source, revision, CASE WHEN state = 'failed' THEN 'failed' WHEN revision = newest THEN 'active' ELSE 'superseded' END AS state FROM r LEFT JOIN n USING (source)""")
def q_revision_activate(spark, sf_dir):
    m = F.col("doc_id") % 5
    r = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("revision"), F.when(m == 0, F.lit("failed")).when(m == 1, F.lit("active")).otherwise(F.lit("staging")).alias("state"))
    return I.activate(r, "source", "revision")


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1""")
def q_skip_unchanged(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit("v2").alias("signature"))
    known = d.where("doc_id % 3 = 0").withColumn("state", F.when(F.col("doc_id") % 2 == 0, F.lit("active")).otherwise(F.lit("superseded")))
    return I.changed(d, known, "doc_id").select("doc_id")


@query("""SELECT CASE WHEN p_size % 6 IN (0, 3) THEN 'rejected' ELSE 'loaded' END AS outcome, count(*) AS n FROM part GROUP BY 1""")
def q_dead_letter(spark, sf_dir):
    from .scalars import _num

    p = read(spark, sf_dir, "part").withColumn("value", V.parse_decimal(_num()))
    good, bad = I.split_bad(p, F.when(F.col("value").isNull(), F.lit("not a number")))
    count = lambda d, name: d.groupBy(F.lit(name).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return count(good, "loaded").union(count(bad, "rejected"))


@query("""SELECT 'orders' AS sheet, o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, 'yyyy-mm-dd' AS date_format FROM orders""")
def q_workbook_rows(spark, sf_dir):
    """Writes the orders to workbooks, one a task and full sheet, and reads all their rows back. Tasks are
    as many as there are cores, four at least: few bytes are much work here."""
    register(spark)
    path = new_path(spark, "workbooks").removeprefix("file://")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    orders.repartition(max(4, spark.sparkContext.defaultParallelism), "o_orderkey").write.format("workbook").option("sheet", "orders").mode("append").save(path)
    rows = spark.read.format("workbook").option("sheet", "orders").load(path).where("row > 1")
    at = lambda i, kind: F.get("cells", F.lit(i)).cast(kind).alias(orders.columns[i])
    return rows.select("sheet", at(0, "bigint"), at(1, "string"), at(2, "double"), at(3, "date"), at(4, "string"), F.get("formats", F.lit(3)).alias("date_format"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","overlap":null,"size":' || p_size || ',"version":"v1"}') AS signature FROM part""")
def q_ingest_signature(spark, sf_dir):
    settings = {"version": F.lit("v1"), "size": F.col("p_size"), "brand": F.col("p_brand"), "overlap": F.lit(None).cast("long")}
    return I.signed(read(spark, sf_dir, "part"), settings).select("p_partkey", "signature")


@query("""SELECT page_id, 's3://bucket/crops/' || page_id || '.png' AS uri, page_id % 3 = 0 AS unsafe FROM pages""")
def q_object_uri(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    key = F.concat(F.lit("crops/"), F.col("page_id").cast("string"), F.lit(".png"))
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.element_at(F.array(F.lit("/"), F.lit("a/../"), F.lit("C:")), (F.col("page_id") / 3).cast("int") % 3 + 1), key)).otherwise(key)
    return p.select("page_id", object_uri("s3://bucket/", key).alias("uri"), (~is_safe_key(odd)).alias("unsafe"))


@query("""WITH p AS (SELECT o_orderstatus AS source, 1 AS revision, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_orderstatus, 2, count(*) FROM orders GROUP BY 1)
SELECT source, revision, CASE revision WHEN 2 THEN 'active' ELSE 'superseded' END AS state, rows FROM p
UNION ALL SELECT source, NULL, 'failed', NULL FROM p WHERE revision = 2""", long="revision rows")
def q_revision_publish(spark, sf_dir):
    """Orders by status as sources: half of them, all of them, all once more, and a load that its check refuses."""
    publisher, orders = Publisher(spark, new_path(spark, "published")), read(spark, sf_dir, "orders")
    for (status,) in orders.select("o_orderstatus").distinct().collect():  # the three states of an order
        mine = orders.where(F.col("o_orderstatus") == status)
        publisher.publish(status, mine.where("o_orderkey % 2 = 0"), "half")
        publisher.publish(status, mine, "whole")
        publisher.publish(status, mine, "whole")
        try:
            publisher.publish(status, mine.select("o_orderkey"), "bad", check=lambda df: None if "o_orderstatus" in df.columns else "no status")
        except ValueError:
            pass
    return publisher.registry().select("source", "revision", "state", "rows")


@query("""SELECT 'host' || page_id % 7 || '/' || page_id || '.html' AS key, strlen(html) AS size, sha256(html) AS sha256 FROM pages WHERE page_id % 7 <> 3""", long="size")
def q_object_store(spark, sf_dir):
    """Puts every page as an object, clears one prefix, and reads the rest."""
    pages, store = read(spark, sf_dir, "pages"), ObjectStore(spark, new_path(spark, "objects"))
    key = F.concat(F.lit("host"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    store.put(pages.select(key.alias("key"), F.col("html").cast("binary").alias("content"))).write.format("noop").mode("overwrite").save()
    store.clear_prefix("host3")
    return store.read().select("key", "size", F.sha2("content", 256).alias("sha256"))


@query("""SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer""")
def q_jdbc_upsert(spark, sf_dir):
    """Customers into a database in two loads, the second again: old rows change, new ones are added, and
    the table is read back in ranges of its key."""
    c, db = read(spark, sf_dir, "customer"), embedded(spark)
    rows = c.select("c_custkey", "c_name", (F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)).alias("c_acctbal"), "c_mktsegment")
    types = {"c_custkey": "BIGINT", "c_name": "VARCHAR(64)", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR(32)"}
    db.upsert(c.where("c_custkey % 2 = 0"), "customers", ["c_custkey"], types)
    db.upsert(rows, "customers", ["c_custkey"], types)
    if db.upsert(rows, "customers", ["c_custkey"], types):
        raise ValueError("a repeated load has changed rows")
    out = db.table("customers", "c_custkey", 4)
    return out.toDF(*(x.lower() for x in out.columns))

@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[=+@-]') THEN chr(39) || t ELSE t END AS text FROM (SELECT conv_id, turn, nullif(trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN '=' ELSE '' END || text || chr(10) || '"quoted", end', '[\s\x{00A0}]+', ' ', 'g')), '') AS t FROM conversations)""")
def q_csv_round_trip(spark, sf_dir):
    """Turns written as CSV, cells that look like formulas made harmless, read back as text and cleaned."""
    path = new_path(spark, "csv")
    text = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("=")).otherwise(F.lit("")), "text", F.lit('\n"quoted", end'))
    write_csv(read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")), path)
    return cleaned(read_csv(spark, path)).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "text")


@query("SELECT conv_id, turn, role, text FROM conversations")
def q_jsonl_scan(spark, sf_dir):
    """Turns written as JSON lines and read by their schema."""
    path = new_path(spark, "jsonl")
    read(spark, sf_dir, "conversations").write.json(path)
    return read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("SELECT n_nationkey, n_name, 1 AS dropped FROM nation", long="dropped")
def q_reset(spark, sf_dir):
    """Of two tables one is reset, beside a name that is no table; the other keeps its rows."""
    mark = new_path(spark, "reset").rsplit("-", 1)[1]
    for name in ("region", "nation"):
        read(spark, sf_dir, name).write.format("parquet").option("path", new_path(spark, "table")).saveAsTable(f"{name}_{mark}")
    dropped = I.reset(spark, [f"region_{mark}", f"absent_{mark}"], confirmed=True)
    return spark.table(f"nation_{mark}").select("n_nationkey", "n_name", F.lit(len(dropped)).alias("dropped"))
