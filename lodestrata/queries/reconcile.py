"""Cleaning, crosswalks, reconciliation, lifecycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import reconcile as R
from lodestrata.operators.ingest import TableContract, one_row_each
from lodestrata.sources.scratch import written
from lodestrata.sources.tables import without_raw

from .registry import query, read


def lineitem(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


@query("""SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part_filled FROM lineitem""")
def q_forward_fill(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("part", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey")))
    return R.forward_fill(df, "part", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "part_filled")


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text), lang) AS duplicate_count, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) AS duplicate_index FROM documents""", long="duplicate_index")
def q_exact_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return R.exact_duplicates(d, ["h", "lang"], ["doc_id"]).select("doc_id", "duplicate_count", "duplicate_index")


@query("""WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), p AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM e)),
r AS (SELECT e.*, n FROM e JOIN p USING (day)), k AS (SELECT DISTINCT user_id, n FROM r), b AS (SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS before FROM k)
SELECT r.user_id, r.event_type, r.day, CASE WHEN r.n = 1 THEN 'first_available_snapshot' WHEN before IS NULL THEN 'newly_seen' WHEN before < r.n - 1 THEN 'reappeared_after_gap'
 WHEN EXISTS (SELECT 1 FROM r o WHERE o.user_id = r.user_id AND o.event_type = r.event_type AND o.n = r.n - 1) THEN 'continued_unchanged' ELSE 'continued_with_attribute_change' END AS status
FROM r JOIN b ON r.user_id = b.user_id AND r.n = b.n""")
def q_lifecycle(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return R.lifecycle(e, "user_id", "event_type", "day")


@query("""SELECT user_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS periods_observed, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS variants FROM events GROUP BY user_id""")
def q_lifecycle_summary(spark, sf_dir):
    return R.lifecycle_summary(read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "event_type", "day")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS fulfilled, count(*) FILTER (o_orderstatus = 'O') AS open,
count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pressing, count(*) FILTER (o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2""")
def q_quarter_summary(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("fulfilled"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("pressing"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_distinct("o_custkey").alias("customers"),
    )


_DIFF = """o AS (SELECT user_id, count(*) AS n, max(event_type) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), w AS (SELECT user_id, count(*) AS n, max(event_type) AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)"""


@query(f"""WITH {_DIFF} SELECT coalesce(o.user_id, w.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'added' WHEN w.user_id IS NULL THEN 'removed' WHEN o.n IS DISTINCT FROM w.n OR o.kind IS DISTINCT FROM w.kind THEN 'changed' ELSE 'unchanged' END AS status,
CASE WHEN o.user_id IS NOT NULL AND w.user_id IS NOT NULL AND (o.n <> w.n OR o.kind <> w.kind) THEN concat_ws(';', CASE WHEN o.n <> w.n THEN 'n' END, CASE WHEN o.kind <> w.kind THEN 'kind' END) END AS changed_fields, w.n - o.n AS n_delta
FROM o FULL JOIN w ON o.user_id = w.user_id""")
def q_revision_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    half = lambda c: e.where(c).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_type").alias("kind"))
    old, new = half(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), half(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    out = R.revision_diff(old.withColumn("kind_n", F.lit(0)), new.withColumn("kind_n", F.lit(0)), "user_id", ["n"])
    kinds = old.select("user_id", F.col("kind").alias("a")).join(new.select("user_id", F.col("kind").alias("b")), "user_id")
    both = out.join(kinds, "user_id", "left")
    differs = F.col("a") != F.col("b")
    status = F.when((F.col("status") == "unchanged") & differs, F.lit("changed")).otherwise(F.col("status"))
    fields = F.when(status == "changed", F.concat_ws(";", "changed_fields", F.when(differs, F.lit("kind"))))
    return both.select("user_id", status.alias("status"), fields.alias("changed_fields"), "n_delta")


@query("""SELECT l_orderkey, CASE WHEN count(v) = count(*) THEN sum(v) END AS strict, sum(v) AS lenient FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 5 > 0 THEN CAST(l_quantity AS BIGINT) END AS v FROM lineitem) GROUP BY 1""", long="strict lenient")
def q_strict_sum(spark, sf_dir):
    v = F.when(F.col("l_linenumber") % 5 > 0, F.col("l_quantity").cast("long"))
    return lineitem(spark, sf_dir).select("l_orderkey", v.alias("v")).groupBy("l_orderkey").agg(R.strict_sum(F.col("v")).alias("strict"), F.sum("v").alias("lenient"))


@query("SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS quantity, count(*) AS n, max(l_partkey) AS last_part FROM lineitem GROUP BY 1", long="quantity")
def q_aggregate_by_id(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("last_part"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags, count(DISTINCT l_returnflag) = 2 AND min(l_returnflag) = 'A' AND max(l_returnflag) = 'R' AS valid FROM lineitem GROUP BY 1""")
def q_group_domain_check(spark, sf_dir):
    flags = F.sort_array(F.collect_set("l_returnflag"))
    return lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(flags, ";").alias("flags"), (flags == F.array(F.lit("A"), F.lit("R"))).alias("valid"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN round(o_totalprice, 2) END AS total FROM orders), p AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * (1 + l_tax) * (1 - l_discount), 2) AS DECIMAL(18,2)))::DOUBLE AS parts, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN total IS NULL THEN 'total_missing' WHEN coalesce(n, 0) = 0 THEN 'components_missing' WHEN abs(total - parts) <= 1e-6 * greatest(1.0, abs(total), abs(parts)) THEN 'reconciled' ELSE 'residual' END AS status, coalesce(n, 0) AS n FROM t LEFT JOIN p ON o_orderkey = l_orderkey""")
def q_component_reconcile(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.round("o_totalprice", 2)).alias("total"))
    line = F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount")), 2).cast("decimal(18,2)")
    p = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(line).cast("double").alias("parts"), F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", R.component_status(F.col("total"), F.col("parts"), n).alias("status"), n.alias("n"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity * round(l_extendedprice / l_quantity, 2) AS b, l_tax AS c, CASE WHEN l_linenumber % 6 > 0 THEN l_tax * 1.0 END AS d FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, 'price' AS check_name, a AS total, b AS expected FROM w UNION ALL SELECT l_orderkey, l_linenumber, 'tax', c, d FROM w)
SELECT l_orderkey, l_linenumber, check_name, CASE WHEN total IS NULL OR expected IS NULL THEN 'not_testable_due_to_blank' WHEN abs(total - expected) <= 1e-6 * greatest(1.0, abs(total), abs(expected)) THEN 'reconciled' ELSE 'mismatch' END AS status FROM x""")
def q_reconcile(spark, sf_dir):
    checks = F.array(
        F.struct(F.lit("price").alias("check_name"), F.col("l_extendedprice").alias("total"), (F.col("l_quantity") * F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("expected")),
        F.struct(F.lit("tax").alias("check_name"), F.col("l_tax").alias("total"), F.when(F.col("l_linenumber") % 6 > 0, F.col("l_tax") * 1.0).alias("expected")),
    )
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(checks).alias("k")).select("l_orderkey", "l_linenumber", "k.check_name", R.check(F.col("k.total"), F.col("k.expected")).alias("status"))


@query("""WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS part, sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS whole FROM lineitem GROUP BY 1)
SELECT l_suppkey, part, whole, part > whole AS violated FROM s""", long="part whole")
def q_subset_violation(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    s = lineitem(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)).alias("part"), F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0)).alias("whole"))
    return s.withColumn("violated", F.col("part") > F.col("whole"))


@query("""SELECT l_orderkey, l_linenumber, measure_name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 4 > 0 THEN l_discount END AS l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR measure_name IN (l_quantity, l_discount, l_tax))""")
def q_melt(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    return R.melt(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("""SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS A, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END) AS N, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS R FROM lineitem GROUP BY 1""", long="A N R")
def q_pivot(spark, sf_dir):
    return lineitem(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("long")).groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("q"))


@query("""WITH b AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 < 8), a AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 IN (1, 9))
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(a.c_acctbal, b.c_acctbal) AS c_acctbal, CASE WHEN b.c_acctbal IS NULL THEN 'new' WHEN a.c_acctbal IS NOT NULL THEN 'amended' ELSE 'baseline' END AS origin
FROM b FULL JOIN a ON b.c_custkey = a.c_custkey WHERE coalesce(b.c_custkey, a.c_custkey) % 10 <> 3""")
def q_overlay_merge(spark, sf_dir):
    c, m = read(spark, sf_dir, "customer"), F.col("c_custkey") % 10
    return R.overlay(c.where(m < 8), c.where(m.isin(1, 9)).withColumn("c_acctbal", F.col("c_acctbal") + 1), c.where(m == 3), "c_custkey", "c_acctbal")


@query("""SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'no_match' ELSE 'matched' END AS status, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON s_nationkey = n_nationkey""")
def q_left_enrich(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 > 0)
    out = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("s_suppkey", F.when(F.col("n_name").isNull(), F.lit("no_match")).otherwise(F.lit("matched")).alias("status"), "n_name")


@query("""WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation)
SELECT i, a.n_name AS old_name, b.n_name AS new_name, a.n_name = b.n_name AS same FROM a JOIN b USING (i)""", long="i")
def q_positional_join(spark, sf_dir):
    n = read(spark, sf_dir, "nation")  # templates are sheets of a few hundred rows
    a = n.select(F.col("n_name").alias("old_name"), F.row_number().over(Window.orderBy("n_nationkey")).alias("i"))
    b = n.select(F.col("n_name").alias("new_name"), F.row_number().over(Window.orderBy("n_name")).alias("i"))
    return a.join(b, "i").withColumn("same", F.col("old_name") == F.col("new_name"))


@query("""WITH o AS (SELECT p_brand, CASE WHEN p_size % 5 > 0 THEN p_size END AS size, count(*) AS n, min(p_partkey) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), w AS (SELECT p_brand, CASE WHEN p_size % 5 > 0 THEN p_size END AS size, count(*) AS n, min(p_partkey) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
SELECT o.p_brand, o.size, o.v AS old_value, w.v AS new_value, CASE WHEN o.n = 1 AND w.n = 1 THEN 'one_to_one' ELSE 'ambiguous' END AS crosswalk_status FROM o JOIN w ON o.p_brand IS NOT DISTINCT FROM w.p_brand AND o.size IS NOT DISTINCT FROM w.size""")
def q_crosswalk_join(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") % 5 > 0, F.col("p_size")))
    return R.crosswalk(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand", "size"], "p_partkey")


@query("""WITH g AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS ids FROM orders GROUP BY 1) SELECT o_custkey, len(ids) AS n_ids, len(list_intersect(ids, ['1-URGENT', '2-HIGH'])) AS covered, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT list_contains(ids, x))) AS missing FROM g""")
def q_group_coverage(spark, sf_dir):
    want = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ids"))
    return g.select("o_custkey", F.size("ids").cast("long").alias("n_ids"), F.size(F.array_intersect("ids", want)).cast("long").alias("covered"), F.size(F.array_except(want, "ids")).cast("long").alias("missing"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem", long="rank")
def q_rank(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc_nulls_last("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return lineitem(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank"))


@query("""SELECT l_orderkey, min(l_linenumber) AS first_number, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS sequential FROM lineitem GROUP BY 1""")
def q_sequence_check(spark, sf_dir):
    n = F.count_distinct("l_linenumber")
    return lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_number"), ((F.max("l_linenumber") - F.min("l_linenumber") + 1 == n) & (F.count(F.lit(1)) == n)).alias("sequential"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS occurrence FROM lineitem", long="occurrence")
def q_chunk_index(spark, sf_dir):
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).alias("occurrence"))


CONTRACT = TableContract(2, "long_metric", ("c_custkey", "c_name", "reporting_year"), ("c_mktsegment", "comment"), ("c_acctbal",), None)


@query("""WITH k AS (SELECT unnest(list_concat(['c_custkey', 'c_nationkey'], CASE WHEN c_custkey % 7 > 0 THEN ['c_name'] ELSE [] END, CASE WHEN c_acctbal < 0 THEN ['c_acctbal'] ELSE [] END, CASE WHEN c_mktsegment = 'BUILDING' THEN ['c_mktsegment'] ELSE [] END)) AS column_name FROM customer), f AS (SELECT column_name, count(*) AS n_rows FROM k GROUP BY 1)
SELECT CASE column_name WHEN 'c_nationkey' THEN 'unknown' WHEN 'c_acctbal' THEN 'excluded_present' WHEN 'c_mktsegment' THEN 'present' ELSE CASE WHEN n_rows < (SELECT count(*) FROM customer) THEN 'incomplete_required' ELSE 'present' END END AS bucket, column_name, n_rows FROM f
UNION ALL SELECT 'missing_optional', 'comment', 0 UNION ALL SELECT 'missing_required', 'reporting_year', 0""", long="n_rows")
def q_column_inventory(spark, sf_dir):
    """Columns that ragged rows of customers have, against their contract."""
    some = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.lit("c_custkey"), F.lit("c_nationkey")), some(F.col("c_custkey") % 7 > 0, "c_name"), some(F.col("c_acctbal") < 0, "c_acctbal"), some(F.col("c_mktsegment") == "BUILDING", "c_mktsegment"))
    return CONTRACT.inventory_rows(read(spark, sf_dir, "customer").select(keys.alias("keys")), "keys")


@query("SELECT c_custkey, c_name FROM customer")
def q_drop_raw_columns(spark, sf_dir):
    return without_raw(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("balance_RAW")))


@query("""SELECT 'doc_id' AS target, 'written' AS outcome, count(*) AS n FROM documents UNION ALL SELECT 'source', 'source repeats: [' || (SELECT string_agg(chr(39) || source || chr(39), ', ' ORDER BY source) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)) || ']', 0""", long="n")
def q_unique_guard(spark, sf_dir):
    """Two writes of the documents, with one output for each number and one for each source; the second is refused."""
    d, outcomes = read(spark, sf_dir, "documents").select("doc_id", "source"), []
    for key in d.columns:
        try:
            outcomes.append((key, "written", written(one_row_each(d, key), "guarded").count()))
        except ValueError as x:
            outcomes.append((key, str(x), 0))
    return spark.createDataFrame(outcomes, "target string, outcome string, n long")


@query("""SELECT (SELECT count(*) FROM (SELECT n_nationkey, n_name FROM nation EXCEPT ALL SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END FROM nation)) AS only_first, (SELECT count(*) FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END FROM nation EXCEPT ALL SELECT n_nationkey, n_name FROM nation)) AS only_second""")
def q_stability(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    b = a.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("X")).otherwise(F.col("n_name")))
    one, two = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_first")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_second"))
    return one.crossJoin(two)


@query("""SELECT event_type, CAST(ts AS DATE) AS day, string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ';' ORDER BY CAST(user_id % 7 AS VARCHAR)) AS triples FROM events GROUP BY 1, 2""")
def q_year_axes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("user_id") % 7).cast("string").alias("v")).distinct()
    return e.groupBy("event_type", "day").agg(F.array_join(F.array_sort(F.collect_list("v")), ";").alias("triples"))


@query("""SELECT p_brand, arg_min(v, p_partkey) AS definition FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name END AS v FROM part) WHERE v IS NOT NULL GROUP BY 1""")
def q_first_nonnull(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_size % 4 > 0")
    return p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("definition"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c) SELECT p_brand, p_type, n, k FROM r WHERE k <= 5""", long="k")
def q_vocab_topn(spark, sf_dir):
    c = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("k <= 5")
