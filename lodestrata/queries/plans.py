"""The plan engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import batch, bind
from lodestrata.plans import generate as G
from lodestrata.plans.execute import active, execute, filtered, metadata, provenance
from lodestrata.plans.model import ClarificationNeeded, Filter, Plan

from .registry import FACTS, facts, query, read, records, registry_rows

SINCE = Filter("year", "gte", 1996)


def _by_period(aggregate: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan(aggregate=aggregate, filters=(SINCE,), group_by=("metric_name", "year", "quarter"), limit=200)
        kind = "long" if aggregate == "count" else "double"
        return execute(plan, facts(spark, sf_dir), registry_rows(spark)).withColumn("value", F.round(F.col("value").cast(kind), 6))

    return run


for _a in ("sum", "avg", "count", "min", "max"):
    _f = _by_period(_a)
    _f.__name__ = f"q_plan_{_a}"
    _value = "count(value_numeric)" if _a == "count" else "round(sum(value_numeric)::DOUBLE / count(value_numeric), 6)" if _a == "avg" else f"round({_a}(value_numeric)::DOUBLE, 6)"
    query(f"WITH {FACTS} SELECT metric_name, year, quarter, {_value} AS value FROM facts WHERE revision_id IN ('1', '2') AND year >= 1996 GROUP BY ALL ORDER BY metric_name, year, quarter LIMIT 200")(_f)


@query("WITH o AS (SELECT o_orderstatus AS status, year(o_orderdate) AS year FROM orders WHERE o_orderkey % 3 > 0) SELECT status, CAST(year AS INTEGER) AS year, count(*) AS value FROM o GROUP BY ALL")
def q_plan_record_count(spark, sf_dir):
    return execute(Plan(source="records", aggregate="count", group_by=("status", "year")), records(spark, sf_dir), registry_rows(spark))


@query(f"WITH {FACTS} SELECT metric_name, region, round(sum(value_numeric)::DOUBLE, 6) AS value FROM facts WHERE revision_id IN ('1', '2') AND year <> 1998 AND quarter <= 3 AND quarter > 1 AND region < 'E' GROUP BY ALL")
def q_plan_filters(spark, sf_dir):
    f = (Filter("year", "ne", 1998), Filter("quarter", "lte", 3), Filter("quarter", "gt", 1), Filter("region", "lt", "E"))
    return execute(Plan(filters=f, group_by=("metric_name", "region")), facts(spark, sf_dir), registry_rows(spark)).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {FACTS} SELECT metric_name, region, round(sum(value_numeric)::DOUBLE, 6) AS value FROM facts WHERE revision_id IN ('1', '2') AND priority > '2' GROUP BY ALL")
def q_plan_json_filter(spark, sf_dir):
    plan = Plan(filters=(Filter("priority", "gt", 2, json_key=True),), group_by=("metric_name", "region"))
    return execute(plan, facts(spark, sf_dir), registry_rows(spark)).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"""WITH {FACTS}, t AS (SELECT line_type, region, sum(value_numeric) AS v FROM facts WHERE revision_id IN ('1', '2') GROUP BY ALL)
SELECT line_type, region, round(v::DOUBLE, 6) AS value, row_number() OVER (ORDER BY v DESC NULLS LAST, region, line_type) AS rank FROM t ORDER BY rank LIMIT 10""", long="rank")
def q_plan_rank(spark, sf_dir):
    top = execute(Plan(operation="rank", group_by=("region", "line_type"), limit=10), facts(spark, sf_dir), registry_rows(spark))
    from pyspark.sql import Window

    order = Window.orderBy(F.col("value").desc_nulls_last(), "region", "line_type")  # over the ten rows of the answer
    return top.withColumn("rank", F.row_number().over(order)).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("""SELECT status, year, record_id, exact_duplicate_index FROM (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS record_id, CAST(o_custkey % 3 AS VARCHAR) AS exact_duplicate_index FROM orders WHERE o_orderkey % 3 > 0) AS o
WHERE year = 1996 AND exact_duplicate_index > '0' ORDER BY record_id DESC NULLS LAST, status, year, exact_duplicate_index LIMIT 50""")
def q_plan_select(spark, sf_dir):
    f = (Filter("year", "eq", 1996), Filter("exact_duplicate_index", "gt", 0, json_key=True))
    plan = Plan(source="records", operation="select", filters=f, group_by=("status", "year", "record_id"), json_keys=("exact_duplicate_index",), order_by="record_id", limit=50)
    return execute(plan, records(spark, sf_dir), registry_rows(spark))


@query(f"WITH {FACTS} SELECT revision_id, count(*) AS n, round(sum(value_numeric)::DOUBLE, 6) AS total FROM facts WHERE revision_id IN ('1', '2') GROUP BY ALL")
def q_active_only(spark, sf_dir):
    return active(facts(spark, sf_dir), registry_rows(spark)).groupBy("revision_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_numeric").cast("double"), 6).alias("total"))


@query("SELECT o_orderstatus AS status, count(*) AS value FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 3 > 0 GROUP BY ALL")
def q_dedupe_default(spark, sf_dir):
    plan = Plan(source="records", aggregate="count", group_by=("status",), dedupe=(("exact_duplicate_index", "1"),))
    return execute(plan, records(spark, sf_dir), registry_rows(spark))


_MIXED = "u AS (SELECT *, CASE WHEN metric_name = 'AF' AND quarter = 1 THEN 'thousands' ELSE 'dollars' END AS unit FROM facts WHERE revision_id IN ('1', '2'))"


def _mixed(spark, sf_dir):
    """Facts of which some have another unit."""
    other = (F.col("metric_name") == "AF") & (F.col("quarter") == 1)
    return facts(spark, sf_dir).withColumn("unit", F.when(other, F.lit("thousands")).otherwise(F.col("unit")))


@query(f"""WITH {FACTS}, {_MIXED} SELECT metric_name, count(value_numeric) AS contributing, string_agg(DISTINCT unit, ';' ORDER BY unit) AS units, min(revision_id) AS first_revision,
 CASE WHEN count(DISTINCT unit) > 1 THEN 'refused' ELSE 'ok' END AS unit_status FROM u GROUP BY ALL""")
def q_plan_metadata(spark, sf_dir):
    return metadata(Plan(), _mixed(spark, sf_dir), registry_rows(spark), by=["metric_name"])


@query(f"""WITH {FACTS}, {_MIXED} SELECT count(value_numeric) AS contributing, string_agg(DISTINCT unit, ';' ORDER BY unit) AS units, min(revision_id) AS first_revision, CASE WHEN count(DISTINCT unit) > 1 THEN 'refused' ELSE 'ok' END AS unit_status FROM u WHERE year = 1997""")
def q_unit_guard(spark, sf_dir):
    return metadata(Plan(filters=(Filter("year", "eq", 1997),)), _mixed(spark, sf_dir), registry_rows(spark))


@query(f"WITH {FACTS} SELECT fact_id, metric_name, value_numeric::DOUBLE AS value FROM facts WHERE revision_id IN ('1', '2') AND year = 1997 AND value_numeric IS NOT NULL ORDER BY fact_id LIMIT 5")
def q_provenance_sample(spark, sf_dir):
    return provenance(Plan(filters=(Filter("year", "eq", 1997),)), facts(spark, sf_dir), registry_rows(spark)).select("fact_id", "metric_name", F.col("value_numeric").cast("double").alias("value"))


@query(f"""WITH {FACTS}, p AS (SELECT DISTINCT 'region' AS dimension, region AS value FROM facts UNION SELECT 'metric_name', metric_name FROM facts UNION SELECT 'priority', priority FROM facts UNION SELECT 'nation', nation FROM facts)
SELECT dimension, value FROM p WHERE dimension IN (SELECT dimension FROM p GROUP BY dimension HAVING count(*) BETWEEN 2 AND 200)""")
def q_dimension_vocab(spark, sf_dir):
    return bind.vocabulary(facts(spark, sf_dir), ["region", "metric_name"])


@query(f"WITH {FACTS} SELECT metric_name, line_type, count(*) AS n FROM facts GROUP BY ALL ORDER BY n DESC, metric_name, line_type LIMIT 10")
def q_top_concepts(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("metric_name", "line_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "metric_name", "line_type").limit(10)


@query(f"""WITH {FACTS}, a AS (SELECT metric_name, coalesce(sum(value_numeric), 0) AS stored, count(value_numeric) AS n FROM facts GROUP BY 1),
b AS (SELECT l_returnflag || l_linestatus AS metric_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS recomputed FROM lineitem GROUP BY 1)
SELECT metric_name, n, stored::DOUBLE AS stored, stored = recomputed AS exact FROM a JOIN b USING (metric_name)""")
def q_exact_sum_check(spark, sf_dir):
    stored = facts(spark, sf_dir).groupBy("metric_name").agg(F.coalesce(F.sum("value_numeric"), F.lit(0)).alias("stored"), F.count("value_numeric").alias("n"))
    raw = read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("metric_name")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("recomputed"))
    return stored.join(raw, "metric_name").select("metric_name", "n", F.col("stored").cast("double").alias("stored"), (F.col("stored") == F.col("recomputed")).alias("exact"))


_QUESTIONS = """q AS (SELECT o_orderkey AS question_id, 'In Q' || CAST(quarter(o_orderdate) AS VARCHAR) || ' of ' || CAST(2018 + year(o_orderdate) % 8 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN ' or 2021' ELSE '' END || ', what was the total for ' || lower(n_name) || ' with priority ' || o_orderpriority || '?' AS question
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def questions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("In Q"), F.quarter("o_orderdate").cast("string"), F.lit(" of "), (2018 + F.year("o_orderdate") % 8).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(" or 2021")).otherwise(F.lit("")), F.lit(", what was the total for "), F.lower("n_name"), F.lit(" with priority "), F.col("o_orderpriority"), F.lit("?")).alias("question"),
    )


@query(f"""WITH {_QUESTIONS}, m AS (SELECT question_id, list_distinct(regexp_extract_all(question, '\\b(20[23][0-9])\\b', 1)) AS y, list_distinct(regexp_extract_all(upper(question), '\\bQ([1-4])\\b', 1)) AS k FROM q)
SELECT question_id, CAST(CASE WHEN len(y) = 1 THEN y[1] END AS INTEGER) AS year, CAST(CASE WHEN len(k) = 1 THEN k[1] END AS INTEGER) AS quarter FROM m""")
def q_bind_period(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", bind.bind_year(F.col("question")).alias("year"), bind.bind_quarter(F.col("question")).alias("quarter"))


@query(f"""WITH {_QUESTIONS}, v AS (SELECT DISTINCT 'nation' AS dimension, n_name AS value FROM nation UNION SELECT DISTINCT 'priority', o_orderpriority FROM orders),
h AS (SELECT question_id, dimension, value, row_number() OVER (PARTITION BY question_id, dimension ORDER BY length(value) DESC, value DESC) AS n FROM q, v
 WHERE length(value) >= 3 AND NOT regexp_matches(value, '^[-.0-9]+$') AND contains(lower(question), lower(trim(value))) AND contains(' ' || regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) || ' '))
SELECT question_id, dimension, value FROM h WHERE n = 1""")
def q_bind_dimensions(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.lit("nation").alias("dimension"), F.col("n_name").alias("value"))
    vocab = nations.union(read(spark, sf_dir, "orders").select(F.lit("priority"), F.col("o_orderpriority"))).distinct()
    return bind.bind_dimensions(questions(spark, sf_dir), vocab)


_CARDS = """c AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'How many orders in ' ELSE 'Total of orders in ' END || CASE WHEN o_orderkey % 7 < 5 THEN CAST(2018 + year(o_orderdate) % 8 AS VARCHAR) ELSE 'all years' END || '?' AS question,
 CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 13) / 12.0 END AS card_score, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 13 WHEN 2 THEN 14 ELSE 2 END AS card_table, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'spend' END AS metric_key,
 CASE WHEN o_orderkey % 17 = 0 THEN 'bad' END AS plan_error FROM orders),
f AS (SELECT l_orderkey AS question_id, sum(CASE WHEN l_quantity > 10 THEN l_quantity END) AS total, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_CARDS}, m AS (SELECT c.*, list_distinct(regexp_extract_all(question, '\\b(20[23][0-9])\\b', 1)) AS y, CASE WHEN card_table = 13 THEN n ELSE total END AS value, n AS contributing FROM c LEFT JOIN f USING (question_id))
SELECT question_id, CASE WHEN card_score IS NULL THEN 'declined: no card' WHEN card_score < 0.3 THEN 'declined: card below the floor' WHEN card_table IS NULL THEN 'declined: card names no table'
 WHEN card_table = 13 AND NOT contains(lower(question), 'how many') THEN 'declined: records, but no count is asked for' WHEN card_table <> 13 AND coalesce(metric_key, '') = '' THEN 'declined: card names no metric'
 WHEN plan_error IS NOT NULL THEN 'declined: no valid plan' WHEN len(y) <> 1 THEN 'declined: no period' WHEN card_table = 14 THEN 'declined: plan refused' WHEN value IS NULL THEN 'declined: no value'
 WHEN card_table = 13 AND value = 0 THEN 'declined: no records match' WHEN card_table <> 13 AND coalesce(contributing, 0) = 0 THEN 'declined: no facts contribute' ELSE 'answer' END AS outcome FROM m""")
def q_excel_gate(spark, sf_dir):
    """Every reason of the gate on cards and sums from the order tables; table 14 has two year axes."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    year = F.when(key % 7 < 5, (2018 + F.year("o_orderdate") % 8).cast("string")).otherwise(F.lit("all years"))
    cards = read(spark, sf_dir, "orders").select(
        key.alias("question_id"),
        F.concat(F.when(key % 3 == 0, F.lit("How many orders in ")).otherwise(F.lit("Total of orders in ")), year, F.lit("?")).alias("question"),
        F.when(key % 11 > 0, (key % 13) / 12.0).alias("card_score"),
        F.when(customer % 5 == 1, 13).when(customer % 5 == 2, 14).when(customer % 5 > 2, 2).alias("card_table"),
        F.when(customer % 4 == 0, F.lit("")).when(customer % 4 > 1, F.lit("spend")).alias("metric_key"),
        F.when(key % 17 == 0, F.lit("bad")).alias("plan_error"),
    )
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.sum(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))).alias("total"), F.count_if(F.col("l_quantity") > 25).alias("contributing"))
    asked = cards.join(sums, "question_id", "left").withColumn("bound_year", bind.bind_year(F.col("question")))
    asked = asked.withColumn("value", F.when(F.col("card_table") == 13, F.col("contributing").cast("double")).otherwise(F.col("total")))
    try:
        Plan(table_number=14, filters=(Filter("reporting_year", "eq", 2023),)).validate()
        refused = None
    except ClarificationNeeded as x:
        refused = str(x)
    asked = asked.withColumn("refusal", F.when(F.col("card_table") == 14, F.lit(refused)))
    return asked.select("question_id", bind.excel_outcome(asked).alias("outcome"))


def part_plans(spark, sf_dir):
    """A plan of every part: right and wrong ones of each rule by the part's number."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(k + n, F.lit(len(values))) + 1).cast("int"))
    field = pick(0, "year", "reporting_year", "region", "year_basis", "source_vintage_year", "nation", "unit")
    two = F.struct(field.alias("field"), pick(1, "eq", "gte", "ne", "like", "lt", "eq", "gt", "lte", "eq", "eq", "eq").alias("operator"), F.lit("2023").alias("value"), (k % 5 == 0).alias("json_key"))
    one = F.struct(F.lit("reporting_year").alias("field"), F.lit("eq").alias("operator"), F.lit("2023").alias("value"), F.lit(False).alias("json_key"))
    return read(spark, sf_dir, "part").select(
        k.cast("string").alias("plan_id"), pick(0, "facts", "records", "facts", "facts", "records", "facts", "views").alias("source"), pick(0, "aggregate", "rank", "select", "aggregate", "aggregate").alias("operation"),
        pick(2, "sum", "count", "avg", "min", "count", "max", "count", "sum", "median").alias("aggregate"), F.col("p_size").cast("int").alias("table_number"), F.lit(None).cast("string").alias("semantic_metric_key"), F.lit(None).cast("string").alias("measure_name"),
        F.when(k % 3 == 0, F.array(two)).when(k % 3 == 1, F.array(two, one)).otherwise(F.array(one)).alias("filters"),
        F.when(k % 4 == 0, F.array(F.lit("region"))).when(k % 29 == 1, F.array(F.lit("nation"))).otherwise(F.array().cast("array<string>")).alias("group_by"), F.when(k % 6 == 2, F.array(F.lit("priority"))).otherwise(F.array().cast("array<string>")).alias("json_keys"),
        F.when(k % 7 == 0, F.lit("region")).when(k % 7 == 1, F.lit("value")).alias("order_by"), F.lit(True).alias("descending"), (k % 23 * 10).cast("int").alias("limit"), F.when(k % 13 == 0, F.lit("reported")).alias("year_basis"), (k % 11 > 0).alias("require_year_basis"),
    )


_ALLOWED = "['table_number', 'record_id', 'utility_id', 'reporting_year', 'reporting_quarter', 'line_type', 'hftd_tier', 'year', 'quarter', 'region', 'priority']"
_PICK = lambda n, *v: f"[{', '.join(repr(x) for x in v)}][(p_partkey + {n}) % {len(v)} + 1]"


@query(f"""WITH p AS (SELECT p_partkey, p_size, {_PICK(0, 'facts', 'records', 'facts', 'facts', 'records', 'facts', 'views')} AS source, {_PICK(0, 'aggregate', 'rank', 'select', 'aggregate', 'aggregate')} AS operation,
 {_PICK(2, 'sum', 'count', 'avg', 'min', 'count', 'max', 'count', 'sum', 'median')} AS aggregate, {_PICK(0, 'year', 'reporting_year', 'region', 'year_basis', 'source_vintage_year', 'nation', 'unit')} AS field, {_PICK(1, 'eq', 'gte', 'ne', 'like', 'lt', 'eq', 'gt', 'lte', 'eq', 'eq', 'eq')} AS op,
 p_partkey % 3 < 2 AS has_two, p_partkey % 3 > 0 AS has_one, p_partkey % 5 = 0 AS json, CASE WHEN p_partkey % 4 = 0 THEN 'region' WHEN p_partkey % 29 = 1 THEN 'nation' END AS grouped, p_partkey % 6 = 2 AS keyed, CASE p_partkey % 7 WHEN 0 THEN 'region' WHEN 1 THEN 'value' END AS ordered FROM part),
 c AS (SELECT *, list_contains(CASE WHEN source = 'facts' THEN list_concat({_ALLOWED}, ['year_basis', 'source_vintage_year', 'unit']) ELSE {_ALLOWED} END, field) AS known FROM p)
SELECT p_partkey::VARCHAR AS plan_id, CASE WHEN source = 'views' THEN 'reject: source' WHEN aggregate = 'median' THEN 'reject: aggregate' WHEN source = 'records' AND operation <> 'select' AND aggregate <> 'count' THEN 'reject: records can be counted only'
 WHEN p_partkey % 23 NOT BETWEEN 1 AND 20 THEN 'reject: limit' WHEN has_two AND op = 'like' THEN 'reject: comparison' WHEN has_two AND NOT json AND NOT known THEN 'reject: filter' WHEN grouped = 'nation' THEN 'reject: group' WHEN keyed AND NOT (operation = 'select' AND source = 'records') THEN 'reject: key'
 WHEN ordered = 'region' AND grouped IS DISTINCT FROM 'region' THEN 'reject: order'
 WHEN p_partkey % 11 > 0 AND p_size IN (14, 15) AND p_partkey % 13 <> 0 AND (has_one OR (has_two AND NOT json AND field IN ('year', 'reporting_year'))) AND NOT (has_two AND NOT json AND field IN ('year_basis', 'source_vintage_year')) THEN 'clarify' ELSE 'accept' END AS verdict FROM c""")
def q_plan_clarify(spark, sf_dir):
    """Every part's plan judged by the rules as one expression."""
    return part_plans(spark, sf_dir).select("plan_id", batch.verdict().alias("verdict"))


_QA = f"""{FACTS}, a AS (SELECT * FROM facts WHERE revision_id IN ('1', '2')),
 m AS (SELECT metric_name, year, quarter, sum(value_numeric)::DOUBLE AS v FROM a GROUP BY ALL),
 qa AS (SELECT 'metric_lookup' AS kind, CASE (year + quarter) % 4 WHEN 0 THEN format('What was {{}} in {{}} Q{{}}?', metric_name, year, quarter) WHEN 1 THEN format('For {{1}} Q{{2}}, what value was reported for {{0}}?', metric_name, year, quarter)
   WHEN 2 THEN format('What value for {{0}} was reported in the Q{{2}} {{1}} update?', metric_name, year, quarter) ELSE format('In Q{{2}} {{1}}, what was reported as {{0}}?', metric_name, year, quarter) END AS question, v AS answer, 1 AS n_rows FROM m
 UNION ALL SELECT 'scoped_aggregate', format('In {{}}, how much {{}} was attributed to {{}}?', year, metric_name, nation), sum(value_numeric)::DOUBLE, 1 FROM a GROUP BY metric_name, year, nation
 UNION ALL SELECT 'split_lookup', format('For {{}} lines in {{}}, what {{}} was reported in {{}} Q{{}}?', line_type, region, metric_name, year, quarter), sum(value_numeric)::DOUBLE, 1 FROM a GROUP BY metric_name, year, quarter, region, line_type
 UNION ALL SELECT 'period_trend', format('How did {{}} of {{}} change across the quarters of {{}}?', metric_name, line_type, year), arg_min(v, quarter), count(*) FROM (SELECT metric_name, line_type, year, quarter, sum(value_numeric)::DOUBLE AS v FROM a GROUP BY ALL) GROUP BY metric_name, line_type, year HAVING count(*) > 1
 UNION ALL SELECT 'group_comparison', format('In {{}} Q{{}}, which regions but ASIA reported most {{}}?', year, quarter, metric_name), max(v), least(3, count(*)) FROM (SELECT metric_name, year, quarter, region, sum(value_numeric)::DOUBLE AS v FROM a WHERE region <> 'ASIA' GROUP BY ALL) GROUP BY metric_name, year, quarter HAVING count(*) > 1
 UNION ALL SELECT 'ranking', format('In {{}}, which three segments had the highest {{}}?', year, metric_name), max(v), least(3, count(*)) FROM (SELECT metric_name, year, line_type, max(value_numeric)::DOUBLE AS v FROM a GROUP BY ALL) GROUP BY metric_name, year HAVING count(*) > 1
 UNION ALL SELECT 'missing_value', format('Has {{}} been reported for {{}} Q{{}} yet?', metric_name, year + 30, quarter), NULL, 0 FROM m
 UNION ALL SELECT DISTINCT 'year_scope', format('What {{}} was reported for {{}}?', metric_name, year), NULL::DOUBLE, 0 FROM m)"""


@query(f"""WITH {_QA} SELECT kind, question, round(answer, 2) AS answer, n_rows FROM qa""", long="n_rows")
def q_question_templates(spark, sf_dir):
    """Questions whose plans, run together, give what the facts say."""
    return G.verified(G.candidates(facts(spark, sf_dir), registry_rows(spark)), facts(spark, sf_dir), registry_rows(spark)).select("kind", "question", F.round("answer", 2).alias("answer"), "n_rows")


@query(f"""WITH {FACTS}, a AS (SELECT region, line_type, year, value_numeric AS v, priority FROM facts WHERE revision_id IN ('1', '2')),
 k AS (SELECT c_custkey, c_mktsegment, c_nationkey % 3 AS m, CAST(1992 + c_custkey % 7 AS INTEGER) AS y, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey::VARCHAR AS plan_id, array_to_string(CASE WHEN m = 2 THEN [region] ELSE [] END, ';') AS groups, round(CASE m WHEN 0 THEN sum(v) WHEN 1 THEN sum(v) / count(v) ELSE max(v) END::DOUBLE, 4) AS value, row_number() OVER (PARTITION BY c_custkey ORDER BY max(v) DESC NULLS LAST, region) AS place, count(v) AS contributing
FROM (SELECT k.*, a.v, CASE WHEN m = 2 THEN region END AS region FROM k LEFT JOIN a ON a.line_type = c_mktsegment AND CASE m WHEN 0 THEN a.year = y AND a.region = r_name WHEN 1 THEN a.year >= y AND a.priority = '2-HIGH' ELSE a.year = y AND a.region <> r_name END) WHERE m < 2 OR v IS NOT NULL GROUP BY c_custkey, m, region QUALIFY place <= 3""", long="place contributing")
def q_plan_batch(spark, sf_dir):
    """A plan of every customer: a sum, a mean over a JSON key, or a rank, answered in one scan of the facts."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("m", F.col("c_nationkey") % 3)
    f = lambda field, op, value, json=False: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), value.cast("string").alias("value"), F.lit(json).alias("json_key"))
    year, of = 1992 + F.col("c_custkey") % 7, f("line_type", "eq", F.col("c_mktsegment"))
    filters = F.when(F.col("m") == 0, F.array(of, f("year", "eq", year), f("region", "eq", F.col("r_name")))).when(F.col("m") == 1, F.array(of, f("year", "gte", year), f("priority", "eq", F.lit("2-HIGH"), True))).otherwise(F.array(of, f("year", "eq", year), f("region", "ne", F.col("r_name"))))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    plans = c.select(
        F.col("c_custkey").cast("string").alias("plan_id"), F.lit("facts").alias("source"), F.when(F.col("m") == 2, F.lit("rank")).otherwise(F.lit("aggregate")).alias("operation"), F.when(F.col("m") == 0, F.lit("sum")).when(F.col("m") == 1, F.lit("avg")).otherwise(F.lit("max")).alias("aggregate"),
        F.lit(2).alias("table_number"), null.alias("semantic_metric_key"), null.alias("measure_name"), filters.alias("filters"), F.when(F.col("m") == 2, F.array(F.lit("region"))).otherwise(none).alias("group_by"), none.alias("json_keys"),
        null.alias("order_by"), F.lit(True).alias("descending"), F.lit(3).alias("limit"), null.alias("year_basis"), F.lit(True).alias("require_year_basis"),
    )
    out = batch.answers(plans, facts(spark, sf_dir), registry_rows(spark))
    return out.select("plan_id", F.array_join("groups", ";").alias("groups"), F.round("value", 4).alias("value"), "place", "contributing")


@query(f"WITH {FACTS} SELECT count(*) AS n FROM facts WHERE year = 1996 AND quarter IS NOT NULL")
def q_plan_pushdown(spark, sf_dir):
    """A plan's filter on its own: counts what filtered() lets through."""
    return filtered(Plan(filters=(Filter("year", "eq", 1996),)), facts(spark, sf_dir)).where("quarter is not null").agg(F.count(F.lit(1)).alias("n"))
