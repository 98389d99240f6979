"""Evaluation: metrics, calibration, folds, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import evaluation as E
from lodestrata.operators import retrieval as R

from .registry import query, read

_JUDGED = """j AS (SELECT e.label AS question_id, row_number() OVER (PARTITION BY e.label ORDER BY (e.vec_id * 7919 % 1009), e.vec_id) AS rank, e.vec_id % 5 = 0 AS gold, e.vec_id FROM embeddings e),
n AS (SELECT question_id, count(*) FILTER (gold) AS n_gold FROM j GROUP BY 1)"""


def judged(spark, sf_dir):
    """Ranked results of ten questions (labels), a fifth of them gold."""
    w = Window.partitionBy("question_id").orderBy(F.col("vec_id") * 7919 % 1009, "vec_id")
    j = read(spark, sf_dir, "embeddings").select(F.col("label").alias("question_id"), "vec_id", (F.col("vec_id") % 5 == 0).alias("gold")).withColumn("rank", F.row_number().over(w))
    return j.join(j.groupBy("question_id").agg(F.count_if("gold").alias("n_gold")), "question_id")


@query(f"""WITH {_JUDGED}, m AS (SELECT question_id, n_gold, count(*) FILTER (gold AND rank = 1) AS hit_at_1, count(*) FILTER (gold AND rank <= 10)::DOUBLE AS hits, min(CASE WHEN gold THEN rank END) AS first_gold_rank, sum(CASE WHEN gold AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM j JOIN n USING (question_id) GROUP BY ALL)
SELECT question_id, hit_at_1, round(hits / n_gold, 6) AS recall, round(CASE WHEN first_gold_rank <= 10 THEN 1.0 / first_gold_rank ELSE 0 END, 6) AS mrr, round(CASE WHEN n_gold > 0 THEN dcg / list_sum(list_transform(range(1, least(greatest(n_gold, 1), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg, first_gold_rank FROM m""", long="first_gold_rank")
def q_ir_metrics(spark, sf_dir):
    return E.ir_metrics(judged(spark, sf_dir), 10).select("question_id", "hit_at_1", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")), "first_gold_rank")


@query(f"""WITH {_JUDGED}, g AS (SELECT question_id, vec_id % 3 AS gold_group, min(rank) AS credited_at FROM j WHERE gold GROUP BY 1, 2) SELECT question_id, count(*) FILTER (credited_at <= 10) AS credited, min(credited_at) AS first_rank FROM g GROUP BY 1""", long="first_rank")
def q_gold_hits(spark, sf_dir):
    g = judged(spark, sf_dir).where("gold").groupBy("question_id", (F.col("vec_id") % 3).alias("gold_group")).agg(F.min("rank").alias("credited_at"))
    return g.groupBy("question_id").agg(F.count_if(F.col("credited_at") <= 10).alias("credited"), F.min("credited_at").alias("first_rank"))


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'resolved' END AS status FROM (SELECT doc_id + 3 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)""")
def q_gold_resolve(spark, sf_dir):
    gold = read(spark, sf_dir, "labels").select((F.col("doc_id") + 3).alias("doc_id"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("there"))
    return gold.join(d, "doc_id", "left").select("doc_id", F.when(F.col("there").isNull(), F.lit("missing")).otherwise(F.lit("resolved")).alias("status"))


_SCORED = "s AS (SELECT l.doc_id, quality, d.lang, round((n_chars % 97) / 97.0, 4) AS score FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.round((F.col("n_chars") % 97) / 97.0, 4).alias("score"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")


@query(f"""WITH {_SCORED}, v AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY score), w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM v)
SELECT round(sum(wins) / (sum(pos) * sum(neg)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM w""")
def q_roc_auc(spark, sf_dir):
    return E.roc_auc(scored(spark, sf_dir), "score", "quality").withColumn("auc", F.round("auc", 6))


@query(f"""WITH RECURSIVE {_SCORED}, n AS MATERIALIZED (SELECT lang, score AS x, quality AS y, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
z AS MATERIALIZED (SELECT lang, sum(n) FILTER (y = 1) AS pos, sum(n) FILTER (y = 0) AS neg FROM n GROUP BY lang),
w AS MATERIALIZED (SELECT lang, x, y, n * CASE WHEN y = 1 THEN 0.5 / pos ELSE 0.5 / neg END AS w FROM n JOIN z USING (lang) WHERE pos > 0 AND neg > 0),
g AS (SELECT 0 AS step, lang, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT lang FROM w)
 UNION ALL SELECT any_value(step) + 1, lang, any_value(a) - 0.05 * sum(e * x), any_value(b) - 0.05 * sum(e) FROM (SELECT g.*, x, w * (1 / (1 + exp(-greatest(-60, least(60, a * x + b)))) - y) AS e FROM g JOIN w USING (lang) WHERE step < 400) GROUP BY lang)
SELECT lang, round(a, 6) AS a, round(b, 6) AS b FROM z LEFT JOIN (SELECT * FROM g WHERE step = 400) USING (lang)""")
def q_platt_fit(spark, sf_dir):
    return E.platt_curves(scored(spark, sf_dir), "lang", "score", "quality").select("lang", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""WITH {_SCORED}, n AS (SELECT sum(quality) AS pos, sum(1 - quality) AS neg FROM s), p AS (SELECT doc_id, 1 / (1 + exp(-greatest(-60, least(60, 2.5 * score - 1)))) AS p FROM s)
SELECT doc_id, round(p * pos / (p * pos + (1 - p) * neg), 6) AS calibrated FROM p, n""")
def q_platt_apply(spark, sf_dir):
    s = scored(spark, sf_dir)
    n = s.agg(F.sum("quality"), F.sum(1 - F.col("quality"))).first()
    return s.select("doc_id", F.round(E.platt(F.col("score"), F.lit(2.5), F.lit(-1.0), F.lit(n[0] or 0), F.lit(n[1] or 0)), 6).alias("calibrated"))


@query("""SELECT doc_id, CAST((dense_rank() OVER (ORDER BY source) - 1) % 5 AS INTEGER) AS fold FROM documents""")
def q_group_kfold(spark, sf_dir):
    """Folds are numbered over distinct groups, then looked up."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    folds = d.select("source").distinct().withColumn("fold", ((F.row_number().over(Window.orderBy("source")) - 1) % 5).cast("int"))
    return d.join(folds, "source").select("doc_id", "fold")


@query("""WITH r AS (SELECT doc_id, source, sha256(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM documents) SELECT doc_id, source FROM r ORDER BY rn > 1, h LIMIT 40""")
def q_diverse_take(spark, sf_dir):
    """One per source first, by hash, then more by hash: the first of each source is a grouped
    minimum, so a large source is not sorted."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("h"))
    first = d.groupBy("source").agg(F.min("h").alias("first_h"))
    return d.join(first, "source").orderBy(F.col("h") != F.col("first_h"), "h").limit(40).select("doc_id", "source")


@query(f"""WITH {_SCORED} SELECT lang, quality, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY GROUPING SETS ((), (lang), (lang, quality))""")
def q_eval_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""WITH {_SCORED}, m AS (SELECT lang, avg(quality) AS metric FROM s GROUP BY 1), f AS (SELECT * FROM (VALUES ('en', 0.8), ('fr', 0.95), ('es', 0.6)) t(lang, floor))
SELECT lang, round(metric, 6) AS metric, round(metric - floor, 6) AS margin, metric >= floor AS passed FROM m JOIN f USING (lang)""")
def q_gate_floors(spark, sf_dir):
    floors = spark.createDataFrame([("en", 0.8), ("fr", 0.95), ("es", 0.6)], "lang string, floor double")
    m = scored(spark, sf_dir).groupBy("lang").agg(F.avg("quality").alias("metric")).join(floors, "lang")
    return m.select("lang", F.round("metric", 6).alias("metric"), F.round(F.col("metric") - F.col("floor"), 6).alias("margin"), (F.col("metric") >= F.col("floor")).alias("passed"))


@query("""WITH d AS (SELECT split_part('declined: ' || o_orderpriority || ': ' || o_orderstatus, ':', 2) AS r FROM orders) SELECT trim(r) AS reason, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, reason LIMIT 6""")
def q_decline_hist(spark, sf_dir):
    text = F.concat(F.lit("declined: "), "o_orderpriority", F.lit(": "), "o_orderstatus")
    r = read(spark, sf_dir, "orders").select(F.trim(F.split_part(text, F.lit(":"), F.lit(2))).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@query("""WITH g AS (SELECT conv_id, list_distinct(list(turn % 4)) AS cited, list_distinct(list(turn % 3 + 1)) AS expected FROM conversations GROUP BY 1), m AS (SELECT *, len(list_intersect(cited, expected))::DOUBLE AS b FROM g)
SELECT conv_id, round(b / len(cited), 6) AS precision, round(b / len(expected), 6) AS recall, list_sort(cited) = list_sort(expected) AS exact FROM m""")
def q_citation_metrics(spark, sf_dir):
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") % 4).alias("cited"), F.collect_set(F.col("turn") % 3 + 1).alias("expected"))
    p, r, x = E.citation_scores(F.col("cited"), F.col("expected"))
    return g.select("conv_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), x.alias("exact"))


__all__ = ["R", "judged", "scored"]
