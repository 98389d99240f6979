"""Retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.stem import STOP, stems_sql
from lodestrata.operators import lanes as L
from lodestrata.operators import retrieval as R
from lodestrata.operators import rewrite as W
from lodestrata.operators.lexical import WEIGHTS, LexicalIndex
from lodestrata.operators.overlap import find_evidence
from lodestrata.operators.vectors import VectorIndex
from lodestrata.sources.scratch import new_path, written

from .registry import CHUNKS, chunks, query, read
from .scalars import variants_sql

_D = "round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _vec(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def _near(spark, sf_dir, n, k=50):
    """Ranked (id, rank, distance) around vector n: one retrieval channel."""
    e = _vec(spark, sf_dir)
    top = R.vector_search(e, e.where(F.col("vec_id") == n), k)
    return top.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"), "distance", "label")  # over the k rows of the channel


def _near_sql(n, k=50):
    return f"(SELECT e.vec_id AS id, {_D} AS distance, e.label, row_number() OVER (ORDER BY {_D}, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {n}) q QUALIFY rank <= {k})"


_AB = f"a AS {_near_sql(0)}, b AS {_near_sql(1)}"


@query(f"WITH a AS {_near_sql(0, 30)} SELECT id, distance, rank FROM a", long="rank")
def q_vector_topk(spark, sf_dir):
    return _near(spark, sf_dir, 0, 30).select("id", "distance", "rank")


@query(f"""SELECT label, e.vec_id, {_D} AS distance, row_number() OVER (PARTITION BY label ORDER BY {_D}, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 10""", long="rank")
def q_vector_topk_per_group(spark, sf_dir):
    e = _vec(spark, sf_dir)
    return R.vector_search(e, e.where("vec_id = 0"), 10, ["label"]).select("label", "vec_id", "distance", "rank")


@query(f"""WITH {_AB}, u AS (SELECT id, rank FROM a UNION ALL SELECT id, rank FROM b) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM u GROUP BY id""", long="best_rank")
def q_rrf(spark, sf_dir):
    both = _near(spark, sf_dir, 0).select("id", "rank").union(_near(spark, sf_dir, 1).select("id", "rank"))
    return R.reciprocal_rank_fusion(both).withColumn("score", F.round("score", 9))


@query(f"""WITH {_AB}, u AS (SELECT id, 0 AS channel, rank FROM a UNION ALL SELECT id, 1, rank FROM b) SELECT id, channel, rank FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY channel, rank) = 1""", long="rank")
def q_union_preserving(spark, sf_dir):
    return R.union_preserving([_near(spark, sf_dir, 0), _near(spark, sf_dir, 1)])


@query(f"""WITH {_AB}, u AS (SELECT id, 0 - distance AS quality, 'dense' AS channel FROM a UNION ALL SELECT id, 1.0 / rank, 'lexical' FROM b) SELECT id, round(quality, 6) AS quality, channel FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY quality DESC, channel) = 1""")
def q_merge_best(spark, sf_dir):
    a, b = _near(spark, sf_dir, 0), _near(spark, sf_dir, 1)
    u = a.select("id", (0 - F.col("distance")).alias("quality"), F.lit("dense").alias("channel")).union(b.select("id", 1.0 / F.col("rank"), F.lit("lexical")))
    return R.best_per(u, ["id"], [F.desc("quality"), F.col("channel")]).withColumn("quality", F.round("quality", 6))


@query("""SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) = 1""")
def q_dedupe_content(spark, sf_dir):
    """Only hash, rank and id are grouped, map-side combined; ties within a hash by id."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupBy("h").agg(F.min(F.struct((-F.col("n_chars")).alias("k"), "doc_id")).alias("m")).select("m.doc_id", (-F.col("m.k")).alias("n_chars"))


@query("""WITH s AS (SELECT conv_id, lower(trim(text)) AS q, turn FROM conversations WHERE role = 'user'), d AS (SELECT conv_id, q, min(turn) AS turn FROM s GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, q) AS n FROM d QUALIFY n <= 2""", long="n")
def q_subquestion_dedupe(spark, sf_dir):
    s = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.lower(F.trim("text")).alias("q"), "turn")
    d = s.groupBy("conv_id", "q").agg(F.min("turn").alias("turn"))
    return R.ranked_within(d, ["conv_id"], [F.col("turn"), F.col("q")], 2, "n").select("conv_id", "turn", "n")


_TERMS = ["the", "and", "onthe", "thing", "les", "que"]
_LIST = "[" + ",".join(f"'{t}'" for t in _TERMS) + "]"


def search_queries(spark, sf_dir):
    """Two search queries of every benchmark item: its text, and its first six words; their vectors
    are those of the items' numbers and of the numbers a hundred later."""
    b = read(spark, sf_dir, "benchmark")
    short = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    q = b.select(F.col("item_id").alias("question_id"), F.explode(F.array(F.struct(F.lit(0).alias("query_no"), F.col("text").alias("question")), F.struct(F.lit(1).alias("query_no"), short.alias("question")))).alias("q")).select("question_id", "q.*")
    vectors = _vec(spark, sf_dir).select(F.col("vec_id").alias("of"), F.col("embedding").alias("raw"), _weighted("embedding").alias("contextual"))
    return q.join(vectors, F.col("of") == F.col("question_id") + 100 * F.col("query_no"), "left").drop("of")


def _weighted(c):
    """A second vector of a chunk: every third and next component weighs twice and three times."""
    return F.transform(c, lambda x, i: x.cast("double") * (1 + i % 3))


_kept: dict[tuple[str, str, str], object] = {}


def _once(spark, sf_dir, name, make):
    """What is built once per application and folder and searched by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def lexical_index(spark, sf_dir):
    return _once(spark, sf_dir, "lexical", lambda: LexicalIndex.build(chunks(spark, sf_dir), new_path(spark, "lexical"), shards=16))


def chunk_vectors(spark, sf_dir):
    """Vectors of chunks with their lanes; a chunk's vector has its number. Chunks and vectors meet once,
    though a build reads its vectors several times and there are two indexes of them."""

    def make():
        lanes = chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), L.lane_of(F.col("content_type")).alias("lane"))
        return written(_vec(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding").join(lanes, "id"), "chunk-vectors")

    return _once(spark, sf_dir, "chunk-vectors", make)


def vector_index(spark, sf_dir, contextual=False):
    """An index of the chunks' vectors, or of their second ones."""

    def make():
        v = chunk_vectors(spark, sf_dir)
        return VectorIndex.build(v.withColumn("embedding", _weighted("embedding")) if contextual else v, new_path(spark, "vectors"))

    return _once(spark, sf_dir, f"vectors-{contextual}", make)


def _words(column):
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+')"


_STOP = ",".join(f"'{w}'" for w in T.STOPWORDS)
_FUNCTION_WORDS = ",".join(f"'{w}'" for w in STOP)


def _acronyms(column):
    return rf"list_transform(regexp_extract_all({column}, '\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{2,}}\b'), lambda r: lower(array_to_string(list_transform(regexp_split_to_array(r, '\s+'), lambda x: x[1]), '')))"


def _meaning(column):
    return f"list_filter({_words(column)}, lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t))"


def _light_terms(column):
    return f"list_distinct(list_concat(list_transform({_meaning(column)}, lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t END), {_acronyms(column)}))"


_CONTEXTUAL = "list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + (i - 1) % 3))"
_SEARCH = f"""{CHUNKS}, sq AS MATERIALIZED (SELECT question_id, query_no, question, embedding::DOUBLE[] AS raw, {_CONTEXTUAL} AS contextual
 FROM (SELECT item_id AS question_id, 0 AS query_no, text AS question FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') FROM benchmark) s LEFT JOIN embeddings ON vec_id = question_id + 100 * query_no)"""
_LEXICAL = f"""{_SEARCH}, occ AS ({" UNION ALL ".join(f"SELECT chunk_id, content_type, unnest({_words(c)}) AS word, {w} AS impact FROM chunks" for c, w in WEIGHTS.items())}),
 qw AS MATERIALIZED (SELECT question_id, query_no, unnest(list_distinct(list_concat({_meaning("question")}, {_acronyms("question")}))) AS word FROM sq),
 vocab AS MATERIALIZED (SELECT word FROM (SELECT word FROM occ UNION SELECT word FROM qw) WHERE word NOT IN ({_FUNCTION_WORDS})),
 {stems_sql("vocab", "word", "st")},
 post AS MATERIALIZED (SELECT chunk_id, content_type, stem AS term, sum(impact) AS impact FROM occ JOIN st USING (word) GROUP BY ALL),
 qt AS MATERIALIZED (SELECT DISTINCT question_id, query_no, stem AS term FROM qw JOIN st USING (word)),
 lex AS MATERIALIZED (SELECT question_id, query_no, content_type, chunk_id, sum(impact)::BIGINT::DOUBLE / 1000 AS score FROM post JOIN qt USING (term) GROUP BY ALL)"""


@query(f"WITH {_LEXICAL} SELECT question_id, chunk_id, round(score, 6) AS score FROM lex WHERE query_no = 0")
def q_lexical_score(spark, sf_dir):
    """Every chunk that matches a benchmark item's text, through the index."""
    q = search_queries(spark, sf_dir).where("query_no = 0")
    return lexical_index(spark, sf_dir).scores(q, ["question_id"]).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEXICAL} SELECT question_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM lex WHERE query_no = 0 QUALIFY rank <= 30", long="rank")
def q_lexical_topk(spark, sf_dir):
    """The best 30 chunks of every benchmark item's text; only blocks that can hold one are summed."""
    q = search_queries(spark, sf_dir).where("query_no = 0")
    return lexical_index(spark, sf_dir).topk(q, ["question_id"], 30).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], v), 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_distance(embedding::DOUBLE[], v), 6), vec_id) AS rank FROM q, embeddings QUALIFY rank <= 10""", long="rank")
def q_vector_index(spark, sf_dir):
    """Ten nearest of every fiftieth vector through the index: near lists first, then those that their radius leaves open."""
    make = lambda: VectorIndex.build(_vec(spark, sf_dir).withColumnRenamed("vec_id", "id"), new_path(spark, "vectors"))
    q = _vec(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _once(spark, sf_dir, "vectors", make).search(q, ["query_id"], 10).drop("lane")


_CAP = _light_terms("caption")


@query(f"""WITH {CHUNKS}, p AS (SELECT chunk_id, content_type, {_CAP} AS c FROM chunks)
SELECT chunk_id, round(CASE WHEN content_type = 'narrative' OR len(c) = 0 THEN 0 ELSE len(list_intersect({_LIST}, c)) / sqrt(6.0 * len(c)) END, 6) AS prior FROM p""")
def q_caption_prior(spark, sf_dir):
    prior = T.overlap_prior(F.array(*map(F.lit, _TERMS)), T.lexical_terms(F.col("caption")))
    return chunks(spark, sf_dir).select("chunk_id", F.round(F.when(F.col("content_type") == "narrative", F.lit(0.0)).otherwise(prior), 6).alias("prior"))


_LANE = "CASE content_type WHEN 'table' THEN 'structured' WHEN 'figure' THEN 'structured' WHEN 'excel_card' THEN 'excel' ELSE 'narrative' END"


def _dense_sql(name, channel, vector, chunk_vector):
    far = f"round(list_cosine_distance({chunk_vector}, {vector}), 6)"
    return f"""{name} AS (SELECT question_id, query_no, lane, id, {channel} AS channel, row_number() OVER (PARTITION BY question_id, query_no, lane ORDER BY {far}, id) AS rank FROM sq, cv WHERE {vector} IS NOT NULL QUALIFY rank <= 10)"""


_POOL = f"""{_LEXICAL}, cv AS MATERIALIZED (SELECT vec_id AS id, {_LANE} AS lane, embedding::DOUBLE[] AS e, {_CONTEXTUAL} AS c FROM embeddings JOIN chunks ON vec_id = chunk_id),
 {_dense_sql("ch0", 0, "raw", "e")}, {_dense_sql("ch1", 1, "contextual", "c")},
 ch2 AS (SELECT question_id, query_no, {_LANE} AS lane, chunk_id AS id, 2 AS channel, row_number() OVER (PARTITION BY question_id, query_no, {_LANE} ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 10),
 ch AS (SELECT * FROM ch0 UNION ALL SELECT * FROM ch1 UNION ALL SELECT * FROM ch2),
 place AS (SELECT *, row_number() OVER (PARTITION BY question_id, lane, id ORDER BY query_no, channel, rank) AS n FROM ch),
 found AS (SELECT question_id, lane, id, string_agg(DISTINCT channel::VARCHAR, '' ORDER BY channel::VARCHAR) AS numbers FROM ch GROUP BY ALL),
 pool AS MATERIALIZED (SELECT question_id, lane, id, replace(replace(replace(array_to_string(string_split(numbers, ''), ';'), '0', 'raw'), '1', 'contextual'), '2', 'lexical') AS channels,
  row_number() OVER (PARTITION BY question_id, lane ORDER BY query_no, channel, rank, id) AS pool_rank FROM place JOIN found USING (question_id, lane, id) WHERE n = 1)"""


def candidates(spark, sf_dir):
    """Ten of each channel, lane and search query of every benchmark item."""

    def make():
        dense = {"raw": (vector_index(spark, sf_dir), "raw"), "contextual": (vector_index(spark, sf_dir, True), "contextual")}
        return written(L.candidate_pool(search_queries(spark, sf_dir), dense, lexical_index(spark, sf_dir), 10), "pool")

    return _once(spark, sf_dir, "pool", make)


@query(f"WITH {_POOL} SELECT question_id, lane, id, channels, pool_rank FROM pool", long="pool_rank")
def q_candidates(spark, sf_dir):
    return candidates(spark, sf_dir)


_PRIOR = "CASE WHEN len({0}) = 0 OR len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, {0}))::DOUBLE / sqrt(len(asked)::DOUBLE * len({0})) END"
_SCORED = f"""{_POOL}, asked AS MATERIALIZED (SELECT question_id, {_light_terms("question")} AS asked FROM sq WHERE query_no = 0),
 terms AS MATERIALIZED (SELECT chunk_id AS id, content_type, sha256(content) AS content_hash, {_light_terms("content")} AS body, {_light_terms("caption")} AS cap FROM chunks WHERE chunk_id IN (SELECT id FROM pool)),
 scored AS MATERIALIZED (SELECT question_id, lane, id, content_type, content_hash, pool_rank, round({_PRIOR.format("body")} + 0.25 * CASE WHEN content_type = 'narrative' THEN 0 ELSE {_PRIOR.format("cap")} END, 6) AS score
  FROM pool JOIN terms USING (id) JOIN asked USING (question_id))"""


def _reranked_sql(name, group):
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, pool_rank) AS rank
 FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY {group}, content_hash ORDER BY score DESC, pool_rank) = 1))"""


_RANKED = f"{_SCORED}, {_reranked_sql('r', 'question_id, lane')}"


def scored_pool(spark, sf_dir):
    """Candidates with a score: the terms that question and content share, in place of a model's
    score, and a quarter of the caption's prior. Contents are read for candidates only."""

    def make():
        asked = search_queries(spark, sf_dir).where("query_no = 0").select("question_id", T.lexical_terms(F.col("question")).alias("asked"))
        pool = candidates(spark, sf_dir)
        c = chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id").join(pool.select("id").distinct(), "id", "left_semi")
        c = c.select("id", "content_type", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), T.lexical_terms(F.col("content")).alias("body"), T.lexical_terms(F.col("caption")).alias("cap"))
        prior = F.when(F.col("content_type") == "narrative", F.lit(0.0)).otherwise(T.overlap_prior(F.col("asked"), F.col("cap")))
        score = F.round(T.overlap_prior(F.col("asked"), F.col("body")) + 0.25 * prior, 6)
        return written(pool.join(c, "id").join(asked, "question_id").select("question_id", "lane", "id", "content_type", "content_hash", "pool_rank", score.alias("score")), "scored")

    return _once(spark, sf_dir, "scored", make)


def lane_ranks(spark, sf_dir):
    return L.reranked(scored_pool(spark, sf_dir), ["question_id", "lane"], F.col("score"))


@query(f"WITH {_RANKED} SELECT question_id, lane, id, score, rank FROM r", long="rank")
def q_rerank(spark, sf_dir):
    return lane_ranks(spark, sf_dir).select("question_id", "lane", "id", "score", "rank")


_CONF = """(SELECT question_id, lane, max(CASE WHEN n = 1 THEN {0} END) AS top1, max(CASE WHEN n = 1 THEN {0} END) - coalesce(max(CASE WHEN n = 2 THEN {0} END), max(CASE WHEN n = 1 THEN {0} END)) AS gap, avg(CASE WHEN n <= 3 THEN {0} END) AS mean_top3,
 count(*) FILTER ({0} >= 0.5) AS n_above, stddev_pop(CASE WHEN n <= 10 THEN {0} END) AS spread, count(*) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lane ORDER BY {0} DESC) AS n FROM {1}) GROUP BY question_id, lane)"""


@query(f"WITH {_RANKED}, c AS {_CONF.format('score', 'r')} SELECT question_id, lane, n_above, candidates, round(top1, 6) AS top1, round(gap, 6) AS gap, round(mean_top3, 8) AS mean_top3, round(spread, 6) AS spread, round(top1 + 0.10 * gap, 8) AS confidence FROM c")
def q_lane_confidence(spark, sf_dir):
    out = L.confidence(lane_ranks(spark, sf_dir), ["question_id", "lane"])
    digits = {"top1": 6, "gap": 6, "mean_top3": 8, "spread": 6, "confidence": 8}  # sums and halves of six digits have more
    return out.select("question_id", "lane", "n_above", "candidates", *(F.round(c, n).alias(c) for c, n in digits.items()))


_CURVES = f"""{CHUNKS.replace("chunks AS (", "typed AS (")}, curves AS (SELECT content_type, 4.0::DOUBLE + avg(quality) AS a, -1.0::DOUBLE - avg(toxic) AS b FROM labels JOIN typed ON doc_id = chunk_id GROUP BY 1 QUALIFY count(*) > min(count(*)) OVER ())"""


def curves(spark, sf_dir):
    """Calibration curves of the content types with labels, but for the one with the fewest."""
    n = read(spark, sf_dir, "labels").join(chunks(spark, sf_dir), F.col("doc_id") == F.col("chunk_id")).groupBy("content_type").agg((4.0 + F.avg("quality")).alias("a"), (-1.0 - F.avg("toxic")).alias("b"), F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.min("n").alias("least")), F.col("n") > F.col("least")).drop("n", "least")


def _merge_sql(floor):
    return f"""{_RANKED}, {_CURVES}, j AS (SELECT r.*, a, b, bool_and(a IS NOT NULL) OVER (PARTITION BY question_id) AS covered, count(*) OVER (PARTITION BY question_id, lane) AS size FROM r LEFT JOIN curves USING (content_type)),
 s AS MATERIALIZED (SELECT *, CASE WHEN covered AND size >= 3 THEN 1 / (1 + exp(-(a * score + b))) ELSE score END AS shared FROM j), c AS {_CONF.format("shared", "s")},
 k AS (SELECT s.*, shared - CASE WHEN top1 + 0.10 * gap < {floor} AND rank = 1 THEN 1 ELSE 0 END AS key, list_position(['narrative', 'structured', 'excel'], lane) AS lane_no FROM s JOIN c USING (question_id, lane)),
 d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY question_id, content_hash ORDER BY key DESC, lane_no, rank) = 1)"""


@query(f"WITH {_merge_sql(0.45)} SELECT question_id, lane, id, round(key, 6) AS key, row_number() OVER (PARTITION BY question_id ORDER BY key DESC, lane_no, rank) AS merged_rank FROM d", long="merged_rank")
def q_lane_merge(spark, sf_dir):
    """Lanes on one scale: calibrated where all types have a curve, weak lanes lose the first place."""
    out = L.merged(lane_ranks(spark, sf_dir), "question_id", curves(spark, sf_dir), floor=0.45)
    return out.select("question_id", "lane", "id", F.round("key", 6).alias("key"), "merged_rank")


@query("""SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'text' WHEN 'es' THEN 'spreadsheet' ELSE 'structured' END AS lane FROM documents""")
def q_lane_map(spark, sf_dir):
    lanes = T.mapped(F.col("lang"), {"en": "text", "es": "spreadsheet", "fr": "structured", "de": "structured"})
    return read(spark, sf_dir, "documents").select("lang", lanes.alias("lane")).distinct()


@query(f"WITH {_SCORED}, {_reranked_sql('r', 'question_id, content_type')} SELECT question_id, content_type, id, rank FROM r WHERE rank <= 10", long="rank")
def q_evidence_groups(spark, sf_dir):
    """Four groups by content type, each with its own first ten."""
    groups = L.reranked(scored_pool(spark, sf_dir), ["question_id", "content_type"], F.col("score"))
    return groups.where("rank <= 10").select("question_id", "content_type", "id", "rank")


@query(f"WITH {_SCORED}, p AS (SELECT * REPLACE (row_number() OVER (PARTITION BY question_id ORDER BY list_position(['narrative', 'structured', 'excel'], lane), pool_rank) AS pool_rank) FROM scored), {_reranked_sql('r', 'question_id').replace('FROM scored', 'FROM p')} SELECT question_id, id, score, rank FROM r WHERE rank <= 10", long="rank")
def q_flat_rank(spark, sf_dir):
    """One list without lanes; the pools stand one after the other."""
    lane_no = F.array_position(F.array(*map(F.lit, L.LANE_ORDER)), F.col("lane"))
    pool = scored_pool(spark, sf_dir).withColumn("pool_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(lane_no, "pool_rank")))
    return L.reranked(pool, ["question_id"], F.col("score")).where("rank <= 10").select("question_id", "id", "score", "rank")


@query(f"WITH {_RANKED} SELECT question_id, lane, id, rank AS round, row_number() OVER (PARTITION BY question_id ORDER BY rank, lane) AS place FROM r", long="round place")
def q_interleave(spark, sf_dir):
    """Round-robin over the lanes of every question."""
    mixed = R.interleave(lane_ranks(spark, sf_dir), ["question_id"], "lane", [F.col("rank")])
    return mixed.select("question_id", "lane", "id", "round", "place")


@query("""SELECT source, count(*) AS chunks, count(*) FILTER (lang = 'en') AS narrative, min(doc_id) AS first_chunk FROM documents GROUP BY 1""")
def q_chunk_doc_join(spark, sf_dir):
    c = chunks(spark, sf_dir)
    sources = c.select("breadcrumb").distinct()
    return c.join(sources, "breadcrumb").groupBy(F.col("breadcrumb").alias("source")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("content_type") == "narrative").alias("narrative"), F.min("chunk_id").alias("first_chunk"))


_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9.%-]+', ' ', 'g'))"
_EVIDENCE = f"""o AS (SELECT o_orderkey, n_name, c_mktsegment, CAST(2020 + year(o_orderdate) % 8 AS VARCHAR) AS y, CAST(quarter(o_orderdate) AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT o_orderkey AS chunk_id, {_NORMAL.format("n_name || ' Order for ' || c_mktsegment || ' in Q' || k || ' ' || y || ': total ' || CASE WHEN o_orderkey % 3 = 0 THEN format('{:,}', CAST(v * 100 AS BIGINT) // 100) || '.' || lpad(CAST(CAST(v * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') ELSE CAST(v AS VARCHAR) END || ' (no. ' || CAST(o_orderkey AS VARCHAR) || ').'")} AS text FROM o),
w AS (SELECT o_orderkey AS needle_id, y, 'q' || k AS q, list_transform({variants_sql("v")}, lambda x: {_NORMAL.format("x")}) AS forms, lower(n_name) AS w1, lower(c_mktsegment) AS w2 FROM o WHERE o_orderkey IN (SELECT arg_max(o_orderkey, {{'v': v, 'k': o_orderkey}}) FROM o GROUP BY n_name, c_mktsegment, y, k)),
f AS (SELECT *, regexp_extract(form, '([0-9.]+)$', 1) AS run FROM (SELECT * EXCLUDE (forms), unnest(forms) AS form FROM w)),
r AS (SELECT chunk_id, text, unnest(list_distinct(regexp_extract_all(text, '[0-9.]+'))) AS run FROM c)"""


@query(f"""WITH {_EVIDENCE} SELECT needle_id, min(chunk_id) AS chunk_id FROM f JOIN r USING (run) WHERE list_contains(string_split(text, ' '), y) AND contains(text, q)
 AND regexp_matches(text, '(^|[^0-9.])' || replace(form, '.', '[.]') || '($|[^0-9.])') AND (SELECT count(*) FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(w1 || ' ' || w2, '[a-z0-9]+'), lambda t: length(t) >= 3))) AS t) WHERE contains(text, t)) >= 2 GROUP BY needle_id""")
def q_overlap_evidence(spark, sf_dir):
    """The largest order of every nation, segment and quarter as a needle, all orders as sentences."""
    n = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    year, quarter = (2020 + F.year("o_orderdate") % 8).cast("string"), F.quarter("o_orderdate").cast("string")
    o = read(spark, sf_dir, "orders").join(n, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "c_mktsegment", year.alias("y"), quarter.alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    total = F.when(F.col("o_orderkey") % 3 == 0, F.format_number("v", 2)).otherwise(F.col("v").cast("string"))
    content = F.concat(F.lit("Order for "), "c_mktsegment", F.lit(" in Q"), "k", F.lit(" "), "y", F.lit(": total "), total, F.lit(" (no. "), F.col("o_orderkey").cast("string"), F.lit(")."))
    largest = o.groupBy("n_name", "c_mktsegment", "y", "k").agg(F.max(F.struct("v", "o_orderkey")).alias("m"))
    needles = largest.select(F.col("m.o_orderkey").alias("needle_id"), F.concat(F.lit("What was the largest order in Q"), "k", F.lit(" of "), "y", F.lit("?")).alias("question"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("concept"), F.col("m.v").alias("value"))
    return find_evidence(needles, o.select(F.col("o_orderkey").alias("chunk_id"), F.col("n_name").alias("caption"), content.alias("content")))


_ASKED = "CASE m WHEN 0 THEN 'What is the size of ' || p_name || '? And the price?' WHEN 1 THEN 'What is the size of ' || p_name || ' and how much is it?' ELSE 'What is the size of ' || p_name || '?' END"


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_size % 3 AS m, p_partkey % 4 AS r FROM part), a AS (SELECT *, {_ASKED} AS asked FROM p),
 x AS (SELECT a.*, mode, (mode = 'always' OR (mode = 'auto' AND m < 2)) AS sent FROM a, (VALUES ('off'), ('auto'), ('always')) AS v(mode))
SELECT p_partkey, mode, CASE WHEN sent AND r = 0 THEN asked || '|size of ' || p_name || '|price of ' || p_name ELSE asked END AS search_queries,
 CASE WHEN mode = 'off' THEN 'disabled' WHEN NOT sent THEN 'simple' WHEN r = 0 THEN 'api' ELSE 'fallback' END AS source,
 CASE WHEN mode = 'off' THEN 'mode_off' WHEN mode = 'always' THEN 'mode_always' WHEN m = 0 THEN 'multiple_questions' WHEN m = 1 THEN 'independent_interrogative_clauses' ELSE 'single_intent' END AS reason FROM x""")
def q_query_rewrite(spark, sf_dir):
    """Replies: a fenced list with repeats, an empty list, a list with a number, none at all."""
    m, r = F.col("p_size") % 3, F.col("p_partkey") % 4
    asked = F.concat(F.lit(" What is the size of "), "p_name", F.when(m == 0, F.lit("? And the price?")).when(m == 1, F.lit(" and how much is it?")).otherwise(F.lit("? ")))
    items = F.array(F.concat(F.lit(" size  of "), "p_name"), F.concat(F.lit("SIZE of "), "p_name"), F.trim(asked), F.lit(" "), F.concat(F.lit("price of "), "p_name"), F.lit("colour"))
    reply = F.when(r == 0, F.concat(F.lit("```json\n"), F.to_json(items), F.lit("\n```"))).when(r == 1, F.lit("[]")).when(r == 2, F.lit('["size", 2]'))
    q = read(spark, sf_dir, "part").select("p_partkey", asked.alias("question"), reply.alias("reply"))
    modes = [W.rewrite(q, mode).select("p_partkey", F.lit(mode).alias("mode"), F.array_join("search_queries", "|").alias("search_queries"), "source", "reason") for mode in W.MODES]
    return modes[0].union(modes[1]).union(modes[2])
