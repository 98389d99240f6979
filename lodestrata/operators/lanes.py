"""Candidates of a block of questions, and lanes: ranked on their own, then merged on one scale.

All windows here are over the candidates of one question (three channels of k rows a lane and
search query), never over a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

from .evaluation import platt
from .lexical import LexicalIndex
from .vectors import VectorIndex

#: Content types by lane, in the order in which lanes are merged, and candidates a lane needs to be calibrated.
LANES = {"narrative": "narrative", "table": "structured", "figure": "structured", "excel_card": "excel"}
LANE_ORDER = ("narrative", "structured", "excel")
LEAST_CALIBRATED = 3
#: Channels in the order in which they fill a pool.
CHANNELS = ("raw", "contextual", "lexical")


def candidate_pool(queries: DataFrame, dense: dict[str, tuple[VectorIndex, str]], lexical: LexicalIndex, k: int, question: str = "question_id", query: str = "query_no", text: str = "question") -> DataFrame:
    """(question, lane, id, channels, pool_rank) for ``queries`` (question, query, text, and a column
    of vectors for each dense channel). Every channel gives its best k for every search query and
    lane. A pool keeps the first channel's order and appends what later ones add, then what later
    search queries of the question add; ``channels`` are all that found the candidate."""
    keys, parts = [question, query], []
    for n, channel in enumerate(CHANNELS):
        if channel in dense:
            index, vector = dense[channel]
            found = index.search(queries, keys, k, lane="lane", vector=vector)
            parts.append(found.select(*keys, "lane", "id", F.lit(n).alias("channel"), "rank"))
    words = lexical.topk(queries, keys, k, text, LANES)
    parts.append(words.select(*keys, "lane", F.col("chunk_id").alias("id"), F.lit(CHANNELS.index("lexical")).alias("channel"), "rank"))
    every = reduce(DataFrame.unionByName, parts)
    names = F.array(*map(F.lit, CHANNELS))
    pool = every.groupBy(question, "lane", "id").agg(
        F.min(F.struct(query, "channel", "rank")).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_set("channel")), lambda c: F.get(names, c)), ";").alias("channels"),
    )
    w = Window.partitionBy(question, "lane").orderBy("place", "id")
    return pool.select(question, "lane", "id", "channels", F.row_number().over(w).alias("pool_rank"))


def reranked(pool: DataFrame, group: list[str], score: Column, content: str = "content_hash") -> DataFrame:
    """Every group by score, ties in pool order; of equal contents the best stays, then ranks."""
    order = [F.desc("score"), F.col("pool_rank")]
    scored = pool.withColumn("score", score)
    first = scored.withColumn("copy", F.row_number().over(Window.partitionBy(*group, content).orderBy(*order))).where("copy = 1").drop("copy")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def confidence(scored: DataFrame, group: list[str], score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Per group from the scores alone, best first: top, gap to the second (0 if there is none),
    mean of three, how many reach the threshold, spread of ten, candidates, top + gap / 10. Only
    the best ten of a group are ordered, in one bounded list; the rest is counted."""
    best = F.expr(f"slice(sort_array(collect_list({score}), false), 1, 10)")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score)))
    top = scored.select(*group, score).withColumn("n", place).where("n <= 10").groupBy(*group).agg(best.alias("best"), F.stddev_pop(score).alias("spread"))
    counts = scored.groupBy(*group).agg(F.count_if(F.col(score) >= threshold).alias("n_above"), F.count(F.lit(1)).alias("candidates"))
    out = top.join(counts, group)
    at = lambda i: F.get("best", F.lit(i))
    three = F.slice("best", 1, 3)
    return out.select(
        *group,
        at(0).alias("top1"),
        (at(0) - F.coalesce(at(1), at(0))).alias("gap"),
        (F.aggregate(three, F.lit(0.0), lambda a, v: a + v) / F.size(three)).alias("mean_top3"),
        "n_above",
        "spread",
        "candidates",
    ).withColumn("confidence", F.col("top1") + 0.10 * F.col("gap"))


def calibrated(ranked: DataFrame, curves: DataFrame | None, question: str, least: int = LEAST_CALIBRATED) -> DataFrame:
    """``ranked`` with ``shared``, its score on the scale of the merge: probabilities if every content
    type among a question's candidates has a curve (content_type, a, b), else the raw scores of all
    of them; candidates of a lane of fewer than ``least`` keep raw scores."""
    if curves is None:
        return ranked.withColumn("shared", F.col("score"))
    of = curves.select("content_type", "a", "b", F.lit(True).alias("curve"))
    joined = ranked.join(of, "content_type", "left")
    covered = F.min(F.coalesce("curve", F.lit(False))).over(Window.partitionBy(question))
    size = F.count(F.lit(1)).over(Window.partitionBy(question, "lane"))
    shared = F.when(covered & (size >= least), platt(F.col("score"), F.col("a"), F.col("b"))).otherwise(F.col("score"))
    return joined.withColumn("shared", shared).drop("a", "b", "curve")


def merged(ranked: DataFrame, question: str, curves: DataFrame | None = None, floor: float = 0.0, k: int | None = None, content: str = "content_hash") -> DataFrame:
    """Lanes of every question in one order: by shared score, ties by lane and rank. The first of
    any lane whose confidence is below ``floor`` loses 1, its others keep their scores. Of equal
    contents in several lanes the first stays. ``k`` cuts the final list."""
    shared = calibrated(ranked, curves, question)
    weak = confidence(shared, [question, "lane"], "shared").select(question, "lane", (F.col("confidence") < floor).alias("weak"))
    keyed = shared.join(weak, [question, "lane"]).withColumn("key", F.col("shared") - F.when(F.col("weak") & (F.col("rank") == 1), F.lit(1.0)).otherwise(F.lit(0.0)))
    keyed = keyed.withColumn("lane_no", F.array_position(F.array(*map(F.lit, LANE_ORDER)), F.col("lane")))
    order = [F.desc("key"), F.col("lane_no"), F.col("rank")]
    first = keyed.withColumn("copy", F.row_number().over(Window.partitionBy(question, content).orderBy(*order))).where("copy = 1")
    out = first.withColumn("merged_rank", F.row_number().over(Window.partitionBy(question).orderBy(*order)))
    return (out.where(F.col("merged_rank") <= k) if k else out).drop("copy", "lane_no", "weak")


def lane_of(content_type: Column) -> Column:
    """A content type's lane; unknown types are prose."""
    return F.coalesce(T.mapped(content_type, LANES), F.lit("narrative"))
