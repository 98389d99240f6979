"""Ranking of evidence: channels, fusion, reranking, groups and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, query: DataFrame, k: int, within: list[str] | None = None) -> DataFrame:
    """Exact k nearest by cosine distance, ties by id; per value of ``within`` if given. ``query``
    is one row, the only side that is sent around; more than one fail the query (searches for
    many are VectorIndex.search)."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("one query row expected"))).otherwise(F.first("embedding"))
    q = F.broadcast(query.limit(2).agg(one.alias("query")).where("query is not null"))
    scored = vectors.crossJoin(q).withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("query")), 6)).drop("query")
    if not within:
        return scored.orderBy("distance", "vec_id").limit(k)
    w = Window.partitionBy(*within).orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score, best_rank) from (id, channel, rank)."""
    return ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))


def union_preserving(channels: list[DataFrame]) -> DataFrame:
    """Ids of several ranked lists (id, rank): the first list's order, then what later ones add."""
    every = None
    for n, c in enumerate(channels):
        part = c.select("id", F.struct(F.lit(n).alias("channel"), F.col("rank").alias("rank")).alias("place"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("id").agg(F.min("place").alias("place"))
    return first.select("id", F.col("place.channel").alias("channel"), F.col("place.rank").alias("rank"))


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def ranked_within(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def interleave(ranked: DataFrame, keys: list[str], group: str, order: list[Column]) -> DataFrame:
    """Round-robin over the groups of every key: each group's first, then each group's second.
    ``ranked`` holds the candidates of a key, so its windows are bounded."""
    rounds = ranked.withColumn("round", F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order)))
    return rounds.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("round", group)))


def weighted_frequency(terms: Column, fields: list[tuple[Column, float]]) -> Column:
    """Sum over fields of weight times the field's tokens that are terms: what cover density
    comes to for a query that is a plain OR. For texts at hand; a corpus is searched by LexicalIndex."""
    total = F.lit(0.0)
    for words, weight in fields:
        total = total + weight * F.size(F.filter(words, lambda t: F.array_contains(terms, t)))
    return total
