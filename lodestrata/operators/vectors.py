"""Nearest vectors by cosine distance: an index of lists around centroids, searched in batches.

Centroids are fitted on a bounded sample; every vector goes into the list of its nearest
centroid, a directory sorted by number. A search takes a table of queries. Queries go out in
blocks of bounded size, and a task keeps the best k of each query (and lane) of all it reads, so
what is shuffled is at most k rows per task, query and lane. ``probes`` lists around each query
give an approximation; without it the search is exact: no member of a list can be nearer than
the angle to its centroid less the list's radius, and all lists that could hold one of the best k
of a first probe are read as well.

Distances are rounded to six digits, ties go to the smaller number. A vector that is null, of
another length than the index, of length zero, or has a null or non-finite component is not indexed and
finds nothing as a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources.scratch import written

#: Vectors at most that centroids are fitted on, rounds of fitting, lists at most, bytes of a block of queries, distances held at once.
SAMPLE, FIT_ROUNDS, MOST_LISTS, QUERY_BYTES, CELLS = 20_000, 8, 4096, 8 << 20, 1 << 22


def usable(vector: Column, dim: int | None = None) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(sound & ((F.size(vector) == dim) if dim else F.lit(True)), F.lit(False))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cluster(sample: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of unit vectors: rounds of assignment and mean direction from the first ones on."""
    centroids = sample[:lists].copy()
    for _ in range(rounds):
        near = (sample @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            total = sample[near == c].sum(axis=0)
            if (size := np.sqrt((total * total).sum())) > 0:
                centroids[c] = total / size
    return centroids


def _listed(centroids: np.ndarray) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit(batch.column("embedding"), centroids.shape[1]) @ centroids.T
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(best.astype("i4"))], [*batch.schema.names, "angle", "list"])

    return assign


def _best(ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id)."""
    if len(far) > k:
        near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
    else:
        near = np.arange(len(far))
    return near[np.lexsort((ids[near], far[near]))[:k]]


def _searched(queries: np.ndarray, wanted: dict[int, np.ndarray], k: int, laned: bool) -> Callable:
    """The best k per query (and lane) of a task's rows (id, embedding, list[, lane])."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            lanes = np.array(batch.column(3).to_pylist(), object) if laned else None
            vectors = unit(batch.column(1), queries.shape[1])
            for c in np.unique(lists):
                if (of := wanted.get(int(c))) is None:
                    continue
                here = np.flatnonzero(lists == c)
                for lane in sorted({*lanes[here]} - {None}) if laned else (None,):
                    every, step = here[lanes[here] == lane] if laned else here, max(1, CELLS // len(of))
                    for rows in (every[i : i + step] for i in range(0, len(every), step)):
                        far = np.round(1 - queries[of] @ vectors[rows].T, 6) + 0.0
                        for q, distances in zip(of, far, strict=True):
                            i, d = held.get((q, lane), (ids[:0], far[0, :0]))
                            i, d = np.concatenate([i, ids[rows]]), np.concatenate([d, distances])
                            keep = _best(i, d, k)
                            held[q, lane] = i[keep], d[keep]
        if held:
            n = [len(i) for i, _ in held.values()]
            queries_of, lanes_of = np.repeat([q for q, _ in held], n).astype("i8"), [lane for (_, lane), m in zip(held, n, strict=True) for _ in range(m)]
            ids_of, far_of = (np.concatenate(x) for x in zip(*held.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(queries_of), pa.array(lanes_of, pa.string()), pa.array(ids_of), pa.array(far_of)], ["_query", "lane", "id", "distance"])

    return search


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index ``vectors`` (id: bigint, embedding, and further columns that are kept) at ``path``.
        Without ``lists`` there are as many as the square root of the rows, 4,096 at most."""
        spark = vectors.sparkSession
        sound = vectors.where(usable(F.col("embedding")))
        total, dim = sound.agg(F.count(F.lit(1)), F.min_by(F.size("embedding"), "id")).first()
        if not total:
            raise ValueError("there is no vector to index")
        sound = sound.where(F.size("embedding") == dim)
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        thinned = sound.where(place < int((1 << 30) * min(1.0, 2 * sample / total)))
        rows = thinned.select("id", "embedding").orderBy(place, "id").limit(sample).collect()
        known = np.array([r["embedding"] for r in rows], "f8")
        known /= np.sqrt((known * known).sum(axis=1, keepdims=True))
        lists = min(len(known), lists or min(MOST_LISTS, max(1, round(total**0.5))))
        centroids = cluster(known, lists)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sound.schema) + ", angle double, list int"
        listed = sound.mapInArrow(_listed(centroids), ddl)
        listed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
        stored = spark.read.schema(ddl).parquet(f"{path}/lists")
        radii = np.full(lists, -1.0)
        for r in stored.groupBy("list").agg(F.max("angle").alias("radius")).collect():  # a row a list
            radii[r["list"]] = r["radius"]
        return cls(spark, path, centroids, radii)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, keys: list[str], k: int, probes: int | None = None, lane: str | None = None, vector: str = "embedding", first: int = 4) -> DataFrame:
        """(*keys, lane, id, distance, rank): the k nearest of every query, or of every query and
        value of the column ``lane``. Exact unless ``probes`` says how many lists to read."""
        dim = self.centroids.shape[1]
        sound = written(queries.where(usable(F.col(vector), dim)).select(*keys, F.col(vector).cast("array<double>").alias("v")), "queries")
        blocks = max(1, -(-sound.count() * dim * 8 // QUERY_BYTES))
        out = None
        for b in range(blocks):
            mine = sound if blocks == 1 else sound.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == b)
            part = self._block(mine, keys, k, probes, lane, first)
            out = part if out is None else out.unionByName(part)
        return out

    def _block(self, queries: DataFrame, keys: list[str], k: int, probes: int | None, lane: str | None, first: int) -> DataFrame:
        rows = queries.collect()  # at most QUERY_BYTES of vectors
        kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keys)
        names = self.spark.createDataFrame([(i, *(r[c] for c in keys)) for i, r in enumerate(rows)], f"_query bigint, {kinds}")
        matrix = np.array([r["v"] for r in rows], "f8").reshape(len(rows), self.centroids.shape[1])
        matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) if len(rows) else 1
        angle = np.arccos(np.clip(matrix @ self.centroids.T, -1, 1))
        nearest = angle.argsort(axis=1, kind="stable")[:, : probes or first]
        chosen = np.zeros(angle.shape, bool)
        np.put_along_axis(chosen, nearest, True, axis=1)
        found = self._scan(matrix, chosen, k, lane)
        if probes is None and len(rows):
            found = written(self._cut(found, k), "nearest")
            lanes = max(1, self.rows().where(F.col(lane).isNotNull()).select(lane).distinct().count() if lane else 1)
            reach = np.full(len(rows), np.inf)
            last = found.groupBy("_query", "lane").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).groupBy("_query")
            for r in last.agg(F.max("far").alias("far"), F.min("n").alias("n"), F.count(F.lit(1)).alias("lanes")).collect():  # a row a query of the block
                if r["n"] == k and r["lanes"] == lanes:
                    reach[r["_query"]] = np.arccos(np.clip(1 - r["far"] - 1e-6, -1, 1)) + 1e-6
            more = (angle - self.radii <= reach[:, None]) & ~chosen
            found = found.drop("rank").union(self._scan(matrix, more, k, lane))
        return self._cut(found, k).join(F.broadcast(names), "_query").select(*keys, "lane", "id", "distance", "rank")

    def _scan(self, matrix: np.ndarray, chosen: np.ndarray, k: int, lane: str | None) -> DataFrame:
        wanted = {int(c): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(axis=0))}
        rows = self.rows().where(F.col("list").isin(list(wanted)) if wanted else F.lit(False))
        rows = rows.select("id", "embedding", "list", *([F.col(lane).cast("string")] if lane else []))
        return rows.mapInArrow(_searched(matrix, wanted, k, lane is not None), "_query bigint, lane string, id bigint, distance double")

    @staticmethod
    def _cut(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("_query", "lane").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
