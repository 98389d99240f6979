"""Product codes of vectors over integers, assigned by partial-distance search.

A component x is kept as floor(4096 * x). Vectors are cut into eight consecutive parts; each part
has a codebook of 16 entries, fitted by rounds of assigning every part to its nearest entry and
moving each entry to its parts' mean, rounded down. A code is the eight entries' numbers.

A search for a part's nearest entry goes through the dimensions by falling variance of the
codebook. It begins with one complete distance, to the entry nearest in the first dimension;
every other entry adds up its squares and is dropped for those vectors whose sum strictly exceeds
their best complete distance. Integers are exact, so what is dropped can't win or tie.

Every round is one scan of the packed vectors; a task gives at most 8 x 16 rows of counts and
sums, however often one vector repeats, and the driver holds the codebooks, 16 whole vectors.

Defined cases: a row goes if its vector is null, empty, of another length than the kept vector
with the smallest id, or has a null or non-finite component; rows of one id are ordered by their
packed vector, null ids come last; repeated rows count as often as they stand there; fewer than 16 rows
give as many entries; parts differ by at most one component if the length is no multiple of
eight; an integer beyond ``bound`` (2^27 for 64 components), where sums of squares would leave 64
bits, is taken as the bound; null labels are one label; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast; with more of them, Spark joins by label and splits hot ones.
FEW_LABELS = 100_000


def bound(dim: int) -> int:
    """The largest size of an integer component for which all sums of squares fit into 64 bits."""
    return 1 << ((62 - (max(dim, 2) - 1).bit_length()) // 2 - 1)


def cuts(dim: int) -> list[tuple[int, int]]:
    return [(dim * p // PARTS, dim * (p + 1) // PARTS) for p in range(PARTS)]


def _packed(dim: int) -> Callable:
    """Integer components of a batch as one binary value a row (32-bit, little-endian)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("f8")
            whole = np.clip(np.floor(flat.reshape(batch.num_rows, dim) * SCALE), -bound(dim), bound(dim)).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in whole], pa.binary())], ["vec_id", "label", "v"])

    return pack


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype("i8")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the number of its nearest entry, ties to the lower one, and the squared distance."""
    order = np.argsort(-entries.astype("f8").var(axis=0), kind="stable")
    x, entries = x[:, order], entries[:, order]
    best = np.abs(x[:, :1] - entries[:, 0]).argmin(axis=1) if x.shape[1] else np.zeros(len(x), "i8")
    least, began = ((x - entries[best]) ** 2).sum(axis=1), best.copy()
    for j, entry in enumerate(entries):
        rows = np.flatnonzero(began != j)
        total = np.zeros(len(rows), "i8")
        for d in range(x.shape[1]):
            total += (x[rows, d] - entry[d]) ** 2
            stays = total <= least[rows]
            if not stays.all():
                rows, total = rows[stays], total[stays]
            if not len(rows):
                break
        wins = (total < least[rows]) | (j < best[rows])
        best[rows[wins]], least[rows[wins]] = j, total[wins]
    return best, least


def _summed(books: list[np.ndarray], dim: int) -> Callable:
    """A task's parts per entry: count, then the sum of every component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, ENTRIES), "i8"), [np.zeros((ENTRIES, b - a), "i8") for a, b in cuts(dim)]
        for batch in batches:
            v = _rows(batch.column(0), dim)
            for p, (a, b) in enumerate(cuts(dim)):
                code, _ = nearest(v[:, a:b], books[p])
                count[p] += np.bincount(code, minlength=ENTRIES)
                np.add.at(total[p], code, v[:, a:b])
        found = [(p, e, int(count[p, e]), total[p][e].tolist()) for p in range(PARTS) for e in range(ENTRIES) if count[p, e]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "sums"])

    return sums


def refined(vectors: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """One round: every entry becomes the mean of its parts, rounded down; unused ones stay."""
    found = vectors.select("v").mapInArrow(_summed(books, dim), "part int, entry int, n bigint, sums array<bigint>")
    width = max(b - a for a, b in cuts(dim))
    sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most 128 rows
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(out[r["part"]].shape[1])]
    return out


def _coded(books: list[np.ndarray], dim: int) -> Callable:
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, error, code = _rows(batch.column(2), dim), np.zeros(batch.num_rows, "i8"), np.zeros((batch.num_rows, PARTS), "u1")
            for p, (a, b) in enumerate(cuts(dim)):
                code[:, p], far = nearest(v[:, a:b], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return codes


def pack_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that can be coded, written once, and the number of components."""
    e = embeddings.select(quoted("vec_id").alias("vec_id"), quoted("label").alias("label"), quoted("embedding").cast("array<double>").alias("e"))
    sound = e.where("size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "e").select(F.size("e").alias("n")).first()
    dim = first["n"] if first else 0
    kind = e.schema["label"].dataType.simpleString()
    return materialize(sound.where(F.size("e") == dim).mapInArrow(_packed(dim), f"vec_id {e.schema['vec_id'].dataType.simpleString()}, label {kind}, v binary"), "vectors"), dim


def fit_codebooks(vectors: DataFrame, dim: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of packed vectors: the parts of the smallest ids' vectors, then ``rounds`` of refinement."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    start = np.array([np.frombuffer(r["v"], "<i4") for r in rows], "i8").reshape(len(rows), dim)
    books = [start[:, a:b] for a, b in cuts(dim)]
    for _ in range(rounds if len(rows) else 0):
        books = refined(vectors, books, dim)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every vector that can be coded."""
    vectors, dim = pack_vectors(embeddings)
    books = fit_codebooks(vectors, dim)
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    coded = materialize(vectors.mapInArrow(_coded(books, dim), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"), "codes")
    of = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    of = F.broadcast(of) if of.limit(FEW_LABELS + 1).count() <= FEW_LABELS else of
    out = coded.join(of, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "label", "code", "error", F.expr("try_cast(label_error AS bigint)").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
