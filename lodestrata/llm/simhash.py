"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance, then components.

Fingerprints of 64 bits are cut into six blocks. Two that differ in at most three bits agree in
at least three whole blocks, so they share one of the 20 keys that mask a fingerprint to three
blocks (32 bits and more). Distinct fingerprints only are keyed: a group of copies is one row.
Keys that one fingerprint alone has are dropped by a grouped count. Where a key has more than
``HOT`` fingerprints, the pigeonhole is applied once more to its other three blocks (six parts,
20 keys each), after which at most 17 bits are free and a group is at most 2^17 fingerprints,
whatever the input. Within a group links come from a search that emits, for each linked
set, a star and not its pairs, so no link between different texts is lost and none multiplies.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are
linked like any other; a null doc_id takes part in no link and has a null component; rows that
share a doc_id are one node, whatever their texts; repeated rows each get their row; texts of
any length are read whole, in pieces; of a component the smallest doc_id stays, with all its
rows; extra columns are never read, and no column name of theirs clashes; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_key, materialize, pieces, quoted, slices, without
from .components import connected_components

MAX_DISTANCE = 3
#: A key with more fingerprints than this is split by the second level.
HOT = 512


def _ranges(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions, of nearly equal size."""
    return [sum(1 << b for b in run) for run in (x.tolist() for x in np.array_split(np.array(bits), parts))]


_BLOCKS = _ranges(list(range(64)), 6)
#: Masks of three blocks, and for each the masks of three parts of the other three blocks.
MASKS = [sum(_BLOCKS[i] for i in c) for c in combinations(range(6), 3)]
SUBMASKS = [[sum(x) for x in combinations(_ranges([b for b in range(64) if not m >> b & 1], 6), 3)] for m in MASKS]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes) -> int:
    """Signed 64-bit SimHash of 3-word shingles, repeats included."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces(data.lower()):
        words = tail + piece.split()
        if len(words) < 3:
            tail = words
            continue
        for i in range(0, len(words) - 2, 1 << 16):
            part = words[i : i + (1 << 16) + 2]
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(part, part[1:], part[2:]))), np.uint64, len(part) - 2)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        tail = words[-2:]
    if not n:
        return signed(xxhash.xxh64_intdigest(b" ".join(tail), 42)) if tail else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t) for t in as_bytes(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def star_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that connect exactly what chains of distances up to MAX_DISTANCE connect."""
    if len(fps) > HOT and (free := int(np.bitwise_or.reduce(fps ^ fps[0]))).bit_count() <= 17:
        return _cube_links(fps, free)
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        seed, rest, todo = int(rest[0]), rest[1:], []
        todo.append(seed)
        while todo and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= MAX_DISTANCE
            if near.any():
                reached = rest[near].tolist()
                rest = rest[~near]
                todo += reached
                out += [(seed, r) for r in reached]
    return out


def _cube_links(fps: np.ndarray, free: int) -> list[tuple[int, int]]:
    """The same for many fingerprints that differ in few positions: minimal labels spread over
    the cube of those positions, MAX_DISTANCE edges at a time, absent corners passing them on."""
    at = [b for b in range(64) if free >> b & 1]
    corner = np.zeros(len(fps), np.int64)
    for i, b in enumerate(at):
        corner |= (fps >> np.uint64(b) & np.uint64(1)).astype(np.int64) << i
    none, size = len(fps), 1 << len(at)
    label = np.full(size, none, np.int64)
    np.minimum.at(label, corner, np.arange(len(fps)))
    cube = np.arange(size)
    while True:
        spread = label
        for _ in range(MAX_DISTANCE):
            spread = np.minimum.reduce([spread, *(spread[cube ^ (1 << i)] for i in range(len(at)))])
        new = np.full(size, none, np.int64)
        new[corner] = spread[corner]
        if (new == label).all():
            break
        label = new
    # labels are the smallest index that a chain of present corners passes on
    return [(int(r), i) for i, r in enumerate(label[corner].tolist()) if r != i]


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, fp), fp distinct, that give the same components as all
    pairs at Hamming distance up to three."""
    spark = nodes.sparkSession
    keys = nodes.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(MASKS)))).alias("k")).select("node", "fp", "k.*")
    shared = keys.groupBy("mask", "key").count().where("count > 1")
    shared = materialize(shared, "keys")
    found = keys.join(shared, ["mask", "key"])
    second = F.array(*(F.array(*(F.lit(signed(m | s)) for s in subs)) for m, subs in zip(MASKS, SUBMASKS, strict=True)))
    masks = F.when(F.col("count") > HOT, F.get(second, F.col("mask").cast("int"))).otherwise(F.array(F.lit(0).cast("long")))
    found = found.select("node", "fp", "mask", "key", F.explode(masks).alias("more"))
    bucket = F.xxhash64("mask", "more", F.when(F.col("more") == 0, F.col("key")).otherwise(F.col("fp").bitwiseAND(F.col("more"))))
    found = found.select(bucket.alias("bucket"), "node", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = found.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(_links_of_buckets, "a long, b long").distinct()


def _links_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket that goes on in the next batch is carried over."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def done(columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node, fp = columns
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_DISTANCE]
        a, b = [node[two]], [node[two + 1]]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            if links := star_links(fp[s:e]):
                pairs = np.array(links)
                a.append(node[s:e][pairs[:, 0]])
                b.append(node[s:e][pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[cut:] for x in now]
        if cut:
            yield done([x[:cut] for x in now])
    if len(held[0]):
        yield done(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links = near_links(nodes)
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    if not several.isEmpty():  # fingerprints of one doc_id are linked through it
        of_one = prints.join(several, "doc_id").select("doc_id", "fp").distinct().join(nodes, "fp")
        links = links.union(of_one.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    roots = connected_components(links)
    placed = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(placed, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id. Rows
    with a null doc_id stay, since nothing links them."""
    out = near_duplicates(docs, id_col, text_col).where("component_id <> doc_id").select("doc_id")
    drop = materialize(out.distinct().select(*(k.alias(n) for k, n in zip(id_key(F.col("doc_id")), ("id", "no_id"), strict=True))), "dropped")
    return without(docs, drop, id_key(quoted(id_col)))
