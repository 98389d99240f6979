"""Merkle manifest of a document table: leaves, subtrees per source, one root, proofs.

A leaf is the digest of a document's fields. Each source's leaves, by document number, are hashed
in runs of three, level after level, to the source's subroot; the subroots, by source, likewise
to the root. ``H`` is the lowercase hex SHA-256 of concatenated inputs.

Nothing of a tree is held in memory. Leaves are range-sorted into runs, one Parquet file each,
and get their coordinate (source, index) from counts of the runs. A band climbs ``DEPTH`` levels:
its nodes are dealt by (source, block of 3^DEPTH) and sorted, every level is hashed from the one
before in order, and all go to a node store that is partitioned by level; a block's last node is
a node of the next band. A source with a third of all rows is many blocks. Proofs come from the
top down: a merge over (source, block, level, index) meets the stored nodes, in which siblings
lie side by side, with the path of the block's last node, one row a block.

Defined cases: fields are taken as text, null as ``-``; null sources come first, and so do null
document numbers in a source; rows with one number are ordered by their leaf, and rows that are
equal in all fields are leaves of their own; texts of any length are hashed in the JVM and never
shuffled; a table of one row has its leaf as root; an empty table gives no rows; further columns
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, quoted, scratch_path, slices

ARITY, DEPTH = 3, 5
BLOCK = ARITY**DEPTH
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row as 32 bytes, ``text`` standing for its text."""
    return F.unhex(F.sha2(F.concat(*(_field(text if c == "text" else quoted(c)) for c in FIELDS)), 256))


def without_line_ends(docs: DataFrame) -> Column:
    """What tampering makes of a row's text: in every second row by crc32 its line ends go."""
    hit = F.crc32(quoted("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.replace(quoted("text"), F.lit("\n"), F.lit(""))).otherwise(quoted("text"))


def _h(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def _stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run's rows with the run's number, their place in their group so far, and whether
    the group is the run's first one, which an earlier run may have begun."""
    run, group, n, head = TaskContext.get().partitionId(), None, 0, True
    seen = False
    for batch in slices(batches, 1 << 14):
        ends = pc.run_end_encode(batch.column(0))
        at, first, start = [], [], 0
        for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
            if seen and value != group:
                n, head = 0, False
            group, seen = value, True
            at.extend(range(n, n + end - start))
            first.extend([head] * (end - start))
            n, start = n + end - start, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(first, pa.bool_())], [*batch.schema.names, "run", "at", "head"])


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``idx``, their place from 0 within the first column's value in the given order, and
    the sorted runs they are read from. The offsets have at most one row a run, so they are broadcast."""
    group = rows.columns[0]
    order = [F.col(group).asc_nulls_first(), *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", run int, at bigint, head boolean"
    runs = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stamp, schema), name)
    sizes = runs.groupBy(group, "run").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head"))
    offset = F.expr(f"sum(n) OVER (PARTITION BY `{group}` ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = sizes.withColumn("offset", offset).where("head AND offset > 0").select("run", F.lit(True).alias("head"), "offset")
    placed = runs.join(F.broadcast(offsets), ["run", "head"], "left").withColumn("idx", F.col("at") + F.coalesce("offset", F.lit(0)))
    return placed.select(*rows.columns, "idx"), runs


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns."""
    key, rows = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_NODE = pa.schema([("g", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("node", pa.binary()), ("top", pa.bool_()), ("level", pa.int32())])


def _climb(base: int):
    """Blocks of one band, (g, block, idx, node) in order, to the nodes above; the last one is ``top``."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (g, block), rows in _streamed(batches):
            at, level, first = [x[1] for x in rows], 0, rows[0][0]
            last = DEPTH if block else 0  # a later block tells that the source has more than one
            while len(at) > 1 or level < last:
                at = [bytes.fromhex(_h(b"".join(x.hex().encode() for x in at[i : i + ARITY])).decode()) for i in range(0, len(at), ARITY)]
                level, first = level + 1, first // ARITY
                done = len(at) == 1 and level >= last
                for i, node in enumerate(at):
                    yield g, block, first + i, node, done, base + level
            if not level:
                yield g, block, first, at[0], True, base

    return lambda batches: _batches(nodes(batches), _NODE)


@dataclass
class Tree:
    """Bands from the leaves up: what a band starts from (g, idx, node, ...) and its stored nodes."""

    bands: list[tuple[DataFrame, DataFrame]]

    def roots(self) -> DataFrame:
        return self.bands[-1][1].where("top").select("g", "node")


def build(leaves: DataFrame, name: str) -> Tree:
    """The trees of ``leaves`` (g, idx, node, ...), one for each g."""
    spark, bands, nodes = leaves.sparkSession, [], leaves
    while True:
        band = nodes.select("g", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "node").repartition("g", "block").sortWithinPartitions("g", "block", "idx")
        path = scratch_path(spark, name)
        band.mapInArrow(_climb(DEPTH * len(bands)), "g string, block bigint, idx bigint, node binary, top boolean, level int").write.partitionBy("level").parquet(path)
        stored = spark.read.schema("g string, block bigint, idx bigint, node binary, top boolean, level int").parquet(path)
        bands.append((nodes, stored))
        nodes = stored.where("top").select("g", F.col("block").alias("idx"), "node")
        if not nodes.where("idx > 0").limit(1).count():
            return Tree(bands)


_ABOVE = 1 << 20
_MERGED = ["g", "block", "level", "idx", "node", "changed", "doc_id", "ref", "path", "subroot"]


def _descend(base: int, emit):
    """Merge-scan of one band: per block the path above it, then its nodes from the top level
    down. ``emit(row, steps, subroot)`` gets every node that the band started from."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (g, _), found in _streamed(batches):
            steps, subroot, levels = (), None, {}
            for level, idx, node, changed, doc_id, ref, path, root in found:
                if level == _ABOVE:
                    steps, subroot = tuple(tuple(x.split(b"|")) for x in path.encode().split(b";")) if path else (), root
                else:
                    levels.setdefault(level, []).append((idx, node.hex().encode(), changed, doc_id, ref))
            paths = {}
            for level in sorted(levels, reverse=True):
                here, below = levels[level], {}
                runs: dict[int, list[bytes]] = {}
                for x in here:
                    runs.setdefault(x[0] // ARITY, []).append(x[1])
                for x in here:
                    up = paths.get(x[0] // ARITY)
                    if up is None:  # the block's last node
                        below[x[0]] = steps
                    else:
                        run, at = runs[x[0] // ARITY], x[0] % ARITY
                        below[x[0]] = ((b"".join(run[:at]), b"".join(run[at + 1 :])), *up)
                    if level == base:
                        yield emit(g, x, below[x[0]], subroot)
                paths = below

    return rows


def _merge(nodes: DataFrame, stored: DataFrame, above: DataFrame, base: int, emit, schema: pa.Schema, ddl: str) -> DataFrame:
    null = {"changed": F.lit(None).cast("binary"), "doc_id": F.lit(None).cast("bigint"), "ref": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string"), "node": F.lit(None).cast("binary")}
    fill = lambda df: df.select(*(F.col(c) if c in df.columns else null[c].alias(c) for c in _MERGED))
    started = fill(nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).withColumn("level", F.lit(base)))
    inner = fill(stored.where(F.col("level") > base))
    over = fill(above.withColumn("level", F.lit(_ABOVE)).withColumn("idx", F.lit(0).cast("bigint")))
    merged = started.union(inner).union(over).repartition("g", "block").sortWithinPartitions("g", "block", F.desc("level"), "idx")
    rows = _descend(base, emit)
    return merged.mapInArrow(lambda batches: _batches(rows(batches), schema), ddl)


_PATH = pa.schema([("g", pa.string()), ("block", pa.int64()), ("ref", pa.string()), ("path", pa.string()), ("subroot", pa.string())])


def _as_path(g, x, steps, subroot):
    return g, x[0], x[4], b";".join(b"|".join(s) for s in steps).decode(), subroot or x[1].decode()


def paths(tree: Tree, above: DataFrame, down_to: int = 0) -> DataFrame:
    """(g, block, ref, path, subroot): the steps from every node of band ``down_to`` to what ``above`` leads to."""
    for k in range(len(tree.bands) - 1, down_to - 1, -1):
        above = _merge(*tree.bands[k], above, DEPTH * k, _as_path, _PATH, "g string, block bigint, ref string, path string, subroot string")
    return above


@dataclass
class Manifest:
    """Leaves by coordinate, a tree per source, the tree of subroots, and the root."""

    sources: Tree
    subroots: Tree
    root: str | None
    runs: tuple[DataFrame, ...] = ()

    def discard(self) -> None:
        discard(*self.runs, *(stored for t in (self.sources, self.subroots) for _, stored in t.bands))


def build_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``tampered``, if given, is what each text is claimed to be at verification."""
    own = leaf_digest(quoted("text"))
    rows = docs.select(quoted("source").cast("string").alias("g"), quoted("doc_id").cast("bigint").alias("doc_id"), own.alias("node"), (own if tampered is None else leaf_digest(tampered)).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    hashed = materialize(rows, "hashed")  # sorting samples its input first: texts are read and hashed once
    leaves, runs = numbered(hashed, [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("tie")], "leaves")
    discard(hashed)
    sources = build(leaves.drop("tie"), "nodes")
    tops = sources.roots().select(F.lit("").alias("g"), F.col("g").alias("ref"), "node")
    ordered, top_runs = numbered(tops, [F.col("ref").asc_nulls_first()], "subroots")
    subroots = build(ordered, "nodes")
    root = subroots.roots().first()
    return Manifest(sources, subroots, root and root["node"].hex(), (runs, top_runs))


_PROOF = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])


def _as_proof(g, x, steps, subroot):
    node = x[2].hex().encode()
    for before, after in steps:
        node = _h(before + node + after)
    return g, x[3], x[1].decode(), subroot, _h(b"".join(before + after for before, after in steps)).decode(), node.decode()


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf: its proof's digest and the root that the claimed text folds to with it."""
    leaves, stored = manifest.sources.bands[0]
    spark: SparkSession = leaves.sparkSession
    start = spark.range(1).select(F.lit("").alias("g"), F.lit(0).cast("bigint").alias("block"), F.lit("").alias("path"))
    tops = paths(manifest.subroots, start).select(F.col("ref").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", "subroot")
    above = paths(manifest.sources, tops, 1)
    out = _merge(leaves, stored, above, 0, _as_proof, _PROOF, "source string, doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return out.select("doc_id", "source", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
