"""Folds over the rows of a key in order, streamed: state per key, never a key's rows.

Rows are dealt by key and sorted, which spills; a task then carries one state from row to row and
starts a new one where the key changes. A key with a third of all rows is one task's stream, which
the order forces, but holds no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[..., tuple]


def folded(rows: DataFrame, keys: list[str], order: list[Column], inputs: list[str], start: Callable[[], Step], outputs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``rows`` with further columns: ``start`` makes a key's step, which takes a row's ``inputs`` and gives
    its ``outputs`` (name: SQL type, Arrow type). Other columns pass through as they are."""
    names = rows.columns
    at_keys, at_inputs = [names.index(k) for k in keys], [names.index(i) for i in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            found = zip(*(batch.column(i).to_pylist() for i in at_keys), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in at_inputs), strict=True)
            out = []
            for key, value in zip(found, values, strict=True):
                if step is None or key != last:
                    last, step = key, start()
                out.append(step(*value))
            made = [pa.array([o[i] for o in out], kind) for i, (_, kind) in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *outputs])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` {t}" for n, (t, _) in outputs.items())])
    ordered = rows.repartition(*keys).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys), *order)
    return ordered.mapInArrow(run, ddl)


def packed(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """``rows`` with ``item``, their number in their key, and ``pack``: one that does not fit opens the next. A null cost is none."""

    def start() -> Step:
        item = pack = used = 0

        def step(c: int | None) -> tuple[int, int]:
            nonlocal item, pack, used
            c = c or 0
            if used > 0 and used + c > budget:
                pack, used = pack + 1, c
            else:
                used += c
            item += 1
            return item - 1, pack

        return step

    return folded(rows, keys, order, [cost], start, {"item": ("int", pa.int32()), "pack": ("int", pa.int32())})


def selected(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """``rows`` with ``item`` and ``kept``: one that does not fit is skipped and takes nothing."""

    def start() -> Step:
        item = used = 0

        def step(c: int | None) -> tuple[int, bool]:
            nonlocal item, used
            fits = used + (c or 0) <= budget
            used += (c or 0) * fits
            item += 1
            return item - 1, fits

        return step

    return folded(rows, keys, order, [cost], start, {"item": ("int", pa.int32()), "kept": ("boolean", pa.bool_())})


def section_paths(outline: DataFrame, document: str, position: str, depth: str, title: str) -> DataFrame:
    """Per outline node (document, position, depth, title) its ``breadcrumb``, the titles from the
    outermost ancestor on, and its ``sub_document``. A title that ends in .pdf opens a document of
    its own: it starts a new breadcrumb and names the sub-document of all below it. A node's
    ancestors are the last nodes before it of each lesser depth since the last that was less deep
    still; the state is that path. Titles are trimmed, a null one is empty."""

    def start() -> Step:
        path: list[tuple[int, str, str | None]] = []

        def step(d: int, t: str) -> tuple[str, str | None]:
            while path and path[-1][0] >= d:
                path.pop()
            crumb, sub = path[-1][1:] if path else ("", None)
            if t.lower().endswith(".pdf"):
                crumb, sub = t, t
            else:
                crumb = f"{crumb} > {t}" if crumb else t
            path.append((d, crumb, sub))
            return crumb, sub

        return step

    nodes = outline.select(document, position, F.coalesce(F.col(depth).cast("int"), F.lit(0)).alias(depth), F.trim(F.coalesce(F.col(title), F.lit(""))).alias(title))
    return folded(nodes, [document], [F.col(position).asc_nulls_first(), F.col(depth), F.col(title)], [depth, title], start, {"breadcrumb": ("string", pa.string()), "sub_document": ("string", pa.string())})
