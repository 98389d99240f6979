"""Document structure: token windows, packing by budget, sections, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import section_paths as section_paths  # a fold over an outline's nodes


def token_windows(words: Column, size: int, overlap: int) -> Column:
    """Array of windows (arrays of words) that advance by size - overlap and stop where one
    reaches the end."""
    step = size - overlap
    n = F.size(words)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def greedy_pack(costs: Column, budget: int) -> Column:
    """Pack number of each item in order, of an array at hand: an item that does not fit opens the
    next pack. Rows of a table are packed by ``folds.packed``."""
    zero = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("packs"))

    def step(a: Column, c: Column) -> Column:
        opens = (a["used"] > 0) & (a["used"] + c > budget)
        pack = F.when(opens, a["pack"] + 1).otherwise(a["pack"])
        return F.struct(pack.alias("pack"), F.when(opens, c.cast("long")).otherwise(a["used"] + c).alias("used"), F.array_append(a["packs"], pack).alias("packs"))

    return F.aggregate(costs, zero, step, lambda a: a["packs"])


def greedy_select(costs: Column, budget: int) -> Column:
    """Which items of an array at hand fit, in order; one that does not fit is skipped and takes
    nothing. Rows of a table are selected by ``folds.selected``."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(a: Column, c: Column) -> Column:
        fits = a["used"] + c <= budget
        return F.struct((a["used"] + F.when(fits, c).otherwise(0)).cast("long").alias("used"), F.array_append(a["kept"], fits).alias("kept"))

    return F.aggregate(costs, zero, step, lambda a: a["kept"])


def leaf_sections(outline: DataFrame, document: str, position: str, depth: str) -> DataFrame:
    """Sections without children and where each ends: at the next node that is not deeper. For a
    leaf that is the next node, so one window settles both."""
    w = Window.partitionBy(document).orderBy(position)
    nxt = outline.withColumn("next_depth", F.lead(depth).over(w)).withColumn("ends_at", F.lead(position).over(w))
    return nxt.where(F.col("next_depth").isNull() | (F.col("next_depth") <= F.col(depth))).drop("next_depth")


def aligned_nodes(start: Column, end: Column) -> Column:
    """The span start..end (whole numbers, both included) as its dyadic nodes, an array of
    (level, node): node n of level k is the 2^k numbers from n * 2^k on. At most two a level, so a
    span of a thousand million numbers has some sixty. An empty span has none."""

    def at(k: Column) -> Column:
        low = -F.call_function("shiftright", -start, k)  # the first node of the level that begins in the span
        high = F.call_function("shiftright", end + 1, k) - 1  # the last one that ends in it
        there = low <= high
        left = F.when(there & (low.bitwiseAND(1) == 1), F.struct(k.alias("level"), low.alias("node")))
        right = F.when(there & (high.bitwiseAND(1) == 0), F.struct(k.alias("level"), high.alias("node")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.floor(F.log2((end - start + 1).cast("double"))).cast("int"))  # a node is no longer than the span
    return F.when(start <= end, F.filter(F.flatten(F.transform(levels, at)), lambda n: n.isNotNull()))


def innermost(points: DataFrame, spans: DataFrame, document: str, point: str, start: str, end: str, leaf: str) -> DataFrame:
    """Per point the span that contains it and starts last, ties to the larger leaf. Points and ends
    are whole numbers. A span stands as its dyadic nodes and a point as the nodes above it, up to
    the length of the longest span: a join on document, level and node, whatever the spans' lengths."""
    low, high = F.col(start).cast("long"), F.col(end).cast("long")
    nodes = spans.where(low <= high).select(document, F.col(start).alias("starts"), leaf, F.explode(aligned_nodes(low, high)).alias("n"))
    nodes = nodes.select(document, "starts", leaf, "n.level", "n.node")
    longest = spans.where(low <= high).agg(F.max(high - low)).first()[0] or 0
    above = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.call_function("shiftright", F.col(point).cast("long"), F.lit(k)).alias("node")) for k in range((longest + 1).bit_length()))))
    hits = points.select(document, point, above.alias("n")).select(document, point, "n.level", "n.node").join(nodes, [document, "level", "node"])
    return hits.groupBy(document, point).agg(F.max_by(leaf, F.struct("starts", leaf)).alias(leaf))


def nearest(points: DataFrame, places: DataFrame, keys: list[str], point: str, at: str, value: str) -> DataFrame:
    """(*keys, point, away, value): for every distinct point the place with equal keys that is nearest,
    ties to the smaller value; places without a position come last, with a null distance. Rows are
    brought down to one for each position first, and each looks back and ahead once: no pairs."""
    marked = points.where(F.col(point).isNotNull()).select(*keys, F.col(point).alias("pos"), F.lit(True).alias("asked"), F.lit(None).cast(places.schema[value].dataType).alias("v")).distinct()
    held = places.select(*keys, F.col(at).alias("pos"), F.lit(None).cast("boolean").alias("asked"), F.col(value).alias("v"))
    rows = marked.unionByName(held).groupBy(*keys, "pos").agg(F.max("asked").alias("asked"), F.min("v").alias("v"))
    there = F.when(F.col("v").isNotNull() & F.col("pos").isNotNull(), F.struct("pos", "v"))
    whole = Window.partitionBy(*keys)
    back, ahead = (F.last(there, ignorenulls=True).over(whole.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc("pos"), F.desc("pos")))
    seen = rows.select("*", back.alias("b"), ahead.alias("a"), F.min(F.when(F.col("pos").isNull(), F.col("v"))).over(whole).alias("unplaced")).where("asked")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.pos") - F.col("pos")).alias("away"), F.col(f"{c}.v").alias("v")))
    best = seen.select(*keys, F.col("pos").alias(point), F.least(far("b"), far("a")).alias("n"), "unplaced")
    return best.select(*keys, point, F.col("n.away").alias("away"), F.coalesce("n.v", "unplaced").alias(value)).where(F.col(value).isNotNull())


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]\s+"), lambda s: s != "")


def sentence_window(text: Column, needle: Column, around: int = 1) -> Column:
    """The first sentence that holds the needle, with its neighbours."""
    parts = sentences(text)
    at = F.array_position(F.transform(parts, lambda s: F.lower(s).contains(F.lower(needle))), F.lit(True)).cast("int")
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(parts, first, at + around - first + 1), ". "))


def section_texts(sections: DataFrame, pages: DataFrame, document: str, section: str, start: str, end: str, page: str, text: str) -> DataFrame:
    """Text of each section's pages from ``start`` up to but not at ``end``, in order, a line end
    between two. Pages that do not exist add nothing, one without text adds an empty line; a
    section without pages has an empty text. A join on document and page: as many rows as pages.
    Bound: one section's pages are in one row, as its text is."""
    spans = sections.where(F.col(start) < F.col(end)).select(document, section, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(page))
    found = spans.join(pages.select(document, page, F.coalesce(F.col(text), F.lit("")).alias(text)), [document, page])
    joined = found.groupBy(document, section).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("parts"))
    texts = joined.select(document, section, F.regexp_replace(F.array_join(F.col("parts")[text], "\n"), r"^\s+|\s+$", "").alias(text))
    return sections.join(texts, [document, section], "left").withColumn(text, F.coalesce(text, F.lit("")))
