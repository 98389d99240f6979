"""Benchmark decontamination with suffix arrays over the training texts.

Every slice of documents is one shard: its words are numbered by the benchmark's vocabulary
(other words get 0, which no test suffix holds), and the suffixes at which a window of benchmark
words can begin are sorted into a suffix array. Every distinct test suffix, cut at the window,
is binary-searched in every shard. Runs of occurrences along an item and a text are the longest
verbatim matches with their locations, and from these matches alone follow the words that are
hit, the items found and whether a document is contaminated and removed.

Documents are never shuffled while there is one block of benchmark text. Of a larger benchmark,
all windows go into a filter of bounded size first. One scan of the texts keeps those that may have
a window; only they meet the blocks, of bounded size, one after the other, and the matches of a
row are put together by its number.

Defined cases: an item with a null id is searched and counts in n_hit and contaminated, but not
in n_items and items_sha256, which are of ids (in ``matches`` its id is empty); a null text has
no words; items without words match nothing; an item of fewer than ``window`` words is one
window; items that share an id count as one in n_items; matches are ordered by their place, then
id, then place in the item; texts of any length are searched whole; repeated rows each get their
row; a row is removed if its own id and text were found contaminated; empty tables give rows
without hits or no rows; extra columns are never read, and no column name of theirs clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes, id_key, materialize, pieces, quoted, slices, text_key, without, words_of

WINDOW = 13
#: Bytes of benchmark text searched at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of text in one shard, give or take one document.
SHARD_BYTES = 6 << 20
#: Bits of the largest filter of benchmark windows (128 MB).
MOST_BITS = 1 << 30
NONE = np.zeros(0, np.int64)


@dataclass
class TestSuffixes:
    """A block of items as one array of word numbers; its suffixes, and the distinct windows."""

    vocabulary: dict[bytes, int]
    item_ids: list[str | None]
    item: np.ndarray  # per suffix: number of its item
    position: np.ndarray  # and its place in the item
    width: np.ndarray  # words of its window
    window_of: np.ndarray  # and that window's number
    windows: np.ndarray  # distinct windows, 0 beyond their width
    widths: np.ndarray  # of the distinct windows
    by_window: np.ndarray  # suffixes ordered by window
    first: np.ndarray  # where each window's suffixes begin in by_window

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        arrays = []
        for _, text in items:
            words = words_of(text)
            arrays.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.uint32, len(words)))
        sizes = np.array([len(a) for a in arrays], np.int64)
        width_of = np.minimum(sizes, window)
        n = np.where(sizes > 0, sizes - width_of + 1, 0)
        item = np.repeat(np.arange(len(items)), n)
        position = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        width = width_of[item] if len(item) else NONE
        flat = np.concatenate([*arrays, np.zeros(window, np.uint32)])
        at = (np.cumsum(sizes) - sizes)[item] + position if len(item) else NONE
        rows = np.where(np.arange(window) < width[:, None], flat[at[:, None] + np.arange(window)], 0).astype(">u4").reshape(-1, window)
        _, kept, window_of = np.unique(_keys(rows), return_index=True, return_inverse=True)
        by_window = np.argsort(window_of, kind="stable")
        first = np.searchsorted(window_of[by_window], np.arange(len(kept) + 1))
        return cls(vocabulary, [i for i, _ in items], item, position, width, window_of, rows[kept], width[kept], by_window, first)


@dataclass
class ShardMatches:
    """Occurrences in one shard: number of the distinct window and word position of each."""

    window: np.ndarray
    at: np.ndarray


def _keys(windows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(windows, ">u4").view(f"S{windows.shape[1] * 4}").ravel()


def search_shard(tokens: np.ndarray, tests: TestSuffixes) -> ShardMatches:
    """Binary-search all distinct test windows in the suffix array of ``tokens``."""
    window = tests.windows.shape[1]
    if not len(tests.windows) or not len(tokens):
        return ShardMatches(NONE, NONE)
    # how many benchmark words follow from each position on, itself included
    known = tokens > 0
    breaks = np.flatnonzero(~known)
    after = np.append(breaks, len(tokens))[np.searchsorted(breaks, np.arange(len(tokens)))] - np.arange(len(tokens))
    starts = np.flatnonzero(known & (after >= tests.widths.min()))
    if not len(starts):
        return ShardMatches(NONE, NONE)
    padded = np.concatenate([tokens, np.zeros(window, tokens.dtype)])
    suffixes = _keys(padded[starts[:, None] + np.arange(window)])
    array = np.argsort(suffixes, kind="stable")
    ordered = suffixes[array]
    low = np.searchsorted(ordered, _keys(tests.windows), "left")
    above = np.where(np.arange(window) < tests.widths[:, None], tests.windows, 0xFFFFFFFF)
    n = np.searchsorted(ordered, _keys(above), "right") - low
    hit = np.flatnonzero(n)
    found = np.repeat(hit, n[hit])
    offset = np.arange(len(found)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
    return ShardMatches(found, starts[array[np.repeat(low[hit], n[hit]) + offset]])


def longest_matches(m: ShardMatches, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Item, place in it, place in the shard and words of the matches that extend neither way."""
    if not len(m.at):
        return NONE, NONE, NONE, NONE
    # from each occurrence of a window to the items that have it
    n = tests.first[m.window + 1] - tests.first[m.window]
    suffix = tests.by_window[np.repeat(tests.first[m.window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    at, item, pos = np.repeat(m.at, n), tests.item[suffix], tests.position[suffix]
    order = np.lexsort((at, at - pos, item))
    item, pos, at, width = item[order], pos[order], at[order], tests.width[suffix[order]]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - pos[1:] != at[:-1] - pos[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return item[first], pos[first], at[first], width[first] + np.diff(np.append(first, len(at))) - 1


def tokenise(data: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    known = vocabulary.get
    parts = [np.fromiter((known(w, 0) for w in words), np.uint32, len(words)) for words in (p.split() for p in pieces(data.translate(WORD_TABLE)))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def search_texts(texts: list[bytes], tests: TestSuffixes) -> Iterator[tuple[int, list[tuple[str | None, int, int, int]]]]:
    """Words and longest matches (item id, place in item, place in text, words) of each text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < SHARD_BYTES):
            size += len(texts[stop])
            stop += 1
        tokens = [tokenise(t, tests.vocabulary) for t in texts[at:stop]]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])])
        shard = np.concatenate([x for t in tokens for x in (t, np.zeros(1, np.uint32))])
        found = search_shard(shard, tests)
        by_place = np.argsort(found.at, kind="stable")
        cuts = np.searchsorted(found.at[by_place], bounds)
        for d in range(len(tokens)):  # one text at a time, so that a passage many items share is spread out for one text only
            own = by_place[cuts[d] : cuts[d + 1]]
            matches = longest_matches(ShardMatches(found.window[own], found.at[own]), tests) if len(own) else (NONE,) * 4
            yield len(tokens[d]), [(tests.item_ids[i], p, a - int(bounds[d]), n) for i, p, a, n in zip(*(x.tolist() for x in matches), strict=True)]
        at = stop


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of test suffixes. Items go to blocks by a hash, about half of ``block_bytes`` in
    each; the size is measured first, and the driver holds one block at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + 2 * total // block_bytes if total > block_bytes else 1
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_bytes / 2
        out.append(spark.sparkContext.broadcast(TestSuffixes.of([(r[0], bytes(r[1])) for r in rows], window)))
    return out


@dataclass
class WindowFilter:
    """Which windows a benchmark may have: bits of their hashes, 64 for each window or MOST_BITS in all.
    It lets no document with a window pass by, and few of the others through."""

    bits: np.ndarray
    widths: list[int]

    @classmethod
    def of(cls, benchmark: DataFrame, window: int = WINDOW) -> WindowFilter:
        """One partition of the benchmark at a time comes to the driver."""
        texts = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
        total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        out = cls(np.zeros(min(MOST_BITS, 1 << max(16, (total * 64 // 5).bit_length())) // 8, np.uint8), [])
        widths, known = set(), {}
        for r in texts.toLocalIterator():
            hashes = _word_hashes(bytes(r["text"]), known)
            if len(hashes):
                width = min(window, len(hashes))
                widths.add(width)
                for at in out.places(hashes, width):
                    np.bitwise_or.at(out.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        out.widths = sorted(widths)
        return out

    def places(self, hashes: np.ndarray, width: int) -> list[np.ndarray]:
        """Bits of every window of ``width`` words."""
        n = len(hashes) - width + 1
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
            h ^= h >> np.uint64(29)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64) for i in range(4)]

    def may_have(self, hashes: np.ndarray) -> bool:
        for width in self.widths:
            if width <= len(hashes):
                there = np.ones(len(hashes) - width + 1, bool)
                for at in self.places(hashes, width):
                    there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if there.any():
                    return True
        return False


def _word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A hash of every word; ``known`` keeps those of words seen, a million at most."""
    if len(known) > 1 << 20:
        known.clear()
    parts = [p.split() for p in pieces(text.translate(WORD_TABLE))]
    for words in parts:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    return np.concatenate([np.fromiter((known[w] for w in words), np.uint64, len(words)) for words in parts])


def _candidates(rows: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """row, doc_id, h, n_words, and the text of those that may have a window: the one scan of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            n, kept = [], []
            for data in as_bytes(batch.column("text")):
                hashes = _word_hashes(data, known)
                n.append(len(hashes))
                kept.append(data.decode() if sent.value.may_have(hashes) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "h")), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["row", "doc_id", "h", "n_words", "text"])

    return rows.select("row", "doc_id", "h", "text").mapInArrow(run, "row long, doc_id long, h long, n_words long, text string")


MATCH = "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def _search(rows: DataFrame, keys: list[str], block) -> DataFrame:  # noqa: ANN001
    """keys, n_words and matches with one block for every row of ``rows`` (keys, text)."""
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
    names = ("item_id", "item_word", "doc_word", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found = list(search_texts(as_bytes(batch.column("text")), block.value))
            matches = pa.array([[dict(zip(names, m, strict=True)) for m in ms] for _, ms in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([n for n, _ in found], pa.int64()), matches], names=[*keys, "n_words", "matches"])

    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + f", n_words long, matches {MATCH}")


def covered(matches: Column) -> Column:
    """How many words lie in some match: matches in the order of their places, each adding what reaches beyond those before it."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["n_words"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["upto"], x["s"]))).alias("n"), F.greatest(acc["upto"], x["e"]).alias("upto"))
    return F.aggregate(spans, start, step)["n"]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, h (hash of the text), n_words, matches (longest verbatim matches), n_hit, contaminated for every row."""
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    text = quoted(text_col).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_key(text).alias("h"), text.alias("text"))
    if len(blocks) == 1:
        found = _search(rows, ["doc_id", "h"], blocks[0])
    else:
        sent = docs.sparkSession.sparkContext.broadcast(WindowFilter.of(benchmark))
        passed = materialize(_candidates(rows.withColumn("row", F.monotonically_increasing_id()), sent), "candidates")
        parts = [_search(passed.where("text is not null").select("row", "doc_id", "h", "text"), ["row", "doc_id", "h"], b) for b in blocks]
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        found = found.groupBy("row", "doc_id", "h").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).drop("row")  # a list a block
        found = found.union(passed.where("text is null").select("doc_id", "h", "n_words", F.expr(f"cast(array() as {MATCH})").alias("matches")))
    found = found.withColumn("n_hit", covered(F.col("matches")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def scan(docs: DataFrame, benchmark: DataFrame, with_matches: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with ``with_matches`` the
    longest verbatim matches (item_id, item_word, doc_word, n_words) of every document."""
    found = search(docs, benchmark, block_bytes=block_bytes)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    placed = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"], m["item_id"], m["item_word"], m["n_words"])))
    out = ["doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), "contaminated"]
    if with_matches:
        out.append(F.transform(placed, lambda m: F.struct(m["item_id"].alias("item_id"), m["item_word"].alias("item_word"), m["doc_word"].alias("doc_word"), m["n_words"].alias("n_words"))).alias("matches"))
    return found.select(*out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = search(docs, benchmark, id_col, text_col).where("contaminated")
    drop = materialize(found.select(*(k.alias(n) for k, n in zip(id_key(F.col("doc_id")), ("id", "no_id"), strict=True)), "h").distinct(), "dropped")
    return without(docs, drop, [*id_key(quoted(id_col)), text_key(quoted(text_col))])
