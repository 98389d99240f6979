"""Lexical search: a persisted inverted index with block maxima.

``LexicalIndex.build`` counts every chunk's words in one pass over the texts and writes, where it reads
them, lists of postings (chunk, impact) of a word, type and block of chunk numbers, in directories by
the word's first two letters; it stems the distinct words, and a second table has the stem of every
word. Lists are not moved, and not joined with the stems: a search finds the words of its
stems in that table. Words of a stem share their first two letters, y as i, so they are in one
directory; those of a stem of one letter may be in several, and all are read. A list has its largest impact beside it. A search takes a table of questions:

1. only the directories of the questions' words are read (partition filters of the scan);
2. the sum of a block's maxima bounds the score of every chunk in it, and a block's largest
   maximum is a score that one of its chunks reaches, so the k-th largest of these is reached by k
   chunks: blocks that are bounded below it for all questions hold none of the best k;
3. the postings of the remaining blocks are summed, and the best k kept, ties by chunk number.

Postings are dealt once, whatever the number of questions, and summed where they are: by chunk for all
scores, and for the best k as whole lists by block. Then questions go out in blocks of bounded size; a task
sums all questions' scores of some chunks at a time and keeps the best k of each question (and lane), so
only these are shuffled. The result is that of a full
scan. A chunk matches if it has any term. Impacts are integers, thousandths of a weight for each
occurrence, so sums do not depend on their order.

Chunk numbers should be dense and near each other in the input: else a list holds few chunks. Rows
of one number and type are one chunk; bounds are as many times as large as rows share a number. A null field has no words, a null question none either; a
chunk without words is not in the index.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import stem as S
from lodestrata.functions import text as T
from lodestrata.sources.scratch import delete, new_path, written

#: Fixed values, in thousandths: caption 1.0 and another 4 x 0.1, breadcrumb 0.4, content 0.2, unverified hint 0.25 x 0.1.
WEIGHTS = {"caption": 1400, "breadcrumb": 400, "content": 200, "hint": 25}
#: Rows of terms that are broadcast, and of a block of questions; beyond, Spark joins, and a search takes several blocks.
FEW_TERMS = 200_000
#: Pairs of a question's word and a posting that one task of a search sums: in Spark, and in arrays.
TASK_PAIRS, ARRAY_PAIRS = 2_000_000, 64_000_000
#: Scores, and pairs, that a task holds at once; candidates that it holds before it keeps the best k; bytes of text that a task of a build makes into lists at once.
CELLS, PAIRS, HELD, LISTED = 1 << 22, 1 << 21, 1 << 16, 1 << 24
#: The number of a chunk without one, after all others.
NO_CHUNK = (1 << 63) - 1


def few(df: DataFrame) -> DataFrame:
    """``df``, a written table, broadcast if it has at most FEW_TERMS rows."""
    return F.broadcast(df) if df.limit(FEW_TERMS + 1).count() <= FEW_TERMS else df


def meaningful(word: str) -> Column:
    return ~F.col(word).isin(S.STOP)


def _words(column: pa.Array, is_word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as one array, and the number of the text of each."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(column.buffers()[2] or b"", "u1")[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = is_word[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(text)]
    begins[heads] = inside[heads]  # a word ends with its text
    letters, first = text[inside], np.flatnonzero(begins[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[first, len(letters)].astype("i8")), pa.py_buffer(letters)])
    return words, np.searchsorted(ends, np.flatnonzero(begins), "right") - 1


def _counted(weights: tuple[int, ...], span: int) -> Callable:
    """Rows (chunk_id, content_type, lower-case texts as bytes) to lists of postings. Words are counted
    by sorting numbers: of the word, the row and the field, in that order."""
    is_word = np.zeros(256, bool)
    is_word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    stop, weight = pa.array([w.encode() for w in S.STOP], pa.large_binary()), np.array(weights, "i8")
    field_bits = len(weights).bit_length()

    def blocks(batch: pa.RecordBatch) -> pa.Array:
        return pc.floor(pc.divide(batch.column(0).cast(pa.float64(), safe=False), span)).cast(pa.int64())

    def lists(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind, block = batch.column(1).dictionary_encode(), blocks(batch)
        kind_of, block_of = kind.indices.fill_null(-1).to_numpy(), block.fill_null(NO_CHUNK).to_numpy()
        order = np.lexsort((block_of, kind_of))  # rows of a type and block side by side
        place, bits = np.argsort(order), len(order).bit_length()
        group = np.cumsum(np.r_[False, (np.diff(kind_of[order]) != 0) | (np.diff(block_of[order]) != 0)])
        found, rows = zip(*(_words(c, is_word) for c in batch.columns[2:]), strict=True)
        word = pa.concat_arrays(found).dictionary_encode()
        keep = ~pc.is_in(word.dictionary, stop).to_numpy(zero_copy_only=False)
        key = word.indices.to_numpy().astype("i8") << bits + field_bits
        key |= np.concatenate([place[r] << field_bits | f for f, r in enumerate(rows)])
        key = np.sort(key[keep[word.indices.to_numpy()]])
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, np.diff(key >> field_bits) != 0])
        impact = np.add.reduceat(weight[key & (1 << field_bits) - 1], first)
        key = key[first] >> field_bits
        of, key = key & (1 << bits) - 1, key >> bits
        first = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(group[of]) != 0)])
        ends, head = pa.array(np.r_[first, len(of)].astype("i4")), pa.array(order[of[first]])
        columns = {
            "word": pc.take(word.dictionary, pa.array(key[first])).cast(pa.binary()).cast(pa.string()),
            "content_type": batch.column(1).take(head),
            "block": block.take(head),
            "most": pa.array(np.maximum.reduceat(impact, first)),
            "n": pa.array(np.diff(np.r_[first, len(of)])),
            "chunks": pa.ListArray.from_arrays(ends, batch.column(0).take(pa.array(order[of]))),
            "impacts": pa.ListArray.from_arrays(ends, pa.array(impact)),
        }
        yield pa.RecordBatch.from_pydict(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes whole blocks at once, as many as LISTED allows, of one batch or several; else what it allows."""
        rest = None
        for batch in _then_none(batches):
            if batch is not None:
                rest = batch if rest is None or not rest.num_rows else pa.concat_batches([rest, batch])
            if rest is None:
                continue
            size = np.cumsum(sum(pc.binary_length(c).to_numpy().astype("i8") for c in rest.columns[2:]))
            new, at = np.flatnonzero(np.diff(blocks(rest).fill_null(NO_CHUNK).to_numpy())) + 1, 0
            while at < len(size):
                to = int(np.searchsorted(size, (size[at - 1] if at else 0) + LISTED, "right"))
                if to == len(size) and batch is not None:
                    break
                whole = new[np.searchsorted(new, to, "right") - 1] if to < len(size) and len(new) else 0
                to = int(whole) if at < whole <= to else max(at + 1, to)
                yield from lists(rest.slice(at, to - at))
                at = to
            rest = rest.slice(at)

    return count


def _kept(starts: np.ndarray, asked: np.ndarray, questions: int, k: int) -> Callable:
    """The best k per question and lane of a task's lists (block, lane, content_type, number of a word,
    chunks, impacts), which come sorted by block and lane. Word n is asked by the questions
    asked[starts[n]:starts[n + 1]]."""

    def best(parts: list[tuple]) -> tuple:
        q, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
        return q[keep], ids[keep], score[keep]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, floor, held, new = np.diff(starts), {}, {}, {}

        def settle(lane: str | None) -> None:
            held[lane] = q, _, score = best([*([held[lane]] if lane in held else []), *new.pop(lane)])
            full = np.flatnonzero(np.bincount(q, minlength=questions) == k)
            last = np.searchsorted(q, full, "right") - 1
            floor[lane][full] = score[last]

        def add(lane: str | None, ids: np.ndarray, run: np.ndarray, word: np.ndarray, impact: np.ndarray) -> None:
            """Sums postings of whole chunks of a lane: of chunk run[i], 0 on, with its number by that."""
            n = times[word]
            at = np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(run * questions, n) + asked[at]
            total = np.bincount(cell, np.repeat(impact, n), len(ids) * questions).reshape(len(ids), questions)
            c, q = np.nonzero(total > floor.setdefault(lane, np.zeros(questions)))  # later chunks lose ties
            if len(c):
                new.setdefault(lane, []).append((q, ids[c], total[c, q]))
                if sum(len(x[0]) for x in new[lane]) >= HELD:
                    settle(lane)

        def block(lists: pa.Table) -> None:
            """Sums all lists of a block and lane, some chunks at a time."""
            lists = lists.combine_chunks()
            lane, sizes = lists.column("lane")[0].as_py(), pc.list_value_length(lists.column("chunks")).to_numpy()
            ids = pc.list_flatten(lists.column("chunks")).fill_null(NO_CHUNK).to_numpy()
            kind = pc.dictionary_encode(lists.column("content_type").combine_chunks()).indices.fill_null(-1).to_numpy() + 1
            kinds = int(kind.max()) + 1
            place = ids - ids.min()
            if place.max() < (1 << 16) // kinds:  # small numbers sort faster
                place = (place * kinds + np.repeat(kind, sizes)).astype("u2")
                order = np.argsort(place, kind="stable")
                other = np.diff(place[order]) != 0
            else:
                kind = np.repeat(kind, sizes)
                order = np.lexsort((kind, place))
                other = (np.diff(place[order]) != 0) | (np.diff(kind[order]) != 0)
            ids, impact = ids[order], pc.list_flatten(lists.column("impacts")).to_numpy()[order]
            word = np.repeat(lists.column("number").to_numpy(), sizes)[order]
            first = np.flatnonzero(np.r_[True, other])
            ends, pairs, i = np.r_[first[1:], len(ids)], np.cumsum(times[word]), 0
            while i < len(first):
                before = pairs[first[i] - 1] if first[i] else 0
                j = max(i + 1, min(i + max(1, CELLS // questions), np.searchsorted(pairs[ends - 1], before + PAIRS, "right")))
                part = slice(first[i], ends[j - 1])
                add(lane, ids[first[i:j]], np.repeat(np.arange(j - i), ends[i:j] - first[i:j]), word[part], impact[part])
                i = j

        rest: list[pa.Table] = []  # lists of the last block and lane, which may go on in the next batch
        for batch in _then_none(batches):
            if batch is None:
                if rest:
                    block(pa.concat_tables(rest))
                continue
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            of = batch.column("block").fill_null(NO_CHUNK).to_numpy(), batch.column("lane").dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(of[0]) != 0) | (np.diff(of[1]) != 0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                if rest and any(rest[-1].column(c)[0] != part.column(c)[0] for c in ("block", "lane")):
                    block(pa.concat_tables(rest))
                    rest = []
                rest.append(part)
        for lane in [*new]:
            settle(lane)
        for lane, (q, ids, score) in held.items():
            columns = [pa.array(q, pa.int64()), pa.array([lane] * len(q), pa.string()), pa.array(ids, pa.int64(), mask=ids == NO_CHUNK), pa.array(score.astype("i8"))]
            yield pa.RecordBatch.from_arrays(columns, ["_question", "lane", "chunk_id", "impact"])

    return keep


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@dataclass
class LexicalIndex:
    spark: SparkSession
    path: str
    shards: int
    span: int
    shared: int = 1  # rows that share a chunk's number, at most
    scanned: list[int] = field(default_factory=list)  # the directories that the last search read

    @classmethod
    def build(cls, chunks: DataFrame, path: str, weights: dict[str, int] = WEIGHTS, shards: int = 64, span: int = 4096) -> LexicalIndex:
        """Index ``chunks`` (chunk_id, content_type and the weighted columns) at ``path``."""
        spark = chunks.sparkSession
        texts = chunks.select(F.col("chunk_id").cast("bigint"), "content_type", *(F.lower(F.coalesce(F.col(c), F.lit(""))).cast("binary").alias(f"text_{i}") for i, c in enumerate(weights)))
        counts = texts.mapInArrow(_counted(tuple(weights.values()), span), cls._LISTS).withColumn("shard", cls._shard("word", shards))
        lists = written(counts, "words", f"{path}/postings", "shard")
        written(S.with_stems(lists.select("word", "shard").distinct(), "word", "term"), "stems", f"{path}/stems")
        shared = chunks.groupBy("chunk_id").count().agg(F.max("count")).first()[0]
        return cls(spark, path, shards, span, shared or 1)

    _LISTS = "word string, content_type string, block bigint, most bigint, n bigint, chunks array<bigint>, impacts array<bigint>"

    @staticmethod
    def _shard(word: str, shards: int) -> Column:
        """By what a word shares with its stem."""
        return F.pmod(F.xxhash64(F.translate(F.substring(word, 1, 2), "y", "i")), F.lit(shards)).cast("int")

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"{self._LISTS}, shard int").parquet(f"{self.path}/postings")

    @staticmethod
    def _postings(lists: DataFrame) -> DataFrame:
        """A row for each chunk of the lists."""
        own = [c for c in lists.columns if c not in ("most", "n", "chunks", "impacts")]
        return lists.select(*own, F.inline(F.arrays_zip("chunks", "impacts"))).withColumnsRenamed({"chunks": "chunk_id", "impacts": "impact"})

    def stems(self) -> DataFrame:
        return self.spark.read.schema("word string, term string, shard int").parquet(f"{self.path}/stems")

    def words(self, questions: DataFrame, keys: list[str], question: str) -> DataFrame:
        """The index's words with a stem of the questions' search words: (*keys, word, shard)."""
        asked = questions.select(*keys, F.explode(T.lexical_query(F.col(question))).alias("word")).where(meaningful("word"))
        terms = written(S.with_stems(asked, "word", "term").select(*keys, "term").distinct(), "terms")
        return written(self.stems().join(few(terms), "term").select(*keys, "word", "shard"), "asked")

    def scores(self, questions: DataFrame, keys: list[str], question: str = "question") -> DataFrame:
        """Every matching chunk: (*keys, chunk_id, content_type, score). Questions meet the postings where
        a chunk's are, so pairs of questions and chunks are never shuffled."""
        words = self.words(questions, keys, question)
        asked = words.groupBy("shard", "word").agg(F.count(F.lit(1)).alias("asked"))
        lists = self._reads(self.lists(), words)
        pairs = lists.join(few(asked), ["shard", "word"]).agg(F.sum(F.col("n") * F.col("asked"))).first()[0]
        dealt = self._postings(lists).repartition(self._parts(pairs, TASK_PAIRS), "chunk_id")
        total = dealt.join(few(words), ["shard", "word"]).groupBy(*keys, "content_type", "chunk_id").agg(F.sum("impact").alias("impact"))
        return total.select(*keys, "chunk_id", "content_type", (F.col("impact") / 1000.0).alias("score"))

    def _reads(self, stored: DataFrame, words: DataFrame) -> DataFrame:
        """Lists of the words, each once, however many questions ask for it."""
        self.scanned = sorted(r[0] for r in words.select("shard").distinct().collect())  # at most as many as there are directories
        return stored.where(F.col("shard").isin(self.scanned) if self.scanned else F.lit(False)).join(few(words.select("shard", "word").distinct()), ["shard", "word"], "left_semi")

    def _parts(self, pairs: int | None, most: int) -> int:
        """Tasks of a search, by the pairs of a question's word and a posting."""
        return max(self.spark.sparkContext.defaultParallelism, -(-(pairs or 0) // most))

    def topk(self, questions: DataFrame, keys: list[str], k: int, question: str = "question", lanes: dict[str, str] | None = None) -> DataFrame:
        """The best k chunks of every question, or of every question and lane if ``lanes`` maps content
        types to lanes: (*keys, lane, chunk_id, score, rank); lane is null without lanes. Content
        types that are in no lane are left out."""
        words = self.words(questions, keys, question)
        blocks = max(1, -(-words.count() // FEW_TERMS))
        out = None
        for b in range(blocks):
            mine = words if blocks == 1 else words.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == b)
            part = self._block(mine, keys, k, lanes)
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, words: DataFrame, keys: list[str], k: int, of_lane: Callable) -> DataFrame:
        """(content_type, block, pairs) of the blocks that can hold one of some question's best k, with
        their pairs of a question's word and a posting."""
        group = [*keys, "lane"]
        largest = self._reads(self.lists(), words).groupBy("shard", "word", "content_type", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
        largest = largest.repartition("block").join(few(words), ["shard", "word"])
        bounds = of_lane(largest).groupBy(*group, "content_type", "block").agg((F.sum("most") * self.shared).alias("bound"), F.max("most").alias("reached"), F.sum("n").alias("pairs"))
        bounds = written(bounds, "bounds")
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("reached")))
        floor = bounds.withColumn("n", place).where(F.col("n") <= k).groupBy(*group).agg(F.when(F.count(F.lit(1)) == k, F.min("reached")).otherwise(F.lit(0)).alias("floor"))
        floor = floor.toDF(*(f"of_{c}" for c in group), "floor")
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
        open_to = bounds.join(floor, same).groupBy("content_type", "block").agg(F.bool_or(F.expr("bound >= floor")).alias("open"), F.sum("pairs").alias("pairs"))
        return written(open_to.where("open").drop("open"), "live")

    def _block(self, words: DataFrame, keys: list[str], k: int, lanes: dict[str, str] | None) -> DataFrame:
        lane = T.mapped(F.col("content_type"), lanes) if lanes else F.lit(None).cast("string")
        of_lane = (lambda df: df.withColumn("lane", lane).where("lane IS NOT NULL")) if lanes else (lambda df: df.withColumn("lane", lane))
        rows = words.collect()  # about FEW_TERMS
        question_no = {q: i for i, q in enumerate(dict.fromkeys(tuple(r[c] for c in keys) for r in rows))}
        word_no = {w: i for i, w in enumerate(dict.fromkeys((r["shard"], r["word"]) for r in rows))}
        kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in keys)
        names = self.spark.createDataFrame([(i, *q) for q, i in question_no.items()], f"_question bigint, {kinds}")
        numbers = self.spark.createDataFrame([(*w, i) for w, i in word_no.items()], "shard int, word string, number int")
        pairs = np.array(sorted((word_no[r["shard"], r["word"]], question_no[tuple(r[c] for c in keys)]) for r in rows), "i8").reshape(-1, 2)
        starts = np.searchsorted(pairs[:, 0], np.arange(len(word_no) + 1))
        live = self._live(words, keys, k, of_lane).toDF("of_type", "of_block", "pairs")
        parts = self._parts(live.agg(F.sum("pairs")).first()[0], ARRAY_PAIRS)
        hits = of_lane(self._reads(self.lists(), words).join(F.broadcast(numbers), ["shard", "word"]))
        hits = hits.join(few(live), F.col("content_type").eqNullSafe(F.col("of_type")) & F.col("block").eqNullSafe(F.col("of_block")), "left_semi")
        dealt = hits.select("block", "lane", "content_type", "number", "chunks", "impacts").repartition(parts, "block", "lane")
        dealt = dealt.sortWithinPartitions(F.asc_nulls_last("block"), "lane")
        found = dealt.mapInArrow(_kept(starts, pairs[:, 1].copy(), max(1, len(question_no)), k), "_question bigint, lane string, chunk_id bigint, impact bigint")
        best = F.row_number().over(Window.partitionBy("_question", "lane").orderBy(F.desc("impact"), F.asc_nulls_last("chunk_id")))
        cut = found.withColumn("rank", best).where(F.col("rank") <= k).join(F.broadcast(names), "_question")
        return cut.select(*keys, "lane", "chunk_id", (F.col("impact") / 1000.0).alias("score"), "rank")
