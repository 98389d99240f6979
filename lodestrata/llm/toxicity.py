"""Toxicity by weak supervision.

1. Lexicon entries (words and word beginnings) are mined from labelled training rows by
   log-likelihood ratio, beside small fixed lists of insults, profanity, threats and phrases.
2. Voters of different kinds (fixed and mined lexicons, phrases, second person near a telling
   word, density, shouting, masked and drawn-out spelling) vote on every document in one pass;
   the vote patterns of all documents, at most 2^N_VOTERS, are counted in one grouped aggregation.
3. A generative label model is fitted to these counts by expectation maximisation: each voter's
   rates in both classes under independence, and correlations of voters within a class from the
   posteriors' residuals, by whose sum a voter's log odds are divided: those that say the same
   thing count once. (A heuristic for correlation, not a term of the likelihood.)
4. A linear classifier of lexicon entries and votes is trained on the label model's posteriors:
   of at most ``max_labelled`` labelled rows, whose label is one more voter, and of all other
   documents by their vote patterns, each as often as it stands there. Its output is the score,
   computed in the JVM from the votes of step 2.

Rows whose crc32(doc_id) mod 3 is 1 never take part in a fit of labels; lang, source and doc_id
are no inputs. Near-copies among labelled rows of one label (0.8 of their 5-word shingles) count
once in mining. Defined cases: null and empty texts are scored (no entries, no votes); labels
that are null or of unknown documents are ignored, of several labels of one document the
largest counts; without usable labels the label model alone scores; texts of any length are read
whole, in pieces; entries of equal weight are ordered by their bytes; repeated rows each get
their row; a row goes from drop_toxic if its own id and text were scored toxic; an empty table
gives an empty result; extra columns are never read, and no column name of theirs clashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes, discard, hash_sample, held_out, id_key, materialize, numbers, pieces, quoted, slices, text_key, without, words_of

#: Bound of the labelled rows that are fitted on the driver.
MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7)
#: Fixed words and phrases of the voters.
SEED = frozenset(b"idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb jerk bastard fool garbage ugly hate".split())
INSULTS_ELSEWHERE = frozenset("idiota imbécil imbecil estúpido estúpida tonto basura inútil payaso idiote imbécile crétin débile connard ordure abruti nul clown idioten dummkopf trottel arschloch blöd dumm abschaum versager widerlich".encode().split())
PROFANITY = frozenset("shit shitty fuck fucking crap damn bitch ass asshole dick piss merde putain chier mierda puta joder scheiße scheisse verdammt kacke".encode().split())
THREATS = frozenset("kill killed murder hang stab shoot destroy beat burn tuer matar töten umbringen".encode().split())
ATTACKS = tuple("shut up|get lost|go to hell|screw you|nobody likes|you are a|you are an|you are such|go away|ta gueule|va te faire|tu es un|du bist ein|halt die klappe|eres un|cállate|vete a".encode().split(b"|"))
YOU = frozenset(b"you your youre u tu du ihr vous usted".split())
SHOUT = re.compile(rb"!{2,}")
MASKED = re.compile(rb"[A-Za-z][*@$]{1,3}[A-Za-z]")
DRAWN = re.compile(rb"([A-Za-z])\1{3}")
VOTERS = ("insult", "insult elsewhere", "profanity", "threat", "mined word", "mined beginning", "attack", "twice", "near you", "shouting", "bangs", "dense", "masked", "drawn out")
N_VOTERS = len(VOTERS)
THRESHOLD = 0.7
NEAR = 3


def entries_of(word: bytes) -> list[bytes]:
    """Lexicon entries a word may stand for: itself and its beginnings (in bytes)."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


@dataclass
class Lexicon:
    """Mined entries by number; whole words, and beginnings by length."""

    index: dict[bytes, int]
    whole: dict[bytes, int] = field(init=False)
    beginnings: list[tuple[int, dict[bytes, int]]] = field(init=False)

    def __post_init__(self) -> None:
        self.whole = {e: i for e, i in self.index.items() if not e.endswith(b"*")}
        by_length: dict[int, dict[bytes, int]] = {}
        for e, i in self.index.items():
            if e.endswith(b"*"):
                by_length.setdefault(len(e) - 1, {})[e[:-1]] = i
        self.beginnings = sorted(by_length.items())

    def find(self, words: set[bytes]) -> tuple[set[int], set[bytes]]:
        """Entries present, and the words that stand for some entry."""
        own = {w for w in words if w in self.whole} if self.whole else set()
        out = {self.whole[w] for w in own}
        for k, starts in self.beginnings:
            for w in words:
                if w[:k] in starts and len(w) > k:
                    out.add(starts[w[:k]])
                    own.add(w)
        return out, own

    def groups(self) -> list[int]:
        """Per entry its voter."""
        return [5 if e.endswith(b"*") else 4 for e in sorted(self.index, key=self.index.get)]


CAPITALS, SMALL, ASCII = (bytes(range(a, b)) for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0, 0x80)))


def letters(data: bytes) -> tuple[int, int]:
    """How many capital and how many small letters a text has, of any script."""
    upper, lower = (len(data) - len(data.translate(None, delete=x)) for x in (CAPITALS, SMALL))
    rest = data.translate(None, delete=ASCII).decode(errors="replace")
    for c in set(rest):
        if c.isupper():
            upper += rest.count(c)
        elif c.islower():
            lower += rest.count(c)
    return upper, lower


def examine(data: bytes, lexicon: Lexicon, groups: list[int]) -> tuple[list[int], int]:
    """Entries present and votes of one text."""
    hits: set[int] = set()
    votes, n_words, telling, before, told = 0, 0, 0, [], set()  # told: those of the last words that are telling
    for piece in pieces(data):
        words = piece.translate(WORD_TABLE).split()
        own = set(words)
        found, marks = lexicon.find(own)
        hits |= found
        for j, fixed in enumerate((SEED, INSULTS_ELSEWHERE, PROFANITY, THREATS)):
            if not fixed.isdisjoint(own):
                votes |= 1 << j
                if j < 3:
                    marks |= fixed & own
        n_words += len(words)
        telling += sum(map(marks.__contains__, words)) if marks else 0
        marks = marks | told
        if not votes >> 8 & 1 and marks and not YOU.isdisjoint(own.union(before)):
            joined = before + words
            at = [i for i, w in enumerate(joined) if w in marks]
            votes |= any(w in YOU for i in at for w in joined[max(0, i - NEAR) : i + NEAR + 1]) << 8
        before = (before + words)[-NEAR:]
        told = marks.intersection(before)
    for h in hits:
        votes |= 1 << groups[h]
    plain = data.lower()
    votes |= any(a in plain for a in ATTACKS) << 6
    votes |= (telling >= 2) << 7
    upper, lower = letters(data)
    votes |= (upper > lower) << 9
    votes |= (b"!!" in data and sum(1 for _ in SHOUT.finditer(data)) >= 3) << 10
    votes |= (0 < n_words <= 100 * telling) << 11
    votes |= (MASKED.search(data) is not None) << 12
    votes |= (DRAWN.search(data) is not None) << 13
    return sorted(hits), votes


BANDS, SHARE = 8, 0.8


def shingles_of(text: bytes) -> np.ndarray:
    """Hashes of the distinct 5-word shingles; a shorter text is one shingle."""
    words = words_of(text)
    own = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


def one_of_copies(train: DataFrame) -> DataFrame:
    """doc_id, toxic, text of ``train`` with one row of each group of near-copies of one label.
    Copies are no independent evidence; counted singly they make chance words of one text look
    telling. Rows that share a band of two minimal hashes are compared with the smallest doc_id
    of the band, and go only if 0.8 of their shingles are the same."""
    factors = np.random.default_rng(5).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in as_bytes(batch.column("text")):
                hashes = shingles_of(text)
                least = [int((hashes * f).min()) for f in factors]
                rows.append([xxhash.xxh64_intdigest(repr((i, least[i], least[i + 1])).encode()) >> 1 for i in range(0, 2 * BANDS, 2)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "toxic", "bands"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in slices(batches):
            out = []
            for i, a, first, b in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("first").to_pylist(), as_bytes(batch.column("first_text")), strict=True):
                if last != first:
                    last, other = first, shingles_of(b)
                own = shingles_of(a)
                shared = len(np.intersect1d(own, other))
                if shared >= SHARE * (len(own) + len(other) - shared):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["doc_id"])

    bands = materialize(train.select("doc_id", "toxic", "text").mapInArrow(sketch, "doc_id long, toxic int, bands array<long>").select("doc_id", "toxic", F.explode("bands").alias("band")), "bands")
    first = bands.groupBy("toxic", "band").agg(F.min("doc_id").alias("first"))
    pairs = bands.join(first, ["toxic", "band"]).where("doc_id <> first").select("doc_id", "first").distinct()
    pairs = pairs.join(train.select("doc_id", "text"), "doc_id").join(train.select(F.col("doc_id").alias("first"), F.col("text").alias("first_text")), "first")
    copies = pairs.mapInArrow(compare, "doc_id long").distinct()
    out = materialize(train.join(copies, "doc_id", "left_anti"), "train")
    discard(bands)
    return out


def without_nested(counts: dict[bytes, tuple[int, int]]) -> list[bytes]:
    """One entry for one stem: a beginning goes where a longer entry marks nearly as many toxic
    rows, and then an entry goes where a beginning of it that stays is about as precise."""
    stem = lambda e: e.removesuffix(b"*")
    shorter = lambda e: [q for k in PREFIXES if k < len(stem(e)) and (q := stem(e)[:k] + b"*") != e and q in counts]
    general = {q for e, (t, c) in counts.items() for q in shorter(e) if t >= 0.95 * counts[q][0] and c <= counts[q][1]}
    left = [e for e in counts if e not in general]
    precise = lambda e: counts[e][0] / sum(counts[e])
    stays = set(left)
    return [e for e in left if not any(q in stays and precise(q) >= precise(e) - 0.1 for q in shorter(e))]


def mine(train: DataFrame) -> Lexicon:
    """Entries that mark toxic rows of ``train`` (text, toxic). The threshold on the likelihood
    ratio grows with the number of entries tried, so chance finds stay rare at every size. All
    entries beyond it are taken."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["entry", "toxic", "clean"])
            seen.clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                for e in {e for w in set(words_of(text)) for e in entries_of(w)}:
                    seen.setdefault(e, [0, 0])[toxic] += 1
                if len(seen) > 1 << 16:
                    yield flush()
        yield flush()

    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        return Lexicon({})
    counts = train.select("text", "toxic").mapInArrow(count, "entry binary, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts.where("toxic >= 2"), "entries")
    base = (n1 + 1) / (n1 + n0 + 2)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    g = 2 * (F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    at_least = 2 * math.log(max(2, counts.count()))
    best = counts.where(share >= max(0.5, min(0.95, 2 * base))).withColumn("g", g).where(F.col("g") >= at_least).orderBy(F.desc("g"), "entry").collect()  # what passes, of entries of at most max_labelled rows
    kept = without_nested({bytes(r["entry"]): (r["toxic"], r["clean"]) for r in best})
    discard(counts)
    return Lexicon({e: i for i, e in enumerate(kept)})


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray  # (2, voters): how often a voter fires in clean and in toxic texts
    correlation: np.ndarray
    discount: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray]:
        """Intercept and weight of each vote."""
        fires = np.log(self.rates[1] / self.rates[0]) * self.discount
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.discount
        return math.log(self.prior / (1 - self.prior)) + float(silent.sum()), fires - silent

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        b, w = self.log_odds()
        return 1 / (1 + np.exp(-np.clip(b + bits @ w, -60, 60)))


def as_bits(votes: list[int]) -> np.ndarray:
    return np.array([[v >> j & 1 for j in range(N_VOTERS)] for v in votes], float).reshape(len(votes), N_VOTERS)


def fit_label_model(counts: dict[int, int], labelled: dict[tuple[int, int], int], rounds: int = 40) -> LabelModel:
    """counts: documents per vote pattern; labelled: training rows per (pattern, label)."""
    keys = sorted(counts)
    bits, n = as_bits(keys), np.array([counts[k] for k in keys], float)
    lab = sorted(labelled)
    lbits, ly, ln = as_bits([v for v, _ in lab]), np.array([y for _, y in lab], float), np.array([labelled[k] for k in lab], float)
    lexical = [0, 1, 2, 3, 4, 5, 6, 8, 11]  # what speaks for toxicity by its nature
    post = np.clip(bits[:, lexical].mean(axis=1) * 2, 0.02, 0.98)
    if len(lab) and 0 < (ly * ln).sum() < ln.sum():
        rates = np.array([((lbits * (ln * c)[:, None]).sum(0) + 1) / ((ln * c).sum() + 2) for c in (1 - ly, ly)])
        post = LabelModel(float((ly * ln).sum() / ln.sum()), rates, np.eye(N_VOTERS), np.ones(N_VOTERS)).posterior(bits)
    discount, model = np.ones(N_VOTERS), None
    for _ in range(rounds):
        rates, spread, weight = np.zeros((2, N_VOTERS)), np.zeros((N_VOTERS, N_VOTERS)), 0.0
        for c, (w, lw) in enumerate(((n * (1 - post), ln * (1 - ly)), (n * post, ln * ly))):
            rates[c] = ((bits * w[:, None]).sum(0) + (lbits * lw[:, None]).sum(0) + 1) / (w.sum() + lw.sum() + 2)
            off = bits - rates[c]
            spread += (off * w[:, None]).T @ off
            weight += w.sum()
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        correlation = spread / np.outer(scale, scale)
        np.fill_diagonal(correlation, 1.0)
        discount = 1 / np.maximum(correlation, 0).sum(axis=1)
        prior = float(np.clip(((n * post).sum() + (ln * ly).sum() + 1) / (n.sum() + ln.sum() + 2), 1e-3, 0.999))
        model = LabelModel(prior, np.clip(rates, 1e-6, 1 - 1e-6), correlation, discount)
        post = model.posterior(bits)
    return model


def fit_linear(hits: list[list[int]], bits: np.ndarray, y: np.ndarray, n: np.ndarray, n_entries: int, steps: int = 400, l2: float = 1e-5) -> tuple[float, np.ndarray]:
    """Logistic regression on entries and votes with soft labels, by Adam; bias and weights.
    ``n``: how much a row counts."""
    n = n / n.sum()
    rows = np.concatenate([np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.nonzero(bits)[0]])
    cols = np.concatenate([np.array([i for h in hits for i in h], np.int64), np.nonzero(bits)[1] + n_entries])
    w, b = np.zeros(n_entries + N_VOTERS), math.log(((n * y).sum() + 1e-3) / (1 - (n * y).sum() + 1e-3))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], len(y))
        err = n * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.append(np.bincount(cols, err[rows], len(w)) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return b, w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    groups: list[int]
    label_model: LabelModel
    bias: float
    weights: np.ndarray  # entries, then votes

    def score_text(self, data: bytes) -> float:
        hits, votes = examine(data, self.lexicon, self.groups)
        z = self.bias + sum(self.weights[h] for h in hits) + sum(self.weights[len(self.groups) + j] for j in range(N_VOTERS) if votes >> j & 1)
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))

    def score(self) -> Column:
        """The score from the columns ``hits`` and ``votes``."""
        n = len(self.groups)
        by_entry, by_vote = numbers(self.weights[:n].tolist()), numbers(self.weights[n:].tolist())
        z = F.lit(self.bias) + F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + F.get(by_entry, h))
        z = z + F.aggregate(F.array(*map(F.lit, range(N_VOTERS))), F.lit(0.0), lambda acc, j: acc + F.get(by_vote, j) * F.expr("votes").bitwiseAND(F.pow(F.lit(2), j).cast("int")).cast("boolean").cast("double"))
        return 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id") -> tuple[ToxicityModel, DataFrame]:
    """The model, and (doc_id, h, hits, votes) of every row of ``docs``; h: hash of the text."""
    spark = docs.sparkSession
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    usable = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    usable = materialize(usable.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "usable")
    sample = materialize(hash_sample(usable, max_labelled, "doc_id"), "labelled")  # at most max_labelled rows
    train = materialize(texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]), "train")
    distinct = one_of_copies(train)
    lexicon = mine(distinct)
    groups = lexicon.groups()
    discard(usable, train)
    sent = spark.sparkContext.broadcast((lexicon, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by = sent.value
        for batch in slices(batches):
            found = [examine(t, own, by) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([h for h, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.int32())], names=["doc_id", "h", "hits", "votes"])

    seen = materialize(texts.withColumn("h", text_key(F.col("text"))).mapInArrow(run, "doc_id long, h long, hits array<int>, votes int"), "votes")
    counts = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}  # at most 2^N_VOTERS
    once = distinct.select("doc_id", "toxic")  # at most max_labelled ids
    rows = seen.join(F.broadcast(once), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    labelled: dict[tuple[int, int], int] = {}
    for r in rows:
        labelled[r["votes"], r["toxic"]] = labelled.get((r["votes"], r["toxic"]), 0) + 1
    model = fit_label_model(counts, labelled) if counts else LabelModel(0.5, np.full((2, N_VOTERS), 0.5), np.eye(N_VOTERS), np.ones(N_VOTERS))
    if len({r["toxic"] for r in rows}) == 2:
        # all other documents count by their votes, each pattern as often as it stands there, together as much as the labelled ones
        rest = {k: n - sum(labelled.get((k, y), 0) for y in (0, 1)) for k, n in counts.items()}
        rest = {k: n for k, n in rest.items() if n > 0}
        bits = as_bits([*(r["votes"] for r in rows), *rest])
        post = model.posterior(bits).clip(1e-6, 1 - 1e-6)
        # a labelled row's own label is one more voter, right in 95 of 100 cases
        said = np.array([(1 if r["toxic"] else -1) * math.log(0.95 / 0.05) for r in rows] + [0.0] * len(rest))
        y = 1 / (1 + np.exp(-(np.log(post / (1 - post)) + said)))
        n = np.array([1.0] * len(rows) + [k * len(rows) / max(1, sum(rest.values())) for k in rest.values()])
        bias, weights = fit_linear([*(r["hits"] for r in rows), *([] for _ in rest)], bits, y, n, len(groups))
    else:
        bias, votes = model.log_odds()
        weights = np.concatenate([np.zeros(len(groups)), votes])
    discard(sample, distinct)
    return ToxicityModel(lexicon, groups, model, float(bias), weights), seen


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model, seen = fit(docs, labels)
    scored = seen.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns. Texts pass
    through Python once, to vote; what is scored toxic is then left out by id and text."""
    model, seen = fit(docs, labels, text_col=text_col, id_col=id_col)
    toxic = seen.where(model.score() >= THRESHOLD).select(*(k.alias(n) for k, n in zip(id_key(F.col("doc_id")), ("id", "no_id"), strict=True)), "h").distinct()
    drop = materialize(toxic, "dropped")
    discard(seen)
    return without(docs, drop, [*id_key(quoted(id_col)), text_key(quoted(text_col))])
