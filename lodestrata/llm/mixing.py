"""Mixing sources to target weights by soft membership. DataFrame functions only.

1. Surface features of every text, and how many of its words and word beginnings are on lists
   mined from labelled rows by likelihood ratio, are cut into bins; a multinomial logistic
   regression on the bins of at most MAX_LABELLED labelled rows gives each document a posterior
   over domains, computed in the JVM from constant tables.
2. Documents with equal posteriors (rounded to 1e-3) get equal rates, so tokens are summed per
   distinct posterior, map-side combined; that table is the least-squares problem.
3. Preconditioned projected gradient descent finds nonnegative rates r with expected domain totals
   sum(r * tokens * p_k) closest to the targets: each step is one aggregation of as many sums as
   there are domains and pairs of them, and a step is one number a domain. ``Fit`` tells the
   distance that is left and whether steps had ceased to lessen it.

Defined cases: a null text has no tokens; a document without tokens gets the rate of its
posterior; without labelled rows all posteriors are equal; a domain with few labelled rows, or
none, has a small share of every posterior, as the rows' number says; zero or missing
targets of a domain pull its rate to zero; of several labels of one document the largest
toxicity and the smallest quality count; mined entries of equal weight are ordered by name; texts
of any length are read whole; repeated rows each get their row; an empty table gives an empty
result; a column named like the rate is replaced by it, no other name clashes.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_sample, held_out, materialize, numbers, quoted
from .toxicity import SEED

#: Domains of the labels table and the share of tokens each should have in the mixture.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.88, "poor": 0.07, "toxic": 0.05}
#: Labelled rows from which word lists are mined and the classifier is fitted, at most.
MAX_LABELLED = 20_000
N_BINS = 12
PREFIX = 5


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("poor")).when(F.col("quality") == 1, F.lit("clean"))


#: What is no sign, digit or capital: most of a text, taken out once before the classes are counted.
PLAIN = r"[a-z\x{80}-\x{10FFFF} \n\t\r]+"


def _share(marks: Column, others: str, text: Column) -> Column:
    """How much of ``text`` is left of ``marks`` without what the pattern ``others`` stands for."""
    return F.length(F.regexp_replace(marks, others, "")) / F.greatest(F.length(text), F.lit(1))


def _blank_share(text: Column) -> Column:
    left = reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit("")), " \n\t", text)
    return 1 - F.length(left) / F.greatest(F.length(text), F.lit(1))


@dataclass
class WordLists:
    """Mined beginnings of words, of each domain."""

    words: dict[str, list[str]] = field(default_factory=dict)


def words_of(text: Column) -> Column:
    """What stands between white space, in lower case, with what sticks to it; one split of a text
    gives its tokens, its repetitions and the beginnings of its words."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def tokens_of(words: Column) -> Column:
    """Words without the empty ones, which only stand at either end."""
    empty = (F.get(words, F.lit(0)) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return F.size(words) - empty


def entries_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, PREFIX))


def features(text: Column, words: Column | None = None, distinct: Column | None = None, marks: Column | None = None, hits: dict[str, Column] | None = None) -> list[Column]:
    """Each a bin from 0 to N_BINS - 1; shares on a logarithmic scale. ``text`` is not null;
    ``hits``: per domain, and for the fixed seed words, those beginnings of the text's words that
    are on its list, repetitions included."""
    words = words_of(text) if words is None else words
    distinct = F.array_distinct(words) if distinct is None else distinct
    marks = F.regexp_replace(text, PLAIN, "") if marks is None else marks
    hits = hits or {d: _on_list(entries_of(words), SEED_STARTS if d == "seed" else []) for d in (*DOMAINS, "seed")}
    log_bin = lambda share: F.least(F.lit(N_BINS - 1), F.greatest(F.lit(0), F.floor(F.log2(share * 4096 + 1)).cast("int")))
    part = lambda x: F.least(F.lit(N_BINS - 1), F.floor(x * N_BINS).cast("int"))
    lines, seeds = F.split(text, "\n"), _strings(sorted(w.decode() for w in SEED))
    bare = lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    out = [
        log_bin(_share(marks, "[^A-Z]+", text)),
        log_bin(_share(marks, "[^0-9]+", text)),
        log_bin(_share(marks, "[^!?]+", text)),
        log_bin(_share(marks, r"[^#$%&*^~<>{}\[\]\\=+_]+", text)),
        log_bin(_share(marks, "[^|]+", text)),
        log_bin(_share(marks, "[^.,;:]+", text)),
        log_bin(_blank_share(text) * 0.999),
        F.least(F.lit(N_BINS - 1), F.floor(F.log2(F.length(text) / 16 + 1)).cast("int")),
        F.least(F.lit(N_BINS - 1), F.when(F.size(hits["seed"]) > 0, F.size(F.filter(words, lambda w: F.array_contains(seeds, bare(w))))).otherwise(0)),
        part(F.size(distinct) / F.size(words)),
        part(F.size(F.array_distinct(lines)) / F.size(lines)),
    ]
    for d in DOMAINS:
        listed = F.size(hits[d])
        out += [F.least(F.lit(N_BINS - 1), F.size(F.array_distinct(hits[d]))), F.least(F.lit(N_BINS - 1), listed), log_bin(listed / F.size(words))]
    return out


SEED_STARTS = sorted({w.decode()[:PREFIX] for w in SEED})


def _on_list(entries: Column, values: list[str]) -> Column:
    """The entries that are among ``values``, which are hashed once a task and not once a row."""
    return F.filter(entries, lambda e: e.isin(values))


def _strings(values: list[str]) -> Column:
    """A constant array, as one literal whatever its length; the values hold no white space."""
    return F.split(F.lit(" ".join(values)), " ")


def mine(texts: DataFrame) -> WordLists:
    """Entries that mark one domain, by likelihood ratio, of rows (text, domain). The threshold
    grows with the number of entries tried; all entries beyond it are taken."""
    sizes = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    seen = texts.select("domain", F.explode(F.array_distinct(entries_of(F.array_distinct(words_of(F.col("text")))))).alias("entry"))
    per = materialize(seen.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS)).where("n >= 2 and entry <> ''"), "entries")
    at_least = 2 * math.log(max(2, per.count()))
    lists = WordLists()
    for d in DOMAINS:
        base = (sizes.get(d, 0) + 1) / (total + 2)
        if base >= 0.5:
            continue  # a mark of what is common tells little
        share = F.col(d) / F.col("n")
        g = 2 * (F.col(d) * F.log(share / base) + F.when(F.col(d) < F.col("n"), (F.col("n") - F.col(d)) * F.log((1 - share) / (1 - base))).otherwise(0.0))
        lists.words[d] = [r["entry"] for r in per.where((F.col(d) >= 2) & (share >= max(0.5, 2 * base)) & (g >= at_least)).select("entry").orderBy("entry").collect()]  # of at most MAX_LABELLED texts
    discard(per)
    return lists


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row. A generator of one row stands
    between them and their uses; a plain projection would be pasted into every use."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of all documents with labels, held-out ones left out."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return known.where(~held_out(F.col("doc_id"))).select("doc_id", domain_of_labels().alias("domain")).where("domain is not null")


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(quoted("text").cast("string"), F.lit(""))


def binned(docs: DataFrame, lists: WordLists, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, tokens and bins (array of int) of every row; each part is computed once."""
    text, marks, words, distinct = (F.col(f"__{x}") for x in ("text", "marks", "words", "distinct"))
    hits = {d: F.col(f"__of_{d}") for d in (*DOMAINS, "seed")}
    listed = lists.words | {"seed": SEED_STARTS}
    rows = once(docs.select(*keep, text_of(docs).alias("__text")), words_of(text).alias("__words"), F.regexp_replace(text, PLAIN, "").alias("__marks"))
    # one look at all beginnings for all lists, and then at the few that are on any
    either = sorted({x for own in listed.values() for x in own})
    rows = once(rows, F.array_distinct(words).alias("__distinct"), _on_list(entries_of(words), either).alias("__any"))
    rows = once(rows, *(_on_list(F.col("__any"), listed.get(d, [])).alias(f"__of_{d}") for d in hits))
    kept = [quoted(c) for c in docs.select(*keep).columns]
    return rows.select(*kept, tokens_of(words).cast("long").alias("__tokens"), F.array(*features(text, words, distinct, marks, hits)).alias("__bins"))


@dataclass
class Tables:
    """Per domain a constant and a weight of each bin of each feature [feature * N_BINS + bin]."""

    constant: list[float]
    weight: list[list[float]]


def fit_softmax(bins: np.ndarray, domain: np.ndarray, l2: float = 3e-4, steps: int = 300) -> Tables:
    """Multinomial logistic regression on bins (rows, features), by Adam on the mean log loss.
    It starts at the smoothed shares of the domains; without rows all domains are alike."""
    k, width = len(DOMAINS), bins.shape[1]
    n = np.bincount(domain, minlength=k)
    constant, weight = np.log((n + 1) / (n.sum() + k)), np.zeros((k, width * N_BINS))
    if not len(bins):
        return Tables(constant.tolist(), weight.tolist())
    cols = bins + np.arange(width) * N_BINS
    target = np.eye(k)[domain]
    m, v = np.zeros((k, weight.shape[1] + 1)), np.zeros((k, weight.shape[1] + 1))
    for t in range(1, steps + 1):
        logits = np.stack([constant[j] + weight[j][cols].sum(1) for j in range(k)], 1)
        p = np.exp(logits - logits.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - target) / len(bins)
        g = np.stack([np.append(np.bincount(cols.ravel(), np.repeat(off[:, j], width), weight.shape[1]) + l2 * weight[j], off[:, j].sum()) for j in range(k)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight -= step[:, :-1]
        constant = constant - step[:, -1]
    return Tables(constant.tolist(), weight.tolist())


def classifier_tables(rows: DataFrame, sample: DataFrame) -> Tables:
    """``rows``: doc_id, bins; ``sample``: doc_id, domain of at most MAX_LABELLED rows."""
    found = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("bins", "domain").collect()
    bins = np.array([r["bins"] for r in found], np.int64).reshape(len(found), len(features(F.lit(""))))
    return fit_softmax(bins, np.array([DOMAINS.index(r["domain"]) for r in found], np.int64))


def posteriors(rows: DataFrame, tables: Tables) -> DataFrame:
    """``rows`` with the posterior per domain, rounded to 1e-3, in place of ``bins``. The weights
    are constants and sums over them folds, whose code does not grow with features or bins."""
    at = F.transform("bins", lambda b, i: i * N_BINS + b)

    def log_of(constant: float, table: Column) -> Column:
        return F.aggregate(at, F.lit(constant), lambda acc, j: acc + F.get(table, j))

    logs = [F.col(f"__log_{d}") for d in DOMAINS]
    rows = once(rows, *(log_of(c, numbers(w)).alias(f"__log_{d}") for c, w, d in zip(tables.constant, tables.weight, DOMAINS, strict=True)))
    shares = [1 / reduce(lambda a, b: a + b, (F.exp(other - own) for other in logs)) for own in logs]
    return once(rows, *(F.round(x, 3).alias(f"p_{d}") for x, d in zip(shares, DOMAINS, strict=True))).drop("bins", *(f"__log_{d}" for d in DOMAINS))


def rate_column(steps: list[list[float]]) -> Column:
    """The rate after the given steps, from the posterior columns: r <- max(0, r - sum_k g_k p_k)."""
    if not steps:
        return F.lit(1.0)
    walk = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    move = lambda r, g: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (g[k] * F.col(f"p_{d}") for k, d in enumerate(DOMAINS))))
    return F.aggregate(walk, F.lit(1.0), move)


@dataclass
class Fit:
    steps: list[list[float]]
    distance: float  # from the targets, as a share of all tokens
    converged: bool


def fit_rates(groups: DataFrame, targets: dict[str, float], budget: float | None = None, rounds: int = 80, tolerance: float = 1e-3) -> Fit:
    """Steps that bring expected domain totals to ``targets`` x ``budget`` tokens (all tokens by
    default). ``groups``: posterior columns and tokens per distinct posterior.

    A step is a projected gradient step on the squared distance, scaled per document by its
    tokens, with the gradient taken where the step ends: that implicit form allows long steps and
    never makes the distance larger. The gradient is one number g a domain, and the g that agrees
    with where the step ends is found by damped Newton rounds on a convex function of g, one
    aggregation of a dozen sums each. Converged: the distance is under ``tolerance``, or a step
    lessens it by under a hundredth of that, as when no nonnegative rates meet the targets."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    k, spent = len(p), 0
    total = groups.agg(F.sum("tokens").cast("double")).first()[0]
    if not total:
        return Fit([], 0.0, True)
    share = sum(targets.get(d, 0.0) for d in DOMAINS) or 1.0
    want = np.array([(budget or total) / total * targets.get(d, 0.0) / share for d in DOMAINS])
    steps: list[list[float]] = []

    def look(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals after a step g, Gram matrix of what stays above zero, half the sum of squares; all per token."""
        nonlocal spent
        spent += 1
        at = groups.withColumn("rate", rate_column([*steps, g.tolist()]))
        live = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        row = at.agg(*(F.sum(F.col("rate") * F.col("tokens") * x) for x in p), *(F.sum(live * x * y) for x in p for y in p), F.sum(F.col("tokens") * F.col("rate") * F.col("rate"))).first()
        sums = np.array(row, float) / total
        return sums[:k], sums[k:-1].reshape(k, k), sums[-1] / 2

    g, length = np.zeros(k), 1e4
    sums, gram, squares = look(g)
    last = float(np.linalg.norm(sums - want))
    while last >= tolerance and spent < rounds:
        value = squares * length
        while spent < rounds:
            off = g - length * (sums - want)
            if np.linalg.norm(off) < 1e-4 * max(1.0, np.linalg.norm(g)):
                break
            way, part = np.linalg.solve(np.eye(k) + length * gram, off), 1.0
            while True:
                new = g - part * way
                new_sums, new_gram, new_squares = look(new)
                new_value = new @ new / 2 + length * (new_squares + new @ want)
                if new_value <= value - 1e-4 * part * (off @ way) or part < 1e-3 or spent >= rounds:
                    break
                part /= 2
            g, sums, gram, squares, value = new, new_sums, new_gram, new_squares, new_value
        steps.append(g.tolist())
        error, g, length = float(np.linalg.norm(sums - want)), np.zeros(k), length * 4
        if error < tolerance or last - error < tolerance * 1e-2:
            return Fit(steps, error, True)
        last = error
        sums, gram, squares = look(g)
    if last >= tolerance:
        logging.getLogger(__name__).warning("rates did not settle in %d rounds, distance %.4f", rounds, last)
    return Fit(steps, last, last < tolerance)


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: list[Column]) -> DataFrame:
    """``keep`` (struct ``doc`` or doc_id), tokens, posteriors and rate of every row."""
    texts = docs.select(quoted("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    present = materialize(labelled_domains(labels).join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "present")
    sample = materialize(hash_sample(present, MAX_LABELLED, "doc_id"), "sample")  # at most MAX_LABELLED rows
    train = materialize(texts.join(F.broadcast(sample), "doc_id").select("domain", "text"), "train")
    lists = mine(train)
    discard(train, present)
    rows = materialize(binned(docs, lists, [*keep, quoted("doc_id").cast("long").alias("__id")]), "features")
    tables = classifier_tables(rows.select(F.col("__id").alias("doc_id"), F.col("__bins").alias("bins")), sample)
    placed = posteriors(rows.drop("__id").withColumnsRenamed({"__bins": "bins", "__tokens": "tokens"}), tables)
    groups = materialize(placed.groupBy(*(f"p_{d}" for d in DOMAINS)).agg(F.sum("tokens").alias("tokens")), "posteriors")
    fit = fit_rates(groups, targets)
    discard(groups, sample)
    return once(placed, F.round(rate_column(fit.steps), 6).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain>..., rate for every row."""
    return _rated(docs, labels, targets or TARGETS, [quoted("doc_id").cast("long").alias("doc_id")])


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` whose rate is above zero, with all their columns and ``rate``, how
    often a document is read in one pass over the mixture; a column ``rate`` of ``docs`` is
    replaced. Rows are written once beside their features, so no text is looked at twice."""
    doc = F.struct(*(quoted(c) for c in docs.columns if c != "rate")).alias("doc")
    out = _rated(docs, labels, targets or TARGETS, [doc])
    return out.where("rate > 0").select("doc.*", "rate")
