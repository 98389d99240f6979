"""Lexical and vector indexes, candidates, lanes and overlap evidence against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import stem as S
from lodestrata.functions import text as T
from lodestrata.operators import lanes as L
from lodestrata.operators import overlap
from lodestrata.operators.lexical import WEIGHTS, LexicalIndex
from lodestrata.operators.retrieval import vector_search
from lodestrata.operators.vectors import VectorIndex
from lodestrata.sources.scratch import new_path

from test_stem import procedure

# --- lexical index

WORDS = "running runs ran runner nation national nations the of a2 2020 electric electricity Wildfire Mitigation Plan wmp hopping hoping über x".split()
TYPES = ["narrative", "table", "figure", "excel_card", "note"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choices(WORDS, k=rng.randint(0, k)))
    rows = [(i, rng.choice(TYPES), rng.choice([None, some(4)]), rng.choice([None, some(2)]), rng.choice([None, "", some(30)]), rng.choice([None, some(3)])) for i in range(n)]
    return [*rows, (n, "table", None, None, "nations " * 5000, None), *((n + 1 + i, "narrative", "runner", None, "running", None) for i in range(60))]


QUESTIONS = [(1, "running nations"), (2, "Wildfire Mitigation Plan of 2020"), (3, "the of"), (4, None), (5, ""), (6, "hoping, ELECTRICITY? electricity"), (7, "absentword"), (8, "runs runner ran")]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content_type string, caption string, breadcrumb string, content string, hint string")


def expected_scores(rows):
    """Scores of all matching chunks, every text read."""

    def stems(text):
        return [procedure(w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in S.STOP]

    def asked(q):
        words = [w for w in re.findall("[a-z0-9]+", (q or "").lower()) if len(w) >= 3 and w not in T.STOPWORDS]
        words += ["".join(x[0] for x in p.split()).lower() for p in re.findall(r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){2,}\b", q or "")]
        return {procedure(w) for w in words if w not in S.STOP}

    out = {}
    for c, kind, *fields in rows:
        impact = Counter()
        for text, weight in zip(fields, WEIGHTS.values(), strict=True):
            for t in stems(text):
                impact[t] += weight
        for q, text in QUESTIONS:
            if total := sum(impact[t] for t in asked(text)):
                out[q, c] = (total / 1000, kind)
    return out


@pytest.fixture(scope="module")
def lexical(spark):
    return LexicalIndex.build(chunks(spark, corpus()), new_path(spark, "lexical"), shards=8, span=16)


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "q long, question string")


def test_lexical_scores_are_a_full_scan(spark, lexical):
    got = {(r["q"], r["chunk_id"]): (r["score"], r["content_type"]) for r in lexical.scores(questions(spark), ["q"]).collect()}
    want = expected_scores(corpus())
    assert got == want and {q for q, _ in want} == {1, 2, 6, 8}


@pytest.mark.parametrize("k", [1, 7, 100, 1000])
def test_lexical_topk_prunes_nothing_that_counts(spark, lexical, k):
    want = {}
    for (q, c), (score, _) in expected_scores(corpus()).items():
        want.setdefault(q, []).append((-score, c))
    got = {}
    for r in lexical.topk(questions(spark), ["q"], k).collect():
        got.setdefault(r["q"], {})[r["rank"]] = (-r["score"], r["chunk_id"])
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: sorted(v)[:k] for q, v in want.items()}


def test_lexical_topk_by_lane(spark, lexical):
    want = {}
    for (q, c), (score, kind) in expected_scores(corpus()).items():
        if kind in L.LANES:
            want.setdefault((q, L.LANES[kind]), []).append((-score, c))
    got = {}
    for r in lexical.topk(questions(spark), ["q"], 5, lanes=L.LANES).collect():
        got.setdefault((r["q"], r["lane"]), []).append((r["rank"], -r["score"], r["chunk_id"]))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: sorted(v)[:5] for q, v in want.items()}


def test_lexical_search_reads_its_directories_only(spark, lexical):
    one = spark.createDataFrame([(1, "electricity")], "q long, question string")
    top = lexical.topk(one, ["q"], 3)
    assert len(lexical.scanned) == 1
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and re.search(r"PartitionFilters: \[[^\]]*shard", plan)


def test_lexical_empty(spark, lexical):
    assert lexical.topk(questions(spark).where("q = 3"), ["q"], 3).collect() == []
    index = LexicalIndex.build(chunks(spark, []), new_path(spark, "lexical"), shards=2)
    assert index.topk(questions(spark), ["q"], 3).collect() == [] and index.scores(questions(spark), ["q"]).collect() == []


def test_lexical_sums_are_not_shuffled_by_question(spark, lexical):
    """Postings move once, by chunk, not once for every question that asks for them."""
    plan = lexical.scores(questions(spark), ["q"])._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert "chunk_id" in moves and "q" not in moves


def test_lexical_build_moves_lists(spark, monkeypatch):
    """Postings are gathered by word where texts are read: no row for every word of every chunk."""
    from lodestrata.operators import lexical as X

    sizes, old = {}, X.written

    def written(df, name, *path):
        out = old(df, name, *path)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(X, "written", written)
    rows = [(i, "table", None, None, " ".join(f"word{j}" for j in range(40)), None) for i in range(600)]
    index = LexicalIndex.build(chunks(spark, rows).coalesce(2), new_path(spark, "lexical"), shards=4)
    assert sizes["words"] <= 2 * 40 and sizes["stems"] == 40
    assert index.scores(spark.createDataFrame([(1, "word7")], "q long, question string"), ["q"]).count() == 600


@pytest.mark.parametrize("lanes", [None, L.LANES])
def test_lexical_search_in_small_pieces(spark, monkeypatch, lanes):
    """Rows of one number are one chunk, also for bounds; slices, blocks of questions and lists of any size give the same."""
    from lodestrata.operators import lexical as X

    for name, n in {"CELLS": 64, "PAIRS": 50, "HELD": 20, "LISTED": 100, "ARRAY_PAIRS": 500, "FEW_TERMS": 5}.items():
        monkeypatch.setattr(X, name, n)
    rows = corpus(300)
    more = [(c, kind, None, None, "nations hoping electricity " * (c % 5), None) for c, kind, *_ in rows[::3]]
    want = {}
    first, second = expected_scores(rows), expected_scores(more)
    for q, c in first.keys() | second.keys():
        (a, kind), (b, _) = first.get((q, c), second.get((q, c))), second.get((q, c), (0, ""))
        score = round(a + b if (q, c) in first else b, 6)
        if lanes is None or kind in lanes:
            want.setdefault((q, lanes and lanes[kind]), []).append((-score, c))
    index = LexicalIndex.build(chunks(spark, [*rows, *more]), new_path(spark, "lexical"), shards=4, span=16)
    got = {}
    for r in index.topk(questions(spark), ["q"], 7, lanes=lanes).collect():
        got.setdefault((r["q"], r["lane"]), []).append((r["rank"], round(-r["score"], 6), r["chunk_id"]))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: sorted(v)[:7] for q, v in want.items()}


def test_lexical_lists_go_over_batches_and_stay(spark, monkeypatch):
    """A list has all of its block that a task reads, however small the batches, and is written once, where the index is."""
    from lodestrata.operators import lexical as X

    made, old = {}, X.written

    def written(df, name, *path):
        made[name] = path
        return old(df, name, *path)

    monkeypatch.setattr(X, "written", written)
    rows = [(i, "table", None, None, " ".join(f"word{j}" for j in range(40)), None) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        index = LexicalIndex.build(chunks(spark, rows).coalesce(1), new_path(spark, "lexical"), shards=4, span=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.lists().count() == 2 * 40 and made["words"][0].startswith(index.path)


def test_lexical_search_moves_lists(spark, lexical, monkeypatch):
    """The best k are found from lists as they are stored: no row for every posting."""
    want = sorted(map(tuple, lexical.topk(questions(spark), ["q"], 7).collect()), key=str)

    def postings(lists):
        raise AssertionError("a row for every posting")

    monkeypatch.setattr(LexicalIndex, "_postings", staticmethod(postings))
    assert want and sorted(map(tuple, lexical.topk(questions(spark), ["q"], 7).collect()), key=str) == want


def test_words_end_with_their_text():
    import pyarrow as pa

    from lodestrata.operators.lexical import _counted

    texts = ["ab", "cd ab the", "", "é9é", "x" * 300 + "-", "ab", ""]
    batch = pa.record_batch([pa.array([*range(6), None], pa.int64()), pa.array(["t"] * 6 + [None]), pa.array([x.encode() for x in texts]), pa.array([b"ab"] * 7)], ["chunk_id", "content_type", "a", "b"])
    got = {(r["word"], c): i for out in _counted((10, 1), 4)([batch.slice(0, 3), batch.slice(3)]) for r in out.to_pylist() for c, i in zip(r["chunks"], r["impacts"], strict=True)}
    want = {("ab", c): 11 if c in (0, 1, 5) else 1 for c in (*range(6), None)}
    assert got == want | {("cd", 1): 10, ("9", 3): 10, ("x" * 300, 4): 10}


def test_captions_and_hints_are_the_first_words(spark, tmp_path):
    from lodestrata.queries import registry

    texts = ["", None, " ", "a", " a  b ", " ".join(map(str, range(6))), " ".join(map(str, range(12))) + " ", " ".join(map(str, range(13))), "x\ty " * 40]
    spark.createDataFrame([(i, t, "de", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["chunk_id"]: (r["caption"], r["hint"]) for r in registry.chunks(spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if t is None else (" ".join(t.split(" ")[:6]), " ".join(t.split(" ")[6:12])) for i, t in enumerate(texts)}


def test_words_of_a_stem_share_a_directory():
    """But for stems of one letter, whose words a search finds in several."""
    letters = "aeiouybcdgkstxl"
    rng = random.Random(4)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) + rng.choice(["", "s", "ies", "ied", "ing", "ed", "eed", "y", "ly"]) for _ in range(20_000)]
    words += [*S.IRREGULAR, *S.FINISHED, "ties", "ies", "dyed", "yes", "a2", "1st"]
    place = lambda w: w[:2].replace("y", "i")
    assert [w for w in words if len(procedure(w)) > 1 and place(w) != place(procedure(w))] == []


# --- vector index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=16)], [None, "a", "b", "c"][i % 4]) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, [0.0] * 16, "a"), (2002, [1.0] * 4, "a"), (2003, [float("nan")] * 16, "a"), *((3000 + i, rows[7][1], "c") for i in range(700))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, lane string")
    return df, VectorIndex.build(df, new_path(spark, "vectors"), lists=24)


def nearest(df, ids, k, lane=False):
    rows = [(r["id"], np.array(r["embedding"], "f8"), r["lane"]) for r in df.where("embedding is not null and size(embedding) = 16").collect()]
    rows = [(i, v / np.sqrt((v * v).sum()), x) for i, v, x in rows if np.isfinite(v).all() and v.any()]
    of, out = {i: v for i, v, _ in rows}, {}
    for q in ids:
        for at in sorted({x for _, _, x in rows} - {None}) if lane else [None]:
            far = sorted((round(1 - float(of[q] @ v), 6) + 0.0, i) for i, v, x in rows if not lane or x == at)
            out[q, at] = [(i, d) for d, i in far[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["q"], r["lane"]), []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize("lane", [None, "lane"])
def test_vector_index_is_exact_by_its_radii(vectors, lane):
    df, index = vectors
    q = df.where("id % 50 = 0 and id < 2000").select(F.col("id").alias("q"), "embedding")
    got, want = found(index.search(q, ["q"], 10, lane=lane)), nearest(df, range(0, 1500, 50), 10, lane is not None)
    assert got.keys() == want.keys()
    for key, rows in want.items():
        assert [i for i, _ in got[key]] == [i for i, _ in rows], key
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[key], rows, strict=True))


def test_vector_index_recall_of_probes(vectors):
    df, index = vectors
    q = df.where("id % 50 = 0 and id < 2000").select(F.col("id").alias("q"), "embedding")
    got, want = found(index.search(q, ["q"], 10, probes=6)), nearest(df, range(0, 1500, 50), 10)
    recall = sum(len({i for i, _ in got[key]} & {i for i, _ in rows}) for key, rows in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert found(index.search(q, ["q"], 10, probes=24)) == found(index.search(q, ["q"], 10))


def test_vector_index_has_every_sound_vector_once(vectors):
    _, index = vectors
    assert index.rows().count() == 2200 and index.rows().select("id").distinct().count() == 2200


def test_vector_search_of_unusable_queries(spark, vectors):
    _, index = vectors
    q = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0])], "q long, embedding array<double>")
    assert index.search(q, ["q"], 3).collect() == []


def test_vector_queries_go_in_blocks(vectors, monkeypatch):
    from lodestrata.operators import vectors as V

    df, index = vectors
    q = df.where("id % 100 = 0 and id < 2000").select(F.col("id").alias("q"), "embedding")
    whole = found(index.search(q, ["q"], 3))
    monkeypatch.setattr(V, "QUERY_BYTES", 16 * 8 * 4)
    monkeypatch.setattr(V, "CELLS", 50)
    assert found(index.search(q, ["q"], 3)) == whole and len(whole) == 15


def test_single_search_takes_one_query(spark, vectors):
    df, _ = vectors
    v = df.where("id < 3").select(F.col("id").alias("vec_id"), "embedding")
    with pytest.raises(Exception, match="one query row"):
        vector_search(v, v, 2).collect()
    assert vector_search(v, v.where("vec_id = 9"), 2).collect() == []


# --- lanes

RANKED = "question_id long, lane string, id long, content_type string, content_hash string, score double, pool_rank int"


def ranked(spark, rows):
    return L.reranked(spark.createDataFrame(rows, RANKED), ["question_id", "lane"], F.col("score"))


def test_rerank_ties_keep_pool_order_and_copies_go(spark):
    rows = [(1, "narrative", 10, "narrative", "a", 0.5, 2), (1, "narrative", 11, "narrative", "b", 0.5, 1), (1, "narrative", 12, "narrative", "a", 0.7, 9), (1, "excel", 13, "excel_card", "a", 0.1, 1)]
    assert sorted((r["lane"], r["rank"], r["id"]) for r in ranked(spark, rows).collect()) == [("excel", 1, 13), ("narrative", 1, 12), ("narrative", 2, 11)]


def test_confidence_of_one_and_of_many(spark):
    rows = [(1, "excel", 1, "excel_card", "a", 0.5, 1)] + [(1, "narrative", 10 + i, "narrative", str(i), i / 20, i) for i in range(15)]
    got = {r["lane"]: r.asDict() for r in L.confidence(ranked(spark, rows), ["question_id", "lane"]).collect()}
    assert got["excel"] == {"question_id": 1, "lane": "excel", "top1": 0.5, "gap": 0.0, "mean_top3": 0.5, "n_above": 1, "spread": 0.0, "candidates": 1, "confidence": 0.5}
    best = [i / 20 for i in range(14, 4, -1)]
    n = got["narrative"]
    assert (n["top1"], n["n_above"], n["candidates"]) == (0.7, 5, 15) and math.isclose(n["gap"], 0.05) and math.isclose(n["mean_top3"], 0.65) and math.isclose(n["spread"], float(np.std(best)))


def test_merge_calibrates_all_types_or_none(spark):
    rows = [(q, "narrative", 10 * q + i, "narrative", f"n{q}{i}", 1.0 - i / 10, i) for q in (1, 2) for i in range(3)] + [(1, "structured", 15, "table", "t1", 5.0, 1), (2, "structured", 25, "figure", "t2", 5.0, 1)]
    curves = spark.createDataFrame([("narrative", 2.0, 0.0), ("table", 1.0, 0.0)], "content_type string, a double, b double")
    got = {(r["question_id"], r["id"]): r for r in L.merged(ranked(spark, rows), "question_id", curves).collect()}
    assert math.isclose(got[1, 10]["shared"], 1 / (1 + math.exp(-2.0))) and got[1, 15]["shared"] == 5.0  # a lane of one keeps raw scores
    assert got[2, 20]["shared"] == 1.0 and got[2, 25]["shared"] == 5.0  # figures have no curve
    assert [got[2, i]["merged_rank"] for i in (25, 20, 21, 22)] == [1, 2, 3, 4]


def test_merge_demotes_every_weak_lane_and_drops_copies(spark):
    rows = [(1, "narrative", 1, "narrative", "a", 0.9, 1), (1, "narrative", 2, "narrative", "b", 0.3, 2), (1, "structured", 3, "table", "c", 0.2, 1), (1, "structured", 4, "table", "a", 0.1, 2), (1, "excel", 5, "excel_card", "d", 0.4, 1)]
    got = [(r["merged_rank"], r["id"], round(r["key"], 6)) for r in L.merged(ranked(spark, rows), "question_id", floor=0.5, k=4).collect()]
    assert sorted(got) == [(1, 1, 0.9), (2, 2, 0.3), (3, 5, -0.6), (4, 3, -0.8)]


def test_candidates_fill_pools_in_channel_order(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)], "narrative" if i < 8 else "excel") for i in range(12)], "id long, embedding array<double>, lane string")
    index = VectorIndex.build(v, new_path(spark, "vectors"), lists=3)
    c = chunks(spark, [(i, "narrative" if i < 8 else "excel_card", None, None, "nation" if i % 3 == 0 else "other", None) for i in range(12)])
    lexical = LexicalIndex.build(c, new_path(spark, "lexical"), shards=2)
    q = spark.createDataFrame([(1, 0, "nations", [1.0, 0.0], [0.0, 1.0]), (1, 1, "other", [math.cos(4 / 9), math.sin(4 / 9)], None)], "question_id long, query_no int, question string, raw array<double>, contextual array<double>")
    pool = L.candidate_pool(q, {"raw": (index, "raw"), "contextual": (index, "contextual")}, lexical, 2).collect()
    got = {lane: [(r["id"], r["channels"]) for r in sorted(pool, key=lambda r: r["pool_rank"]) if r["lane"] == lane] for lane in ("narrative", "excel")}
    assert [i for i, _ in got["narrative"]][:4] == [0, 1, 7, 6]
    assert [r["pool_rank"] for r in sorted(pool, key=lambda r: (r["lane"], r["pool_rank"])) if r["lane"] == "excel"] == list(range(1, len(got["excel"]) + 1))
    assert L.lane_of(F.lit("x")) is not None


def test_chunks_meet_their_vectors_once(spark, monkeypatch):
    """A build reads its vectors several times: both indexes get them from a table, not from a join."""
    from lodestrata.queries import retrieval as Q

    sf, joins, old = "/root/testdata/sf0.001", [], VectorIndex.build

    def build(vectors, path):
        joins.append("Join" in vectors._jdf.queryExecution().executedPlan().toString())
        return old(vectors, path)

    monkeypatch.setattr(Q, "_kept", {})
    monkeypatch.setattr(Q.VectorIndex, "build", build)
    raw, contextual = Q.vector_index(spark, sf), Q.vector_index(spark, sf, contextual=True)
    assert joins == [False, False]
    lanes = {r["doc_id"]: {"en": "narrative", "fr": "structured", "de": "structured", "es": "excel"}.get(r["lang"], "narrative") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    want = {r["vec_id"]: (r["embedding"], lanes[r["vec_id"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["vec_id"] in lanes}
    assert want and {r["id"]: (r["embedding"], r["lane"]) for r in raw.rows().collect()} == want
    assert {r["id"]: (r["embedding"], r["lane"]) for r in contextual.rows().collect()} == {i: ([x * (1 + n % 3) for n, x in enumerate(v)], lane) for i, (v, lane) in want.items()}


# --- overlap evidence


def plain_evidence(needles, texts):
    """Every needle against every text, by the stated patterns."""
    norm = lambda t: re.sub("[^a-z0-9.%-]+", " ", (t or "").lower()).strip()

    def forms(v):
        exact = format(v, "f")
        out = {exact, exact.rstrip("0").rstrip(".") if "." in exact else exact}
        if v == v.to_integral_value():
            out |= {f"{int(v):,}", str(int(v))}
        else:
            out |= {f for p in (1, 2, 3) for f in (f"{v:,.{p}f}", f"{v:.{p}f}")}
        return {norm(f) for f in out}

    out = {}
    for n, question, concept, value in needles:
        words = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", norm(concept))) if len(w) >= 3 and w not in overlap.NO_CONCEPT and not w.isdigit()]
        years, quarters = set(re.findall(r"\b20[2-3][0-9]\b", question)), {q.lower() for q in re.findall(r"\bQ[1-4]\b", question, re.I)}
        for c, caption, content in sorted(texts):
            t = norm(f"{caption or ''} {content or ''}")
            if not any(re.search(rf"(?<![\d.]){re.escape(f)}(?![\d.])", t) for f in forms(value)) or (years and not years & set(t.split())) or (quarters and not any(q in t for q in quarters)):
                continue
            if sum(w in t for w in words) >= min(2, len(words)):
                out[n] = c
                break
    return out


def test_overlap_evidence_against_every_pair(spark):
    from decimal import Decimal

    rng = random.Random(6)
    numbers = ["12", "112", "12.5", "12.50", "1,234", "1234", "1 234", "-7", "7", "0.125", "0.12", "3-7", "12.", ".12", "999,999.99", "12%", "1,234.50"]
    words = ["poles", "wire", "lines", "Q1", "q2", "2023", "2024.", "in", "of", "(2025)", "Pole"]
    texts = [(i, rng.choice([None, "", rng.choice(words)]), rng.choice([None, " ".join(rng.choices(numbers + words, k=rng.randint(1, 9)))])) for i in range(500)]
    values = [Decimal(x) for x in ("12.00", "12.50", "1234.00", "-7.00", "7.00", "0.12", "0.13", "999999.99", "1234.50", "0.00")]
    needles = [(i, rng.choice(["How many?", "In 2023?", "In Q1 2024?", "q2 2025 or 2023", "Q4"]), rng.choice(["poles and wire", "poles", "the value", "wire lines 2023", ""]), rng.choice(values)) for i in range(150)]
    got = overlap.find_evidence(spark.createDataFrame(needles, "needle_id long, question string, concept string, value decimal(18,2)"), spark.createDataFrame(texts, "chunk_id long, caption string, content string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = plain_evidence(needles, texts)
    assert {r["needle_id"]: r["chunk_id"] for r in got.collect()} == want and len(want) > 30


def test_overlap_evidence_of_few_and_of_many_needles(spark, monkeypatch, tmp_path):
    """Few needles go to the chunks: these are read once and not dealt by their runs. Many meet them in a shuffle."""
    from decimal import Decimal

    texts = [(i, f"Order in Q{1 + i % 4} {2020 + i % 8}", f"poles and wire: {i * 37 % 900},{100 + i % 800}.{10 + i % 90} (no. {i}).") for i in range(400)]
    needles = [(i, f"In Q{1 + i % 4} of {2020 + i % 8}?", "poles", Decimal(f"{i * 37 % 900}{100 + i % 800}.{10 + i % 90}")) for i in range(0, 400, 9)]
    spark.createDataFrame(texts, "chunk_id long, caption string, content string").write.parquet(str(tmp_path / "texts"))
    found = lambda: overlap.find_evidence(spark.createDataFrame(needles, "needle_id long, question string, concept string, value decimal(18,2)"), spark.read.parquet(str(tmp_path / "texts")))
    names, old = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, name: (names.append(name), old(df, name))[1])
    want, few = plain_evidence(needles, texts), found()
    assert names == ["forms"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run" not in plan and plan.count("/texts") == 1 and "ReadSchema: struct<chunk_id:bigint,caption:string,content:string>" in plan
    assert {r["needle_id"]: r["chunk_id"] for r in few.collect()} == want and len(want) == len(needles)
    monkeypatch.setattr(overlap, "FEW_FORMS", 0)
    assert {r["needle_id"]: r["chunk_id"] for r in found().collect()} == want
