"""The pipeline's stages against the queries of the operators they apply."""

import re

import xxhash

import corpus_pipeline
from lodestrata.llm import decontaminate, exact_dedup, simhash, toxicity
from lodestrata.llm.common import materialize, table

from .cases import awkward, empty

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_do_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    one = corpus_pipeline.drop_toxic(spark, docs, SF)
    scored = toxicity.score_documents(docs, table(spark, SF, "labels"))
    assert ids(one) == ids(scored.where("predicted = 0"))
    two = corpus_pipeline.drop_copies(spark, docs, SF)
    assert ids(two) == ids(exact_dedup.DigestIndex(spark).add(docs).where("kept"))
    three = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert ids(three) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
    four = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert ids(four) == ids(decontaminate.scan(docs, table(spark, SF, "benchmark")).where("not contaminated"))
    five = corpus_pipeline.mix(spark, docs, SF)
    assert set(five.columns) == {*docs.columns, "rate"} and five.where("rate <= 0").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    assert set(out.columns) == {*docs.columns, "rate"} and 0 < out.count() < docs.count()


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(out.columns) == set(docs.columns), name
            assert out.count() <= docs.count()


# --- the chain in plain Python


def same(texts):
    """Of equal texts after folding white space, the smallest id."""
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    return set(first.values())


def alike(texts):
    """Of texts whose fingerprints are linked by at most three bits, the smallest id."""

    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks, root = {i: fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and bin(marks[i] ^ marks[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


def unseen(texts, items):
    """Texts of which less than a twentieth of the words lies in windows of items."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[k : k + 13]) for w in map(words, items) if w for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    out = set()
    for i, t in texts.items():
        w = words(t)
        hit = {k + x for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for x in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.add(i)
    return out


def test_chain_against_plain_python(spark):
    """Every stage on what the stages before have kept; the toxic ones by the fitted model, text by text."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    long = sorted((r["text"] for r in docs.collect() if r["text"]), key=len)[-6:]
    planted = [t + " and one more word" for t in long] + [" ".join(t.split()) for t in long] + items[:6]
    docs = docs.union(spark.createDataFrame([(10_000 + i, t, "en", "planted", len(t)) for i, t in enumerate(planted)], docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model, _ = toxicity.fit(docs, labels)
    rules = [
        lambda t: {i for i, x in t.items() if model.score_text(x.encode()) < toxicity.THRESHOLD}, same, alike, lambda t: unseen(t, items),
    ]
    for (name, stage), rule in zip(corpus_pipeline.STAGES[:-1], rules, strict=True):
        docs, before = materialize(stage(spark, docs, SF), f"test-{name}"), len(texts)
        kept = rule(texts)
        texts = {i: x for i, x in texts.items() if i in kept}
        assert ids(docs) == sorted(texts), name
        assert len(texts) < before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(ids(last)) <= set(texts) and last.where("rate <= 0").count() == 0
