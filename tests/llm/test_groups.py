"""Operators on groups of documents and trained ones."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup, mixing, quality, simhash, toxicity, url_filter
from lodestrata.llm import queries as Q
from lodestrata.llm.components import connected_components

from .cases import TEXTS, awkward, by_id, empty, labels

SF = "/root/testdata/sf0.01"


# --- exact duplicates


def test_exact_dedup_awkward(spark):
    rows = exact_dedup.DigestIndex(spark).add(awkward(spark)).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert len(rows) == len(TEXTS)
    assert of[1] == [(1, 3, True)] and of[2] == [(1, 3, False)] and of[3] == [(1, 3, False)]
    assert of[4] == [(4, 3, True)] and of[5] == [(4, 3, False)] and of[6] == [(6, 1, True)]
    assert sorted(of[9]) == [(9, 2, False), (9, 2, True)]
    assert sorted(of[None], key=repr) == [(4, 3, False), (None, 1, True)]
    assert exact_dedup.DigestIndex(spark).add(empty(spark)).collect() == []


def test_exact_dedup_keep_first(spark):
    kept = exact_dedup.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "9", "None", "11"])
    assert exact_dedup.keep_first(empty(spark)).collect() == []


def test_digest_index_is_persistent(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    exact_dedup.DigestIndex(spark, path, buckets=4).add(rows((1, "a"), (2, "b"))).collect()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.add(rows((3, "a"), (4, "c"), (5, "c"))).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert again.rows().count() == 3


def test_hot_digest_goes_through_the_broadcast(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.DigestIndex(spark).add(docs)
    assert out.where("kept").count() == 5000 - 1667 + 1 and out.where("keep_id = 0").count() == 1667


# --- SimHash


def brute_fingerprint(t):
    w = [x for x in t.encode().lower().split()]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array([f & (1 << 64) - 1 for f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark):
    r = random.Random(1)
    texts = ["", "one", "Two Words", "a b c", *(" ".join(r.choice(["Ä", "b", "CC", "dd\t", "e\x0bf"]) for _ in range(r.randint(0, 60))) for _ in range(200))]
    assert [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts] == [brute_fingerprint(t) for t in texts]
    long = "alpha beta gamma delta " * 120_000
    assert simhash.fingerprint(long.encode()) & (1 << 64) - 1 == brute_fingerprint(long)
    words = [f"{t}" for t in ("a b c", "x")]
    spark_hash = spark.createDataFrame([(w,) for w in words], "t string").select(F.xxhash64("t")).collect()
    assert [x[0] & (1 << 64) - 1 for x in spark_hash] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@pytest.mark.parametrize("spread", [2, 5, 9, 16])
def test_links_give_brute_components(spark, spread):
    """Clusters of fingerprints around centres, dense enough to take the second level."""
    r = random.Random(spread)
    fps = {r.getrandbits(64) for _ in range(300)}
    for centre in (r.getrandbits(64), r.getrandbits(64)):
        places = r.sample(range(64), spread)
        for _ in range(1500):
            fps.add(centre ^ sum(1 << b for b in places if r.random() < 0.4))
        for _ in range(200):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    roots = {x["node"]: x["root"] for x in connected_components(simhash.near_links(nodes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_star_and_cube_links_agree():
    r = np.random.default_rng(2)
    for bits in (10, 14):
        base, places = int(r.integers(1 << 63)), r.choice(64, bits, replace=False).tolist()
        fps = np.unique(np.array([base ^ sum(1 << b for i, b in enumerate(places) if k >> i & 1) for k in r.choice(1 << bits, 600).tolist()], np.uint64))
        free = int(np.bitwise_or.reduce(fps ^ fps[0]))

        def classes(links):
            root = list(range(len(fps)))
            for a, b in links:
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
            return root

        assert classes(simhash._cube_links(fps, free)) == brute_components([int(f) for f in fps])


def test_near_duplicates_awkward(spark):
    out = simhash.near_duplicates(awkward(spark))
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out.collect()}
    assert out.count() == len(TEXTS)
    assert {c for (i, _), c in of.items() if i in (1, 2, 3)} == {1}
    assert {c for (i, _), c in of.items() if i in (4, 5, 6)} == {4}
    assert {c for (i, _), c in of.items() if i is None} == {None}
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.keep_representatives(awkward(spark))
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "7", "8", "9", "9", "11", "None", "None"])


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"] or "") for r in docs]
    roots = brute_components(fps)
    want = sorted((r["doc_id"], f"{f:016x}", docs[k]["doc_id"]) for r, f, k in zip(docs, fps, roots, strict=True))
    assert by_id(Q.op6_simhash(spark, "/root/testdata/sf0.001")) == sorted(want, key=repr)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[1001] == roots[1000] == 1000
    assert connected_components(links.where("a < 0")).collect() == []


# --- toxicity, quality


def test_toxicity_held_out(spark):
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.op2_toxicity(spark, "/root/testdata/sf0.1")
    rows = out.join(lab, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_toxicity_awkward(spark):
    for lab in (labels(spark), labels(spark, [(1, 1, 0), (8, 1, 1), (8, None, None), (None, 1, 1), (99, 1, 1), (5, 1, 0)])):
        rows = toxicity.score_documents(awkward(spark), lab).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
        score = {r["doc_id"]: r["score"] for r in rows}
        assert score[8] > score[1]
        kept = toxicity.drop_toxic(awkward(spark), lab)
        assert kept.columns == awkward(spark).columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in rows if not r["predicted"])
        assert toxicity.score_documents(empty(spark), lab).collect() == []


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert by_id(toxicity.score_documents(docs, lab)) == by_id(toxicity.score_documents(docs, flipped))


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.2
    fires = lambda tp, fp: r.random(len(y)) < np.where(y, tp, fp)
    votes = [fires(0.8, 0.02) for _ in range(4)]
    votes += [votes[3].copy()] + [fires(0.5, 0.5) for _ in range(toxicity.N_VOTERS - 5)]  # a copy, and noise
    patterns = sum(v.astype(int) << j for j, v in enumerate(votes))
    counts = dict(zip(*(x.tolist() for x in np.unique(patterns, return_counts=True)), strict=True))
    labelled = {}
    for v, t in zip(patterns[:600].tolist(), y[:600].tolist(), strict=True):  # a few labels say which class is which
        labelled[v, int(t)] = labelled.get((v, int(t)), 0) + 1
    m = toxicity.fit_label_model(counts, labelled)
    assert abs(m.prior - 0.2) < 0.03 and np.all(np.abs(m.rates[1][:4] - 0.8) < 0.05) and np.all(np.abs(m.rates[0][:4] - 0.02) < 0.03)
    assert m.correlation[3, 4] > 0.95 and m.discount[4] < 0.6 < m.discount[0]


def test_quality(spark):
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.op9_quality(spark, "/root/testdata/sf0.1").join(lab, "doc_id").where("held_out")
    assert out.where("predicted = quality").count() >= 0.97 * out.count()
    for t in (labels(spark), labels(spark, [(1, 1, 0), (8, 0, 1)])):
        assert quality.score_quality(awkward(spark), t).count() == len(TEXTS)
        assert quality.score_quality(empty(spark), t).collect() == []


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "plain words in a row here", "big", "a") for i in range(400)] + [(1000, "plain words in a row here", "small", "b")]
    out = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels(spark))
    rate = {r["doc_id"]: r["path_rate"] for r in out.collect()}
    assert abs(rate[0] - rate[1000]) < 0.05


def test_seed_near_you_is_seen_anywhere():
    lexicon = toxicity.Lexicon({})
    far = b"idiot and some other plain words in a row " * 1100
    assert not toxicity.examine(far, lexicon, [])[1] >> 8 & 1
    assert toxicity.examine(far + b"you idiot", lexicon, [])[1] >> 8 & 1


# --- mixing


def test_mixing_reaches_targets(spark):
    out = Q.op10_mixing(spark, "/root/testdata/sf0.1")
    total = out.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) / F.sum("tokens") for d in mixing.DOMAINS), F.min("rate")).first()
    for got, d in zip(total, mixing.DOMAINS, strict=False):
        assert abs(got - mixing.TARGETS[d]) < 0.01
    assert total[-1] >= 0


def test_mixing_awkward(spark):
    for t in (labels(spark), labels(spark, [(1, 1, 0), (8, 0, 1), (None, 1, 1), (4, None, None)])):
        rows = mixing.mix(awkward(spark), t).collect()
        assert len(rows) == len(TEXTS) and all(r["rate"] >= 0 for r in rows)
        assert {r["tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
        out = mixing.with_rates(awkward(spark), t)
        assert set(out.columns) == set(awkward(spark).columns)
        assert mixing.mix(empty(spark), t).collect() == [] and mixing.with_rates(empty(spark), t).collect() == []


def test_mixing_is_native(spark):
    plan = Q.op10_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixing_features_read_whole_classes(spark):
    def bins(*texts):
        out = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", F.array(*mixing.features(F.col("text"))).alias("bins"))
        return [r["bins"] for r in out.orderBy("i").collect()]

    plain = "some plain words in a row"
    base, *others = bins(plain, plain.upper().replace("E", "X").replace("A", "Y"), plain[:-3] + "123", plain[:-1] + "?", plain[:-1] + "$", plain[:-1] + ";", plain.replace(" ", "\n"))
    for k, changed in zip((0, 1, 2, 3, 5), others, strict=False):
        assert changed[k] > base[k]
    assert others[5][6] == base[6]
    assert [b[8] for b in bins("IDIOT, Idiot idiot dumb", "idiotic clownfish", "")] == [4, 0, 0]


# --- urls


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), tail[:end]


def brute_rule(host, path):
    fits = [(len(r.text), r.text, r.verdict) for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/71?x#y", "x://example.net/de/8/1", "http://foo.net/de/", "http://foo.net/de", "http://com/en/x", "http://telecom/en/x", "s://a?b/c://d/e", "http://É.org/es/1", "http://h\nost.org/es/\n1", "http://h.org#/es/"]
    urls += [f"https://site.example.org/{k}/{i}.html?p={i}" for i in range(70) for k in ("good", "bad", f"var{i}")] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("x"))
    labelled = spark.createDataFrame([(u, int("/bad/" in u)) for u in urls[14:160]], "url string, bad int")
    rows = url_filter.filter_urls(pages, labelled, Q.URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = brute_url(urls[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == verdict)
    by = {urls[r["page_id"]]: r for r in rows}
    assert by[urls[14]]["verdict"] == "allow" and by[urls[15]]["verdict"] == "block"
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(nothing, labelled, Q.URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages.where("page_id >= 14"), labelled.limit(0), []).collect()} == {"allow"}


def test_url_tree_wildcards(spark):
    urls = [f"http://h.org/user{i}/about" for i in range(80)] + ["http://h.org/12/x.html"]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string, bad int"), [], max_children=50).collect()
    assert {r["template"] for r in rows} == {"*/about", "*/x.html"}


@pytest.mark.parametrize("others", [48, 49, 50, 51])
def test_url_rare_values_do_not_depend_on_their_number(spark, others):
    urls = ["http://h.org/main/x"] * (2000 - others) + [f"http://h.org/v{i}/x" for i in range(others)]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string, bad int"), []).collect()
    assert {r["template"] for r in rows} == {"main/x", "*/x"}


def test_url_bad_branch_of_few_pages_is_blocked(spark):
    pages = [(f"http://s.example.net/es/{i}", int(i < 10)) for i in range(11)] + [(f"http://s.example.net/{k}/{i}", 0) for k in ("a", "b", "c") for i in range(20)]
    urls = [u for u, _ in pages] + ["http://s.example.net/es/99", "http://s.example.net/a/99"]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(pages, "url string, bad int"), []).collect()
    verdict = {urls[r["page_id"]]: r["verdict"] for r in rows}
    assert verdict["http://s.example.net/es/99"] == "block" and verdict["http://s.example.net/a/99"] == "allow"


def test_url_branches_merge_up_to_the_host(spark):
    sections = {"http://spam.org/a": 1, "http://spam.org/b": 1, "http://fine.org/a": 0, "http://fine.org/b": 0, "http://mixed.org/good": 0, "http://mixed.org/bad": 1}
    pages = [(f"{k}/{i}", bad) for k, bad in sections.items() for i in range(20)]
    unseen = ["http://spam.org/new/1", "http://fine.org/new/1", "http://spam.org/new/deep/x/2"]
    urls = [u for u, _ in pages] + unseen
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(pages, "url string, bad int"), []).collect()
    by = {urls[r["page_id"]]: r for r in rows}
    assert [by[u]["verdict"] for u in unseen] == ["block", "allow", "block"]
    assert {by[f"http://spam.org/{k}/0"]["purity"] for k in "ab"} == {by[u]["purity"] for u in (unseen[0], unseen[2])}  # pooled
    assert by["http://mixed.org/good/0"]["verdict"] == "allow" and by["http://mixed.org/bad/0"]["verdict"] == "block"  # not pooled


def brute_tree(pages, labelled, max_children=50, merge_z=2.0, w=5.0):
    """Plain Python: template and purity of each (host, segments) of ``pages``."""
    from collections import Counter, defaultdict

    seen, n, b = Counter(pages), Counter(p for p, _ in labelled), Counter(p for p, y in labelled if y)
    prior = (sum(b.values()) + 1) / (sum(n.values()) + 2) if labelled else 0.0

    def differs(own_n, own_b, all_n, all_b):
        rest_n, rest_b = all_n - own_n, all_b - own_b
        if not own_n or not rest_n:
            return False
        p = (all_b + prior) / (all_n + 1)
        z = abs(own_b / own_n - rest_b / rest_n) / (p * (1 - p) * (1 / own_n + 1 / rest_n)) ** 0.5
        return z >= merge_z

    def generalise(context, use_labels):
        values = defaultdict(lambda: [0, 0, 0])
        for t in seen:
            for i, s in enumerate(t[1]):
                for k, x in enumerate((seen[t], n[t], b[t])):
                    values[(t[0], i, context(t, i)), s][k] += x
        groups = defaultdict(list)
        for (g, s), v in values.items():
            groups[g].append((s, v))
        star = set()
        for g, vs in groups.items():
            total = [sum(v[k] for _, v in vs) for k in range(3)]
            rare = [(s, v) for s, v in vs if v[0] * max_children < total[0]]
            star |= {(g, s) for s, v in rare if sum(v[0] for _, v in rare) * max_children >= total[0] and not (use_labels and differs(v[1], v[2], total[1], total[2]))}
        return {t: tuple("*" if ((t[0], i, context(t, i)), s) in star else s for i, s in enumerate(t[1])) for t in seen}

    loose = generalise(lambda t, i: None, False)
    general = generalise(lambda t, i: loose[t][:i], True)
    sums = defaultdict(lambda: [0, 0])
    for t in seen:
        for i in range(len(t[1]) + 1):
            sums[t[0], general[t][:i]][0] += n[t]
            sums[t[0], general[t][:i]][1] += b[t]
    kids = defaultdict(lambda: [0, 0])
    for (h, x), v in sums.items():
        if x:
            kids[h, x[:-1], len(x)][0] += v[0]
            kids[h, x[:-1], len(x)][1] += v[1]
    stands = {(h, x) for (h, x), v in sums.items() if not x or differs(*v, *kids[h, x[:-1], len(x)])}
    chain = {t: [(t[0], general[t][:i]) for i in range(len(t[1]) + 1) if (t[0], general[t][:i]) in stands] for t in seen}
    pool = defaultdict(lambda: [0, 0])
    for t, c in chain.items():
        pool[c[-1]][0] += n[t]
        pool[c[-1]][1] += b[t]
    out = {}
    for t, c in chain.items():
        p = prior
        for x in c:
            p = (pool[x][1] + w * p) / (pool[x][0] + w)
        out[t] = "/".join(general[t]), round(p, 6)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_tree_against_brute_force(spark, seed):
    r = random.Random(seed)
    pages, labelled = [], []
    for _ in range(1500):
        host = r.choice(["a.org", "b.org", "b.org", ""])
        first = r.choice(["good", "bad", "bad", f"u{r.randint(0, 90)}"])
        path = tuple([first, r.choice(["x", "y", f"t{r.randint(0, 200)}"]), "z", "deep", "e", "f", "g", "h"][: r.randint(0, 8)])
        pages.append((host, path))
        if r.random() < 0.5:
            labelled.append((pages[-1], int(r.random() < (0.9 if path[:1] == ("bad",) and host != "a.org" else 0.1))))
    want = brute_tree(pages, labelled, max_children=8)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = url_filter.template_tree(frame([(h, list(s)) for h, s in pages], "host string, segments array<string>"), frame([(h, list(s), y) for (h, s), y in labelled], "host string, segments array<string>, bad int"), max_children=8)
    got = {(x["host"], tuple(filter(None, x["typed"].split("/")))): (x["template"], round(x["purity"], 6)) for x in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert len({v[1] for v in want.values()}) > 4


def test_urls_awkward(spark):
    rows = [(None, None), (None, None), (1, "http://h.org/" + "a/" * 3000 + "x"), (1, "http://h.org/" + "a" * 200_000), (2, "http://h.org"), (2, "http://h.org")]
    pages = spark.createDataFrame([(*x, "?", "?", "?") for x in rows], "page_id long, url string, host string, path string, segments string")
    lab = spark.createDataFrame([(None, 0), ("http://h.org/b", None), ("http://h.org/b", 7)], "url string, bad int")
    got = url_filter.filter_urls(pages, lab, Q.URL_RULES).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got if r["host"] == "h.org"} == {"allow"}
    assert max(len(r["path"]) for r in got) == 200_001 and max(r["template"].count("/") for r in got) == 3000


def test_quality_against_plain_shrinkage(spark):
    """Rates and scores of a small table, by plain Python from the operator's own evidence."""
    import math

    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["some", "plain", "words", "|", "###", "A!"]) for _ in range(r.randint(1, 30))), r.choice(["a", "a", "b", None]), r.choice(["x", "y", None])) for i in range(200)]
    lab = [(i, int(("|" not in t) ^ (r.random() < 0.2)), 0) for i, t, _, _ in rows if i % 2]
    got = {x["doc_id"]: x for x in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels(spark, lab)).collect()}
    p = {i: got[i]["evidence"] for i in got}
    total = sum(p.values()) / len(p)
    groups = lambda key: {k: [i for i, *x in rows if key(x) == k] for k in {key(x) for _, *x in rows}}
    hosts, paths = groups(lambda x: x[1]), groups(lambda x: (x[1], x[2]))

    def strength(parts):  # (documents, expected good, mean above)
        parts = [x for x in parts if x[0] >= 2]
        n = sum(x[0] for x in parts)
        within = sum(k * m * (1 - m) for k, _, m in parts) / n
        between = (sum(k * (g / k - m) ** 2 for k, g, m in parts) - (len(parts) - 1) * within) / (n - sum(k * k for k, _, _ in parts) / n)
        return min(1e6, max(2.0, within / between - 1)) if between > 0 else 1e6

    good = lambda ids: sum(p[i] for i in ids)
    kappa = strength([(len(v), good(v), total) for v in hosts.values()])
    rate = {h: (good(v) + kappa * total) / (len(v) + kappa) for h, v in hosts.items()}
    below = strength([(len(v), good(v), rate[h]) for (h, _), v in paths.items()])
    train = [y for i, y, _ in lab if quality_fold(i) != 1]
    base = sum(train) / len(train)
    for i, _, h, q in rows:
        host = (good(hosts[h]) - p[i] + kappa * total) / (len(hosts[h]) - 1 + kappa)
        path = (good(paths[h, q]) - p[i] + below * host) / (len(paths[h, q]) - 1 + below)
        odds = p[i] / (1 - p[i]) / (base / (1 - base)) * path / (1 - path)
        assert abs(got[i]["host_rate"] - host) < 1e-9 and abs(got[i]["path_rate"] - path) < 1e-9
        assert math.isclose(got[i]["score"], odds / (1 + odds), rel_tol=1e-6)


def quality_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3


def test_exact_index_survives_a_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    kept = lambda df: sorted(r["doc_id"] for r in df.where("kept").collect())
    path = f"file://{tmp_path}/index"
    for batch in ("first", None):
        with exact_dedup.DigestIndex(spark, f"{path}-{batch}", buckets=2) as index:
            index.add(rows, batch=batch)  # the driver dies after the append
        with exact_dedup.DigestIndex(spark, f"{path}-{batch}", buckets=2) as index:
            assert kept(index.add(rows, batch=batch)) == [1, 3] == kept(index.add(rows, batch=batch))
            assert index.rows().count() == 2
            assert kept(index.add(rows, batch="other")) == []
            assert sorted(r["doc_id"] for r in exact_dedup.keep_first(rows, index=index, batch=batch).collect()) == [1, 3]
        assert not [t for t in spark.catalog.listTables() if t.name == index.name]


def test_names_of_helpers_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "one two three", "x", "y", "z"), (2, "one two three", "x", "y", "z"), (3, "else", "x", "y", "z")], "doc_id long, text string, __digest string, __id string, `a``b.c` string")
    for f in (exact_dedup.keep_first, simhash.keep_representatives):
        out = f(docs)
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_one_id_with_several_texts_is_one_node(spark):
    texts = ["alpha beta gamma delta epsilon", "completely other words are here now"]
    rows = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (2, texts[1]), (7, texts[0])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()} == {(5, 2), (2, 2), (7, 2)}


def test_mixing_rates_against_plain_least_squares(spark):
    """No nonnegative rates do better than the fit, by plain projected gradient on the groups."""
    r = np.random.default_rng(3)
    for targets in ({"clean": 0.88, "poor": 0.07, "toxic": 0.05}, {"clean": 0.9, "poor": 0.1, "toxic": 0.0}, {"clean": 0.1, "poor": 0.1, "toxic": 0.8}):
        p = r.dirichlet([2, 0.5, 0.3], 60).round(3)
        tokens = r.integers(1, 500, 60)
        frame = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens, strict=True)], "p_clean double, p_poor double, p_toxic double, tokens long")
        fit = mixing.fit_rates(frame, targets)
        want = tokens.sum() * np.array([targets[d] for d in mixing.DOMAINS])
        a = (p * tokens[:, None]).T
        rate = np.ones(60)
        for _ in range(20_000):
            rate = np.maximum(0, rate - a.T @ (a @ rate - want) / np.linalg.norm(a, 2) ** 2)
        best = np.linalg.norm(a @ rate - want) / tokens.sum()
        assert fit.converged and fit.distance <= best + 2e-3


def test_near_copies_of_one_label_count_once(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(n))
    shared, one = text(60), text(100)
    rows = [(1, 0, one), (2, 0, one + " z"), (3, 1, one + " y"), (4, 0, shared + text(200)), (5, 0, shared + text(200)), (6, 1, shared + " idiot " + text(200)), (7, 0, ""), (8, 0, "")]
    left = toxicity.one_of_copies(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    assert sorted(x["doc_id"] for x in left.collect()) == [1, 3, 4, 5, 6, 7]


def test_toxicity_score_in_the_plan_is_the_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, seen = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r["doc_id"]: r["s"] for r in seen.select("doc_id", model.score().alias("s")).collect()}
    assert all(abs(got[r["doc_id"]] - model.score_text((r["text"] or "").encode())) < 1e-9 for r in docs.collect())
    assert abs(sum(got.values()) / len(got)) < 0.5


# --- toxicity: no letters, cuts or rows left out


def test_shouting_counts_all_letters():
    vote = lambda t: toxicity.examine(t.encode(), toxicity.Lexicon({}), [])[1] >> 9 & 1
    assert [vote(t) for t in ("YOU SUCK GO BUY ROLL", "you suck go buy roll", "ТЫ ДУРАК", "ты дурак", "ÉÈÀ éè", "", "123 !!", "aB", "ABc")] == [1, 0, 1, 0, 1, 0, 0, 0, 1]
    text = "Straße ÀÉÎ ωΩ Жж 漢字 aZ"
    assert toxicity.letters(text.encode()) == (sum(map(str.isupper, text)), sum(map(str.islower, text)))


@pytest.mark.parametrize("word", ["basura", "idiot", "crap"])
@pytest.mark.parametrize("shift", range(0, 24, 3))
def test_second_person_near_a_telling_word_across_pieces(word, shift):
    vote = lambda t: toxicity.examine(t, toxicity.Lexicon({}), [])[1] >> 8 & 1
    filler = b"w " * ((1 << 19) - 12 + shift // 2)
    assert vote(filler + f"{word} so you ".encode() + b"w " * 40) == 1
    assert vote(filler + f"{word} a b c you ".encode() + b"w " * 40) == 0
    assert vote(filler + f"you a b {word} ".encode() + b"w " * 40) == 1


# --- the digest index over many batches


def test_digest_index_stays_sorted_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 4)
    path, seen = f"file://{tmp_path}/generations", {}
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    for k in range(9):
        rows = [(100 * k + i, f"t{(k * 17 + i * (k + 1)) % 60}") for i in range(40)]
        got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, t in sorted(rows):
            seen.setdefault(t, i)
        assert got == {i: (seen[t], seen[t] == i) for i, t in rows}
        if k == 5:
            index.close()
            index = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert sorted(index.generations) == [(1, 4), (5, 8), (9, 9)] and index.rows().count() == len(seen)
    batch = spark.createDataFrame([(b"x" * 32,)], "digest binary")
    with exact_dedup._sorted_scans(spark):
        plan = batch.join(index.tables()[0].hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SelectedBucketsCount: 4 out of 4" in plan  # the batch alone is sorted


def test_digest_index_ignores_what_a_crash_leaves(spark, tmp_path):
    path = f"file://{tmp_path}/crash"
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, buckets=2)
    index.add(rows((1, "a"), (2, "b"))).collect()
    index.add(rows((3, "b"), (4, "c"))).collect()
    index._append(index.rows(), 3, 1, 2)  # merged, but the old ones are still there
    (tmp_path / "crash/batches-00000003-00000003-2-ff").mkdir()  # begun, not finished
    again = exact_dedup.DigestIndex(spark, path, buckets=2)
    assert list(again.generations) == [(1, 2)] and again.rows().count() == 3
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.add(rows((5, "c"), (6, "d"))).collect()}
    assert got == {5: (4, False), 6: (6, True)}
