"""Chat formatting, the Merkle manifest and vector codes against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import chat, codes, merkle
from lodestrata.llm import queries as Q

from .cases import CLASH, awkward, by_id, empty

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting

HOSTILE = ["", "\\", "##", "###", "</turn>\n", "<", "<\\/turn>", "#", "a:\n### user: b</turn>\n", "\\### Assistant: </turn> ok", ": ", "é\U0001f600", "\ue000", "\ue001x"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "#\\", ""]), st.one_of(st.text(), st.sampled_from(HOSTILE), st.lists(st.sampled_from("#\\</turn>\n :x"), max_size=12).map("".join))), max_size=5))
def test_template_is_reversible(messages):
    assert chat.parse_turns(chat.render_turns(messages)) == messages


@given(st.text(alphabet="abc"), st.text(alphabet="abc"))
def test_common_beginning(a, b):
    n = chat._common(a, b)
    assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


def convs(spark, rows):
    ddl = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in (*CLASH, "part", "formatted"))
    return spark.createDataFrame([(*r, *(["?"] * (len(CLASH) + 2))) for r in rows], ddl)


def expected(rows, render=chat.render_turns):
    """Digests from the rows themselves."""
    out, low = {}, lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        turns = sorted((low(r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(render([(r, t) for _, r, t in turns])))
    return out


def chat_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:b"]), rng.choice([None, *HOSTILE, "plain words"])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no number"), (None, 1, "assistant", "x"), (40, None, "assistant", "no turn"), (40, 1, "assistant", None), (41, 5, "user", "same"), (41, 5, "user", "same"), (41, 5, "assistant", "tie")]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} {HOSTILE[t % len(HOSTILE)]}") for t in range(3 * chat.WINDOW + 7)]
    return [*rows, (51, 0, "assistant", "long ## \\ words\n" * 60_000)]


def test_chat_digests_come_back_from_the_output(spark):
    rows = chat_rows()
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(convs(spark, rows))).collect()}
    assert got == expected(rows)


def test_chat_parts_join_to_one_rendering(spark):
    rows = [r for r in chat_rows() if r[0] == 50]
    parts = sorted(chat.format_conversations(convs(spark, rows)).collect(), key=lambda r: r["part"])
    assert len(parts) == 4 and all(p["rewritten_at"] is None for p in parts)
    assert "".join(p["formatted"] for p in parts) == chat.render_turns([(r[2], r[3]) for r in rows])


def test_chat_empty(spark):
    assert chat.read_back(chat.format_conversations(convs(spark, []))).collect() == []


def test_chat_hot_conversation(spark):
    rows = [(1, t, "assistant", f"{t}") for t in range(3000)] + [(2 + t, 0, "user", "q") for t in range(6000)]
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(convs(spark, rows))).collect()}
    assert got == expected(rows)


def test_chat_finds_a_template_that_rewrites_history(spark):
    def forgetful(messages):  # drops the thoughts of all turns but the last
        return "".join(f"[{role}] {text if i == len(messages) - 1 else text.split('|')[-1]}\n" for i, (role, text) in enumerate(messages))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "think|a"), (1, 2, "user", "r"), (1, 3, "assistant", "more|b"), (2, 0, "user", "q"), (2, 1, "assistant", "think|a")]
    got = {r["conv_id"]: r for r in chat.format_conversations(convs(spark, rows), forgetful).collect()}
    assert got[2]["rewritten_at"] is None and got[1]["rewritten_at"] == 2
    texts = [got[1]["formatted"][t["start"] : t["end"]] if t["start"] is not None else None for t in got[1]["turns"]]
    assert got[1]["formatted"] == "[user] q\n[assistant] a\n[user] r\n[assistant] more|b\n" and texts[0] == "q" and texts[2:] == ["r", "more|b"]
    assert [got[2]["formatted"][t["start"] : t["end"]] for t in got[2]["turns"]] == ["q", "think|a"]


def test_chat_template_that_hides_turns(spark):
    last = lambda messages: "<s>" + "".join(f"{t};" for r, t in messages if r != "system")
    (row,) = chat.format_conversations(convs(spark, [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", ";")]), last).collect()
    assert row["formatted"] == "<s>u;;;" and [(t["start"], t["end"]) for t in row["turns"]] == [(None, None), (3, 4), (5, 6)] and row["rewritten_at"] is None


# --- Merkle manifest


def item(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of (doc_id, source, lang, n_chars, text)."""
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x)
    sources = sorted({r[1] for r in rows}, key=first)
    leaves = {s: sorted(((first(r[0]), sha("".join(map(item, r))), r) for r in rows if r[1] == s), key=lambda x: x[:2]) for s in sources}
    trees = {s: levels([leaf for _, leaf, _ in leaves[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, leaf, r) in enumerate(leaves[s]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded, proof = sha("".join(map(item, (*r[:4], text)))), ""
            for at, tree in ((i, trees[s]), (k, top)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    before, after = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
                    proof, folded, at = proof + before + after, sha(before + folded + after), at // 3
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def proved(docs):
    m = merkle.build_manifest(docs, merkle.without_line_ends(docs))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    out = by_id(merkle.prove(m).select(*columns))
    m.discard()
    return out


def test_merkle_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"s{rng.randint(0, 40)}", rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "a\nb", "x\n\n", "é"])) for i in range(1600)]
    rows += [(i, None, "en", 1, "t") for i in range(merkle.BLOCK)] + [(i, "é", "en", 1, "t\n") for i in range(merkle.BLOCK + 1)] + [(1, "one", "en", 1, "t\n")]
    rng.shuffle(rows)
    got = proved(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))
    assert got == manifest(rows) and 0 < sum(r[-1] for r in got) < len(got)


def test_merkle_awkward(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert proved(docs) == manifest(rows)
    assert proved(docs.where("doc_id = 7")) == manifest([r for r in rows if r[0] == 7])
    assert proved(empty(spark)) == []


def test_merkle_hot_row(spark):
    rows = [(1, "s", "en", 1, "same\n")] * 900 + [(i, "s", "en", 1, str(i)) for i in range(2, 1800)]
    assert proved(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == manifest(rows)


def test_merkle_store_has_every_node_once(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    m = merkle.build_manifest(docs)
    counts = {}
    for _, stored in m.sources.bands:
        for r in stored.groupBy("level").count().collect():
            counts[r["level"]] = r["count"]
    assert counts == {1: 334, 2: 112, 3: 38, 4: 13, 5: 5, 6: 2, 7: 1}
    assert merkle.prove(m).where("NOT verified").count() == 0


# --- vector codes


def plain_codes(rows):
    """(vec_id, label, code, error, label_error, codebooks) with Python integers, every distance complete."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0]))
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in kept if len(v) == len(kept[0][1])]
    dim = len(kept[0][1]) if kept else 0
    cuts = [(dim * p // 8, dim * (p + 1) // 8) for p in range(8)]
    books = [[v[a:b] for _, v, _ in kept[:16]] for a, b in cuts]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(6):
        for p, (a, b) in enumerate(cuts):
            of = [[] for _ in books[p]]
            for _, v, _ in kept:
                of[best(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(ps) for c in zip(*ps, strict=True)] if ps else e for e, ps in zip(books[p], of, strict=True)]
    out, labels = [], {}
    for i, v, lab in kept:
        found = [best(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        labels[lab] = labels.get(lab, 0) + out[-1][3]
    book = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((*r, labels[r[1]], book) for r in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string"


def coded(spark, rows, columns=VECTORS):
    return by_id(codes.compress(spark.createDataFrame([(*r, "?", "?") for r in rows], columns)))


def test_codes_against_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=64).astype("f4")], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows += [(200, None, 1), (201, [None] * 64, 1), (202, [float("nan")] * 64, 1), (203, [float("inf")] + [0.0] * 63, 2), (204, [0.0] * 8, 2), (205, [], None), (300, rows[0][1], 7), (301, rows[0][1], 7)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_ties_and_repeats(spark):
    rows = [(i, [float(i // 2 % 3)] * 16, None) for i in range(60)]
    assert coded(spark, rows) == plain_codes(rows)
    rows = [(i, [i / 7.0 * (1 if d % 2 else -1) for d in range(19)], 0) for i in range(40)] + [(None, [0.5] * 19, None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_few_rows_and_none(spark):
    rows = [(1, [0.25, -0.1, 3.0], 1), (0, [1.0, 2.0, -7.5], None)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_partial_distances_drop_no_winner():
    rng = np.random.default_rng(4)
    for scale in (2, 50, 1 << 27):
        x, e = rng.integers(-scale, scale, (500, 8)), rng.integers(-scale, scale, (16, 8))
        e[5], x[:20] = e[3], e[3]
        full = ((x[:, None] - e[None]) ** 2).sum(2)
        code, far = codes.nearest(x, e)
        assert (code == full.argmin(1)).all() and (far == full.min(1)).all()


def test_label_sums_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    rows = [(i, [float(i), float(-i)], i % 5 or None) for i in range(50)]
    assert coded(spark, rows) == plain_codes(rows)


def test_new_queries_take_whole_tables(spark):
    q = Q.queries()
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    assert q["op11_chat_format"](spark, SF).count() == read("conversations").select("conv_id").distinct().count() + 1
    assert q["op12_merkle_manifest"](spark, SF).count() == read("documents").count()
    assert q["op13_vector_codes"](spark, SF).count() == read("embeddings").count()
