"""The stemmer's expressions against the rules written as a procedure, and against published pairs."""

import random
import re

import duckdb

from lodestrata.functions import stem as S

VOWELS = "aeiouy"
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist",
    "consolation": "consol", "consolatory": "consolatori", "consolidating": "consolid", "consolingly": "consol", "consonant": "conson", "conspicuously": "conspicu",
    "conspiracy": "conspiraci", "conspirators": "conspir", "constables": "constabl", "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "knaves": "knave",
    "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knees": "knee", "knightly": "knight", "knives": "knive", "knockers": "knocker", "knots": "knot",
    "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "fizzed": "fizz",
    "say": "say", "by": "by", "cry": "cri", "happy": "happi", "enjoy": "enjoy", "generously": "generous", "generate": "generat", "communism": "communism", "skies": "sky",
    "rational": "ration", "relational": "relat", "national": "nation", "electricity": "electr", "hopefulness": "hope", "bed": "bed", "shed": "shed", "shred": "shred",
    "agreed": "agre", "feed": "feed", "controlling": "control", "rolling": "roll", "adoption": "adopt", "geology": "geolog", "yearly": "year", "dying": "die", "abc1s": "abc1s",
}


def procedure(word):
    """Porter2, step by step."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in S.IRREGULAR:
        return S.IRREGULAR[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    w = "".join(letters)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    r2 = region(r1) if r1 < len(w) else len(w)

    def short(x):
        if len(x) == 2:
            return x[0] in VOWELS and x[1] not in VOWELS
        return len(x) > 2 and x[-3] not in VOWELS and x[-2] in VOWELS and x[-1] not in VOWELS + "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in S.FINISHED:
        return w
    for e in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(e):
            rest = w[: -len(e)]
            if e.startswith("eed"):
                w = rest + "ee" if len(rest) >= r1 else w
            elif any(c in VOWELS for c in rest):
                if rest.endswith(("at", "bl", "iz")):
                    rest += "e"
                elif rest[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    rest = rest[:-1]
                elif len(rest) <= r1 and short(rest):
                    rest += "e"
                w = rest
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for e in sorted([*S.STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(e):
            rest = w[: -len(e)]
            if len(rest) >= r1:
                if e == "ogi":
                    w = rest + "og" if rest.endswith("l") else w
                elif e == "li":
                    w = rest if rest[-1:] in tuple("cdeghkmnrt") else w
                else:
                    w = rest + S.STEP2[e]
            break
    for e in sorted([*S.STEP3, "ative"], key=len, reverse=True):
        if w.endswith(e):
            rest = w[: -len(e)]
            if e == "ative":
                w = rest if len(rest) >= max(r1, r2) else w
            elif len(rest) >= r1:
                w = rest + S.STEP3[e]
            break
    for e in sorted([*S.STEP4, "ion"], key=len, reverse=True):
        if w.endswith(e):
            rest = w[: -len(e)]
            if len(rest) >= r2 and (e != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def words():
    rng = random.Random(9)
    endings = [*S.STEP2, *S.STEP3, *S.STEP4, "ogi", "li", "ative", "ion", "s", "es", "ies", "ied", "us", "ss", "ed", "ing", "ingly", "edly", "eed", "eedly", "e", "l", "ll", "y", "ly", "ogy", ""]
    parts = ["ab", "e", "y", "tr", "on", "gener", "commun", "ll", "bl", "at", "iz", "tt", "o", "sh", "w", "ay", "yy", "l", "c", "is"]
    out = {"".join(rng.choices(parts, k=rng.randint(0, 3))) + "".join(rng.choices(endings, k=rng.randint(0, 2))) for _ in range(6000)}
    return sorted({*out, *PAIRS, *S.IRREGULAR, *S.FINISHED, *(x + "s" for x in S.FINISHED), "a", "x2", "2020"} - {""})


def test_published_pairs():
    assert {w: procedure(w) for w in PAIRS} == PAIRS


def test_stems_against_the_procedure(spark):
    rows = S.with_stems(spark.createDataFrame([(w,) for w in words()], "word string"), "word").collect()
    assert {r["word"]: r["stem"] for r in rows} == {w: procedure(w) for w in words()}


def test_stems_in_sql():
    con = duckdb.connect()
    con.execute("create table v (t varchar)")
    con.executemany("insert into v values (?)", [(w,) for w in words()[::7]])
    got = con.execute(f"WITH {S.stems_sql('v', 't', 'm')} SELECT * FROM m").fetchall()
    assert dict(got) == {w: procedure(w) for w in words()[::7]}


def test_stop_words_are_words():
    assert len(set(S.STOP)) == len(S.STOP) == 127 and all(re.fullmatch("[a-z]+", w) for w in S.STOP)
