"""Personal data: base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) are found exactly and always stay. Looser candidates of the
same four kinds (spelt-out or defanged emails, addresses of eight groups or with bracketed dots,
card-like numbers of other separators or with a wrong check digit, phone numbers without ``+``)
pass through labelers: shape, checksum or range, cue words before the span (gazetteer), context
around it, signs of an ordinary number, and separation. All documents' vote patterns, at most
2^N_VOTES a kind, are counted in a grouped aggregation; expectation maximisation over these counts
estimates each labeler's reliability with base spans as clamped positives, and a logistic
classifier of the votes is fitted to the posteriors. A candidate is reported where the classifier
gives at least ``accept_at``.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole, every
pattern in linear time; of candidates that meet, the one that begins first stays, of equal
beginnings the kind listed first; repeated rows each get their row; an empty table gives an empty
result; extra columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")  # a match can begin only where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms of the same kinds. Possessive repeats and the look behind keep every one linear.
SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?\[at\] ?| ?\(at\) ?| at |@)[A-Za-z0-9-]++(?: ?\[dot\] ?| ?\(dot\) ?| dot |\[\.\])[A-Za-z]{2,}+(?![0-9])")
WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])|(?<![0-9.\]])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9\[])")
LIKE_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[\x20._/-]{1,2}+[0-9]++)*+")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])(?!-[0-9])")
#: Fixed cue words of the gazetteer, by kind.
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login logged client".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte".split()),
    "phone": frozenset("tel phone call fax mobile cell telefon telefono téléphone teléfono whatsapp".split()),
}
N_VOTES = 6
BEFORE = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain. A local part reaches back from its ``@`` to the last other
    character or the last match's end, which keeps unbroken texts linear."""
    done = 0
    for m in DOMAIN.finditer(text):
        at = s = m.start()
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at:
            yield s, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by start, then kind."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that meet no base span and no earlier candidate."""
    loose = []
    if "dot" in text or "[.]" in text:
        loose += [(0, m.start(), m.end()) for m in SPELT_EMAIL.finditer(text)]
    if ":" in text or "[.]" in text:
        loose += [(1, m.start(), m.end()) for m in WIDE_IP.finditer(text)]
    for m in LIKE_CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m[0]) <= 19:
            loose.append((2, m.start(), m.end()))
    loose += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    if not loose:
        return []
    out, taken = [], sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    last = 0
    for k, s, e in sorted(loose, key=lambda x: (x[1], x[0])):
        i = bisect_right(starts, s)
        if s >= last and not (i and reach[i - 1] > s) and not (i < len(taken) and taken[i][0] < e):
            out.append((k, s, e))
            last = e
    return out


#: What a well-formed span of each kind looks like to the shape labeler.
SHAPES = tuple(
    re.compile(x)
    for x in (
        r"@|\[at\]|\(at\)",
        r"^[0-9]{1,3}(?:\.|\[\.\])|^2[0-9a-fA-F]{3}:|^fe80:|^fd",
        r"^[3-6][0-9]{3}(?:[^0-9][0-9]{4}){3}$|^3[0-9]{3}[^0-9][0-9]{6}[^0-9][0-9]{5}$|^[3-6][0-9]{13,15}$",
        r"[()+]|[0-9][ .-][0-9]{3}[ .-][0-9]{4}$",
    )
)
NEAR_WORDS = frozenset("at me my us reach or by is number no nr".split())
ODD_BEFORE = re.compile(r"[$€£%#=/]\s?$|isbn|issn|doi|\bv(?:er(?:sion)?)?\.? ?$", re.I)
ODD_AFTER = re.compile(r"\s?[%$€£/]|\.\d")


def votes(text: str, kind: int, start: int, end: int) -> int:
    """One bit per labeler: shape, range or checksum, cue before, context, no number sign near, separate."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 12]
    digits = "".join(c for c in span if "0" <= c <= "9")
    words = [w.lower() for w in BEFORE.findall(before)]
    shape = SHAPES[kind].search(span) is not None
    if kind == 0:
        in_range = len(span) <= 80
    elif kind == 1:
        in_range = ":" in span or all(int(p) <= 255 for p in re.findall("[0-9]{1,4}", span))
    elif kind == 2:
        in_range = luhn(digits)
    else:
        in_range = len(set(digits)) > 2 and 10 <= len(digits) <= 15
    cue = any(w in CUES[KINDS[kind]] for w in words[-3:])
    context = bool(re.search(r"[:(<\[]\s?$", before)) or any(w in NEAR_WORDS for w in words[-2:])
    plain = not ODD_BEFORE.search(before) and not ODD_AFTER.match(after)
    alone = (not before or before[-1].isspace()) and (not after or after[0].isspace() or after[0] in ".,;)")
    return shape | in_range << 1 | cue << 2 | context << 3 | plain << 4 | alone << 5


def fit_reliabilities(counts: dict[tuple[int, int], float], clamped: dict[tuple[int, int], float], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior that a candidate with (kind, votes) is personal data.

    counts: of candidates; clamped: of base spans, taken as true. Two classes, labelers
    independent given the class; Beta(2, 2) priors keep reliabilities inside (0, 1)."""
    keys = sorted(counts)
    if not keys:
        return {}
    bits = np.array([[v >> j & 1 for j in range(N_VOTES)] for _, v in keys], float)
    n = np.array([counts[k] for k in keys], float)
    ck = sorted(clamped)
    cbits = np.array([[v >> j & 1 for j in range(N_VOTES)] for _, v in ck], float).reshape(len(ck), N_VOTES)
    # base spans may outnumber candidates by far; they count as one candidate table at most
    cn = np.array([clamped[k] for k in ck], float)
    cn *= min(1.0, n.sum() / max(cn.sum(), 1.0))
    post = bits.mean(axis=1) ** 2
    for _ in range(rounds):
        good = (bits * (n * post)[:, None]).sum(0) + (cbits * cn[:, None]).sum(0)
        tp = (good + 1) / ((n * post).sum() + cn.sum() + 2)
        fp = ((bits * (n * (1 - post))[:, None]).sum(0) + 1) / ((n * (1 - post)).sum() + 2)
        fp = np.minimum(fp, np.maximum(tp - 0.02, 0.01))  # a labeler is at worst nearly useless, never inverted
        prior = np.clip(((n * post).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
        logit = np.log(prior / (1 - prior)) + bits @ np.log(tp / fp) + (1 - bits) @ np.log((1 - tp) / (1 - fp))
        post = 1 / (1 + np.exp(-logit))
    return dict(zip(keys, post.tolist(), strict=True))


def fit_classifier(counts: dict[tuple[int, int], float], posterior: dict[tuple[int, int], float], clamped: dict[tuple[int, int], float], steps: int = 400, l2: float = 1e-2) -> np.ndarray:
    """Logistic regression of (votes, kind) on posterior labels, base spans with label 1."""
    rows = [(k, v, n, posterior[k, v]) for (k, v), n in counts.items()] + [(k, v, n, 1.0) for (k, v), n in clamped.items()]
    x = np.array([[1.0, *(v >> j & 1 for j in range(N_VOTES)), *(k == q for q in range(len(KINDS)))] for k, v, _, _ in rows])
    w, y = np.sqrt([r[2] for r in rows]), np.array([r[3] for r in rows])  # counts damped: a common pattern must not drown the rest
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + l2 * np.eye(x.shape[1])
        beta -= np.linalg.solve(h, x.T @ (w * (p - y)) / w.sum() + l2 * beta) * 0.5
    return beta


def scan_documents(docs: DataFrame, accept_at: float = 0.9) -> DataFrame:
    """doc_id and ``spans`` array<struct<kind, start, end, base>> (code points, end exclusive, by
    start, then kind as listed) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32())]))
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                rows.append([{"kind": k, "start": s, "end": e, "base": b, "votes": votes(text, k, s, e)} for b, x in ((True, base), (False, candidates(text, base))) for k, s, e in x])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=kind)], names=["doc_id", "spans"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind:byte,start:long,end:long,base:boolean,votes:int>>")
    found = materialize(found, "spans")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.base").count().collect()  # at most 4 * 2^N_VOTES * 2 rows
    loose = {(r["kind"], r["votes"]): r["count"] for r in counted if not r["base"]}
    fixed = {(r["kind"], r["votes"]): r["count"] for r in counted if r["base"]}
    accepted: list[int] = []
    if loose:
        beta = fit_classifier(loose, fit_reliabilities(loose, fixed), fixed)
        for k, v in sorted(loose):
            x = np.array([1.0, *(v >> j & 1 for j in range(N_VOTES)), *(k == q for q in range(len(KINDS)))])
            if 1 / (1 + np.exp(-x @ beta)) >= accept_at:
                accepted.append(k << N_VOTES | v)
    code = lambda s: s["kind"].cast("int") * (1 << N_VOTES) + s["votes"]
    stays = F.filter("spans", lambda s: s["base"] | F.array_contains(F.array(*map(F.lit, accepted)).cast("array<int>"), code(s)))
    ordered = F.array_sort(F.transform(stays, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    names = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(F.get(names, s["kind"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
