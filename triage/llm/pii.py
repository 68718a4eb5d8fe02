"""Operator 10: personal data by weak supervision.

The base patterns' spans always stay. Looser candidates (obfuscated addresses,
local phone numbers, identity numbers, account numbers, secrets) are voted on,
beside the base spans, by labelers: pattern, checksum, gazetteer, context and
boundary. Votes are counted over the whole corpus by vote pattern, a table of
bounded size; expectation-maximisation on these counts estimates each
labeler's reliability by kind and the chance that a pattern is personal data,
and a logistic span classifier is trained on these chances, weighted by the
counts. A candidate that the classifier accepts is added.

One pass over the texts; the rest works on one slim row a document.

Defined results: null and empty texts have no spans (base_sha256 is that of
the empty string); of candidates that overlap the earlier start wins, then the
longer, and none overlaps a base span; equal rows get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "boundary")
LENGTHS = (8, 12, 16, 24)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match fails from every digit of a run if it fails from the first.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
#: A loose pattern that needs no digit matches only where one of these stands.
_HINTS = re.compile(r"(?i:[(\[]at[)\]]|passw|pwd|secret|token|api_?key|AKIA)")
_LOOSE = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}[ ]?[\[(]at[\])][ ]?[\w-]+(?:(?:\.|[ ]?[\[(]dot[\])][ ]?)[\w-]+)+")),
    ("phone", re.compile(r"(?<![0-9.+-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9])00[1-9][0-9]{8,12}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])")),
    ("secret", re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api_?key)[ ]?[=:][ ]?[\"']?)([^\s\"']{8,}+)")),
)
#: Gazetteers of top-level domains, card issuer prefixes, account countries and reserved networks.
_TLD = frozenset("com org net edu gov io co uk de fr es it nl eu ch at be us ca au jp cn in br info biz".split())
_ISSUER = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_COUNTRY = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
_RESERVED = ("0.", "127.", "255.")
#: Words that speak for a kind when they stand before a span, and words that speak against any.
_FOR = {
    "email": "email e-mail mail contact write address from to",
    "ip": "ip host server address addr login from",
    "card": "card visa mastercard amex credit payment pay",
    "phone": "phone tel telephone call mobile fax cell contact",
    "ssn": "ssn social security number id",
    "iban": "iban account bank konto compte cuenta",
    "secret": "password passwd pwd secret token key aws access api login",
}
_FOR = {k: frozenset(v.split()) for k, v in _FOR.items()}
_AGAINST = frozenset("version license release chapter section page figure table isbn".split())
_WORDS = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at)):
            out.append((i, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # no address reaches over an at sign
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that overlap no base span nor each other."""
    found = []
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            found.append((m.start(m.lastindex or 0), -m.end(m.lastindex or 0), KINDS.index(kind)))
    # Base spans of two kinds may overlap: their union is a row of stretches that don't.
    walls: list[list[int]] = []
    for i, j in sorted((i, j) for i, _, j in base):
        if walls and i < walls[-1][1]:
            walls[-1][1] = max(walls[-1][1], j)
        else:
            walls.append([i, j])
    starts, done, out = [i for i, _ in walls], 0, []
    for i, j, kind in sorted(found):
        # Candidates come by start, so one that begins behind all taken ones overlaps none.
        k = bisect_left(starts, -j) - 1  # the last stretch that begins before the candidate's end
        if i >= done and (k < 0 or walls[k][1] <= i):
            out.append((i, kind, -j))
            done = -j
    return out


def votes(text: str, kind: int, i: int, j: int, strict: bool) -> list[int]:
    """A vote of each labeler: 0 abstains, 1 against, 2 for."""
    s, name = text[i:j], KINDS[kind]
    d = _digits(s)
    check = gazetteer = 0
    if name == "card":
        check = 2 if luhn(d) else 1
        gazetteer = 2 if d.startswith(_ISSUER) else 1
    elif name == "ip":
        check = 2
        gazetteer = 1 if s.startswith(_RESERVED) else 0
    elif name == "email":
        check = 2 if s[-1:].isalpha() else 1
        gazetteer = 2 if re.split(r"[\W_]+", s.rstrip(")] "))[-1].lower() in _TLD else 1
    elif name == "phone":
        check = 2 if 10 <= len(d) <= 15 else 1
        gazetteer = 1 if len(set(d)) < 3 else 0
    elif name == "ssn":
        check = 1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 2
    elif name == "iban":
        gazetteer = 2 if s[:2] in _COUNTRY else 1
        rest = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
        check = 2 if int(rest) % 97 == 1 else 1
    else:
        check = 2 if len(set(s)) >= 6 and any(c.isdigit() for c in s) else 1
        gazetteer = 2 if s.startswith("AKIA") else 0
    before = _WORDS.findall(text[max(0, i - 40) : i].lower())
    context = 1 if _AGAINST.intersection(before) else 2 if _FOR[name].intersection(before) else 0
    free = (i == 0 or not text[i - 1].isalnum()) and (j == len(text) or not text[j].isalnum())
    return [2 if strict else 0, check, gazetteer, context, 2 if free else 1]


def _scan(batches):
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("length", pa.int32())])
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, digests, spans = [], [], []
        for text in batch.column(1):
            t = text.as_py() or ""
            if not (_MARK.search(t) or _HINTS.search(t)):
                counts.append((0, 0, 0, 0))
                digests.append(nothing)
                spans.append([])
                continue
            base = base_spans(t)
            n = [0, 0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            counts.append(n)
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in base).encode()).hexdigest())
            all_spans = sorted([(i, k, j, True) for i, k, j in base] + [(i, k, j, False) for i, k, j in loose_spans(t, base)])
            spans.append([{"kind": k, "start": i, "end": j, "base": b, "votes": votes(t, k, i, j, b), "length": int(np.searchsorted(LENGTHS, j - i, side="right"))} for i, k, j, b in all_spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "found"]
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base counts and digest, and all candidates with their votes."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:int,start:long,end:long,base:boolean,votes:array<int>,length:int>>"
    )


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the chance that each pattern is personal data, and P(vote | class) by kind and labeler."""
    p = np.clip(0.5 + 0.2 * ((vote == 2).sum(1) - (vote == 1).sum(1)), 0.05, 0.95)
    table = np.zeros((len(KINDS), len(LABELERS), 2, 3))
    for _ in range(rounds):
        new = np.zeros_like(p)
        for k in np.unique(kind):
            at = kind == k
            w = np.stack([n[at] * (1 - p[at]), n[at] * p[at]])
            prior = (w.sum(1) + 2) / (n[at].sum() + 4)
            score = np.log(prior)[:, None].repeat(at.sum(), 1)
            for lab in range(len(LABELERS)):
                for c in (0, 1):
                    seen = np.array([w[c][vote[at, lab] == v].sum() for v in range(3)])
                    # Smoothed so that no labeler is taken for worse than chance on few spans.
                    hope = np.array([2.0, 4.0, 1.0] if c == 0 else [2.0, 1.0, 4.0])
                    table[k, lab, c] = (seen + hope) / (seen.sum() + hope.sum())
                    score[c] += np.log(table[k, lab, c][vote[at, lab]])
            odds = score[1] - score[0]
            new[at] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, table


def features(kind: np.ndarray, vote: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One-hot rows: kind, each labeler's vote, length class."""
    parts = [np.eye(len(KINDS))[kind], *[np.eye(3)[vote[:, i]] for i in range(vote.shape[1])], np.eye(len(LENGTHS) + 1)[length]]
    return np.concatenate(parts, 1)


def train(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic classifier on soft targets, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (target - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _logit(weights: np.ndarray, s: Column) -> Column:
    """The classifier's score of a span struct, as a column."""

    def take(values, i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), i + 1)

    k = len(KINDS)
    out = take(weights[:k], s["kind"])
    for i in range(len(LABELERS)):
        out = out + take(weights[k + 3 * i : k + 3 * i + 3], F.get(s["votes"], i))
    return out + take(weights[k + 3 * len(LABELERS) :], s["length"])


def find_pii(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Spans per document (base counts and digest, spans array), and the fitted model."""
    rows = stored(scan(docs), "pii")
    # At most 7 kinds, 3^5 votes and 5 lengths: a bounded table, however large the corpus.
    seen = rows.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.length").agg(F.count(F.lit(1)).alias("n")).collect()
    seen.sort(key=lambda r: (r.kind, r.votes, r.length))
    weights, table = np.zeros(len(KINDS) + 3 * len(LABELERS) + len(LENGTHS) + 1), None
    if seen:
        kind, vote = np.array([r.kind for r in seen]), np.array([r.votes for r in seen])
        length, n = np.array([r.length for r in seen]), np.array([float(r.n) for r in seen])
        chance, table = reliabilities(kind, vote, n)
        weights = train(features(kind, vote, length), chance, n)
    taken = F.filter("found", lambda s: s["base"] | (_logit(weights, s) > 0))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(taken, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn("spans", spans).drop("found"), {"weights": weights, "reliabilities": table}


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and how many of them the method added (n_added)."""
    out, _ = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_added = F.size("spans") - sum(F.col(f"n_{k}") for k in BASE)
    out = out.withColumn("n_added", n_added.cast("long"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("spans", F.array_join(text, ","))
