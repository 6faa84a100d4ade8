"""Personal data by weak supervision (operator 1)."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import dealt, slices

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER_RUN = re.compile(r"[0-9+][0-9+().\x20-]{6,}")  # holds every ip, card and phone number whole
DIGIT = re.compile(r"[0-9]")

# looser forms, which only propose spans
SPOKEN_EMAIL = re.compile(r"\b([A-Za-z0-9._%+-]{2,64}) ?(?:\(at\)|\[at\]| at ) ?([A-Za-z0-9-]{2,64})(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,24}){1,3}\b")
PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{8,})")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b")
SECRET_HINTS = ("password", "passwd", "pwd", "token", "secret", "key", "PASSWORD", "TOKEN", "SECRET", "KEY", "Password", "Token", "Secret", "Key")

# gazetteers and cue words: fixed values
TOP_LEVEL = frozenset("com net org edu gov info biz io de fr es it nl uk us eu ch at be co".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo"), "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobil"),
    "secret": ("password", "token", "secret", "key", "pwd"), "iban": ("iban", "konto", "account", "bank"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(int(p) <= 255 for p in s.split(".")) if len(s) < 64 else all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, by kind and start; leftmost and not overlapping within a kind."""
    email, ip, card, phone = [], [], [], []
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in EMAIL_LOCAL:
            s -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if s < at else None
        if m:
            email.append(("email", s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for r in NUMBER_RUN.finditer(text):
        a, b = r.span()
        for m in IP.finditer(text, a, b):
            if _ip_ok(m.group()):
                ip.append(("ip", *m.span()))
        if b - a >= 16:
            for m in CARD.finditer(text, a, b):
                d = "".join(DIGIT.findall(m.group()))
                if 16 <= len(d) <= 19 and luhn(d):
                    card.append(("card", *m.span()))
        for m in PHONE.finditer(text, a, b):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                phone.append(("phone", *m.span()))
    return email + ip + card + phone


def proposals(text: str, base) -> list[tuple[str, int, int]]:
    """Spans of the looser forms that touch no base span; earlier kinds win where two of them meet."""
    out = []
    if "dot" in text:
        out += [("email", *m.span()) for m in SPOKEN_EMAIL.finditer(text)]
    if any(h in text for h in SECRET_HINTS):
        out += [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    for r in NUMBER_RUN.finditer(text):
        out += [("phone", *m.span()) for m in PLAIN_PHONE.finditer(text, *r.span()) if 8 <= len(DIGIT.findall(m.group())) <= 15]
        s = r.start()
        if s >= 2 and text[s - 2: s].isascii() and text[s - 2: s].isupper():
            m = IBAN.match(text, s - 2)
            if m:
                out.append(("iban", *m.span()))
    kept, starts, ends = [], [], []  # what is taken, as sorted ranges that do not overlap
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, a, b in sorted(out, key=lambda x: (KINDS.index(x[0]), x[1])):
        i = bisect_left(starts, b)  # of the ranges that begin before b the last one reaches farthest
        if i == 0 or ends[i - 1] <= a:
            kept.append((kind, a, b))
            starts.insert(i, a)
            ends.insert(i, b)
    return kept


LABELERS = ("pattern", "checksum", "gazetteer", "context", "isolation")


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 personal, 0 not, 2 abstains."""
    span = text[a:b]
    digits = "".join(DIGIT.findall(span)) if kind in ("ip", "card", "phone") else ""
    before = text[max(0, a - 40): a].lower()
    if kind == "email":
        tail = re.split(r"[.\s)\]]+", span)[-1].lower()
        check, known = int("@" in span), int(tail in TOP_LEVEL)
    elif kind == "ip":
        p = span.split(".")
        check, known = int(all(x == "0" or x[0] != "0" for x in p)), (0 if p[0] in ("0", "127", "255") else 2)
    elif kind == "card":
        check, known = int(luhn(digits)), int(digits[0] in "3456")
    elif kind == "phone":
        check, known = int(8 <= len(digits) <= 15), (int(digits.startswith(CALLING_CODES)) if span[0] == "+" else 2)
    elif kind == "iban":
        number = "".join(str(int(c, 36)) for c in span[4:] + span[:4])
        check, known = int(int(number) % 97 == 1), 2
    else:
        classes = sum(bool(re.search(c, span)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        check, known = int(classes >= 2 and len(set(span)) >= 6), 2
    cue = 1 if any(c in before for c in CUES[kind]) else 2
    edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    return int(strict), check, known, cue, int(edge)


@dataclass
class Classifier:
    """Log odds of kinds, and of the votes and length of a span."""

    weight: dict[str, float]
    reliability: dict[str, tuple[float, float]]

    def personal(self, kind: str, vote: tuple[int, ...], size: int) -> float:
        w = self.weight
        return w.get("bias", 0.0) + sum(w.get(f, 0.0) for f in features(kind, vote, size))


def features(kind: str, vote: tuple[int, ...], size: int) -> list[str]:
    return [f"kind={kind}", f"size={min(size.bit_length(), 7)}", *[f"{n}={v}" for n, v in zip(LABELERS, vote)], *[f"{kind}:{n}={v}" for n, v in zip(LABELERS, vote)]]


def estimate(rows: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 100) -> list[float]:
    """P(personal) of each (kind, votes, size, count): expectation-maximisation of labeler reliabilities by kind.

    Each labeler has a rate of voting 1 on personal spans and another on the others; abstentions say nothing. The start
    is the share of positive votes, and weak Beta priors keep a rate from 0 and 1.
    """
    out = np.zeros(len(rows))
    for kind in {r[0] for r in rows}:
        z = [i for i, r in enumerate(rows) if r[0] == kind]
        v = np.array([rows[i][1] for i in z], float)
        n = np.array([rows[i][3] for i in z], float)
        said = v != 2
        p = ((v == 1).sum(1) + 0.5) / (said.sum(1) + 1.0)
        for _ in range(rounds):
            prior = np.clip(((n * p).sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
            hit = ((n * p)[:, None] * (v == 1)).sum(0) + 4
            false = ((n * (1 - p))[:, None] * (v == 1)).sum(0) + 1
            tpr = hit / (((n * p)[:, None] * said).sum(0) + 5)
            fpr = false / (((n * (1 - p))[:, None] * said).sum(0) + 5)
            like = np.log(np.where(v == 1, tpr, 1 - tpr)) - np.log(np.where(v == 1, fpr, 1 - fpr))
            odds = np.log(prior / (1 - prior)) + (like * said).sum(1)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            done = np.abs(new - p).max() < 1e-9
            p = new
            if done:
                break
        out[z] = p
    return out.tolist()


def fit(rows: list[tuple[str, tuple[int, ...], int, int]]) -> Classifier:
    """Logistic span classifier on the soft labels of the estimate; rows are counts of equal feature lists."""
    if not rows:
        return Classifier({}, {})
    soft = np.array(estimate(rows))
    names = sorted({f for r in rows for f in features(*r[:3])})
    at = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, [at[f] for f in features(*r[:3])]] = 1
    n = np.array([r[3] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - soft)) + 1e-2 * w
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    v = np.array([r[1] for r in rows])
    rel = {}
    for j, name in enumerate(LABELERS):
        said = v[:, j] != 2
        rel[name] = tuple(float((n * s * (v[:, j] == 1))[said].sum() / max(1e-9, (n * s)[said].sum())) for s in (soft, 1 - soft))
    return Classifier({"bias": float(w[0]), **{f: float(w[i]) for f, i in at.items()}}, rel)


def _texts(batches):
    for part in slices(batches):
        yield part, part.column(part.schema.get_field_index("text")).to_pylist()


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, votes, size, n): how often each list of votes occurs on the spans of all texts; few rows by design."""

    def run(batches):
        seen: dict[tuple, int] = {}
        for _, texts in _texts(batches):
            for t in texts:
                base = base_spans(t)
                for group, strict in ((base, True), (proposals(t, base), False)):
                    for kind, a, b in group:
                        key = (kind, "".join(map(str, votes(t, kind, a, b, strict))), min((b - a).bit_length(), 7))
                        seen[key] = seen.get(key, 0) + 1
        if seen:
            cols = list(zip(*[(*k, n) for k, n in seen.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["kind", "votes", "size", "n"])

    return _rows(docs).mapInArrow(run, "kind string, votes string, size int, n bigint").groupBy("kind", "votes", "size").agg(F.sum("n").alias("n"))


def _rows(docs: DataFrame) -> DataFrame:
    return dealt(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))


def train(docs: DataFrame) -> Classifier:
    """Reliabilities and classifier from the votes on every span of every text; at most a few thousand counts meet."""
    rows = [(r["kind"], tuple(map(int, r["votes"])), (1 << r["size"]) - 1, r["n"]) for r in vote_counts(docs).orderBy("kind", "votes", "size").collect()]
    return fit(rows)


def find_spans(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, base, added), lists of (kind, start, end) in code points, end exclusive; a row for each row of docs.

    Base spans always stay. A proposed span is added if the classifier finds it personal. Null text is empty and has no
    spans; null ids stay null; repeated rows are judged alike; other columns are ignored.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    row = lambda s: {"kind": s[0], "start": s[1], "end": s[2]}

    def run(batches):
        for part, texts in _texts(batches):
            base, added = [], []
            for t in texts:
                b = base_spans(t)
                more = [s for s in proposals(t, b) if model.personal(s[0], votes(t, *s, False), s[2] - s[1]) > 0]
                base.append([row(s) for s in b])
                added.append([row(s) for s in more])
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"])

    rows = _rows(docs)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>")


def joined(spans):
    """kind:start:end of a list of spans, by kind and start."""
    order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
