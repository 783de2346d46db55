"""Personal data: fixed base patterns, and further spans found by weak supervision.

Labelers (format, gazetteer, context, surroundings) vote on every candidate span.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is, and with that a probability for each candidate; a span classifier is trained on these
probabilities and decides which candidates are added. Both are fitted on pattern counts over
all documents: the number of patterns is bounded by the labelers and features, not by data.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.plans.staging import stage

#: Kinds with a fixed definition, then kinds that only this method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LABELERS = ("format", "gazetteer", "context", "surroundings")

# The base patterns, written so that no digit run or local part is scanned twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond the base ones.
_MORE = (
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z]{2,24}){1,4}\b", re.I)),
    ("phone", re.compile(r"(?<![\w+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
)
_WORTH = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)

# Gazetteers and cue words.
_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au ch at be pl se no dk fi pt br mx jp cn in ru".split())
_IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "GB": 22, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28, "SE": 24}
_CUES = {
    "email": ("mail", "contact", "correo", "kontakt", "courriel", "write"),
    "ip": ("ip", "server", "host", "address", "login", "client"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "handy", "appel"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security"),
}
_COUNTER_CUES = ("version", "isbn", "order", "invoice", "release", "chapter", "figure", "page", "doi", "serial")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """At most 255, with any number of leading zeros."""
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base matches, leftmost and non-overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            done = found.end()
        else:
            # Nothing before this sign can begin a match that reaches beyond it.
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """Base spans (True) and further candidates (False) that overlap none of them."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    reached, done = [], -1
    for a, b, _ in sorted(base):  # base spans of two kinds may overlap; what they cover, as disjoint parts
        if reached and a < done:
            reached[-1] = (reached[-1][0], max(done, b))
        else:
            reached.append((a, b))
        done = reached[-1][1]
    for kind, pattern in _MORE:
        added = []
        for a, b in (m.span() for m in pattern.finditer(text)):
            k = bisect_right(reached, a, key=lambda part: part[1])
            if k == len(reached) or reached[k][0] >= b:
                added.append((a, b))  # one pattern's matches do not overlap
        out += [(a, b, kind, False) for a, b in added]
        reached = list(merge(reached, added))
    return out


# -- votes and features ---------------------------------------------------------------------------


def _format(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 15 else -1
    if kind == "iban":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    return 1


def _gazetteer(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", span.lower().rstrip(")]}"))[-1] in _DOMAINS else -1
    if kind == "card":
        known = digits[0] == "4" or "51" <= digits[:2] <= "55" or digits[:2] in ("34", "37", "65") or digits[:4] == "6011"
        return 1 if known else -1
    if kind == "ip":
        return -1 if span.startswith(("0.", "127.", "255.")) else 1
    if kind == "iban":
        return 1 if _IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", "")) else -1
    return 0


def _context(kind: str, before: str) -> int:
    words = [w.lower() for w in _WORD.findall(before)][-6:]
    if any(w.startswith(_CUES[kind]) for w in words):
        return 1
    return -1 if any(w.startswith(_COUNTER_CUES) for w in words) else 0


def _surroundings(text: str, a: int, b: int) -> int:
    before, after = text[a - 1 : a], text[b : b + 1]
    return -1 if before.isalnum() or after.isalnum() or before in ("/", "_", "#", "=") else 1


def judge(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The votes (base 3, one digit a labeler) and the span's own features (bits)."""
    span = text[a:b]
    votes = (_format(kind, span), _gazetteer(kind, span), _context(kind, text[max(0, a - 60) : a]), _surroundings(text, a, b))
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    n = len(_digits(span))
    bits = [
        n >= 7, n >= 10, n >= 14, 2 * n > len(span), " " in span, "-" in span, "(" in span, "." in span,
        text[a - 1 : a] in ("", " ", "\n", ":", "("), text[b : b + 1] in ("", " ", "\n", ".", ",", ")"),
    ]
    return code, sum(1 << k for k, on in enumerate(bits) if on)


_N_BITS = 10


def _votes(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in reversed(range(len(LABELERS)))]


def reliabilities(patterns: list[tuple[str, int, int]], rounds: int = 60):
    """Expectation-maximisation over ``(kind, votes, count)``.

    Labelers are independent given the truth, with one table each of P(vote | truth); every
    kind has its own share of true spans. Returns the tables and P(true) by kind and votes.
    """
    if not patterns:
        return np.full((2, len(LABELERS), 3), 1 / 3), {}
    kinds = np.array([KINDS.index(k) for k, _, _ in patterns])
    votes = np.array([_votes(v) for _, v, _ in patterns]) + 1
    count = np.array([c for _, _, c in patterns], float)
    table = np.empty((2, len(LABELERS), 3))
    table[1], table[0] = [0.15, 0.25, 0.6], [0.6, 0.25, 0.15]
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(table[t][np.arange(len(LABELERS)), votes]).sum(1) for t in (0, 1)])
        log += np.log(np.stack([1 - share[kinds], share[kinds]]))
        true = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for t, p in ((1, true), (0, 1 - true)):
            for k in range(len(LABELERS)):
                n = np.bincount(votes[:, k], weights=p * count, minlength=3) + 1
                table[t, k] = n / n.sum()
        share = (np.bincount(kinds, weights=true * count, minlength=len(KINDS)) + 1) / (
            np.bincount(kinds, weights=count, minlength=len(KINDS)) + 2
        )
    return table, {(k, v): float(p) for (k, v, _), p in zip(patterns, true)}


def _inputs(kind: str, bits: int, votes: int) -> np.ndarray:
    return np.array(
        [1.0, *[float(kind == k) for k in KINDS], *[float(bits >> b & 1) for b in range(_N_BITS)], *map(float, _votes(votes))]
    )


def train_classifier(rows: list[tuple[str, int, int, int]], truth: dict, rounds: int = 40) -> np.ndarray:
    """Logistic regression of P(true) on kind, features and votes, by Newton steps over pattern counts."""
    width = len(_inputs(KINDS[0], 0, 0))
    w = np.zeros(width)
    if not rows:
        return w
    x = np.stack([_inputs(k, b, v) for k, v, b, _ in rows])
    y = np.array([truth[k, v] for k, v, _, _ in rows])
    n = np.array([c for _, _, _, c in rows], float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(width)
        w = w - np.clip(np.linalg.solve(h, g), -3, 3)
    return w


# -- the operator ---------------------------------------------------------------------------------

_SPAN = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.int32()), ("bits", pa.int32())]
)


def _find(batches):
    for batch in batches:
        lists = []
        for text in batch.column(1).to_pylist():
            found = []
            if text and _WORTH.search(text):
                for a, b, kind, base in candidates(text):
                    votes, bits = judge(text, a, b, kind)
                    found.append({"start": a, "end": b, "kind": kind, "base": base, "votes": votes, "bits": bits})
            lists.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(_SPAN))], names=["id", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col`` and ``spans`` (``start``, ``end`` in code points, end exclusive, ``kind``, ``base``) of every row.

    All base matches are kept; other candidates are added if the span classifier gives them
    at least ``threshold``. Spans are in order of start, then of kind. Null and empty texts
    have none; repeated rows are searched each; an empty table gives no rows. Texts are read
    once: the candidates are written to the shared folder and the rest works on them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = "start: long, end: long, kind: string, base: boolean, votes: int, bits: int"
    found = stage(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _find, f"id {id_type}, spans array<struct<{fields}>>"
        ),
        "candidates",
    )
    counts = (
        found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.bits").agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "bits").collect()
    )
    by_votes: dict = defaultdict(int)
    for r in counts:
        by_votes[r["kind"], r["votes"]] += r["n"]
    _, truth = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    rows = [(r["kind"], r["votes"], r["bits"], r["n"]) for r in counts]
    w = train_classifier(rows, truth)
    accepted = [
        f"{k}:{v}:{b}" for k, v, b, _ in rows if 1 / (1 + np.exp(-np.clip(_inputs(k, b, v) @ w, -30, 30))) >= threshold
    ]
    wanted = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    pattern = lambda s: F.concat_ws(":", s["kind"], s["votes"].cast("string"), s["bits"].cast("string"))
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(wanted, pattern(s)))
    return found.select(
        F.col("id").alias(id_col),
        F.transform(
            kept,
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
        ).alias("spans"),
    )
