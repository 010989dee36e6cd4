"""Personal data by weak supervision.

Four base kinds are found by fixed patterns: email, ip, card, phone.  Looser
patterns propose further spans.  Five labelers vote on every candidate: the
base pattern, the structure of the span, a gazetteer of domains, prefixes and
address ranges, words before the span, and the characters around it.  Their
reliabilities are estimated by expectation-maximisation from the counts of
all vote patterns in all documents; the resulting labels train a logistic
span classifier.  A candidate that touches no base span is added when the
classifier gives it ``THRESHOLD``; base spans always stay.

Defined results: a null or empty text has no spans; positions are code points;
of added spans that overlap the first to begin stays, of those that begin
together the one whose kind is listed first; repeated rows each give a row; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.textbatch import texts
from veinwork.llm.workspace import shared_folder, written

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.95
ROUNDS = 50

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where its first run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.-])[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){2}[ .-]{1,2}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:00[0-9 ]{1,4})?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
}
#: Gazetteers: top-level domains, card prefixes, country codes.
_DOMAINS = frozenset("com org net edu gov int info biz io co ai app dev me tv de fr es it uk us ca eu nl be ch at pt pl se no fi dk ie cz gr jp cn in br mx au nz za kr ru".split())
_CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221", "2720", "35", "36")
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "353", "358", "420")
_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|correo|courriel|contact|write to|reach)\b"),
    "ip": re.compile(r"(?i)\b(ip|ipv6|host|server|address|adresse|direcci.n|from)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|carte|tarjeta|karte)\b"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|fax|mobile|t.l.phone|tel.fono|telefon|handy)\b"),
}
_COUNTER_CUES = re.compile(r"(?i)\b(version|isbn|issn|order|invoice|item|no|id|ref|serial|rfc|chapter|section|page)\b\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((0, start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """What each labeler says of a span: 1 personal data, -1 not, 0 nothing."""
    name, span = KINDS[kind], text[start:end]
    digits, before = _digits(span), text[max(0, start - 40) : start]
    if name == "email":
        tail = re.split(r"[.\])\s]+", span.rstrip(" )]"))[-1].lower()
        structure, known = (1 if len(span) <= 254 else -1), (1 if tail in _DOMAINS else -1)
    elif name == "ip":
        structure = 1
        known = 0 if ":" in span else (-1 if span.split(".")[0].lstrip("0") in ("", "127") else 1)
    elif name == "card":
        structure, known = (1 if luhn(digits) and 13 <= len(digits) <= 19 else -1), (1 if digits.startswith(_CARD_HEADS) else -1)
    else:
        structure = 1 if 8 <= len(digits) <= 15 else -1
        known = (1 if digits.removeprefix("00").startswith(_COUNTRIES) else -1) if span[0] in "+0" else 0
    context = 1 if _CUES[name].search(before) else (-1 if _COUNTER_CUES.search(before) else 0)
    edges = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    around = -1 if any(c.isalnum() or c in "_/=" for c in edges) else 1
    return [1 if base else 0, structure, known, context, around]


def pattern(kind: int, cast: list[int]) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v + 1
    return code


def unpack(code: int) -> tuple[int, list[int]]:
    cast = []
    for _ in range(5):
        code, v = divmod(code, 3)
        cast.append(v - 1)
    return code, cast[::-1]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column(1))
        # without @, digit or bracketed "at" there is nothing to find
        mark = np.zeros(256, bool)
        mark[[ord("@"), ord("["), ord("("), *range(0x30, 0x3A)]] = True
        marks = np.concatenate([[0], np.cumsum(mark[data])])
        raw = memoryview(data)
        rows: dict[str, list] = {"base": [], "more": []}
        for d in range(len(offsets) - 1):
            a, b = int(offsets[d]), int(offsets[d + 1])
            base: list = []
            more: list = []
            if marks[b] > marks[a]:
                text = bytes(raw[a:b]).decode()
                base = base_spans(text)
                taken = sorted((s, e) for _, s, e in base)
                begins, reach = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
                more = [(k, s, e, pattern(k, votes(text, k, s, e, True))) for k, s, e in base]
                for kind, name in enumerate(KINDS):
                    for m in _LOOSE[name].finditer(text):
                        before = bisect.bisect_left(begins, m.end())  # spans that begin before it ends
                        if not before or reach[before - 1] <= m.start():
                            more.append((kind, m.start(), m.end(), pattern(kind, votes(text, kind, m.start(), m.end(), False))))
            rows["base"].append([x for s in base for x in s])
            rows["more"].append([x for s in more for x in s])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[k], pa.list_(pa.int64())) for k in rows]], ["doc_id", "base", "more"])


class SpanClassifier:
    """EM over vote patterns, then logistic regression on votes and kind."""

    def __init__(self, counts: dict[int, int]):
        self.table: dict[int, float] = {}
        if not counts:
            return
        codes = sorted(counts)
        weight = np.array([counts[c] for c in codes], float)
        kinds = np.array([unpack(c)[0] for c in codes])
        cast = np.array([unpack(c)[1] for c in codes])
        belief = np.clip(0.5 + 0.15 * cast.sum(1), 0.05, 0.95)
        for _ in range(ROUNDS):
            # reliabilities: how often each labeler casts each vote, by true class
            like = np.zeros((2, len(codes)))
            for side, part in enumerate((weight * (1 - belief), weight * belief)):
                for kind in range(len(KINDS)):
                    own = kinds == kind
                    like[side, own] += np.log(part[own].sum() + 1)
                for labeler in range(cast.shape[1]):
                    for vote in (-1, 0, 1):
                        own = cast[:, labeler] == vote
                        like[side, own] += np.log((part[own].sum() + 1) / (part.sum() + 3))
            belief = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        self.labels = dict(zip(codes, belief.tolist()))
        features = self._features(kinds, cast)
        self.weights = np.zeros(features.shape[1])
        for _ in range(30):  # Newton steps on soft labels
            p = 1 / (1 + np.exp(-features @ self.weights))
            gradient = features.T @ (weight * (belief - p)) - self.weights
            curve = (features * (weight * p * (1 - p))[:, None]).T @ features + np.eye(len(self.weights))
            self.weights += np.linalg.solve(curve, gradient)
        p = 1 / (1 + np.exp(-features @ self.weights))
        self.table = dict(zip(codes, p.tolist()))

    @staticmethod
    def _features(kinds: np.ndarray, cast: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(kinds)), *[kinds == k for k in range(1, len(KINDS))]]
        columns += [cast[:, j] == v for j in range(cast.shape[1]) for v in (-1, 1)]
        return np.stack(columns, 1).astype(float)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base spans by kind (n_*), the digest of their list, and all spans."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(source.mapInArrow(_found, "doc_id long, base array<long>, more array<long>"), f"{folder}/candidates")
    codes = F.expr("transform(sequence(3, size(more) - 1, 4), i -> more[i])")
    counted = found.filter(F.size("more") > 0).select(F.explode(codes).alias("code")).groupBy("code").count()
    # at most 4 kinds * 3**5 votes
    model = SpanClassifier({r["code"]: r["count"] for r in counted.collect()})
    accepted = frozenset(c for c, p in model.table.items() if p >= threshold)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                known = set(own)
                spans, end = list(own), -1
                for k, s, e, code in sorted((tuple(more[i : i + 4]) for i in range(0, len(more), 4)), key=lambda x: (x[1], x[0])):
                    if code in accepted and (k, s, e) not in known and s >= end:
                        spans.append((k, s, e))
                        end = e
                for kind in range(len(KINDS)):
                    out[kind].append(sum(k == kind for k, _, _ in own))
                out[4].append(hashlib.sha256(_listed(own).encode()).hexdigest())
                out[5].append(_listed(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], [x.split()[0] for x in _SCHEMA.split(", ")])

    return found.mapInArrow(rows, _SCHEMA)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
