"""Personal data: base formats, and more spans chosen by boosted trees.

Base spans follow fixed formats and always stay. Beyond them, generators with high recall propose
overlapping candidates: telephone numbers without a country code, identity numbers, mail addresses
written oddly, and secrets. Boosted trees score a candidate by its format and its context. They are
trained on candidates that a strict rule can label; their scores are calibrated on candidates kept
out of training, and a threshold per kind is set there for the precision asked for. Chosen spans
that overlap a base span, or a chosen one with a higher score, go.

The rules do not look at whether a base span was found, nor do the features: what is learned holds
outside base spans. Training looks at all documents, each text once, and takes of their labelled
candidates ``max_candidates`` in all, the same number of each kind, those with the smallest hashes;
scoring covers all rows in one pass without a shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablechange.llm.boosting import BoostedTrees, platt
from tablechange.session import discard, materialize

MAX_CANDIDATES, PRECISION, ENOUGH = 30_000, 0.95, 10
BASE = ("email", "ip", "card", "phone")
ADDED = ("odd_email", "local_phone", "id_number", "secret")
KINDS = BASE + ADDED
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The check behind the first digit keeps long runs of digits linear: a match starts where its run does.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[(0-9](?<![0-9][0-9])[0-9]*+(?:[ ().-]{0,3}+[0-9]++)*+")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/")
_ASSIGNED = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9_\-+/]{8,}+)""")
_AT = re.compile(r"[@\[(]\s{0,2}(?:at\s{0,2}[\])])?\s{0,2}([A-Za-z0-9-]+)(?:\s{0,2}(?:\.|[\[(]\s{0,2}dot\s{0,2}[\])])\s{0,2}([A-Za-z0-9-]+))+", re.I)
_WORDS = re.compile(r"\s{1,2}at\s{1,2}[A-Za-z0-9-]+(?:\s{1,2}dot\s{1,2}[A-Za-z0-9-]+)+", re.I)
_SPELLED = re.compile(r"[\[(]\s{0,2}at\s{0,2}[\])]", re.I)
_ENDING = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z]{2,24}$")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{1,4}(?![a-z])){3,10}")
_ID_CUE = re.compile(r"(?:ssn|social security|passport|account|acct|iban|tax id|national id|licen[cs]e)(?:\s(?:number|no|nr))?[\s.:#]{0,3}$", re.I)
_CUE = re.compile(r"(?:pass(?:word|wd)?|pwd|secret|token|api[_ -]?key|key|auth|bearer)[\s\"']{0,3}[=:]?[\s\"']{0,3}$", re.I)
_CALL = re.compile(r"(?:phone|tel|call|fax|mobile|ssn|passport|account|iban|id|no)[\s.:#]{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether this is an account number with right check digits, spaces and hyphens aside."""
    body = text.replace(" ", "").replace("-", "")
    if not 15 <= len(body) <= 34 or not body.isascii() or not body.isalnum() or not (body[:2].isalpha() and body[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed formats, ordered by start, then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        m, start = _DOMAIN.match(text, at + 1), at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap, also with base spans."""
    found: set[Span] = set()
    for m in _ASSIGNED.finditer(text):
        found.add(("secret", *m.span(1)))
    marked = "@" in text or _SPELLED.search(text)
    for pattern in (_AT, _WORDS) if marked else (_WORDS,):
        for m in pattern.finditer(text):
            start = m.start()
            while start and text[start - 1] == " ":
                start -= 1
            end = start
            while start and text[start - 1] in _LOCAL:
                start -= 1
            if start < end:
                found.add(("odd_email", start, m.end()))
    done = 0
    for d in _DIGIT.finditer(text):
        if d.start() < done:
            continue
        start, done = d.start(), d.end()
        while start and text[start - 1] in _TOKEN:
            start -= 1
        while done < len(text) and text[done] in _TOKEN:
            done += 1
        if done - start >= 12 and not text[start:done].isdigit():
            found.add(("secret", start, done))
    if done:
        for m in _IBAN.finditer(text):
            # words in capitals may follow: the longest part that ends with a word and has right check digits
            stops = [e for e in range(m.end(), m.start() + 14, -1) if not text[e - 1 : e + 1].isalnum() or e == len(text)]
            stops = [e for e in stops if text[e - 1].isalnum()]
            if stops:
                found.add(("id_number", m.start(), next((e for e in stops if iban(text[m.start() : e])), stops[0])))
        for m in _NUMBERS.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15 and n < m.end() - m.start():
                found.add(("local_phone", *m.span()))
            if 8 <= n <= 34:
                found.add(("id_number", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def features(text: str, span: Span, base: list[Span]) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 4]
    digits = "".join(c for c in body if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in body)
    counts = Counter(body).values()
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return [
        float(ADDED.index(kind)), len(body), len(digits), letters / len(body), (len(body) - letters - len(digits)) / len(body), entropy, switches / len(body),
        float(bool(digits) and luhn(digits)), float(body.count(".")), float("@" in body), float(sum(c.isupper() for c in body)),
        float(bool(_CUE.search(before))), float(bool(_CALL.search(before))), float(before[-1:] in "=:\"'" if before else 0), float(before[-1:] == "+"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in "\"'" if after else 0), float(iban(body)), float(bool(_ID_CUE.search(text[max(0, start - 32) : start]))),
        float(_spelled(body)), float(bool(_ENDING.search(body))), float(len(set(digits))),
    ]


def _spelled(body: str) -> bool:
    return bool(_SPELLED.search(body) or _WORDS.search(body))


def weak_label(text: str, span: Span, base: list[Span]) -> int | None:
    """What a strict rule says of a candidate: 1 personal, 0 not, None if it can't tell."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - 24) : start]
    n = sum("0" <= c <= "9" for c in body)
    inside = any(s < end and start < e for k, s, e in base)
    if kind == "secret":
        varied = n >= 2 and len(set(body)) >= 6
        if _CUE.search(before):
            return int(varied)
        return 0 if not n or inside or iban(body) else None
    if kind == "odd_email":
        if _spelled(body) or "@" in body and " " not in body:
            return int(bool(_ENDING.search(body)))
        return None if "@" in body else 0
    digits = "".join(c for c in body if "0" <= c <= "9")
    if kind == "id_number":
        if body[:1].isalpha():
            return int(iban(body))
        if start and text[start - 1].isalpha():
            return None  # behind letters, as in the middle of an account number
        if _ID_CUE.search(text[max(0, start - 32) : start]) or 14 <= n <= 19 and luhn(digits):
            return int(len(set(digits)) > 3)
        if n >= 13 or len(set(digits)) <= 3:
            return 0
        return 0 if any(k in ("email", "ip") and s < end and start < e for k, s, e in base) else None
    if inside:
        return 1 if any(k in ("phone", "card") and s <= start and end <= e for k, s, e in base) else 0
    if n >= 13 and not luhn(digits):
        return 0
    return 1 if _CALL.search(before) else None


@dataclass
class PiiModel:
    """Trees, the calibration of their margins, and the least calibrated score per added kind."""

    trees: BoostedTrees = field(default_factory=BoostedTrees)
    scale: tuple[float, float] = (1.0, 0.0)
    least: dict[str, float] = field(default_factory=dict)

    def score(self, row: list[float]) -> float:
        z = self.scale[0] * self.trees.margin(row) + self.scale[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        scored = []
        for span in candidates(text):
            least = self.least.get(span[0])
            if least is not None and (p := self.score(features(text, span, base))) >= least:
                scored.append((-p, span[1], -span[2], span))
        # Spans taken so far are marked by character, so a text with many candidates stays linear.
        taken = bytearray(len(text)) if scored else b""
        for _, s, e in base if scored else ():
            taken[s:e] = b"\1" * (e - s)
        out = []
        for *_, span in sorted(scored):
            if not any(taken[span[1] : span[2]]):
                taken[span[1] : span[2]] = b"\1" * (span[2] - span[1])
                out.append(span)
        return out


def fit_pii(rows: list[tuple[str, list[float], int, bool]], precision: float = PRECISION) -> PiiModel:
    """A model from ``(kind, features, label, held out)``. A kind without positive rows among those held
    out, or with positive rows only and fewer than ``ENOUGH``, gets no threshold and adds nothing."""
    fit, test = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    if not fit:
        return PiiModel()
    trees = BoostedTrees.fit(np.array([r[1] for r in fit]).reshape(len(fit), -1), np.array([r[2] for r in fit], float))
    margins, y = np.array([trees.margin(r[1]) for r in test]), np.array([r[2] for r in test], float)
    model = PiiModel(trees, platt(margins, y))
    for kind in ADDED:
        scored = sorted(((model.score(r[1]), r[2]) for r in test if r[0] == kind), reverse=True)
        positive = sum(label for _, label in scored)
        if not positive:
            continue
        if positive == len(scored):
            # nothing to be precise against: the calibration over all kinds decides
            if positive >= ENOUGH:
                model.least[kind] = 0.9
            continue
        hits = 0
        for k, (p, label) in enumerate(scored, 1):
            hits += label
            if hits / k >= precision and (k == len(scored) or scored[k][0] < p):
                model.least[kind] = max(p, 0.5)
    return model


def train_pii(docs: DataFrame, text_col: str = "text", max_candidates: int = MAX_CANDIDATES, precision: float = PRECISION) -> PiiModel:
    """A model trained on weakly labelled candidates of all ``docs``; equal texts count once."""
    texts = docs.select(F.col(text_col).cast("string").alias("__text")).dropna()
    most = max(1, max_candidates // len(ADDED))

    def run(batches):
        # The smallest hashes of each kind, largest first. What a task drops can't be among the smallest of all tasks.
        heaps: dict[str, list[tuple]] = {kind: [] for kind in ADDED}
        kept: set[tuple[str, int]] = set()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                base, digest = None, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                for span in candidates(text):
                    kind, heap = span[0], heaps[span[0]]
                    h = xxhash.xxh64_intdigest(f"{kind} {span[1]} {span[2]}".encode(), digest) >> 1
                    if (kind, h) in kept or len(heap) == most and -heap[0][0] <= h:
                        continue
                    base = base_spans(text) if base is None else base
                    label = weak_label(text, span, base)
                    if label is not None:
                        kept.add((kind, h))
                        row = (-h, label, features(text, span, base))
                        if len(heap) < most:
                            heapq.heappush(heap, row)
                        else:
                            kept.discard((kind, -heapq.heapreplace(heap, row)[0]))
        for kind, heap in heaps.items():
            for at in range(0, len(heap), 1024):
                h, labels, rows = zip(*heap[at : at + 1024])
                columns = [pa.array([kind] * len(h)), pa.array([-x for x in h], pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "h", "features", "label"])

    found = materialize(texts.mapInArrow(run, "kind string, h long, features array<double>, label int"), "candidates")
    rows = []
    for kind in ADDED:
        some = found.filter(F.col("kind") == kind).dropDuplicates(["h"]).orderBy("h").limit(most).collect()
        rows += [(kind, list(r["features"]), r["label"], r["h"] % 3 == 0) for r in some]
    discard(found)
    return fit_pii(rows, precision)


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, added)`` per row of ``docs``: arrays of ``(kind, start, end)`` in code points of the
    whole text, end exclusive, ordered by start, then kind.

    Null and empty texts have no spans. Repeated rows and null ids are kept; an empty table gives no
    rows; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema[0], T.StructField("base", span), T.StructField("added", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        names = ("kind", "start", "end")
        for b in batches:
            base, added = [], []
            for t in b.column(1):
                text = t.as_py()
                one = base_spans(text)
                more = sorted(given.value.added(text, one), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                base.append([dict(zip(names, s)) for s in one])
                added.append([dict(zip(names, s)) for s in more])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, arrow), pa.array(added, arrow)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])
