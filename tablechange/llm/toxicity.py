"""Toxicity by weak supervision.

Lexicon entries (words and word beginnings) are mined from a bounded sample of labelled rows and
dealt to many lexicon voters; pattern voters look at shouting and punctuation. A generative label
model estimates by EM how often each voter fires on either class, and by how much voters repeat
each other given the class; repeated votes count less. A linear classifier is trained on the
model's posterior labels and scores every whole text.

Bounds: at most ``max_train`` labelled rows (those with the smallest hash of their id) are looked
at for training, and at most ``max_terms`` lexicon entries are kept; only ids of entries, counts and
votes of that sample reach the driver. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablechange.session import discard, materialize

MAX_TRAIN, MAX_TERMS, VOTERS = 20_000, 4096, 24
PREFIXES = (4, 5)
PATTERNS = 4
_WORD = re.compile(r"\w+")
_LOUD = re.compile(r"\b[A-Z]{4,}\b")
_MARKS = re.compile(r"[!?]{2,}")
_MASKED = re.compile(r"\w[*@#$]+\w")


def terms_of(text: str) -> set[str]:
    """The distinct words of a text and their beginnings, each marked with its kind."""
    words = set(_WORD.findall(text.lower()))
    out = {"w" + w for w in words}
    for n in PREFIXES:
        out |= {f"{n}{w[:n]}" for w in words if len(w) > n}
    return out


def patterns_of(text: str) -> list[int]:
    """Which pattern voters fire: shouting, many marks, masked letters, a second person with marks."""
    words = 1 + text.count(" ")
    loud, marks, masked = len(_LOUD.findall(text)), len(_MARKS.findall(text)), len(_MASKED.findall(text))
    fires = (loud * 50 > words, marks * 100 > words, masked * 200 > words, marks > 0 and " you " in text.lower())
    return [i for i, x in enumerate(fires) if x]


@dataclass
class LabelModel:
    """A mixture of two classes over binary votes. ``on[c, j]``: how often voter j fires on class c;
    ``share[j]``: the weight of its vote after what other voters repeat of it."""

    prior: float
    on: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 25, trust: float = 0.95) -> LabelModel:
        """EM over ``votes`` (rows by voters, 0 or 1). ``start`` holds the labels known for the rows;
        they are one more voter, right with probability ``trust``."""
        rows = max(1, len(votes))
        q = np.clip(start, 1 - trust, trust)
        known = np.log(q / (1 - q))
        for _ in range(rounds):
            prior = float(np.clip(q.mean() if len(q) else 0.5, 1 / (rows + 2), 1 - 1 / (rows + 2)))
            weights = np.stack([1 - q, q])
            on = (weights @ votes + 0.5) / (weights.sum(1, keepdims=True) + 5)
            left = votes - (1 - q)[:, None] * on[0] - q[:, None] * on[1]
            spread = np.sqrt((left**2).mean(0) + 1e-9) if len(votes) else np.ones(votes.shape[1])
            related = np.abs((left / spread).T @ (left / spread)) / rows
            np.fill_diagonal(related, 1.0)
            related[related < 3 / math.sqrt(rows)] = 0
            np.fill_diagonal(related, 1.0)
            model = cls(prior, on, 1 / related.sum(1))
            odds = model.log_odds(votes) + known
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return model

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.on[1] / self.on[0])
        silent = np.log((1 - self.on[1]) / (1 - self.on[0]))
        return math.log(self.prior / (1 - self.prior)) + (votes * fired + (1 - votes) * silent) @ self.share


@dataclass
class ToxicityModel:
    """A linear classifier over lexicon entries and patterns."""

    weights: dict[str, float]
    patterns: list[float]
    bias: float

    def score(self, text: str | None) -> float:
        text = text or ""
        z = self.bias + sum(self.patterns[i] for i in patterns_of(text))
        if self.weights:
            words = set(_WORD.findall(text.lower()))
            for n, known in self._by_kind().items():
                for w in known & ({"w" + w for w in words} if n == "w" else {n + w[: int(n)] for w in words if len(w) > int(n)}):
                    z += self.weights[w]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def _by_kind(self) -> dict[str, set[str]]:
        if not hasattr(self, "_kinds"):
            self._kinds = {}
            for t in self.weights:
                self._kinds.setdefault(t[0], set()).add(t)
        return self._kinds


def _mined(total: np.ndarray, toxic: np.ndarray, rate: float, tried: int, false_share: float = 0.05) -> np.ndarray:
    """Evidence that an entry marks toxic rows; minus infinity where it may be chance.

    The evidence is the divergence of the entry's toxic share from the rate of all rows, times its
    rows; its negative exponential bounds the chance of such a share. Of the entries kept about
    ``false_share`` may be chance finds (step-up rule over all entries tried).
    """
    share = np.clip(toxic / total, 1e-9, 1 - 1e-9)
    evidence = total * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    evidence = np.where(share > max(0.5, 2 * rate), evidence, 0.0)
    ordered = -np.sort(-evidence)
    passes = np.flatnonzero(-ordered <= np.log(np.arange(1, len(ordered) + 1) * false_share / max(1, tried)))
    least = ordered[passes[-1]] if len(passes) else np.inf
    return np.where(evidence >= least, evidence, -np.inf)


def _logistic(rows: list[np.ndarray], size: int, target: np.ndarray, decay: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic regression on 0/1 features, by Adam."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not len(rows):
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.concatenate(rows).astype(np.int64) if len(at) else np.empty(0, np.int64)
    base = np.clip(target.mean(), 1e-4, 1 - 1e-4)
    w[-1] = math.log(base / (1 - base))
    for k in range(1, rounds + 1):
        z = np.bincount(at, w[of], len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(of, error[at], size), error.sum()) / len(rows)
        g[:-1] += decay * w[:-1] / math.sqrt(len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS,
) -> ToxicityModel:
    """A model from the labelled rows. Rows of ``labels`` without id or label are left out; several
    labels of an id count as their mean. Without labelled rows every score is one half."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__y")).dropna()
    known = known.groupBy("__id").agg(F.avg("__y").alias("__y"))
    chosen = materialize(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    labelled = materialize(texts.join(chosen, "__id"), "sample")
    if labelled.isEmpty():
        return ToxicityModel({}, [0.0] * PATTERNS, 0.0)
    model = _fit(labelled, max_terms)
    for df in (chosen, labelled):
        discard(df)
    return model


def _fit(sample: DataFrame, max_terms: int) -> ToxicityModel:
    """A model from ``(__id, __text, __y)``."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(terms_of(text))
                if len(total) > 500_000:
                    yield from _counts(total)
                    total = Counter()
        yield from _counts(total)

    toxic = sample.filter("__y > 0.5").select("__text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequent = materialize(toxic, "terms")
    tried = frequent.count()
    # Entries of at least two toxic rows; their number is bounded by the sample.
    candidates = {r["term"]: i for i, r in enumerate(frequent.filter("n >= 2").orderBy(F.desc("n"), "term").limit(50 * max_terms).toLocalIterator())}
    given = sample.sparkSession.sparkContext.broadcast(candidates)

    def present(batches):
        at = given.value
        for b in batches:
            found, fires = [], []
            for text in b.column(1):
                found.append(sorted(at[t] for t in terms_of(text.as_py()) if t in at))
                fires.append(patterns_of(text.as_py()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (found, fires)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], names=["id", "y", "terms", "fires"])

    facts = materialize(sample.select("__id", "__text", "__y").mapInArrow(present, "id long, y double, terms array<int>, fires array<int>"), "facts")
    # Evidence per entry is counted by Spark, so that only kept entries of each row reach the driver.
    counted = facts.select(F.explode("terms").alias("t"), "y").groupBy("t").agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0.5, 1).otherwise(0)).alias("k")).orderBy("t").collect()
    ids = np.array([r["t"] for r in counted], np.int64)
    rate = facts.agg(F.avg(F.when(F.col("y") > 0.5, 1.0).otherwise(0.0))).first()[0]
    evidence = _mined(np.array([r["n"] for r in counted], float), np.array([r["k"] for r in counted], float), min(max(rate, 1e-6), 1 - 1e-6), tried) if len(ids) else np.empty(0)
    order = np.lexsort((ids, -evidence))
    kept = [int(ids[i]) for i in order[:max_terms] if np.isfinite(evidence[i])]
    slot = {t: i for i, t in enumerate(kept)}
    wanted = F.array(*[F.lit(t) for t in kept]) if kept else F.array().cast("array<int>")
    data = facts.select("id", "y", F.array_intersect("terms", wanted).alias("terms"), "fires").orderBy("id").collect()
    for df in (frequent, facts):
        discard(df)
    names = {i: t for t, i in candidates.items()}
    y = np.array([r["y"] for r in data], float)
    features = [np.array([slot[t] for t in r["terms"]] + [len(kept) + p for p in r["fires"]], np.int64) for r in data]
    votes = np.zeros((len(data), VOTERS + PATTERNS))
    voter = np.array([zlib.crc32(names[t].encode()) % VOTERS for t in kept] + [VOTERS + p for p in range(PATTERNS)], np.int64)
    for i, f in enumerate(features):
        votes[i, voter[f]] = 1
    model, trusted = LabelModel.fit(votes, y), np.clip(y, 0.05, 0.95)
    posterior = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + np.log(trusted / (1 - trusted)), -30, 30)))
    w = _logistic(features, len(kept) + PATTERNS, posterior)
    return ToxicityModel({names[t]: float(w[i]) for i, t in enumerate(kept)}, [float(x) for x in w[len(kept) : -1]], float(w[-1]))


def _counts(total: Counter) -> Iterator[pa.RecordBatch]:
    terms = list(total)
    for at in range(0, len(terms), 20_000):
        part = terms[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[t] for t in part], pa.int64())], names=["term", "n"])


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep_columns: bool = False
) -> DataFrame:
    """``(id, score, predicted)`` for every row of ``docs``, repeated rows and null ids included; with
    ``keep_columns`` all columns of ``docs`` with ``__score`` and ``__predicted``.

    Only the text enters the score; null texts count as empty and get a score too. An empty table
    gives no rows.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        # one text at a time leaves memory bounded whatever the length
        return pa.array([given.value.score(t.as_py()) for t in texts], pa.float64())

    # only the text goes to Python, and only the score comes back
    kept = docs if keep_columns else docs.select(F.col(id_col), F.col(text_col))
    scored = kept.withColumn("__score", score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    scored = scored.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))
    return scored if keep_columns else scored.select(F.col(id_col), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
