"""Mixing documents to target weights of domains, with soft membership.

A naive Bayes classifier over hashed words, trained on a labelled table, gives every document its
domain posteriors. Distributed projected-gradient least squares then fits a nonnegative rate per
document, such that the expected domain token totals ``sum(rate * tokens * posterior)`` match the
targets. It starts from rate 1, so documents change no more than the targets ask for.

Only the totals of the domains (a handful of numbers) reach the driver in each step; a rate is a
function of the document's posteriors and of the steps so far, so no step writes or shuffles rows.
All expressions are DataFrame functions and ``pyspark.ml`` transformers, without Python workers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablechange.session import discard, materialize

MAX_TRAIN, FEATURES = 5_000, 1 << 14


@dataclass
class DomainModel:
    """Domains in the order of the posteriors, and the fitted classifier (None: nothing to learn from)."""

    domains: list[str]
    classifier: PipelineModel | None


def words(text: Column) -> Column:
    """The lower-cased words of a text, split at white space."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")


def labelled_sample(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` for at most ``max_train`` ids of ``labelled`` (those with the smallest hash).

    The ids are chosen and written before any text is touched, so the join broadcasts a set of bounded
    size and texts are not shuffled. Null ids are left out.
    """
    ids = labelled.select(F.col(id_col).alias("__id")).dropna().distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    ids = materialize(ids, "labelled")
    return docs.join(ids, docs[id_col] == ids["__id"], "left_semi")


def train_domains(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain", features: int = FEATURES) -> DomainModel:
    """A classifier of ``domains`` from a labelled table, bounded as by ``labelled_sample``. Rows with null
    text or with a domain not asked for are left out. Without any row left, every document belongs to
    all domains alike."""
    place = F.array_position(F.array(*map(F.lit, domains)), F.col(domain_col)) - 1
    rows = labelled.filter(F.col(domain_col).isin(domains) & F.col(text_col).isNotNull())
    sample = materialize(rows.select(words(F.col(text_col)).alias("__words"), place.cast("double").alias("__label")), "labelled")
    # The classifier counts classes up to the largest label it meets, so each domain gets one empty row.
    empty = sample.sparkSession.range(len(domains)).select(F.array().cast("array<string>").alias("__words"), F.col("id").cast("double").alias("__label"))
    if sample.isEmpty():
        return DomainModel(domains, None)
    hashing = HashingTF(inputCol="__words", outputCol="__features", numFeatures=features)
    bayes = NaiveBayes(featuresCol="__features", labelCol="__label", probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw")
    model = bayes.fit(hashing.transform(sample.union(empty)))
    discard(sample)
    return DomainModel(domains, PipelineModel([hashing, model]))


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` (words of the whole text) and ``__posterior`` (array of doubles)."""
    rows = docs.withColumn("__words", words(F.col(text_col))).withColumn("__tokens", F.size("__words").cast("double"))
    if model.classifier is None:
        even = F.array(*[F.lit(1.0 / len(model.domains)) for _ in model.domains])
        return rows.withColumn("__posterior", even).drop("__words")
    found = model.classifier.transform(rows).withColumn("__posterior", vector_to_array("__probability"))
    return found.drop("__words", "__features", "__raw", "__probability", "__prediction")


def _rate(steps: list[list[float]]) -> Column:
    """The rate of a document after the steps: each moves it against the gradient and projects it to
    zero or more."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def step(r, g):
        move = F.aggregate(F.zip_with(F.col("__posterior"), g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), r - move)

    return F.aggregate(moves, rate, step)


def fit_steps(posteriors: DataFrame, model: DomainModel, targets: dict[str, float], tolerance: float = 1e-4, max_steps: int = 60) -> list[list[float]]:
    """The gradient steps that bring the expected domain shares to ``targets`` (scaled to sum 1; the
    token total is that of the input). ``posteriors`` must be written, as each step reads it.

    It ends when every share is within ``tolerance`` of its target, when a step gains no more (targets
    out of reach, such as a domain without documents), or after ``max_steps``.
    """
    total = sum(targets.values())
    want = [targets[d] / total for d in model.domains]
    size = len(want)

    def shares(steps: list[list[float]]) -> tuple[float, list[float]]:
        weight = F.col("__tokens") * _rate(steps)
        sums = [F.sum(weight * F.col("__posterior")[k]) for k in range(size)]
        row = posteriors.agg(F.sum("__tokens"), *sums).first()
        tokens = row[0] or 0.0
        return tokens, [(x or 0.0) / tokens if tokens else 0.0 for x in row[1:]]

    tokens, start = shares([])
    if not tokens:
        return []
    steps: list[list[float]] = []
    now, best = start, float("inf")
    # Residuals count relative to the domain's mass at rate 1; the step length is then near the
    # inverse of the curvature, whatever the number of domains.
    mass = [max(x, 1e-9) for x in start]
    while len(steps) < max_steps:
        off = [a - b for a, b in zip(now, want)]
        error = sum(o * o / m for o, m in zip(off, mass))
        if max(map(abs, off)) <= tolerance or error > 0.9999 * best:
            break
        best = error
        steps.append([o / m for o, m in zip(off, mass)])
        _, now = shares(steps)
    return steps


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``(id, tokens, domain, posterior, rate)`` per row of ``docs``; ``domain`` is the likeliest.

    Null and empty texts have no tokens and weigh nothing; they get the rate of their posteriors all
    the same. Repeated rows get equal rates. Of domains equally likely the first one of ``targets``
    is named. An empty table gives no rows; other columns are ignored.
    """
    model = train_domains(labelled, list(targets), text_col, domain_col)
    rows = with_posteriors(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text")
    written = materialize(rows.select("__id", "__tokens", "__posterior"), "posteriors")
    steps = fit_steps(written, model, targets)
    names = F.array(*map(F.lit, model.domains))
    likeliest = F.element_at(names, F.array_position("__posterior", F.array_max("__posterior")).cast("int"))
    return written.select(
        F.col("__id").alias(id_col), F.col("__tokens").cast("long").alias("tokens"), likeliest.alias("domain"),
        F.col("__posterior").alias("posterior"), _rate(steps).alias("rate"),
    )


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``docs`` resampled by its rates: a row comes as often as the whole part of its rate says, and
    once more if a hash of its id (of its text, where the id is null) falls below the rest.

    Same rows, columns and order of columns as ``docs``; the same input always gives the same result.
    """
    model = train_domains(labelled, list(targets), text_col, domain_col)
    rows = with_posteriors(docs, model, text_col)
    written = materialize(rows.select("__tokens", "__posterior"), "posteriors")
    steps = fit_steps(written, model, targets)
    discard(written)
    coin = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 32)) / float(1 << 32)
    rated = rows.withColumn("__rate", _rate(steps))
    copies = (F.floor("__rate") + F.when(coin < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("int")
    out = rated.withColumn("__copies", copies).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
