"""URL filter by explicit rules and by association rules mined from labels.

Explicit rules name a host and a path beginning; the longest fitting one decides. Other URLs are
judged by rules of the form "these URL tokens together: block", mined by Spark's FP-growth from
labelled pages and pruned by support and confidence. Mined rules are looked up by an inverted index:
each rule stands under its rarest token, and the other tokens of a rule found are then verified.

Numbers in a URL become one token, so that many pages share a basket of tokens; the rules are
matched once per distinct basket. Tokens that stand in the same labelled rows say the same: they
are one *class* under its first token, so a long URL that no other resembles is one item to the miner
and not all subsets of its tokens. On wish rules that may be chance are pruned by a test over all
combinations tried. Everything is DataFrame functions and ``pyspark.ml``.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tablechange.llm.exact_dedup import LOWER, UPPER
from tablechange.operators.sequence import number_rows
from tablechange.session import discard, materialize

MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS, FALSE_SHARE = 0.002, 0.6, 0, 0.05
_BAD = "=block"


def host_of(url: Column) -> Column:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for null or where there is no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_name(host: str, path: str) -> str:
    return host + path


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest of ``(verdict, host, path)`` rules that fits, or nulls. A rule
    fits its host and all subdomains, if the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(rule_name(r[1], r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in order: scheme, each part of the host name, words of parts with
    hyphens, path segments, names of query fields, presence of a fragment. Digits become ``0``."""
    host, path = host_of(url), path_of(url)
    query, rest = F.regexp_extract(url, r"\?([^#]*)", 1), F.coalesce(url, F.lit(""))

    def marked(kind: str, parts: Column) -> Column:
        parts = F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "0"))
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    every = F.concat(
        marked("scheme:", F.array(F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        marked("part:", F.split(host, r"\.")),
        marked("word:", F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda p: p.contains("-")), lambda p: F.split(p, "-")))),
        marked("path:", F.split(path, "/")), marked("query:", F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        F.when(rest.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(every))


def token_classes(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """``(token, head)``: tokens that stand in the same rows with a label share ``head``, the first of them by name.
    Two sums over hashes of the rows, 128 bits, tell whether rows are the same."""
    rows = labelled.filter(F.col(bad_col).isNotNull()).select(url_tokens(F.col(url_col)).alias("__tokens")).distinct()
    rows = rows.select("__tokens", F.xxhash64("__tokens").alias("__x"), F.xxhash64(F.lit("second"), "__tokens").alias("__y"))
    held = rows.select(F.explode("__tokens").alias("token"), "__x", "__y")
    marks = held.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("__x").alias("x"), F.bit_xor("__y").alias("y"))
    heads = marks.groupBy("n", "x", "y").agg(F.min("token").alias("head"))
    return marks.join(heads, ["n", "x", "y"]).select("token", "head")


def _heads(baskets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(__tokens, heads)`` per distinct basket with tokens that have a class."""
    each = baskets.select("__tokens").distinct().select("__tokens", F.explode("__tokens").alias("token"))
    return each.join(classes, "token").groupBy("__tokens").agg(F.array_sort(F.collect_set("head")).alias("heads"))


def mine_rules(
    labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS, false_share: float | None = None, classes: DataFrame | None = None,
) -> DataFrame:
    """``(items, confidence, support)``: combinations of token classes (``token_classes``) that mark blocked URLs.

    Rows with a null label are left out. A combination stays if it holds together with the block
    label in at least ``min_support`` of the rows, whatever their number, and the label follows in at
    least ``min_confidence`` of its rows; it goes if a part of it is already as confident. A caller may
    ask for ``min_rows`` rows besides; by default none are. No rows give no rules.

    With ``false_share`` combinations go that may be chance: a one-sided test asks how likely so high a
    share of blocked rows is under the rate of all rows, and a step-up rule over all combinations
    tried keeps those of which at most about this share is chance. So few rows that even a single
    test could not tell are then not mined, which changes no result.
    """
    bad = F.col(bad_col).cast("boolean")
    classes = token_classes(labelled, url_col, bad_col) if classes is None else classes
    rows = materialize(labelled.filter(bad.isNotNull()).select(url_tokens(F.col(url_col)).alias("__tokens"), bad.alias("__bad")), "labelled")
    heads = F.coalesce("heads", F.array().cast("array<string>"))
    baskets = rows.join(_heads(rows, classes), "__tokens", "left").select(F.concat(heads, F.when(F.col("__bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialize(baskets, "baskets")
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("__bad").cast("long")), F.lit(0))).first()
    rate = blocked / max(1, n)
    if false_share is not None and 0 < rate < 1:
        min_rows = max(min_rows, math.ceil(math.log(false_share) / math.log(rate)))
    support = min(1.0, max(min_support, min_rows / max(1, n)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.element_at("consequent", 1) == _BAD).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    found = materialize(found, "rules")
    if false_share is not None:
        tried = model.freqItemsets.filter(~F.array_contains("items", _BAD)).count()
        found = _by_test(found, n, rate, tried, false_share)
    # Parts of a rule are met by leaving out one token at a time: by support they are frequent too.
    smaller = found.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    parts = found.select("items", "confidence", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
    beaten = parts.join(smaller, "part").filter(F.col("sure") >= F.col("confidence")).select("items").distinct()
    kept = materialize(found.join(beaten, "items", "left_anti"), "kept")
    for df in (rows, baskets, found):
        discard(df)
    return kept


def _by_test(rules: DataFrame, n: int, rate: float, tried: int, false_share: float) -> DataFrame:
    """The rules that pass. The evidence is the divergence of a rule's share of blocked rows from ``rate``, times its
    rows; its negative exponential bounds the chance of such a share. With no or only blocked rows nothing passes."""
    if not 0 < rate < 1:
        return rules.limit(0)
    share = F.col("confidence")
    odds = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    evidence = F.col("support") * n / share * (share * F.log(share / rate) + odds)
    rated = rules.withColumn("__against", F.when(share > rate, -evidence).otherwise(0.0))
    ranked = materialize(number_rows(rated, [], ["__against", "items"], "__rank"), "ranked")
    most = ranked.filter(F.col("__against") <= F.log(F.col("__rank") * false_share / max(1, tried))).agg(F.max("__against")).first()[0]
    kept = materialize(ranked.filter(F.col("__against") <= F.lit(-math.inf if most is None else most)).drop("__against", "__rank"), "rules")
    discard(ranked)
    discard(rules)
    return kept


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS, false_share: float | None = None,
) -> DataFrame:
    """``(id, host, path, rule, verdict, confidence)`` per row of ``pages``.

    ``rule`` is the explicit rule that decides, else null; ``confidence`` is that of the surest mined
    rule that fits the URL, null if none does. Without an explicit rule a URL is blocked if a mined
    rule fits, else allowed; any token of a class stands for the class. ``false_share`` is that of ``mine_rules``. Null URLs have an empty host and path and are allowed. Repeated rows
    and null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("__tokens"))
    classes = materialize(token_classes(labelled, url_col), "classes")
    mined = mine_rules(labelled, url_col, min_support=min_support, min_confidence=min_confidence, min_rows=min_rows, false_share=false_share, classes=classes)
    # The rarest token of each rule is its entry in the index, so hot tokens head few rules.
    often = labelled.select(F.explode(url_tokens(F.col(url_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    entries = mined.select("items", "confidence", F.explode("items").alias("token")).join(often, "token", "left")
    index = entries.groupBy("items", "confidence").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("head"))
    looked = _heads(rows, classes).select("__tokens", "heads", F.explode("heads").alias("head")).join(index, "head")
    fits = looked.filter(F.size(F.array_except("items", "heads")) == 0)
    surest = materialize(fits.groupBy("__tokens").agg(F.max("confidence").alias("confidence")), "matched")
    name, said = explicit_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(surest, "__tokens", "left")
    verdict = F.coalesce(said, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", name.alias("rule"), verdict.alias("verdict"), "confidence")
