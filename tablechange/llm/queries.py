"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablechange.llm.ann import nearest_neighbours
from tablechange.llm.bpe import bpe_encode
from tablechange.llm.exact_dedup import exact_dedup
from tablechange.llm.mixing import labelled_sample, mix_rates
from tablechange.llm.simhash import simhash_classes
from tablechange.llm.toxicity import score_toxicity, train_toxicity
from tablechange.llm.html_text import extract_text
from tablechange.llm.url_rules import FALSE_SHARE, judge_urls
from tablechange.llm.lexical import ranked_search
from tablechange.llm.periodic import periodic_runs
from tablechange.llm.pii import BASE, KINDS, find_pii, train_pii
from tablechange.llm.quality import score_quality, train_quality
from tablechange.llm.suffix_dedup import cut_repeats
from tablechange.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401  the entry reads both

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op9_exact_dedup",
    f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents),
  g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def vocabulary_path() -> str:
    """The public vocabulary file that the query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded_col="decoded", keep=["doc_id"])
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_simhash_classes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def may_learn(rows: DataFrame) -> DataFrame:
    """The rows that may be learned from: a third of the ids is held out."""
    return rows.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, may_learn(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


#: Shares of tokens that the mixture is to have, by language.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text, domain)`` of a bounded sample of the documents labelled as good: their language is the
    domain to be learned."""
    labels = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return labelled_sample(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain")), labels)


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)


#: Explicit rules: verdict, host, beginning of the path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose id is labelled; poor or toxic ones are to be blocked."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id")


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_pages(spark, sf_dir), URL_RULES, false_share=FALSE_SHARE)


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train_pii(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"))


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_NORM)


@query(
    "op11_ranked_search",
    f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ts FROM documents),
  c AS (SELECT r, len(ts) AS n FROM d WHERE len(ts) > 0),
  s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM c),
  q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
  t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
  m AS (SELECT r, 50 + (50 * n * docs) // terms AS m FROM c, s),
  x AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN m USING (r) JOIN q USING (term) GROUP BY item_id, r)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM x JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 50""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; of a tenth of the ids the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a = F.size("__w").cast("long"), F.col("__a")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__w"), g.alias("__g"))
    rows = rows.withColumn("__a", F.when(n > 0, F.col("__g") % n))
    rows = rows.withColumn("__p", 1 + F.floor((n - a) / (3 + F.col("__g") % 8)))
    moved = F.transform("__w", lambda w, i: F.when(i >= a, F.get(F.col("__w"), (a + (i - a) % F.col("__p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, period = F.col("best.n"), -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.n) div (-best.p)").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels").filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
