import math
import random
import zlib

import numpy as np

from tablechange.llm.queries import QUERIES
from tablechange.llm.toxicity import LabelModel, ToxicityModel, score_toxicity, terms_of, train_toxicity

BAD = ["grumbleface", "dunderhead", "zorkling", "zorkmire", "blatherer"]


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(BAD)
        out.append((i, " ".join(words), int(toxic)))
    return out


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, toxic int")


def test_held_out_accuracy(spark, make):
    data = rows()
    known = [(i, y) for i, _, y in data if i % 3] + [(None, 1), (7, None), (5, data[5][2])]
    extra = [(1000, None), (1001, ""), (None, "zorkmire dunderhead grumbleface"), (0, data[0][1]), (1002, "plain " * 50_000)]
    docs = make([(i, t) for i, t, _ in data] + extra, extra=True)
    model = train_toxicity(docs, labels(spark, known))
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(data) + len(extra)
    held = [(r, data[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 3 == 0]
    assert sum(r["predicted"] == y for r, y in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {0}
    assert {r["predicted"] for r in got if r["doc_id"] is None} == {1}
    kept = score_toxicity(docs, model, keep_columns=True)
    assert kept.columns == [*docs.columns, "__score", "__predicted"]


def test_nothing_to_learn_from(spark, make):
    model = train_toxicity(make([(1, "a")]), labels(spark, []))
    assert [tuple(r) for r in score_toxicity(make([(1, "a")]), model).collect()] == [(1, 0.5, 0)]
    assert score_toxicity(make([]), train_toxicity(make([]), labels(spark, [(1, 1)]))).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good, poor = np.where(rng.random(4000) < 0.9, y, ~y), rng.random(4000) < 0.5
    votes = np.stack([good, good, np.where(rng.random(4000) < 0.8, y, ~y), np.where(rng.random(4000) < 0.8, y, ~y), poor], 1).astype(float)
    start = np.where(rng.random(4000) < 0.5, y, 0.5).astype(float)
    model = LabelModel.fit(votes, start)
    assert model.on[1, 0] > 0.8 > 0.3 > model.on[0, 0]
    assert abs(model.on[1, 4] - model.on[0, 4]) < 0.1
    assert model.share[0] < 0.5 and model.share[2] > model.share[0] + 0.2  # voters that repeat each other share their weight
    assert ((model.log_odds(votes) > 0) == y).mean() > 0.88


def test_score_is_the_linear_form():
    model = ToxicityModel({"wbad": 2.0, "4badd": 1.0}, [0.0] * 4, -1.0)
    assert terms_of("Bad BADDIE") == {"wbad", "wbaddie", "4badd", "5baddi"}
    for text, z in (("bad", 1.0), ("baddies", 0.0), ("bad baddies bad", 2.0), (None, -1.0)):
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-z)))


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(p and y for p, y in held)
    assert hits / sum(y for _, y in held) > 0.75 and hits / sum(p for p, _ in held) > 0.95
