import zlib

import numpy as np
import pytest

from tablechange.llm.quality import FEATURES, AdditiveModel, _quadrants, _tree, features_of, fit_additive, score_quality, train_quality
from tablechange.llm.queries import QUERIES


def test_features_are_defined_for_all_texts():
    for raw in (b"", b" ", b"\n\n", b"a", b"!!", "ä".encode(), b"\x00", b"x " * 100_000, b"y" * 100_000):
        found = features_of(raw)
        assert len(found) == len(FEATURES) and np.isfinite(found).all()
    by = dict(zip(FEATURES, features_of("Ab ab ab. XYZ!! | | ü\nAb\nAb\n".encode())))
    assert by["stutter"] == pytest.approx(2 / 9) and by["repeated_lines"] == pytest.approx(1 / 3) and by["ends_in_marks"] == pytest.approx(1 / 9)
    assert by["bare_marks"] == pytest.approx(2 / 9) and by["all_capitals"] == pytest.approx(1 / 9) and by["distinct_words"] == pytest.approx(6 / 9)


def test_triples_of_long_texts_are_counted_alike():
    from tablechange.llm.quality import _mixed

    ids = np.random.default_rng(0).integers(0, 9, 5000)
    assert len(np.unique(_mixed(ids))) == len({tuple(ids[i : i + 3]) for i in range(len(ids) - 2)})


def test_tree_finds_the_best_cuts():
    g, h = np.array([0.0, 0, 9, 9, 9, 0, -6, -6]), np.full(8, 2.0)
    assert _tree(g, h).round(3).tolist() == [0, 0, *[round(27 / 7, 3)] * 3, *[round(-12 / 7, 3)] * 3] or np.argmax(_tree(g, h)) in (2, 3, 4)
    assert _tree(np.zeros(4), h[:4]).tolist() == [0] * 4 and _tree(np.array([1.0]), np.array([1.0])).tolist() == [0.5]


def test_cyclic_boosting_learns_tables_and_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 4))
    x[:, 3] = 7  # a constant feature has one bin
    odds = 6 * (np.abs(x[:, 0]) > 0.5) - 3 + 4 * np.sign(x[:, 1] * x[:, 2])
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = fit_additive(x[:3000], y[:3000], pairs=2)
    assert model.pairs[0] == (1, 2)
    shape = model.tables[0]
    assert shape[len(shape) // 2] < min(shape[0], shape[-1])
    right = ((model.scores(x[3000:]) >= 0.5) == (y[3000:] > 0.5)).mean()
    best = ((odds[3000:] > 0) == (y[3000:] > 0.5)).mean()
    alone = fit_additive(x[:3000], y[:3000], pairs=0)
    assert right > best - 0.03 and right > ((alone.scores(x[3000:]) >= 0.5) == (y[3000:] > 0.5)).mean() + 0.2


def test_gain_of_a_grid_and_no_rows():
    gain, out = _quadrants(np.array([[4.0, -4.0], [-4.0, 4.0]]), np.ones((2, 2)))
    assert gain == pytest.approx(4 * 16 / 2) and out.tolist() == [[2, -2], [-2, 2]]
    x = np.zeros((3, len(FEATURES)))
    assert fit_additive(x[:0], np.empty(0)).scores(x).tolist() == [0.5] * 3
    assert (fit_additive(x, np.ones(3)).scores(x) > 0.9).all()


def test_operator(spark, make):
    rows = [(i, ("good words follow here and there. " if i % 2 else "BAD!! ") * (3 + i % 5)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = train_quality(make(rows), labels)
    more = [(200, None), (201, ""), (None, "good words follow here."), (None, "BAD!! BAD!!"), (202, "good words follow here and there. " * 20_000), *rows[:2], *rows[:2]]
    got = score_quality(make(more, extra=True), model).collect()
    assert len(got) == len(more) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] in (0, 1, 202)] == [1, 0, 1, 0, 1]
    assert len({r["score"] for r in got if r["doc_id"] in (200, 201)}) == 1
    assert score_quality(make([]), model).count() == 0
    none = train_quality(make(rows), labels.limit(0))
    assert none == AdditiveModel(0.0) and train_quality(make([]), labels) == none
    assert {r["score"] for r in score_quality(make(rows[:3]), none).collect()} == {0.5}


def test_sample_is_bounded(spark, make):
    rows = [(1, f"text {k}") for k in range(50)]
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert train_quality(make(rows), labels, max_train=10).bias == 0


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and right > 0.97 * len(labels)
