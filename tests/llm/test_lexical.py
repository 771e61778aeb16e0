import math
import re
from collections import Counter

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import types as T

from tablechange.llm.lexical import Block, automaton, blocks, bounded, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    words = [Counter(terms(t)) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(sum(w.values()) for w in words)
    df = Counter(t for w in words for t in w)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        found = []
        for (doc, _), w in zip(docs, words):
            if w:
                m = 100 - 50 + (50 * sum(w.values()) * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * w[t]) // (1000 * w[t] + 20 * m)) for t in asked if w[t])
                if score > 0:
                    found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], schema)


DOCS = [
    (1, "Alpha beta, beta GAMMA."), (2, "alpha-beta alphabet"), (3, None), (4, ""), (5, "-- !!"), (6, "größe Größe GRÖSSE ÄÖ alpha"),
    (7, "gamma"), (8, "gamma"), (8, "gamma"), (None, "gamma beta"), (None, "gamma beta"), (9, "delta " * 4000 + "beta"), (10, "x_y [z] 1a2 a1"), (11, "beta\x00gamma\x7falpha"),
]
ITEMS = [(1, "alpha beta"), (2, "GAMMA gamma größe"), (3, None), (4, "..."), (5, "unheard of"), (None, "delta"), (7, "beta"), (7, "x Y 1a2"), (8, "ÄÖ äö 中文")]


@pytest.mark.parametrize("top,cost", [(50, 1 << 20), (2, 1 << 20), (2, 1), (3, 40)])
def test_equals_brute_force(spark, make, top, cost):
    got = ranked_search(make(DOCS, extra=True).repartition(3), items_of(spark, ITEMS), top, block_cost=cost)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS, top)


def test_ties_beyond_the_limit_go_to_small_ids(spark, make):
    docs = [(i, "same words here" if i % 2 else "other words") for i in range(400, 0, -1)]
    got = ranked_search(make(docs).repartition(5), items_of(spark, [(1, "same words")]), 50).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, [(1, "same words")], 50)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])][:3] == [1, 3, 5]


def test_empty_tables(spark, make):
    assert ranked_search(make([]), items_of(spark, ITEMS)).count() == 0
    assert ranked_search(make(DOCS), items_of(spark, [])).count() == 0
    assert ranked_search(make([(1, None), (2, "!")]), items_of(spark, ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search(make([(1, None), (2, "!")]), items_of(spark, ITEMS)).count() == 0


@given(st.text("aAbB9.é \n_", max_size=60), st.sets(st.sampled_from(["a", "ab", "b9", "é", "éa", "9"]), min_size=1))
def test_outputs_are_whole_terms(text, wanted):
    wanted = sorted(wanted)
    scanned, n = bounded(text)
    found = terms(text)
    assert n == len(found)
    assert Counter(wanted[i] for _, i in automaton(wanted).iter(scanned)) == Counter(t for t in found if t in wanted)


def test_blocks_hold_whole_items(spark):
    frame = spark.createDataFrame([(i, ["term%d" % i, "common"]) for i in range(20)], "item long, terms array<string>")
    cut = list(blocks(frame, 60))
    assert sorted(i for b in cut for i in b.items) == list(range(20)) and max(len(b.items) for b in cut) == 3
    one = Block.of([(1, ["a", "b"]), (2, ["b"])])
    assert [one.holders[one.starts[t] : one.starts[t + 1]].tolist() for t in range(2)] == [[0], [0, 1]]
