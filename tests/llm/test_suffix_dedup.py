import hashlib
import random
import time
from collections import Counter

import numpy as np

from tablechange.llm.queries import QUERIES
from tablechange.llm.suffix_dedup import COVER, PERIOD, anchors, cut_repeats, difference_cover, repeated_suffixes

W = 200


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[k : k + W] for _, raw in raws for k in range(len(raw) - W + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - W + 1):
            if seen[raw[k : k + W]] > 1:
                gone[k : k + W] = b"\1" * W
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=repr)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é") for _ in range(n))


def corpus():
    rng = random.Random(11)
    passage, page = prose(rng, 500), prose(rng, 3000)
    rows = [(i, prose(rng, rng.randrange(100)) + passage[rng.randrange(250) :] + prose(rng, rng.randrange(300))) for i in range(25)]
    for i in range(25):  # near copies
        text = list(page)
        for _ in range(6):
            text[rng.randrange(len(text))] = "#"
        rows.append((100 + i, "".join(text)))
    rows += [(200, page), (201, page), (202, "a" * 1500), (203, "ab" * 400), (204, "ba" * 300), (205, "xyz" * 80), (206, None), (207, ""), (208, "short")]
    edge = prose(rng, 199)
    rows += [(300, edge), (301, edge), (302, edge + "x"), (303, edge + "x"), (304, edge + "y"), (305, "q" + edge), (None, edge + "x"), (300, edge)]
    rows += [(400 + i, passage[:W] + str(i)) for i in range(5)]
    return rows


def test_against_brute_force(make):
    rows = corpus()
    want = brute(rows)
    assert digest(cut_repeats(make(rows, extra=True).repartition(4))) == want
    assert digest(cut_repeats(make(rows).repartition(3), bucket_rows=3)) == want  # hot anchors


def test_long_text_over_segments(make):
    rng = random.Random(4)
    raw = bytes(rng.randrange(97, 123) for _ in range(700_000)).decode()
    rows = [(1, raw), (2, raw[500_000:560_000]), (3, raw[524_200:524_500])]
    got = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in cut_repeats(make(rows)).collect()}
    assert got == {1: (60_000, [(500_000, 560_000)]), 2: (60_000, [(0, 60_000)]), 3: (300, [(0, 300)])}


def test_empty_table(make):
    assert cut_repeats(make([])).count() == 0


def test_difference_cover():
    for period in (7, 13, 32, 64):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(COVER) < PERIOD // 3


def test_anchors_depend_on_the_suffix_alone():
    rng = random.Random(6)
    base = prose(rng, 2000).encode()
    a = np.frombuffer(base, np.uint8)
    b = np.frombuffer(base[333:1700], np.uint8)

    def per_suffix(text):
        starts, anchor = anchors(text)
        return np.repeat(anchor, np.diff(np.append(starts, len(text) - W + 1)))

    assert (per_suffix(a)[333 : 333 + len(b) - W + 1] == per_suffix(b)).all()


def test_block_sort_against_counting():
    rng = random.Random(8)
    for _ in range(40):
        base = prose(rng, 320).encode()
        texts = []
        for _ in range(rng.randrange(1, 14)):
            t = bytearray(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(b"xyz")
            a = rng.randrange(60)
            texts.append(bytes(t[a : a + rng.randrange(W, 261)]))
        buckets = [rng.randrange(2) for _ in texts]
        weights = [rng.choice((1, 1, 1, 2)) for _ in texts]
        seen = Counter()
        for t, w, b in zip(texts, weights, buckets):
            for k in range(len(t) - W + 1):
                seen[b, t[k : k + W]] += w
        for t, b, mask in zip(texts, buckets, repeated_suffixes(texts, weights, buckets)):
            assert mask.tolist() == [seen[b, t[k : k + W]] > 1 for k in range(len(t) - W + 1)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_rows_that_repeat_id_and_text_take_linear_time(make):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    began = time.time()
    got = cut_repeats(make([(None, text)] * 1500 + [(1, text[:300] + "tail")]).repartition(3)).collect()
    assert time.time() - began < 60
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(None, 4000), (1, 300)} and len(got) == 1501
