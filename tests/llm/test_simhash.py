import random
import re

import xxhash
from hypothesis import given, settings, strategies as st

from tablechange.llm.components import components
from tablechange.llm.queries import QUERIES
from tablechange.llm.simhash import BKTree, fingerprint, near_links, shard_links, simhash_classes


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def all_links(fps, radius):
    return [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius]


def brute(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    group = classes(all_links({f for _, f in fps}, 3), {f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f, least.get(group[f])) for i, f in fps), key=repr)


def unsigned(rows):
    return sorted(((i, f & (1 << 64) - 1, c) for i, f, c in rows), key=repr)


def family(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(300)] = "edit%d" % rng.randrange(99)
        out.append(" ".join(words))
    return out


def test_fingerprints():
    for t in ["", None, "one", "one two", "A B c", "a b c d", "x\x0by\x0cz  w\xa0v\n\n", "É é", "rep " * 50, *family(1, 3), "long " * 50_000]:
        assert fingerprint(t) == plain_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1).flatmap(lambda v: st.lists(st.integers(0, 63), max_size=4).map(lambda bits: v ^ sum(1 << b for b in set(bits)))), max_size=30), st.integers(0, 8))
def test_tree_and_links(values, radius):
    values = sorted({v & 0xFF0FFF for v in values} | set(values))
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.values[i] for i in tree.within(v, radius)) == [w for w in values if (v ^ w).bit_count() <= radius]
    assert classes(shard_links(values, radius), values) == classes(all_links(values, radius), values)


def test_hot_shards_are_divided(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(400)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = classes(all_links(fps, 3), fps)
    for shard in (5, 4096):
        links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in near_links(df, 3, shard).collect()]
        assert classes(links, fps) == want


def test_classes_against_brute_force(make):
    rows = [(i + 10, t) for i, t in enumerate(family(1, 25) + family(2, 10) + ["", "  ", None, "one two", "ONE two", "tail"])] + [(3, family(1, 1)[0]), (3, family(1, 1)[0]), (None, "lonely words here"), (None, "one two")]
    got = simhash_classes(make(rows, extra=True).repartition(3)).collect()
    assert unsigned(map(tuple, got)) == brute(rows)
    assert simhash_classes(make([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (7, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op2_simhash_classes"](spark, sf).collect()]
    assert sorted(got, key=repr) == brute(rows)
