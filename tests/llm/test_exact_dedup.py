import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from tablechange.llm.exact_dedup import PatriciaTrie, _terminals, _tries, exact_dedup


def brute(rows, pick):
    groups = defaultdict(list)
    norm = {}
    for n, (i, t) in enumerate(rows):
        norm[n] = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups[norm[n]].append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        g = groups[norm[n]]
        owner = pick([x for x in g if x is not None], default=None)
        out.append((i, owner, len(g), i == owner, hashlib.sha256(norm[n].encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "dup"), (10, "dup"), (None, "abc"), (None, "only"), (11, "ab"), (12, "abcd")]


def test_against_brute_force(make):
    for keep, pick in (("smallest", min), ("largest", max)):
        for block in (1, 32 << 20):
            got = exact_dedup(make(ROWS, extra=True).repartition(3), keep=keep, block_bytes=block).collect()
            assert sorted(map(tuple, got), key=repr) == brute(ROWS, pick)


def test_empty_table(make):
    assert exact_dedup(make([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.integers(0, 50)), max_size=40), st.integers(1, 2000))
def test_trie(rows, block):
    want = {}
    trie = PatriciaTrie()
    for t, i in rows:
        trie.insert(t.encode(), i)
        owner, n = want.get(t.encode(), (i, 0))
        want[t.encode()] = (min(owner, i), n + 1)
    assert {k: (o, n) for k, o, n in trie.items()} == want
    ordered = sorted(((len(t), hash(t) % 3, t.encode(), i, 1) for t, i in rows), key=lambda r: r[:2])
    assert {k: (o, n) for _, _, k, o, n in _tries(iter(ordered), min, block, True)} == want


def test_texts_of_a_partition_share_beginnings():
    start = b"the same license stands at the head of every text "
    texts = [start + b"%04d" % i for i in range(1000)]
    trie = PatriciaTrie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    assert list(trie.root.children) == [start[0]] and trie.root.children[start[0]].label == start + b"0"
    nodes, todo = 0, [trie.root]
    while todo:
        node = todo.pop()
        nodes += 1
        todo.extend(node.children.values())
    assert nodes == 1 + 1 + 10 + 100 + 1000  # root, beginning with the first digit, three digits
    assert trie.bytes == sum(trie.sizes.values()) < 1000 * len(start) + 1111 * 200
    assert {t for t, _ in _terminals(trie.cut(start[0]))} == set(texts) and trie.bytes == 0 and not list(trie.items())


def test_spilled_subtrees():
    texts = [bytes([97 + i % 7]) * 3 + b"%05d" % i for i in range(3000)] * 2
    rows = [(len(t), hash(t), t, i, 1) for i, t in enumerate(texts)]
    for in_order in (False, True):
        given = sorted(rows, key=lambda r: r[:2]) if in_order else rows
        got = list(_tries(iter(given), min, 20_000, in_order))
        assert in_order == (len(got) == 3000) and all(h == hash(t) and n == len(t) for n, h, t, _, _ in got)
        merged = {}
        for _, _, t, owner, copies in got:
            o, c = merged.get(t, (owner, 0))
            merged[t] = (min(o, owner), c + copies)
        assert merged == {t: (i, 2) for i, t in enumerate(texts[:3000])}


def test_very_long_texts(make):
    base = "long text " * 300_000
    rows = [(1, base + "a"), (2, base + "b"), (3, base.upper() + "A"), (None, base)]
    assert sorted(map(tuple, exact_dedup(make(rows, extra=True), keep="largest", block_bytes=1000).collect()), key=repr) == brute(rows, max)
