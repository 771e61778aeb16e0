import random

import pytest

from tablechange.operators.changeset import order_changes
from tablechange.operators.diff import change_rows
from tablechange.operators.levels import dependency_levels


def brute(edges, extra=()):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {n for e in edges for n in e} | set(extra)
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r.union(*(reach[m] for m in r)) for n, r in reach.items()}
    cycle = {n: min(m for m in reach[n] if n in reach[m]) if n in reach[n] else None for n in nodes}
    rep = {n: n if cycle[n] is None else cycle[n] for n in nodes}
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            if rep[a] != rep[b]:
                up = level[a] + 1
                for n in nodes:
                    if rep[n] == rep[b]:
                        level[n] = max(level[n], up)
    return {n: (level[n], cycle[n]) for n in nodes}


def levels(spark, edges, nodes=None):
    frame = spark.createDataFrame(edges, "src int, dst int")
    given = None if nodes is None else spark.createDataFrame([(n,) for n in nodes], "n int")
    found = dependency_levels(frame, given).collect()
    assert len({r["node"] for r in found}) == len(found)
    return {r["node"]: (r["level"], r["cycle"]) for r in found}


CASES = {
    "none": [],
    "chains, repeated and null ends": [(1, 2), (2, 3), (2, 3), (None, 4), (4, None), (3, 4), (1, 4), (4, 5), (6, 5)],
    "loop": [(1, 1), (1, 2)],
    "loop inside a cycle": [(1, 2), (2, 1), (2, 2), (0, 1)],
    "cycles in line, a node between": [(5, 6), (6, 5), (6, 7), (7, 8), (8, 9), (9, 8), (9, 10), (3, 5)],
    "two cycles of one colour": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 6)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert levels(spark, CASES[name], [1, 99]) == brute(CASES[name], [1, 99])


def test_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(18), rng.randrange(18)) for _ in range(24)]
    assert levels(spark, edges) == brute(edges)


def test_order_over_scopes(spark):
    rows = [("create", "z", "view"), ("create", "a", "base"), ("create", "b", "alone"), ("drop", "z", "old_base"), ("drop", "a", "old_view")]
    changes = change_rows(spark.createDataFrame(rows, "kind string, scope string, key string"))
    needs = spark.createDataFrame([("base", "view"), ("old_base", "old_view")], "src string, dst string")
    got = {(r["phase"], r["seq"]): r["key"] for r in order_changes(changes, depends=needs).collect()}
    assert got == {(1, 1): "base", (1, 2): "alone", (1, 3): "view", (3, 1): "old_view", (3, 2): "old_base"}
