import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablechange.llm import periodic
from tablechange.llm.periodic import collapsed, occurrences, periodic_runs, runs_of, transform, transform_back
from tablechange.llm.queries import QUERIES


def brute(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, 2 * q) and not any(q % p == 0 and all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(0, 140), st.integers(0, 2**32), st.sampled_from([12, 12, 2, 5, 21]))
def test_runs_equal_brute_force(letters, n, seed, least):
    rng = random.Random(seed)
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, n // 2 + 1)
        for i in range(a, rng.randint(a, n)):
            w[i] = w[a + (i - a) % p]
    found = runs_of(np.array(w, np.int64), least)
    assert found == brute(w, least)
    assert [w[i] for i in np.flatnonzero(collapsed(n, found))] == kept(w, found)


def test_many_runs_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert runs_of(np.array(b)) == brute(b)


def test_transform_and_convolution(monkeypatch):
    a = np.random.default_rng(1).integers(0, periodic.PRIME, (32, 5)).astype(np.uint64)
    assert (transform_back(transform(a.copy())) == a).all()
    w = np.random.default_rng(2).integers(0, 2, 300)
    at = np.arange(0, 280, 4)
    want = sorted((int(i), d) for i in at for d in range(3, 21) if i + d + 4 <= 300 and (w[i : i + 4] == w[i + d : i + d + 4]).all())
    assert sorted(zip(*map(np.ndarray.tolist, occurrences(w, at, 4, 3, 20)))) == want
    # blocks and windows beyond the longest transform
    monkeypatch.setattr(periodic, "LONGEST", 4)
    assert sorted(zip(*map(np.ndarray.tolist, occurrences(w, at, 4, 3, 20)))) == want
    v = [0, 1, 1, 0, 2] * 30 + list(range(50)) + [7] * 40
    assert runs_of(np.array(v)) == brute(v)


def test_sums_that_are_multiples_of_the_prime_are_thrown_out(monkeypatch):
    """Modulo a small prime most zeros are false; the comparison of words decides."""
    monkeypatch.setattr(periodic, "PRIME", 257)
    monkeypatch.setattr(periodic, "_P", np.uint64(257))
    periodic._powers.cache_clear()
    rng = random.Random(5)
    try:
        for _ in range(40):
            w = [rng.randrange(40) for _ in range(120)]
            p = rng.randint(1, 20)
            w[60:100] = [w[60 + k % p] for k in range(40)]
            assert runs_of(np.array(w)) == brute(w)
    finally:
        periodic._powers.cache_clear()


@pytest.mark.parametrize("words", [[0] * 200_000, [0, 1] * 100_000, list(range(500)) * 400, [0] * 50_000 + [1] + [0] * 50_000])
def test_long_periodic_texts_take_near_linear_time(words):
    began = time.time()
    assert 1 <= len(runs_of(np.array(words))) <= 3
    assert time.time() - began < 20


def test_operator(spark, make):
    long = "a b c " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 20), (4, "x " * 20), (None, "one two one two " * 8), (5, long), (6, "ä\x0bö\x0c" * 9 + "end")]
    got = periodic_runs(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert [tuple(r) for r in by[4, 20]["runs"]] == [(0, 20, 1)] and by[4, 20]["collapsed"] == "x"
    assert all(by[k, 0]["runs"] == [] and by[k, 0]["collapsed"] == "" for k in (1, 2, 3))
    assert [tuple(r) for r in by[None, 16]["runs"]] == [(0, 16, 1)]
    assert [tuple(r) for r in by[5, 90_000]["runs"]] == [(0, 90_000, 3)] and by[5, 90_000]["collapsed"] == "a b c"
    assert by[6, 19]["collapsed"] == "ä ö end"
    assert periodic_runs(make([])).count() == 0
    few = periodic_runs(make([(1, "a b a b a")]), least=4).first()
    assert [tuple(r) for r in few["runs"]] == [(0, 5, 2)]


def test_query_equals_brute_force(spark, tmp_path, make):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90)))) for i in range(250)] + [(-7, "q " * 50), (None, "q " * 50), (900, None)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        words = (text or "").split()
        h = None if i is None else zlib.crc32(str(i).encode())
        n = len(words)
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(kept(words, runs)))]
        want.append((i, len(runs), s, length, q, 1000 * length // q if runs else None, *sha))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
