import hashlib
import random

import pytest
from pyspark.sql import functions as F

import tablechange.functions.similarity as similarity
import tablechange.operators.matching as matching
from tablechange.functions.similarity import (
    block_scores,
    jaro,
    jaro_column,
    jaro_scores,
    jaro_winkler,
    jaro_winkler_column,
    jaro_winkler_scores,
)
from tablechange.operators.diff import change_rows, diff, is_empty
from tablechange.operators.matching import _FEW_PAIRS, diff_with_renames, fold_renames, match_names, match_one_to_one, similar_pairs
from tablechange.operators.merge import apply_changes
from tablechange.session import materialize


def names(spark, values, scope="s"):
    return spark.createDataFrame([(scope, v) if isinstance(v, str) else v for v in values], "scope string, name string")


def random_names(seed, n, alphabet="abcde_1", longest=12):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        out.add(base)
        # relatives: one character changed, dropped, added or swapped
        if base and rng.random() < 0.7:
            i = rng.randrange(len(base))
            out.add(rng.choice([base[:i] + rng.choice(alphabet) + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + "x" + base[i:], base[::-1]]))
    return sorted(out)


def brute_pairs(olds, news, threshold, **weights):
    left = [o for o in olds for _ in news]
    right = [n for _ in olds for n in news]
    scores = jaro_winkler_scores(left, right, **weights)
    return {(o, n): s for o, n, s in zip(left, right, scores) if s > threshold}


def tie(pair):
    return hashlib.md5("\0".join(pair).encode()).hexdigest()


def greedy(pairs):
    used_o, used_n, out = set(), set(), {}
    for (o, n), s in sorted(pairs.items(), key=lambda p: (-p[1], tie(p[0]), p[0])):
        if o not in used_o and n not in used_n:
            used_o.add(o)
            used_n.add(n)
            out[(o, n)] = s
    return out


# published examples, and edges
@pytest.mark.parametrize(
    "a,b,j,jw",
    [
        ("MARTHA", "MARHTA", 0.944444, 0.961111),
        ("DIXON", "DICKSONX", 0.766667, 0.813333),
        ("DWAYNE", "DUANE", 0.822222, 0.84),
        ("", "", 1.0, 1.0),
        ("", "a", 0.0, 0.0),
        ("a", "a", 1.0, 1.0),
        ("a", "b", 0.0, 0.0),
        ("ab", "ba", 0.0, 0.0),
    ],
)
def test_known_scores(a, b, j, jw):
    assert jaro_scores([a], [b])[0] == pytest.approx(j, abs=1e-6)
    assert jaro_winkler_scores([a], [b])[0] == pytest.approx(jw, abs=1e-6)


def test_batch_and_column_forms_agree(spark):
    words = random_names(1, 60) + ["straße", "größe", "😀a", "a😀"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words[::5]] + [(None, "a")], "a string, b string")
    got = pairs.select(
        "a", "b", jaro("a", "b").alias("x"), jaro_column(F.col("a"), F.col("b")).alias("y"),
        jaro_winkler("a", "b").alias("z"), jaro_winkler_column(F.col("a"), F.col("b")).alias("w"),
    ).collect()
    for r in got:
        if r["a"] is None:
            assert r["x"] is None and r["y"] is None
            continue
        assert r["x"] == pytest.approx(r["y"], abs=1e-12), (r["a"], r["b"])
        assert r["z"] == pytest.approx(r["w"], abs=1e-12), (r["a"], r["b"])
        assert 0 <= r["x"] <= 1 and (r["x"] == 1) == (r["a"] == r["b"])


def test_long_texts_keep_their_places():
    a, b = "ab" * 3000, "ba" * 3000
    short = jaro_scores(["MARTHA", a, "x"], ["MARHTA", b, "y"])
    assert short[0] == pytest.approx(0.944444, abs=1e-6) and short[1] > 0.6 and short[2] == 0


@pytest.mark.parametrize("threshold", [0.8, 0.95])
@pytest.mark.parametrize("weights", [{}, {"prefix_cap": None, "boost_floor": 0.0}, {"prefix_weight": 0.0}])
def test_no_pair_is_lost(spark, threshold, weights):
    olds, news = random_names(2, 150), random_names(3, 150)
    got = similar_pairs(names(spark, olds), names(spark, news), "scope", threshold, **weights).collect()
    want = brute_pairs(olds, news, threshold, **weights)
    assert len(got) == len({(r["old_name"], r["new_name"]) for r in got})
    assert {(r["old_name"], r["new_name"]): round(r["score"], 9) for r in got} == {p: round(s, 9) for p, s in want.items()}


def test_no_long_pair_is_lost(spark):
    rng = random.Random(5)
    olds = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(25, 90))) for _ in range(60)]
    news = [o[: rng.randint(10, len(o))] + rng.choice(["", "zz", "abcabcabc"]) for o in olds] + [o[5:] for o in olds] + ["ünï" + o for o in olds[:9]]
    got = similar_pairs(names(spark, olds), names(spark, news), "scope").collect()
    assert {(r["old_name"], r["new_name"]) for r in got} == set(brute_pairs(olds, sorted(set(news)), 0.8))


def test_scope_and_block_separate(spark):
    old = spark.createDataFrame([("s", 1, "customer_id"), ("t", 1, "customer_id")], "scope string, blk int, name string")
    new = spark.createDataFrame([("s", 1, "customer_ids"), ("t", 2, "customer_ids"), ("u", 1, "customer_ids")], "scope string, blk int, name string")
    assert {r["scope"] for r in similar_pairs(old, new, "scope").collect()} == {"s", "t"}
    assert {r["scope"] for r in similar_pairs(old, new, "scope", block="blk").collect()} == {"s"}
    assert similar_pairs(old, new).count() == 1  # distinct names once


def test_score_of_exactly_the_threshold_is_no_rename(spark):
    # one of five characters differs on each side, nothing in front agrees: 0.8 by the formula
    a, b = "xabcd", "yabcd"
    score = jaro_winkler_scores([a], [b])[0]
    assert similar_pairs(names(spark, [a]), names(spark, [b]), "scope", threshold=float(score)).count() == 0
    assert similar_pairs(names(spark, [a]), names(spark, [b]), "scope", threshold=float(score) - 1e-6).count() == 1


@pytest.mark.parametrize("seed", [11, 12])
def test_matching_is_the_greedy(spark, seed, monkeypatch):
    olds, news = random_names(seed, 80), random_names(seed + 100, 80)
    want = greedy(brute_pairs(olds, news, 0.8))
    pairs = similar_pairs(names(spark, olds), names(spark, news), "scope")
    got = {(r["old_name"], r["new_name"]) for r in match_one_to_one(pairs, "scope").collect()}
    assert got == set(want)
    for few in (_FEW_PAIRS, 0):  # straight to the threshold, and in bands
        monkeypatch.setattr(matching, "_FEW_PAIRS", few)
        banded = match_names(names(spark, olds), names(spark, news), "scope").collect()
        assert {(r["old_name"], r["new_name"]) for r in banded} == set(want)


def test_matching_similar_pairs_does_not_write_them_all(spark, monkeypatch):
    """Names all alike: 40,000 pairs pass, 200 of them are the best of both names."""
    monkeypatch.setattr(matching, "_FEW_PAIRS", 0)
    written = []

    def counted(df, label="table", **more):
        out = materialize(df, label, **more)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(matching, "materialize", counted)
    olds, news = [f"customer#{i:04d}" for i in range(200)], [f"customer-{i:04d}" for i in range(200)]
    pairs = similar_pairs(names(spark, olds), names(spark, news), "scope")
    got = match_one_to_one(pairs, "scope").collect()
    assert {(r["old_name"], r["new_name"]) for r in got} == set(zip(olds, news))
    assert sum(n for label, n in written if label == "pairs") < 5000
    assert pairs.count() == 40000  # still there for other uses
    assert match_one_to_one(pairs.filter("old_name < 'customer#0003'"), "scope").count() == 3


def test_folding_matched_similar_pairs_writes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "_FEW_PAIRS", 0)
    written = []

    def counted(df, label="table", **more):
        out = materialize(df, label, **more)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(matching, "materialize", counted)
    old = spark.createDataFrame([("s", f"customer#{i:04d}", i) for i in range(150)], "blk string, k string, v int")
    new = spark.createDataFrame([("s", f"customer-{i:04d}", i) for i in range(149)], "blk string, k string, v int")
    changes = diff(old, new, ["k"], ["v"], scope="blk")
    named = [F.col("scope"), F.col("key").alias("name")]
    pairs = similar_pairs(changes.filter("kind = 'drop'").select(named), changes.filter("kind = 'create'").select(named), "scope")
    got = {(r["kind"], r["key"], r["old_key"]) for r in fold_renames(changes, match_one_to_one(pairs, "scope")).collect()}
    assert got == {("rename", f"customer-{i:04d}", f"customer#{i:04d}") for i in range(149)} | {("drop", "customer#0149", None)}
    assert sum(n for label, n in written if label == "pairs") < 5000


def test_renames_never_go_through_the_driver(spark, monkeypatch):
    """Written tables are packed to a small part of their rows, so their size must not make them broadcast."""
    monkeypatch.setattr(matching, "_FEW_PAIRS", 0)
    plans = []

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().toString())
        return rows

    def planned(df, label="table", **more):
        run(df)
        return materialize(df, label, **more)

    monkeypatch.setattr(matching, "materialize", planned)
    old = spark.createDataFrame([("s", f"customer#{i:02d}", i) for i in range(30)], "blk string, k string, v int")
    new = spark.createDataFrame([("s", f"customer-{i:02d}", max(i, 1)) for i in range(29)], "blk string, k string, v int")
    changes = diff(old, new, ["k"], ["v"], scope="blk")
    named = [F.col("scope"), F.col("key").alias("name")]
    pairs = similar_pairs(changes.filter("kind = 'drop'").select(named), changes.filter("kind = 'create'").select(named), "scope")
    renames = [("rename", f"customer-{i:02d}", f"customer#{i:02d}") for i in range(29)]
    folded = run(fold_renames(changes, match_one_to_one(pairs, "scope")))
    assert sorted((r["kind"], r["key"], r["old_key"]) for r in folded) == [("drop", "customer#29", None), *renames]
    folded = run(diff_with_renames(old, new, ["k"], ["v"], "blk"))
    moved = [("change", "customer-00", "customer#00"), ("drop", "customer#29", None), *renames]
    assert sorted((r["kind"], r["key"], r["old_key"]) for r in folded) == moved
    assert len(plans) > 10 and all("Final Plan" in plan and "Broadcast" not in plan for plan in plans)


def test_long_chain_of_worse_pairs(spark):
    # each pair is beaten by the one before it at one end, so every round settles one link
    links = [(f"o{i:02d}", f"n{i:02d}", 1 - i / 100) for i in range(8)] + [(f"o{i + 1:02d}", f"n{i:02d}", 1 - i / 100 - 0.005) for i in range(7)]
    pairs = spark.createDataFrame(links, "old_name string, new_name string, score double")
    got = {(r["old_name"], r["new_name"]) for r in match_one_to_one(pairs).collect()}
    assert got == set(greedy({(o, n): s for o, n, s in links})) and len(got) == 8


def test_equal_scores_take_few_rounds(spark, monkeypatch):
    pairs = spark.range(200).selectExpr("concat('o', id) AS old_name").crossJoin(spark.range(200).selectExpr("concat('n', id) AS new_name"))
    pairs = pairs.selectExpr("old_name", "new_name", "0.9D AS score")
    written = []

    def counted(df, label="table", **more):
        written.append(label)
        return materialize(df, label, **more)

    monkeypatch.setattr(matching, "materialize", counted)
    got = [(r["old_name"], r["new_name"]) for r in match_one_to_one(pairs).collect()]
    every = {(f"o{a}", f"n{b}"): 0.9 for a in range(200) for b in range(200)}
    assert set(got) == set(greedy(every)) and len(got) == 200
    assert written.count("pairs") - 1 < 25


def test_signatures_never_go_through_the_driver(spark):
    """Few bytes of names have very many signatures, so their size must not make them broadcast."""
    pairs = similar_pairs(names(spark, ["customer#1", "customer#2"]), names(spark, ["customer-1"]), "scope")
    plan = pairs._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan
    assert pairs.count() == 2


@pytest.mark.parametrize("olds_more", [True, False])
def test_signatures_in_parts_give_each_pair_once(spark, olds_more, monkeypatch):
    monkeypatch.setattr(matching, "_PART_PAIRS", 40)
    olds, news = random_names(21, 90 if olds_more else 60), random_names(22, 60 if olds_more else 90)
    for weights in ({}, {"prefix_cap": None, "boost_floor": 0.0}):
        got = [(r["old_name"], r["new_name"]) for r in similar_pairs(names(spark, olds), names(spark, news), "scope", **weights).collect()]
        assert len(got) == len(set(got)) and set(got) == set(brute_pairs(olds, news, 0.8, **weights))


@pytest.mark.parametrize("weights", [{}, {"prefix_cap": None, "boost_floor": 0.0}, {"prefix_weight": 0.0}, {"prefix_cap": 2}])
def test_blocks_score_as_pairs_do(weights, monkeypatch):
    rng = random.Random(31)
    for la, lb in [(1, 1), (1, 6), (9, 9), (18, 17), (32, 32), (33, 20), (64, 64), (12, 64)]:
        for letters in ("ab", "Customer#0123456789", "äß漢\U0001f600\0z", [chr(c) for c in range(0x4E00, 0x5E00)]):
            left = ["".join(rng.choice(letters) for _ in range(la)) for _ in range(23)]
            right = ["".join(rng.choice(letters) for _ in range(lb)) for _ in range(19)] + left[:3] * (la == lb)
            want = jaro_winkler_scores([x for x in left for _ in right], [y for _ in left for y in right], **weights)
            for cells in (1 << 20, 10):  # one table of characters, and one for each slice
                with monkeypatch.context() as m:
                    m.setattr(similarity, "_BLOCK_PAIRS", 100)
                    m.setattr(similarity, "_CELLS", cells)
                    got = [score for rows in block_scores(left, right, **weights) for score in rows.ravel()]
                assert got == want.tolist()


def test_names_all_alike_are_paired_in_tiles(spark):
    """Nearly all of these pairs pass, so nothing is gained by signatures, and a pair is a row only when it is found."""
    olds, news = [f"customer#{i:05d}" for i in range(510)], [f"customer-{i:05d}" for i in range(505)]
    pairs = similar_pairs(names(spark, olds), names(spark, news), "scope")
    plan = pairs._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "Broadcast" not in plan
    assert pairs.distinct().count() == pairs.count() == len(brute_pairs(olds, news, 0.8)) == 510 * 505


@pytest.mark.parametrize("on", ["scope", None])
@pytest.mark.parametrize("weights", [{}, {"prefix_cap": None, "boost_floor": 0.0}, {"prefix_weight": 0.0}])
def test_no_pair_is_lost_in_tiles(spark, on, weights, monkeypatch):
    monkeypatch.setattr(matching, "_TILED_FROM", 0)
    monkeypatch.setattr(matching, "_TILE", 7)
    long = ["".join(random.Random(i).choice("abc") for _ in range(60 + i)) for i in range(10)]
    olds, news = random_names(41, 120) + long, random_names(42, 120) + [name[1:] for name in long]
    for signed in (0.0, 1.0, 2e-4):  # all by signature, all in tiles, some of each
        monkeypatch.setattr(matching, "_SIGNED", signed)
        monkeypatch.setattr(matching, "_PAIRED", signed)
        got = [(r["old_name"], r["new_name"], r["score"]) for r in similar_pairs(names(spark, olds), names(spark, news), on, **weights).collect()]
        assert sorted(got) == sorted((*pair, score) for pair, score in brute_pairs(olds, news, 0.8, **weights).items())


def test_tiles_keep_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(matching, "_TILED_FROM", 0)
    old = names(spark, [("s", "customer_id"), ("s", "customer_ix"), (None, "customer_id"), ("t", "customer_id"), ("t", None), ("t", "")])
    new = names(spark, [("s", "customer_ids"), ("s", "customer_ids"), (None, "customer_ids"), ("u", "customer_ids"), ("t", ""), ("s", "zz")])
    for signed in (0.0, 1.0):
        monkeypatch.setattr(matching, "_SIGNED", signed)
        got = sorted((r["scope"], r["old_name"], r["new_name"]) for r in similar_pairs(old, new, "scope").collect())
        assert got == [("s", "customer_id", "customer_ids"), ("s", "customer_ix", "customer_ids"), ("t", "", "")]


def test_tiles_where_signatures_would_take_longer(spark):
    """Which of the two takes longer is told by the characters that names of both sides have."""
    bounds, pairs = matching._Bounds(0.8, 0.1, 4, 0.7), 1_000_000_000
    for news, longer in (([f"customer-{i:04d}" for i in range(200)], True), ([f"Acct{i:06d}xyz" for i in range(200)], False)):
        olds = [f"customer#{i:04d}" for i in range(300)]
        profile = matching._read_profile(matching._names(names(spark, olds), names(spark, news), ["scope"], "name"))
        in_tiles = pairs * 13 * matching._SCORED
        assert (matching._signing_time(bounds, profile, 13, 13, pairs) > in_tiles) == longer


def test_characters_of_one_side_come_first(spark):
    """A name is filed under what few names of the other side have, however frequent on its own."""
    olds, news = [f"Customer#{i:04d}" for i in range(300)], [f"Acct{i:03d}" for i in range(200)]
    profile = matching._read_profile(matching._names(names(spark, olds), names(spark, news), ["scope"], "name"))
    first = matching._ranked_tokens("Acct177", profile.ranks)[:3]
    assert {chr(token >> 24 & (1 << 21) - 1) for token in first} == {"A", "c"}
    assert similar_pairs(names(spark, olds), names(spark, news), "scope").count() == 0


def test_one_scope_with_most_names(spark, monkeypatch):
    """A scope of names all alike: every rename is found, in bands, without all pairs."""
    monkeypatch.setattr(matching, "_FEW_PAIRS", 0)
    olds = [f"customer#{i:06d}" for i in range(1500)]
    news = [f"customer-{i:06d}" for i in range(1500)]
    got = match_names(names(spark, olds), names(spark, news), "scope").collect()
    assert {(r["old_name"], r["new_name"]) for r in got} == set(zip(olds, news))


def test_renames_with_changes_and_apply(spark):
    schema = "k string, v int, w string"
    old = spark.createDataFrame([("invoice_a", 1, "p"), ("invoice_b", 2, "q"), ("zz", 3, "r"), ("keep", 4, "s")], schema)
    new = spark.createDataFrame([("invoice_a2", 1, "p"), ("invoice_b2", 5, "q"), ("quux", 3, "r"), ("keep", 4, "t")], schema)
    changes = diff_with_renames(old, new, ["k"])
    got = sorted((r["kind"], r["key"], r["old_key"], r["column"]) for r in changes.select("kind", "key", F.coalesce("old_key", F.lit("")).alias("old_key"), F.coalesce("column", F.lit("")).alias("column")).collect())
    assert got == [
        ("change", "invoice_b2", "invoice_b", "v"),
        ("change", "keep", "", "w"),
        ("create", "quux", "", ""),
        ("drop", "zz", "", ""),
        ("rename", "invoice_a2", "invoice_a", ""),
        ("rename", "invoice_b2", "invoice_b", ""),
    ]
    assert is_empty(diff(apply_changes(old, new, changes, ["k"], force_drop=True), new, ["k"]))


def test_rename_chain_is_applied_at_once(spark):
    schema = "k string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], schema), spark.createDataFrame([("b", 1), ("c", 2)], schema)
    chain = change_rows(spark.createDataFrame([("rename", "b", "a"), ("rename", "c", "b")], "kind string, key string, old_key string"))
    assert sorted(tuple(r) for r in apply_changes(old, new, chain, ["k"]).collect()) == [("b", 1), ("c", 2)]
