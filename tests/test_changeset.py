import pytest

from tablechange.operators.changeset import (
    gate_destructive,
    mark_ignored,
    mentions,
    order_changes,
    pull_back,
    render_changes,
    select_changes,
    to_apply,
    visible,
    write_script,
)
from tablechange.operators.closure import impact_closure
from tablechange.operators.diff import change_rows, diff
from tablechange.operators.merge import apply_changes
from tablechange.operators.sequence import number_rows


def changes(spark, rows, schema="kind string, key string, old_key string, scope string"):
    return change_rows(spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], schema))


PATTERNS = ["temp_*", "*_backup", "exact", "*mid*"]
NAMES = ["temp_a", "temp_", "tem", "a_backup", "_backup", "a_backups", "exact", "exactly", "amidst", "mid", "md"]


@pytest.mark.parametrize("as_table", [False, True])
def test_ignore_patterns(spark, as_table):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "p string") if as_table else PATTERNS
    rows = [("create", n) for n in NAMES] + [("rename", "fine", "temp_x"), ("rename", "temp_y", "fine2"), ("rename", "fine3", "fine4")]
    got = {(r["key"], r["old_key"]): r["ignored"] for r in mark_ignored(changes(spark, rows), patterns).collect()}
    hit = {k[0] for k, v in got.items() if v}
    assert hit == {"temp_a", "temp_", "a_backup", "_backup", "exact", "amidst", "mid", "fine", "temp_y"}
    assert len(got) == len(rows)


def test_star_alone_and_no_patterns(spark):
    cs = changes(spark, [("create", "a"), ("drop", "b")])
    assert mark_ignored(cs, ["*"]).filter("ignored").count() == 2
    assert mark_ignored(cs, spark.createDataFrame([("*",)], "p string")).filter("ignored").count() == 2
    assert visible(mark_ignored(cs, [])).count() == 2
    assert visible(mark_ignored(cs, ["*"])).count() == 0
    assert visible(mark_ignored(cs, ["*"]), show_ignored=True).count() == 2


def test_long_pattern_lists_are_joined(spark):
    cs = changes(spark, [("create", "p7_x"), ("create", "q")])
    got = {r["key"]: r["ignored"] for r in mark_ignored(cs, [f"p{i}_*" for i in range(500)]).collect()}
    assert got == {"p7_x": True, "q": False}


def test_gate(spark):
    cs = changes(spark, [("create", "a"), ("drop", "b"), ("drop_column", "c"), ("same", "d")])
    assert {r["key"] for r in gate_destructive(cs).collect()} == {"a", "d"}
    assert {r["key"] for r in to_apply(cs, True).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("whole", [False, True])
def test_mentions_match_brute_force(spark, whole):
    import random
    import re

    rng = random.Random(3)
    words = ["user", "users", "a", "ab", "order_items", "x.y", "größe", "😀", "the quick brown fox jumps over the lazy dog " * 3, "a+b"]
    texts = ["", "a", "SELECT * FROM users", "users.x.y", "größen", "größe!", "x😀y"] + [
        " ".join(rng.choice(words + ["select", "from", ","]) for _ in range(rng.randint(1, 40))) for _ in range(60)
    ]
    texts.append("z" * 501 + "order_items" + "z" * 77)
    defs = spark.createDataFrame(list(enumerate(texts)), "def_id int, text string")
    names = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "name string")

    def hit(name, text):
        if whole:
            return re.search(r"(?<!\w)" + re.escape(name) + r"(?!\w)", text) is not None
        return name in text

    want = {(i, w) for i, t in enumerate(texts) for w in words if hit(w, t)}
    assert {(r["def_id"], r["name"]) for r in mentions(defs, names, whole_word=whole).collect()} == want


def test_closure_ends_on_cycles_and_takes_least_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("c", "d"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert {tuple(r) for r in impact_closure(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {tuple(r) for r in impact_closure(edges, seeds, max_depth=1).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in impact_closure(edges, spark.createDataFrame([("q",)], "node string")).collect()} == {("q", 0)}


def test_deselecting_locks_dependents_and_ignored_stay(spark):
    cs = mark_ignored(changes(spark, [("create", k) for k in "abcd"]), ["d"])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    pick = lambda keys: {
        r["key"]: (r["selected"], r["locked"]) for r in select_changes(cs, spark.createDataFrame([(k,) for k in keys], "k string"), edges).collect()
    }
    assert pick("b") == {"a": (True, False), "b": (False, False), "c": (False, True), "d": (True, False)}
    assert pick("d") == {k: (True, False) for k in "abcd"}


def test_numbers_follow_the_order_whatever_the_partitions(spark):
    rows = [("s" if i % 3 else None, f"k{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "scope string, key string").repartition(7)
    got = number_rows(df, ["scope"], ["key"]).collect()
    for scope in ("s", None):
        keys = sorted(r["key"] for r in got if r["scope"] == scope)
        assert [r["key"] for r in sorted((r for r in got if r["scope"] == scope), key=lambda r: r["seq"])] == keys
        assert sorted(r["seq"] for r in got if r["scope"] == scope) == list(range(1, len(keys) + 1))


def test_orders(spark):
    cs = changes(spark, [("drop", "a"), ("rename", "c", "b"), ("create", "d"), ("replace", "v"), ("change", "a2")])
    review = {r["key"]: r["phase"] for r in order_changes(cs).collect()}
    assert review == {"d": 1, "v": 1, "c": 2, "a2": 2, "a": 3}
    apply = {r["key"]: r["phase"] for r in order_changes(cs, "apply").collect()}
    assert apply["d"] < apply["v"] < apply["a"]
    with pytest.raises(ValueError):
        order_changes(cs, "other")


def test_rendered_rows_and_script(spark, tmp_path):
    old = spark.createDataFrame([("it's", 1), ("b", 2), ("c", 3)], "k string, `v v` int")
    new = spark.createDataFrame([("it's", 5), ("b", None), ("d", 4)], "k string, `v v` int")
    cs = order_changes(diff(old, new, ["k"]), "apply")
    got = [r["statement"] for r in render_changes(cs, "db.t", "k", force_drop=True).orderBy("phase", "seq").collect()]
    assert got == [
        "UPDATE `db`.`t` SET `v v` = NULL WHERE `k` = 'b';",
        "INSERT INTO `db`.`t` SELECT * FROM `db`.`t_new` WHERE `k` = 'd';",
        "UPDATE `db`.`t` SET `v v` = '5' WHERE `k` = 'it''s';",
        "DELETE FROM `db`.`t` WHERE `k` = 'c';",
    ]
    assert not any("DELETE" in r["statement"] for r in render_changes(cs, "t", "k").collect())
    write_script(render_changes(cs, "db.t", "k"), str(tmp_path / "script"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "script")).collect()) == sorted(got[:3])


def test_rendered_definitions(spark):
    rows = [("replace", "v", " create  VIEW v AS SELECT 1;"), ("replace", "w", "CREATE OR REPLACE VIEW w AS SELECT 2 "), ("replace", "x", "  ")]
    cs = change_rows(spark.createDataFrame(rows, "kind string, key string, new_value string"))
    got = {r["statement"] for r in render_changes(cs).collect()}
    assert got == {" create  OR REPLACE VIEW v AS SELECT 1;", "CREATE OR REPLACE VIEW w AS SELECT 2;"}


def test_rendered_compound_keys_run(spark):
    schema = "a string, b string, v string"
    old = spark.createDataFrame([("1.2", "x\\", "it\\n's"), ("1", "2.x", "u"), ("gone", ".", "w")], schema)
    new = spark.createDataFrame([("1.2", "x\\", "a\\tb'c"), ("1", "2.x", "u"), ("new.", "\\.", "z")], schema)
    changes = order_changes(diff(old, new, ["a", "b"]), "apply")
    statements = [r["statement"] for r in render_changes(changes, "t", ["a", "b"], force_drop=True).orderBy("phase", "seq").collect()]
    old.createOrReplaceTempView("t")
    new.createOrReplaceTempView("t_new")
    for text in statements:
        where = text[text.index(" WHERE ") : -1]
        source = "t_new" if text.startswith("INSERT") else "t"
        assert spark.sql(f"SELECT * FROM {source}{where}").count() == 1, text
    update = next(t for t in statements if t.startswith("UPDATE"))
    value = update[update.index("SET `v` = ") + len("SET `v` = ") : update.index(" WHERE ")]
    assert spark.sql(f"SELECT {value}").first()[0] == "a\\tb'c"


def test_dropped_objects_by_kind(spark):
    rows = [("drop", "v1", "CREATE OR REPLACE VIEW v1 AS SELECT 1"), ("drop", "f1", "create function f1() returns int return 1"), ("drop", "t1", "a int"), ("drop", "t2", None)]
    cs = change_rows(spark.createDataFrame(rows, "kind string, key string, old_value string"))
    got = {r["statement"] for r in render_changes(cs, force_drop=True).collect()}
    assert got == {"DROP VIEW `v1`;", "DROP FUNCTION `f1`;", "DROP TABLE `t1`;", "DROP TABLE `t2`;"}


def test_pulled_back_rows_leave_the_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 3)], "k string, v int")
    back = pull_back(new, old, diff(old, new, ["k"]), ["k"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", 3), ("b", 2)]
    assert [r["kind"] for r in diff(old, back, ["k"]).collect()] == ["change"]
    some = spark.createDataFrame([("zz",)], "key string")
    assert pull_back(new, old, some, ["k"]).count() == 1


def test_a_rename_follows_either_name(spark):
    cs = changes(spark, [("rename", "new_a", "a"), ("rename", "b2", "b"), ("create", "c")])
    edges = spark.createDataFrame([("a", "b2")], "src string, dst string")
    got = select_changes(cs, spark.createDataFrame([("a",)], "k string"), edges).collect()
    assert {r["key"]: (r["selected"], r["locked"]) for r in got} == {"new_a": (False, False), "b2": (False, True), "c": (True, False)}


def test_a_deep_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "src string, dst string")
    reach = impact_closure(edges, spark.createDataFrame([("n0",)], "node string"))
    assert {r["node"]: r["depth"] for r in reach.collect()} == {f"n{i}": i for i in range(31)}


def test_many_patterns_with_two_stars(spark):
    rows = [{"kind": "drop", "key": f"table_{i:04d}_x"} for i in range(300)] + [{"kind": "drop", "key": None}, {"kind": "drop", "key": ""}]
    changes = change_rows(spark.createDataFrame(rows, "kind string, key string"))
    patterns = [f"*{i:04d}*" for i in range(0, 3000, 3)]
    got = {r["key"] for r in mark_ignored(changes, patterns).filter("ignored").collect()}
    assert got == {f"table_{i:04d}_x" for i in range(0, 300, 3)}
    every = mark_ignored(changes, [*patterns, "**"]).filter("ignored")
    assert every.count() == 301  # any name, also the empty one; no name is no match


def test_changes_under_a_deselected_rename(spark):
    old = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 3)], "k string, v int")
    changes = change_rows(
        spark.createDataFrame(
            [("rename", "b", "a", None, False), ("change", "b", "a", "v", True)],
            "kind string, key string, old_key string, column string, selected boolean",
        )
    )
    assert sorted(map(tuple, apply_changes(old, new, changes, ["k"]).collect())) == [("a", 5), ("c", 3)]


def test_rename_and_create_of_the_old_key(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 7), ("b", 1)], "k string, v int")
    changes = change_rows(spark.createDataFrame([("rename", "b", "a"), ("create", "a", None)], "kind string, key string, old_key string"))
    assert sorted(map(tuple, apply_changes(old, new, changes, ["k"]).collect())) == [("a", 7), ("b", 1)]
    there = change_rows(spark.createDataFrame([("create", "a")], "kind string, key string"))
    assert [tuple(r) for r in apply_changes(old, new, there, ["k"]).collect()] == [("a", 1)]
