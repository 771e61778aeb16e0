import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import types as T

from tablechange.functions import linediff
from tablechange.functions.linediff import edit_script, equal_items, line_diff, side_by_side
from tablechange.functions.render import csv_line, quote_name, render_text
from tablechange.functions.text import canonical_outside_quotes, canonical_text, fingerprint, interpolate


def one(df):
    return [r[0] for r in df.collect()]


def test_interpolate(spark):
    rows = [
        ("${A} and ${B}${A}.", {"A": "x${B}", "B": "y"}, "x${B} and yx${B}."),
        ("${not-a} ${} $A {A} ${A", {"A": "1", "not-a": "2"}, "${not-a} ${} $A {A} ${A"),
        ("${A}", {}, "${A}"),
        ("${A}", {"A": None}, "${A}"),
        ("${A}", {"A": ""}, ""),
        ("", {"A": "1"}, ""),
        (None, {"A": "1"}, None),
        ("${A_1}\n${ü}", {"A_1": r"\1$0", "ü": "no"}, "\\1$0\n${ü}"),
    ]
    df = spark.createDataFrame(rows, "t string, m map<string,string>, want string")
    for r in df.select("want", interpolate("t", "m").alias("got")).collect():
        assert r["got"] == r["want"]


def test_canonical(spark):
    df = spark.createDataFrame([("  SELECT\n\t 1 ",), ("select 1",), ("select  2",)], "t string")
    assert one(df.select(canonical_text("t"))) == ["select 1", "select 1", "select 2"]
    assert len(set(one(df.select(fingerprint("t"))))) == 2


def test_canonical_outside_quotes(spark):
    rows = [
        ("  SELECT\n 'A  b'  AS \"My  Col\"\t", "select 'A  b' as \"My  Col\""),
        ("X = 'it''S  A'  AND `Q  q`", "x = 'it''S  A' and `Q  q`"),
        ("A  \"un'closed  B", "a \"un'closed b"),
        ("''  ''", "'' ''"),
        ("", ""),
        ("   ", ""),
        (None, None),
        ("'" + "Ab  " * 50_000 + "'  C", "'" + "Ab  " * 50_000 + "' c"),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", canonical_outside_quotes("t").alias("got")).collect():
        assert r["got"] == r["want"]


def test_rendering(spark):
    schema = T.StructType(
        [
            T.StructField("d", T.DoubleType()), T.StructField("f", T.FloatType()), T.StructField("i", T.LongType()),
            T.StructField("b", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("ts", T.TimestampNTZType()),
            T.StructField("dt", T.DateType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("q.r", T.StringType()),
        ]
    )
    rows = [
        (1e10, 0.5, -3, True, bytearray(b"z"), datetime(1960, 1, 2, 3, 4, 5, 678), date(1999, 1, 2), [1, 2], "t"),
        (-1.5e-9, 1e20, None, None, None, None, None, None, None),
        (123456789.25, -0.0, 0, False, None, None, None, [], ""),
        (float("nan"), float("-inf"), 0, False, None, None, None, None, "NULL"),
    ]
    got = [tuple(r) for r in render_text(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("10000000000", "0.5", "-3", "true", "[BLOB]", "1960-01-02 03:04:05.000678", "1999-01-02", "[1,2]", "t"),
        ("-0.0000000015", "100000000000000000000", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"),
        ("123456789.25", "-0", "0", "false", "NULL", "NULL", "NULL", "[]", ""),
        ("NaN", "-inf", "0", "false", "NULL", "NULL", "NULL", "NULL", "NULL"),
    ]


def test_rendering_of_time_decimal_and_interval(spark):
    df = spark.sql("SELECT time'01:02:03' a, time'01:02:03.5' b, 1.50BD c, interval 1 day d, named_struct('x', 1) e, 12345678901234567890123456789012345678BD f")
    assert tuple(render_text(df).first()) == ("01:02:03.000000", "01:02:03.500000", "1.50", "INTERVAL '1' DAY", '{"x":1}', "12345678901234567890123456789012345678")


def test_csv_line(spark):
    df = spark.createDataFrame([("a,b", 'q"q', "l\nl", None, "", " pad ")], "a string, b string, c string, d string, e string, f string")
    assert one(csv_line(df)) == ['"a,b","q""q","l\nl",NULL,, pad ']


def test_quote_name():
    assert quote_name("s.t`x") == "`s`.`t``x`"


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("letters", [2, 4, 12])
def test_equal_items_are_a_longest_common_subsequence(letters):
    rng = random.Random(letters)
    for _ in range(300):
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 14))]
        b = [rng.randrange(letters) for _ in range(rng.randint(0, 14))]
        pairs = equal_items(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b)


def test_edit_script_rebuilds_both_texts():
    rng = random.Random(7)
    for _ in range(200):
        old = "\n".join(rng.choice(["a", "b", "", "c "]) for _ in range(rng.randint(0, 9)))
        new = "\n".join(rng.choice(["a", "b", "", "d"]) for _ in range(rng.randint(0, 9)))
        script = edit_script(old, new)
        assert "\n".join(s[3] for s in script if s[0] != "insert") == old
        assert "\n".join(s[3] for s in script if s[0] != "delete") == new
        tags = "".join(s[0][0] for s in script)
        assert "id" not in tags  # deletes come first inside a change


def test_large_difference_in_linear_memory():
    old = "\n".join(str(i % 50) for i in range(1500))
    new = "\n".join(str((i * 7) % 50) for i in range(1500))
    script = edit_script(old, new)
    assert "\n".join(s[3] for s in script if s[0] != "delete") == new


@pytest.mark.parametrize("near", [0, 1, 64])
def test_bit_vectors_find_longest_common_subsequences(monkeypatch, near):
    monkeypatch.setattr(linediff, "NEAR", near)
    rng = random.Random(near)
    for _ in range(300):
        a = [rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(30))]
        pairs = equal_items(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b)


def test_whole_rewrite_of_a_long_text():
    rng = random.Random(11)
    old, new = (" ".join(str(rng.randrange(40)) for _ in range(3000)).replace(" ", "\n") for _ in range(2))
    script = edit_script(old, new)
    assert "\n".join(s[3] for s in script if s[0] != "delete") == new
    # the same length as the table of all cells, by numpy
    a, b = old.split("\n"), np.array(new.split("\n"))
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    assert sum(s[0] == "equal" for s in script) == row[-1]
    twice = "\n".join(str(i) for i in range(20_000))
    assert len(edit_script(twice, "\n".join(f"n{i}" if i % 3 else str(i) for i in range(20_000)))) > 20_000


def test_line_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "same", "same"), (3, None, "n")], "k int, o string, n string")
    got = {(r["id"], r["pos"]): (r["tag"], r["old_line_no"], r["new_line_no"], r["line"]) for r in line_diff(df, "k", "o", "n").collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {
        (1, 1): ("equal", 1, 1, "a"), (1, 2): ("delete", 2, None, "b"), (1, 3): ("insert", None, 2, "x"), (1, 4): ("equal", 3, 3, "c"),
    }
    assert not any(k[0] == 2 for k in got)
    assert line_diff(df, "k", "o", "n", with_same=True).filter("id = 2").count() == 1
    shown = {(r["id"], r["pos"]): (r["left"], r["right"]) for r in side_by_side(line_diff(df, "k", "o", "n")).collect()}
    assert shown[(1, 1)] == ("  a", "  a") and shown[(1, 2)] == ("- b", "") and shown[(1, 3)] == ("", "+ x")
