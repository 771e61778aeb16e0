"""Keyed diff of two snapshots.

All functions take DataFrames with one row per key (see ``sources.snapshots.keyed_snapshot``)
and return DataFrames; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablechange.functions.render import field, key_text, named_text, reference, value_text
from tablechange.functions.text import canonical_outside_quotes, canonical_text
from tablechange.session import materialize

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("old_key", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("destructive", T.BooleanType()),
        T.StructField("selected", T.BooleanType()),
        T.StructField("locked", T.BooleanType()),
        T.StructField("ignored", T.BooleanType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

# review order: what appears, what is altered, what goes
PHASE = {
    "create": 1, "replace": 1, "same": 1,
    "change": 2, "rename": 2, "add_column": 2, "rename_column": 2, "retype_column": 2,
    "drop": 3, "drop_column": 3,
}
DESTRUCTIVE = ["drop", "drop_column"]


def phase_of(kind: Column, phases: dict[str, int] = PHASE) -> Column:
    out = F.lit(None).cast("int")
    for phase in sorted(set(phases.values())):
        out = F.when(kind.isin([k for k, p in phases.items() if p == phase]), phase).otherwise(out)
    return out


def change_rows(df: DataFrame) -> DataFrame:
    """Bring a DataFrame that has some change-set columns to the full change-set schema."""
    have = set(df.columns)
    defaults = {
        "destructive": F.col("kind").isin(DESTRUCTIVE),
        "selected": F.lit(True),
        "locked": F.lit(False),
        "ignored": F.lit(False),
        "phase": phase_of(F.col("kind")),
    }
    out = []
    for f in CHANGE_SCHEMA.fields:
        c = F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(out)


def created(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``."""
    return new.join(old.select(keys), keys, "left_anti")


def dropped(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``."""
    return old.join(new.select(keys), keys, "left_anti")


def _comparable(c: Column, dtype: T.DataType) -> Column:
    """Maps and variants have no equality in Spark; sorted entries and JSON texts do."""
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    return F.array_sort(F.map_entries(c)) if isinstance(dtype, T.MapType) else c


def _attributes(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str] | None, scope: str | None) -> list[str]:
    attrs = [c for c in new.columns if c not in keys and c != scope] if attrs is None else list(attrs)
    missing = [c for c in [*keys, *attrs] if c not in old.columns or c not in new.columns]
    if missing:
        raise ValueError(f"columns missing on one side: {missing}; compare the schemas first")
    return attrs


def _side(df: DataFrame, keys: list[str], attrs: list[str], scope: str | None, tag: str) -> DataFrame:
    cols = [field(k).alias(f"k{i}") for i, k in enumerate(keys)]
    body = [field(a).alias(a) for a in attrs]
    if scope:
        body.append(field(scope).cast("string").alias("__scope"))
    body.append(F.lit(True).alias("__here"))
    return df.select(*cols, F.struct(*body).alias(tag))


def _differs(old: DataFrame, new: DataFrame, attr: str) -> Column:
    a, b = F.col(f"o.`{attr}`"), F.col(f"n.`{attr}`")
    return ~_comparable(a, old.schema[attr].dataType).eqNullSafe(_comparable(b, new.schema[attr].dataType))


class _Compared:
    """Attribute by attribute: does it differ, and both texts."""

    def __init__(self, old: DataFrame, new: DataFrame, attrs: list[str]):
        self.differs = {a: _differs(old, new, a) for a in attrs}
        self.old_text = {a: value_text(reference(a, "o."), old.schema[a].dataType) for a in attrs}
        self.new_text = {a: value_text(reference(a, "n."), new.schema[a].dataType) for a in attrs}

    def any_differs(self) -> Column:
        return reduce(lambda x, y: x | y, self.differs.values(), F.lit(False))

    def changes(self) -> Column:
        """One entry per attribute that differs."""
        entries = [
            F.when(
                d,
                F.struct(F.lit(a).alias("column"), self.old_text[a].alias("old_value"), self.new_text[a].alias("new_value")),
            )
            for a, d in self.differs.items()
        ]
        return F.array_compact(F.array(*entries))


def changed(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str] | None = None) -> DataFrame:
    """One row per key in both sides and attribute that differs; null equals null."""
    attrs = _attributes(old, new, keys, attrs, None)
    on = [f"k{i}" for i in range(len(keys))]
    both = _side(old, keys, attrs, None, "o").join(_side(new, keys, attrs, None, "n"), on)
    compared = _Compared(old, new, attrs)
    return (
        both.filter(compared.any_differs())
        .select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(compared.changes()).alias("c"))
        .select(*[field(k) for k in keys], "c.column", "c.old_value", "c.new_value")
    )


def row_digest(df: DataFrame, attrs: list[str]) -> Column:
    """128 bits over the attributes; the second half is seeded by the first."""
    cells = []
    for a in attrs:
        c = _comparable(field(a), df.schema[a].dataType)
        cells += [c, c.isNull()]
    first = F.xxhash64(*cells)
    return F.struct(first.alias("a"), F.xxhash64(F.lit("second"), first, *reversed(cells)).alias("b"))


def _keep_differing(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Only the rows whose key is new, gone, or carries another digest."""
    o = old.select(*[field(k) for k in keys], row_digest(old, attrs).alias("__o"))
    n = new.select(*[field(k) for k in keys], row_digest(new, attrs).alias("__n"))
    touched = o.join(n, keys, "full_outer").filter(~F.col("__o").eqNullSafe(F.col("__n"))).select(*[field(k) for k in keys])
    # written once: its size is then known, so a small set is broadcast to both sides and the rows
    # of neither are shuffled before they are filtered
    touched = materialize(touched, "touched")
    return old.join(touched, keys, "left_semi"), new.join(touched, keys, "left_semi")


def diff(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    attrs: list[str] | None = None,
    with_same: bool = False,
    scope: str | None = None,
    digest_first: bool = False,
) -> DataFrame:
    """The change set between two snapshots: ``create``, ``drop``, one ``change`` per attribute,
    and ``same`` on request.

    One full outer join, so each side is shuffled once (not at all when both are bucketed by
    the keys). ``digest_first`` joins 128-bit digests of the attributes before the rows
    themselves: for wide rows that rarely change only keys and digests are shuffled in full.
    Then two different rows are taken for equal with probability 2^-128.
    """
    attrs = _attributes(old, new, keys, attrs, scope)
    if digest_first and not with_same:
        old, new = _keep_differing(old, new, keys, attrs)
    on = [f"k{i}" for i in range(len(keys))]
    both = _side(old, keys, attrs, scope, "o").join(_side(new, keys, attrs, scope, "n"), on, "full_outer")
    in_old, in_new = F.col("o.__here").isNotNull(), F.col("n.__here").isNotNull()
    compared = _Compared(old, new, attrs)
    differs = compared.any_differs()
    kind = (
        F.when(~in_old, "create").when(~in_new, "drop").when(differs, "change").otherwise("same")
    )
    text = T.StringType()
    empty = F.lit(None).cast(text)
    whole = F.array(
        F.struct(
            empty.alias("column"),
            F.when(in_old, named_text(compared.old_text)).alias("old_value"),
            F.when(in_new, named_text(compared.new_text)).alias("new_value"),
        )
    )
    key = key_text([(f"k{i}", new.schema[k].dataType) for i, k in enumerate(keys)])
    where = F.coalesce(F.col("n.__scope"), F.col("o.__scope")) if scope else empty
    if not with_same:
        both = both.filter(~in_old | ~in_new | differs)
    parts = F.when(kind == "change", compared.changes()).otherwise(whole) if attrs else whole
    rows = both.select(kind.alias("kind"), where.alias("scope"), key.alias("key"), F.explode(parts).alias("c"))
    return change_rows(rows.select("kind", "scope", "key", "c.column", "c.old_value", "c.new_value"))


def diff_summary(changes: DataFrame) -> DataFrame:
    """How many changes of each kind, per attribute where one is named."""
    return changes.groupBy("kind", "column").agg(F.count("*").alias("n"))


def is_empty(changes: DataFrame) -> bool:
    """True when no row is left but ``same`` ones; reads at most one row."""
    return changes.filter("kind <> 'same'").isEmpty()


def diff_bags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of data without a key, as counted rows: ``change`` is ``create`` or ``drop``,
    ``copies`` how many copies of the row one side has beyond the other.

    One grouping with partial sums instead of two ``exceptAll``: copies are added up before the
    shuffle, so a row repeated many times stays one row per task, and both directions share it.
    """
    cols = [field(c) for c in new.columns]
    signed = old.select(*cols, F.lit(-1).cast("long").alias("__d")).unionByName(new.select(*cols, F.lit(1).cast("long").alias("__d")))
    return (
        signed.groupBy(*cols)
        .agg(F.sum("__d").alias("__d"))
        .filter("__d <> 0")
        .select(F.when(F.col("__d") > 0, "create").otherwise("drop").alias("change"), *cols, F.abs("__d").alias("copies"))
    )


def diff_definitions(
    old: DataFrame, new: DataFrame, key: str = "name", definition: str = "definition", canonical: bool = False, quotes: bool = False
) -> DataFrame:
    """Text definitions: a new or different text is one ``replace``, a missing one a ``drop``.
    With ``canonical`` only differences beyond case and whitespace count; with ``quotes`` too, but within
    quotes every difference does."""
    shown = [F.col(key), F.col(definition)]
    o, n = old.select(shown), new.select(shown)
    o = o.select(F.col(key).alias("k"), F.struct(F.col(definition).alias("d"), F.lit(True).alias("here")).alias("o"))
    n = n.select(F.col(key).alias("k"), F.struct(F.col(definition).alias("d"), F.lit(True).alias("here")).alias("n"))
    form = canonical_outside_quotes if quotes else canonical_text if canonical else (lambda c: c)
    both = o.join(n, "k", "full_outer")
    gone = F.col("n.here").isNull()
    differs = F.col("o.here").isNull() | ~form(F.col("o.d")).eqNullSafe(form(F.col("n.d")))
    rows = both.filter(gone | differs).select(
        F.when(gone, "drop").otherwise("replace").alias("kind"),
        key_text([("k", new.schema[key].dataType)]).alias("key"),
        F.col("o.d").alias("old_value"),
        F.col("n.d").alias("new_value"),
    )
    return change_rows(rows)
