"""Schema changes: comparing inventories, and carrying them out on data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablechange.functions.render import field
from tablechange.functions.similarity import THRESHOLD
from tablechange.operators.changeset import to_apply
from tablechange.operators.diff import change_rows, created, dropped
from tablechange.operators.matching import fold_renames, match_names
from tablechange.session import materialize

# fixed values: type changes that keep every value
WIDER = {
    "tinyint": ["smallint", "int", "bigint", "float", "double"],
    "smallint": ["int", "bigint", "float", "double"],
    "int": ["bigint", "double"],
    "float": ["double"],
    "date": ["timestamp", "timestamp_ntz"],
}
# fixed values: decimal digits of the whole-number types
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def keeps_values(old_type: Column, new_type: Column) -> Column:
    """True where every value of the old type has a place in the new one."""
    wider = F.create_map(*[x for k, v in WIDER.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    digits = F.create_map(*[x for k, v in DIGITS.items() for x in (F.lit(k), F.lit(v))])
    decimal = r"^decimal\((\d+),\s*(\d+)\)$"

    def whole(t: Column) -> Column:
        return F.regexp_extract(t, decimal, 1).try_cast("int") - scale(t)

    def scale(t: Column) -> Column:
        return F.regexp_extract(t, decimal, 2).try_cast("int")

    grows = (whole(new_type) >= whole(old_type)) & (scale(new_type) >= scale(old_type))
    holds = whole(new_type) >= F.try_element_at(digits, old_type)
    listed = F.array_contains(F.try_element_at(wider, old_type), new_type)
    return F.coalesce(new_type == "string", F.lit(False)) | F.coalesce(listed, F.lit(False)) | F.coalesce(grows, F.lit(False)) | F.coalesce(holds, F.lit(False))


def _fits(old: Column, new: Column) -> Column:
    """``keeps_values`` of types that may end in ``NOT NULL``."""
    plain = [F.regexp_replace(t, " NOT NULL$", "") for t in (old, new)]
    stricter = new.endswith(" NOT NULL") & ~old.endswith(" NOT NULL")
    return ((plain[0] == plain[1]) | keeps_values(*plain)) & ~stricter


def quoted(column: str) -> Column:
    """A column's name as it stands in a statement: in backticks, unless it is a plain name."""
    name = F.col(column)
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def bare_type(text: str) -> str:
    """A type without its nullability."""
    return text.removesuffix(" NOT NULL")


def _no_matches(inventory: DataFrame, group: list[str]) -> DataFrame:
    """What ``match_names`` gives where there is nothing to match."""
    names = ", ".join(f"{g} string" for g in [*group, "old_name", "new_name"])
    return inventory.sparkSession.createDataFrame([], f"{names}, score double")


def diff_schemas(
    old_inv: DataFrame, new_inv: DataFrame, threshold: float = THRESHOLD, compare_nullable: bool = False, **weights
) -> DataFrame:
    """Schema changes between two inventories (``dataset, ordinal, column, type``).

    Datasets of one side only are ``create``, ``drop`` or ``rename``; in datasets of both, and in
    renamed ones, columns are ``add_column``, ``drop_column``, ``rename_column`` or
    ``retype_column``. ``scope`` is the dataset under its new name. A column renamed and retyped
    gives both rows. A retype that may lose values is destructive.
    """
    spelled = F.col("type")
    if compare_nullable:
        spelled = F.concat("type", F.when(F.col("nullable"), F.lit("")).otherwise(F.lit(" NOT NULL")))
    cols = ["dataset", "ordinal", "column", spelled.alias("type")]
    sides = [inv.select(F.lit(s).alias("side"), *cols) for s, inv in (("old", old_inv), ("new", new_inv))]
    both = materialize(sides[0].unionByName(sides[1]), "inventory")
    old_inv, new_inv = both.filter("side = 'old'").drop("side"), both.filter("side = 'new'").drop("side")

    # one job says which of the steps below have anything to do
    old_here, new_here = (F.max(F.when(F.col("side") == s, 1).otherwise(0)) for s in ("old", "new"))
    by_column = both.groupBy("dataset", "column").agg(old_here.alias("o"), new_here.alias("n"))
    by_set = by_column.groupBy("dataset").agg(F.max("o").alias("so"), F.max("n").alias("sn"), F.max(F.col("o") > F.col("n")).alias("lost"), F.max(F.col("n") > F.col("o")).alias("gained"))
    shared = (F.col("so") == 1) & (F.col("sn") == 1)
    found = by_set.agg(
        F.coalesce(F.max(F.col("so") > F.col("sn")), F.lit(False)), F.coalesce(F.max(F.col("sn") > F.col("so")), F.lit(False)),
        F.coalesce(F.max(shared & F.col("lost")), F.lit(False)), F.coalesce(F.max(shared & F.col("gained")), F.lit(False)),
    ).first()

    # datasets
    old_sets, new_sets = old_inv.select("dataset").distinct(), new_inv.select("dataset").distinct()
    gone, come = dropped(old_sets, new_sets, ["dataset"]), created(old_sets, new_sets, ["dataset"])
    may_move = found[0] and found[1]
    moved = match_names(gone, come, None, threshold, name="dataset", **weights) if may_move else _no_matches(both, [])

    def listing(inv: DataFrame, sets: DataFrame) -> DataFrame:
        # the column list is bounded by the width of one dataset
        entry = F.struct("ordinal", F.concat_ws(" ", quoted("column"), "type").alias("c"))
        lists = inv.join(sets, "dataset", "left_semi").groupBy("dataset").agg(F.array_sort(F.collect_list(entry)).alias("l"))
        return lists.select("dataset", F.array_join(F.transform("l", lambda e: e["c"]), ", ").alias("columns"))

    one_sided = change_rows(
        listing(old_inv, gone).select(F.lit("drop").alias("kind"), F.col("dataset").alias("key"), F.col("columns").alias("old_value"))
    ).unionByName(
        change_rows(listing(new_inv, come).select(F.lit("create").alias("kind"), F.col("dataset").alias("key"), F.col("columns").alias("new_value")))
    )
    sets = fold_renames(one_sided, moved, scoped=False)
    sets = sets.withColumn("scope", F.col("key"))

    # columns, with renamed datasets under their new name on both sides
    named = old_inv.join(moved.select(F.col("old_name").alias("dataset"), "new_name"), "dataset", "left")
    was = named.select(F.coalesce("new_name", "dataset").alias("scope"), F.col("column").alias("name"), "type")
    now = new_inv.select(F.col("dataset").alias("scope"), F.col("column").alias("name"), "type")
    shared = was.select("scope").distinct().join(now.select("scope").distinct(), "scope", "left_semi")
    was, now = was.join(shared, "scope", "left_semi"), now.join(shared, "scope", "left_semi")
    lost, gained = dropped(was, now, ["scope", "name"]), created(was, now, ["scope", "name"])
    # under renamed datasets any column may have been renamed too
    may_rename = may_move or (found[2] and found[3])
    renamed = match_names(lost, gained, "scope", threshold, **weights) if may_rename else _no_matches(both, ["scope"])
    adds = gained.select(F.lit("add_column").alias("kind"), "scope", F.col("name").alias("key"), F.col("type").alias("new_value"))
    drops = lost.select(F.lit("drop_column").alias("kind"), "scope", F.col("name").alias("key"), F.col("type").alias("old_value"))
    columns = fold_renames(
        change_rows(adds).unionByName(change_rows(drops)), renamed, kinds=("add_column", "drop_column", "rename_column")
    )

    # types, also under a rename
    aligned = was.join(renamed.select("scope", F.col("old_name").alias("name"), "new_name"), ["scope", "name"], "left")
    pairs = aligned.select(
        "scope",
        F.coalesce("new_name", "name").alias("name"),
        F.when(F.col("new_name").isNotNull(), F.col("name")).alias("old_key"),
        F.col("type").alias("old_type"),
    ).join(now, ["scope", "name"])
    retyped = pairs.filter(F.col("old_type") != F.col("type")).select(
        F.lit("retype_column").alias("kind"),
        "scope",
        F.col("name").alias("key"),
        "old_key",
        F.lit("type").alias("column"),
        F.col("old_type").alias("old_value"),
        F.col("type").alias("new_value"),
        # what is required from now on may be missing in old rows
        (~_fits(F.col("old_type"), F.col("type"))).alias("destructive"),
    )
    return sets.unionByName(columns).unionByName(change_rows(retyped))


def add_column(df: DataFrame, name: str, dtype: str | T.DataType) -> DataFrame:
    """A new column, null in existing rows."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(None).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return df.withColumnsRenamed({old: new})


def _retyped(c: Column, dtype: str | T.DataType, on_error: str) -> Column:
    if on_error == "fail":
        # independent of the session's ANSI setting: a value without a place raises
        kept = c.try_cast(dtype)
        reason = F.concat(F.lit("cannot cast to "), F.lit(str(dtype)), F.lit(": "), c.cast("string"))
        return F.when(c.isNotNull() & kept.isNull(), F.raise_error(reason)).otherwise(kept)
    if on_error == "null":
        return c.try_cast(dtype)
    raise ValueError(f"on_error is 'fail' or 'null', not {on_error!r}")


def retype_column(df: DataFrame, name: str, dtype: str | T.DataType, on_error: str = "fail") -> DataFrame:
    """Change a column's type. A value that cannot be cast fails the job, or becomes null."""
    return df.select([_retyped(field(c), dtype, on_error).alias(c) if c == name else field(c) for c in df.columns])


def lost_values(df: DataFrame, types: dict[str, str]) -> dict[str, int]:
    """How many values of each column do not survive the cast and back; one pass for all."""
    if not types:
        return {}
    counts = []
    for name, dtype in types.items():
        c = field(name)
        back = c.try_cast(bare_type(dtype)).try_cast(df.schema[name].dataType)
        lost = ~c.eqNullSafe(back)
        counts.append(F.count(F.when(lost | c.isNull() if dtype.endswith(" NOT NULL") else lost, 1)).alias(name))
    return df.agg(*counts).first().asDict()


def evolve(
    df: DataFrame,
    changes: DataFrame,
    force_drop: bool = False,
    on_error: str = "fail",
    columns: list[str] | None = None,
    check_values: bool = True,
) -> DataFrame:
    """Carry out the column changes of one dataset in one ``select``, so the data is read once.

    The change list (at most a few rows per column) is read on the driver. A destructive retype
    is carried out without force when ``check_values`` finds in one pass that no value is lost.
    Changes of nullability alone leave the data as it is (a DataFrame cannot promise it), but a
    column that becomes required is checked for nulls like any narrowing.
    ``columns`` gives the order of the result; else renamed columns keep their place and new ones
    follow. Drops wait for ``force_drop``; such columns come last.
    """
    wanted = changes.filter(F.col("kind").isin("add_column", "drop_column", "rename_column", "retype_column"))
    # what is new, and what concerns a column of the dataset, each once
    mine = (F.col("kind") == "add_column") | F.coalesce("old_key", "key").isin(df.columns)
    rows = to_apply(wanted.filter(mine), force_drop=True).select("kind", "key", "old_key", "new_value", "destructive").distinct().collect()
    renames = {r["old_key"]: r["key"] for r in rows if r["kind"] == "rename_column"}
    adds = [(r["key"], bare_type(r["new_value"])) for r in rows if r["kind"] == "add_column"]
    drops = {r["key"] for r in rows if r["kind"] == "drop_column"} if force_drop else set()
    retypes = {r["old_key"] or r["key"]: r["new_value"] for r in rows if r["kind"] == "retype_column"}
    risky = {r["old_key"] or r["key"] for r in rows if r["kind"] == "retype_column" and r["destructive"]}
    if risky and not force_drop:
        lost = lost_values(df, {c: retypes[c] for c in risky}) if check_values else dict.fromkeys(risky, 1)
        retypes = {c: t for c, t in retypes.items() if not lost.get(c)}
    out: dict[str, Column] = {}
    for c in df.columns:
        if c not in drops:
            value = _retyped(field(c), bare_type(retypes[c]), on_error) if c in retypes else field(c)
            out[renames.get(c, c)] = value
    for name, dtype in adds:
        if name in out:
            raise ValueError(f"column {name} exists")
        out[name] = F.lit(None).cast(dtype)
    order = [c for c in columns or [] if c in out]
    order += [c for c in out if c not in order]
    return df.select([out[c].alias(c) for c in order])
