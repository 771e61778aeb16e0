"""Schema changes inside structs, arrays and maps.

The type tree of a dataset is walked to its structs. Each struct is compared like a dataset of its own:
its scope is the dataset's name and the path to it, such as ``orders:items[].price`` (``[]`` stands for the
elements of an array, ``{}`` and ``{key}`` for the values and keys of a map), its columns are its fields, and
what lies in a field that is a struct itself is left to that struct. Levels are compared from the top, so
the fields of a renamed struct are compared under its new name instead of being dropped and added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablechange.functions.render import field
from tablechange.functions.similarity import THRESHOLD
from tablechange.operators.changeset import to_apply
from tablechange.operators.diff import change_rows
from tablechange.operators.schemas import _retyped, diff_schemas
from tablechange.session import materialize
from tablechange.sources.inventory import INVENTORY

ELEMENT, VALUE, KEY = "[]", "{}", "{key}"


def shape(dtype: T.DataType) -> str:
    """The name of a type without the fields of structs."""
    if isinstance(dtype, T.StructType):
        return "struct"
    if isinstance(dtype, T.ArrayType):
        return f"array<{shape(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"map<{shape(dtype.keyType)},{shape(dtype.valueType)}>"
    return dtype.simpleString()


def _path(scope: str, name: str) -> str:
    """The scope of a field: in backticks, unless it is a plain name."""
    plain = name.replace("_", "a").isalnum() and name.isascii()
    return scope + (":" if ":" not in scope else ".") + (name if plain else "`" + name.replace("`", "``") + "`")


def _inside(scope: str, name: str, dtype: T.DataType) -> Iterator[tuple[str, T.StructType]]:
    """The nearest structs within a field, with their scopes."""

    def down(path: str, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            yield path, dtype
        elif isinstance(dtype, T.ArrayType):
            yield from down(path + ELEMENT, dtype.elementType)
        elif isinstance(dtype, T.MapType):
            yield from down(path + KEY, dtype.keyType)
            yield from down(path + VALUE, dtype.valueType)

    return down(_path(scope, name), dtype)


def _next_level(level: dict[str, T.StructType], renamed: dict[tuple[str, str], str]) -> dict[str, T.StructType]:
    """The structs one level down, their scopes spelled with the new names of renamed fields."""
    return {path: inner for scope, struct in level.items() for f in struct.fields for path, inner in _inside(scope, renamed.get((scope, f.name), f.name), f.dataType)}


def _inventory(spark: SparkSession, level: dict[str, T.StructType]) -> DataFrame:
    rows = [(scope, i, f.name, shape(f.dataType), f.nullable) for scope, s in level.items() for i, f in enumerate(s.fields, start=1)]
    return spark.createDataFrame(rows, INVENTORY)


def diff_nested_schemas(
    spark: SparkSession, old: dict[str, T.StructType], new: dict[str, T.StructType], threshold: float = THRESHOLD, **weights
) -> DataFrame:
    """The changes between the schemas of datasets, as ``diff_schemas`` gives them, at all levels.

    ``scope`` is the struct in which a field changes. What is inside an added, dropped or differently shaped
    field is not listed again. A field of a struct that becomes an array of it, say, is a destructive
    retype. The schemas are on the driver anyway; one comparison is run per level.
    """
    out, below = [], False
    while old and new:
        changes = diff_schemas(_inventory(spark, old), _inventory(spark, new), threshold, **weights)
        changes = materialize(changes, "level")
        out.append(changes)
        moved = changes.filter("kind IN ('rename', 'rename_column')").select("kind", "scope", "key", "old_key").collect()
        if not below:
            old = {next((r["key"] for r in moved if r["kind"] == "rename" and r["old_key"] == name), name): s for name, s in old.items()}
        renamed = {(r["scope"], r["old_key"]): r["key"] for r in moved if r["kind"] == "rename_column"}
        below = True
        old, new = _next_level({k: s for k, s in old.items() if k in new}, renamed), _next_level(new, {})
        # structs of one side only are part of a change one level up
        old, new = {k: s for k, s in old.items() if k in new}, {k: s for k, s in new.items() if k in old}
    return reduce(DataFrame.unionByName, out) if out else change_rows(spark.createDataFrame([], "kind string"))


class _Plan:
    """What happens to the fields of each struct, by scope."""

    def __init__(self, rows: list, force_drop: bool):
        self.renames, self.adds, self.drops, self.retypes, self.risky = {}, {}, set(), {}, []
        for r in rows:
            scope, at = r["scope"], (r["scope"], r["old_key"] or r["key"])
            if r["kind"] == "rename_column":
                self.renames[at] = r["key"]
            elif r["kind"] == "add_column":
                self.adds.setdefault(scope, []).append((r["key"], r["new_value"]))
            elif r["kind"] == "drop_column" and force_drop:
                self.drops.add(at)
            elif r["kind"] == "retype_column":
                self.retypes[at] = r["new_value"]
                if r["destructive"]:
                    self.risky.append(at)


def _rebuilt(c: Column, dtype: T.DataType, scope: str, plan: _Plan, target: T.DataType | None, on_error: str) -> Column:
    """A value with the changes of all structs inside it. ``target`` gives whole types for added fields."""
    if isinstance(dtype, T.StructType):
        out = {}
        wanted = {f.name: f.dataType for f in target.fields} if isinstance(target, T.StructType) else {}
        for f in dtype.fields:
            at = (scope, f.name)
            if at in plan.drops:
                continue
            name = plan.renames.get(at, f.name)
            value = c.getField(f.name)
            if at in plan.retypes:
                value = _retyped(value, wanted.get(name, plan.retypes[at]), on_error)
            else:
                value = _rebuilt(value, f.dataType, _path(scope, name), plan, wanted.get(name), on_error)
            if name in out:
                raise ValueError(f"field {name} exists in {scope}")
            out[name] = value.alias(name)
        for name, dtype_text in plan.adds.get(scope, []):
            if name in out:
                raise ValueError(f"field {name} exists in {scope}")
            if name not in wanted and "struct" in dtype_text:
                raise ValueError(f"the type of {scope}.{name} needs the new schema")
            out[name] = F.lit(None).cast(wanted.get(name, dtype_text)).alias(name)
        order = [n for n in wanted if n in out]
        return F.when(c.isNotNull(), F.struct(*[out[n] for n in [*order, *(n for n in out if n not in order)]]))
    if isinstance(dtype, T.ArrayType) and _touched(dtype, scope, plan):
        inner = target.elementType if isinstance(target, T.ArrayType) else None
        return F.transform(c, lambda x: _rebuilt(x, dtype.elementType, scope + ELEMENT, plan, inner, on_error))
    if isinstance(dtype, T.MapType) and _touched(dtype, scope, plan):
        inner = (target.keyType, target.valueType) if isinstance(target, T.MapType) else (None, None)
        if _touched(dtype.keyType, scope + KEY, plan):
            c = F.transform_keys(c, lambda k, v: _rebuilt(k, dtype.keyType, scope + KEY, plan, inner[0], on_error))
        return F.transform_values(c, lambda k, v: _rebuilt(v, dtype.valueType, scope + VALUE, plan, inner[1], on_error))
    return c


def _touched(dtype: T.DataType, scope: str, plan: _Plan) -> bool:
    """Whether a struct below ``scope`` changes."""
    scopes = {s for s, _ in [*plan.renames, *plan.drops, *plan.retypes]} | set(plan.adds)
    return any(s.startswith(scope) for s in scopes)


def _loses(c: Column, dtype: T.DataType, scope: str, at: tuple[str, str], plan: _Plan) -> Column | None:
    """Whether a value holds, at any depth, a field that does not survive its retype and the way back."""
    if isinstance(dtype, T.StructType):
        if scope == at[0]:
            f = next(f for f in dtype.fields if f.name == at[1])
            value = c.getField(f.name)
            if "struct" in (shape(f.dataType) + plan.retypes[at]):
                return value.isNotNull()
            return ~value.eqNullSafe(value.try_cast(plan.retypes[at]).try_cast(f.dataType))
        found = [_loses(c.getField(f.name), f.dataType, _path(scope, plan.renames.get((scope, f.name), f.name)), at, plan) for f in dtype.fields]
        return next((x for x in found if x is not None), None)
    if isinstance(dtype, T.ArrayType):
        return _anywhere(c, dtype.elementType, scope + ELEMENT, at, plan)
    if isinstance(dtype, T.MapType):
        found = [_anywhere(part(c), t, scope + mark, at, plan) for part, t, mark in ((F.map_keys, dtype.keyType, KEY), (F.map_values, dtype.valueType, VALUE))]
        return next((x for x in found if x is not None), None)
    return None


def _anywhere(c: Column, dtype: T.DataType, scope: str, at: tuple[str, str], plan: _Plan) -> Column | None:
    if not at[0].startswith(scope):
        return None
    return F.coalesce(F.exists(c, lambda x: F.coalesce(_loses(x, dtype, scope, at, plan), F.lit(False))), F.lit(False))


def evolve_nested(
    df: DataFrame,
    changes: DataFrame,
    dataset: str,
    target: T.StructType | None = None,
    force_drop: bool = False,
    on_error: str = "fail",
    check_values: bool = True,
) -> DataFrame:
    """Carry out the changes of one dataset at all levels in one ``select``, so the data is read once.

    Structs are rebuilt field by field, in arrays and maps by their transforms; null structs, arrays and
    maps stay null. ``target``, the new schema, gives the order of fields and the whole type of added
    structs. Drops wait for ``force_drop``, and so do destructive retypes, unless ``check_values`` finds in
    one pass that no value at any depth is lost. The change list is read on the driver.
    """
    mine = (F.col("scope") == dataset) | F.col("scope").startswith(f"{dataset}:")
    wanted = changes.filter(mine & F.col("kind").isin("add_column", "drop_column", "rename_column", "retype_column"))
    columns = ["kind", "scope", "key", "old_key", "new_value", "destructive"]
    plan = _Plan(to_apply(wanted, force_drop=True).select(*columns).distinct().collect(), force_drop)
    whole = F.struct(*[field(c) for c in df.columns])
    if plan.risky and not force_drop:
        lost = dict.fromkeys(plan.risky, 1)
        if check_values:
            counts = [F.count(F.when(_loses(whole, df.schema, dataset, at, plan), 1)) for at in plan.risky]
            lost = dict(zip(plan.risky, df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()))
        plan.retypes = {at: t for at, t in plan.retypes.items() if not lost.get(at)}
    return df.select(_rebuilt(whole, df.schema, dataset, plan, target, on_error).alias("__row")).select("__row.*")
