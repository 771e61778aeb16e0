"""Applying a change set to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tablechange.functions.render import field, row_key_text
from tablechange.operators.changeset import to_apply
from tablechange.operators.diff import diff, is_empty
from tablechange.session import materialize

Step = Callable[[DataFrame], DataFrame]


def apply_changes(
    current: DataFrame,
    new: DataFrame,
    changes: DataFrame,
    keys: list[str],
    force_drop: bool = False,
    before: Sequence[Step] = (),
    after: Sequence[Step] = (),
) -> DataFrame:
    """``current`` with the chosen changes: inserts, updates of single attributes, renames of the
    key, and deletes only if forced. Values come typed from ``new``, not from the change texts.

    All changes of one row are first gathered under its present key and written, then the new
    values of those rows alone are taken from ``new``. Both are as small as the change set, and
    their size is known to the plan: a small change set is broadcast, and the rows of ``current``
    stay where they are. ``before`` and ``after`` are the caller's own steps on either side.
    """
    for step in before:
        current = step(current)
    attrs = [c for c in new.columns if c not in keys]
    kind, chosen = F.col("kind"), to_apply(changes, force_drop)
    # edits of rows that are there; a change under a rename keeps its key in ``new`` even if the
    # rename itself is not carried out
    actions = materialize(
        chosen.filter(kind != "create")
        .groupBy(F.coalesce("old_key", "key").alias("__at"))
        .agg(
            F.max(kind == "drop").alias("__drop"),
            F.max(F.when(kind == "rename", F.col("key"))).alias("__to"),
            F.max(F.when(F.col("old_key").isNotNull(), F.col("key"))).alias("__new"),
            # at most one entry per attribute
            F.collect_set(F.when(kind == "change", F.col("column"))).alias("__set"),
        )
        .withColumn("__source", F.coalesce("__to", "__new", "__at")),
        "actions",
    )
    creates = chosen.filter(kind == "create").select(F.col("key").alias("__source")).distinct()
    source = new.select(row_key_text(new, keys).alias("__source"), F.struct(*[field(c) for c in [*keys, *attrs]]).alias("n"))
    valued = materialize(actions.filter(~F.col("__drop")).join(source, "__source"), "values")
    gone = actions.filter("__drop").select("__at", "__drop")
    edits = valued.filter(F.col("__to").isNotNull() | (F.size("__set") > 0)).select("__at", "__drop", "__to", "__set", "n")
    edits = edits.unionByName(gone, allowMissingColumns=True)

    def typed(value, c: str):
        return value.cast(current.schema[c].dataType).alias(c)

    at = row_key_text(current, keys).alias("__at")
    rows = current.select(at, F.struct(*[field(c) for c in current.columns]).alias("c")).join(edits, "__at", "left")
    out = []
    for c in current.columns:
        was, now = F.col(f"c.`{c}`"), F.col(f"n.`{c}`")
        if c in keys:
            was = F.when(F.col("__to").isNull(), was).otherwise(now)
        elif c in attrs:
            was = F.when(F.array_contains("__set", c), now).otherwise(was)
        out.append(typed(was, c))
    kept = rows.filter(~F.coalesce("__drop", F.lit(False))).select(out)
    # a row to create that is there already is left as it is; what counts are the keys once renames
    # and drops are done
    left = actions.filter(F.col("__drop") | F.col("__to").isNotNull()).select("__at")
    taken = current.select(at).join(left, "__at", "left_anti").union(valued.filter(F.col("__to").isNotNull()).select("__to"))
    new_rows = materialize(source.join(creates, "__source"), "creates")
    fresh = new_rows.join(taken, F.col("__source") == F.col("__at"), "left_anti")
    added = fresh.select([typed(F.col(f"n.`{c}`") if c in new.columns else F.lit(None), c) for c in current.columns])
    result = kept.unionByName(added)
    for step in after:
        result = step(result)
    return result


def apply_until_stable(
    current: DataFrame,
    new: DataFrame,
    keys: list[str],
    attrs: list[str] | None = None,
    force_drop: bool = False,
    max_rounds: int = 2,
    differ: Callable[..., DataFrame] = diff,
) -> tuple[DataFrame, DataFrame, int]:
    """Apply, compare again, until nothing is left to apply: ``(result, remaining changes, rounds)``.

    Without ``force_drop`` the drops remain and are not counted as unfinished.
    """
    left = materialize(differ(current, new, keys, attrs), "changes")
    rounds = 0
    while not is_empty(to_apply(left, force_drop)):
        if rounds == max_rounds:
            raise RuntimeError(f"changes are left after {rounds} rounds")
        current = materialize(apply_changes(current, new, left, keys, force_drop), "applied", replaces=current if rounds else None)
        left = materialize(differ(current, new, keys, attrs), "changes", replaces=left)
        rounds += 1
    return current, left, rounds
