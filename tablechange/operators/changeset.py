"""Working with a change set: ignore, gate, order, depend, render, pull back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablechange.functions.render import field, row_key_text
from tablechange.operators.closure import impact_closure
from tablechange.operators.diff import CHANGE_SCHEMA, DESTRUCTIVE, phase_of
from tablechange.operators.levels import dependency_levels
from tablechange.operators.sequence import number_rows
from tablechange.session import materialize

# apply order: structure, then definitions that may use it, then drops
APPLY_PHASE = {
    "create": 2, "change": 2, "rename": 2, "add_column": 2, "rename_column": 2, "retype_column": 2,
    "replace": 3, "drop": 4, "drop_column": 4, "same": 5,
}

# above this many patterns or names, a join replaces literals in the plan
_LITERALS = 200


def _match_pattern(name: Column, pattern: str) -> Column:
    if pattern == "*":
        return name.isNotNull()
    if pattern.endswith("*") and pattern.startswith("*") and len(pattern) > 1:
        return name.contains(pattern[1:-1])
    if pattern.endswith("*"):
        return name.startswith(pattern[:-1])
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    return name == pattern


def _fragments(name: Column, lengths: list[int], kind: str) -> Column:
    """The starts (or ends) of a name with the given lengths, as (kind, fragment)."""
    parts = []
    for n in lengths:
        text = F.substring(name, 1, n) if kind == "prefix" else F.substring(name, -n, n) if n else F.lit("")
        parts.append(F.when(F.length(name) >= n, F.struct(F.lit(kind).alias("how"), text.alias("text"))))
    return F.array(*parts)


def _joined_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names that match a pattern of a table of any size, by equi-joins on whole names, starts
    and ends of the lengths that occur among the patterns. Patterns with a star at both ends are
    found as substrings (see ``mentions``), which is an equi-join on pieces of the names."""
    p = F.col("pattern")
    first, last = p.startswith("*"), p.endswith("*")
    split = patterns.select(
        p,
        F.when(first & last, "inside").when(last, "prefix").when(first, "suffix").otherwise("exact").alias("how"),
        F.when(first & last, F.expr("substring(pattern, 2, greatest(length(pattern) - 2, 0))"))
        .when(last, F.expr("substring(pattern, 1, length(pattern) - 1)"))
        .when(first, F.expr("substring(pattern, 2)"))
        .otherwise(p)
        .alias("text"),
    ).distinct()
    # one row per distinct pattern length, so bounded by the longest name
    lengths = split.filter("how IN ('prefix', 'suffix')").groupBy("how").agg(F.collect_set(F.length("text")).alias("n")).collect()
    of = {r["how"]: sorted(r["n"]) for r in lengths}
    name = F.col("name")
    frags = F.concat(
        F.array(F.struct(F.lit("exact").alias("how"), name.alias("text"))),
        *[_fragments(name, of[k], k) for k in sorted(of)],
    )
    exploded = names.select("name", F.explode(F.array_compact(frags)).alias("f")).select("name", "f.how", "f.text")
    hit = exploded.join(split.filter("how <> 'inside'").select("how", "text"), ["how", "text"], "left_semi").select("name")
    inside = split.filter("how = 'inside'").select("text")
    # a lone star, or two, matches any name
    every = inside.filter("text = ''").limit(1).select(F.lit(True).alias("any"))
    hit = hit.unionByName(names.select("name").join(every, F.lit(True), "left_semi"))
    found = mentions(names.select(F.col("name").alias("def_id"), F.col("name").alias("text")), inside.filter("text <> ''").toDF("name"))
    hit = hit.unionByName(found.select(F.col("def_id").alias("name")))
    return hit.distinct()


def mark_ignored(changes: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """Set ``ignored`` where the key equals a pattern, or starts (``temp_*``) or ends
    (``*_backup``) as it says. A rename is ignored when either of its names is.

    A short list becomes part of the filter expression; a table of patterns is joined.
    """
    if isinstance(patterns, list) and len(patterns) <= _LITERALS:
        flags = [F.coalesce(_match_pattern(F.col(c), p), F.lit(False)) for p in patterns for c in ("key", "old_key")]
        return changes.withColumn("ignored", reduce(lambda a, b: a | b, flags, F.lit(False)))
    if isinstance(patterns, list):
        patterns = changes.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    patterns = patterns.select(F.col(patterns.columns[0]).alias("pattern"))
    names = changes.select(F.explode(F.array("key", "old_key")).alias("name")).filter("name IS NOT NULL").distinct()
    hit = _joined_matches(names, patterns)
    flagged = _with_either_key(changes, hit.select("name", F.lit(True).alias("hit")), "hit")
    return flagged.withColumn("ignored", F.coalesce("__hit", "__old_hit", F.lit(False))).select(changes.columns)


def _with_either_key(changes: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """Look up a value by the key and by the old key. A change without an old key looks up its
    key twice instead of null, so that most of a change set does not meet in one task."""
    by_key = names.select(F.col("name").alias("__k"), F.col(value).alias(f"__{value}"))
    by_old = names.select(F.col("name").alias("__o"), F.col(value).alias(f"__old_{value}"))
    return changes.join(by_key, F.col("key") == F.col("__k"), "left").join(by_old, F.coalesce("old_key", "key") == F.col("__o"), "left")


def visible(changes: DataFrame, show_ignored: bool = False) -> DataFrame:
    """What a review shows."""
    return changes if show_ignored else changes.filter(~F.col("ignored"))


def gate_destructive(changes: DataFrame, force_drop: bool = False) -> DataFrame:
    """Drops stay out unless forced."""
    return changes if force_drop else changes.filter(~F.col("destructive"))


def to_apply(changes: DataFrame, force_drop: bool = False) -> DataFrame:
    """Selected, not locked, not ignored, and not destructive unless forced."""
    chosen = changes.filter(F.col("selected") & ~F.col("locked") & ~F.col("ignored") & (F.col("kind") != "same"))
    return gate_destructive(chosen, force_drop)


def order_changes(changes: DataFrame, order: str = "review", depends: DataFrame | None = None) -> DataFrame:
    """Set ``phase``, and ``seq`` as the place inside a phase and scope. Review order: create,
    alter, drop. Apply order: structure, definitions, drops.

    With ``depends``, ``(src, dst)`` edges between keys of which ``dst`` needs ``src``, each phase has
    one order over all scopes, since needs cross them: everything comes after what it needs, and
    drops go the other way round. Keys on a cycle come together, by name; ``dependency_levels``
    names the cycles. Keys without edges need nothing.
    """
    if order == "apply":
        changes = changes.withColumn("phase", phase_of(F.col("kind"), APPLY_PHASE))
    elif order == "review":
        changes = changes.withColumn("phase", phase_of(F.col("kind")))
    else:
        raise ValueError(f"order is 'review' or 'apply', not {order!r}")
    shown = [f.name for f in CHANGE_SCHEMA.fields]
    if depends is None:
        return number_rows(changes, ["phase", "scope"], ["key", "column", "kind"]).select(shown)
    levels = dependency_levels(depends).select(F.col("node").alias("__node"), "level")
    held = changes.join(levels, F.col("key") == F.col("__node"), "left")
    level = F.coalesce("level", F.lit(0))
    held = held.withColumn("__level", F.when(F.col("kind").isin(DESTRUCTIVE), -level).otherwise(level))
    return number_rows(held, ["phase"], ["__level", "scope", "key", "column", "kind"]).select(shown)


def _piece_size(name: Column) -> Column:
    """The largest power of two, up to 64, whose piece must lie whole inside any occurrence of ``name``."""
    size = F.lit(1)
    for k in (2, 4, 8, 16, 32, 64):
        size = F.when(F.length(name) >= 2 * k - 1, k).otherwise(size)
    return size


def mentions(
    defs: DataFrame,
    names: DataFrame,
    whole_word: bool = False,
    def_id: str = "def_id",
    text: str = "text",
    name: str = "name",
) -> DataFrame:
    """``(def_id, name)`` for every definition whose text contains the name.

    An equi-join finds the candidates: each text is cut into adjacent pieces of ``k`` characters,
    each name gives its ``k``-character pieces at the first ``k`` places. Wherever a name of at
    least ``2k-1`` characters lies in a text, one piece of the text falls wholly inside it at one
    of those places, so no occurrence is lost. ``k`` grows with the name. Texts are then checked
    for the name itself. The pieces of a text add up to the text once per ``k`` in use.
    """
    wanted = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    sized = wanted.withColumn("k", _piece_size(F.col("name")))
    sizes = sorted(r[0] for r in sized.select("k").distinct().collect())  # at most seven
    if not sizes:
        return defs.select(def_id, F.lit(None).cast("string").alias("name")).limit(0)
    last = F.least(F.col("k"), F.length("name") - F.col("k") + 1)
    name_pieces = sized.select(
        "name", "k", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("name"), i, F.col("k")))).alias("piece")
    ).distinct()
    # pieces are joined as hashes: a clash only adds a candidate, and the check below is on text
    # written first, so that its size is known and Catalyst can spare the texts a shuffle
    name_pieces = materialize(name_pieces.select("name", F.xxhash64("k", "piece").alias("h")).distinct(), "pieces")

    def hashed(k: int) -> Column:
        pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{{k}}}"), F.lit(0))
        return F.transform(pieces, lambda p: F.xxhash64(F.lit(k), p))

    cut = [hashed(k) for k in sizes]
    text_pieces = defs.select(F.col(def_id), F.explode(F.array_distinct(F.concat(*cut))).alias("h"))
    candidates = text_pieces.join(name_pieces, "h").select(def_id, "name").distinct()
    checked = defs.select(def_id, text).join(candidates, def_id)
    if whole_word:
        quoted = F.regexp_replace(F.col("name"), r"([^\p{L}\p{N}_\s])", r"\\$1")
        found = F.rlike(F.col(text), F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    else:
        found = F.col(text).contains(F.col("name"))
    return checked.filter(found).select(def_id, "name")


def change_edges(changes: DataFrame, whole_word: bool = True) -> DataFrame:
    """``(src, dst)`` as ``select_changes`` takes them: the new text of change ``dst`` mentions ``src``, the
    key or old key of another change."""
    texts = changes.filter("new_value IS NOT NULL AND key IS NOT NULL").select(F.col("key").alias("def_id"), F.col("new_value").alias("text"))
    names = changes.select(F.explode(F.array("key", "old_key")).alias("name")).filter("name IS NOT NULL").distinct()
    found = mentions(texts, names, whole_word).filter("def_id <> name")
    return found.select(F.col("name").alias("src"), F.col("def_id").alias("dst")).distinct()


def select_changes(changes: DataFrame, deselected: DataFrame, edges: DataFrame) -> DataFrame:
    """Take some changes out; everything that depends on them is taken out and locked.

    ``deselected`` holds keys, ``edges`` ``(src, dst)``: ``dst`` depends on ``src``. The state is
    always computed from the full set of deselected keys, so taking a key back in frees its
    dependents. A rename follows either of its names. Locked and ignored changes cannot be deselected by themselves.
    """
    seeds = deselected.select(F.col(deselected.columns[0]).alias("node")).distinct()
    frozen = changes.filter("ignored").select(F.col("key").alias("node"))
    seeds = seeds.join(frozen, "node", "left_anti")
    reach = impact_closure(edges, seeds).withColumnRenamed("node", "name")
    joined = _with_either_key(changes, reach, "depth").withColumn("__least", F.least("__depth", "__old_depth"))
    locked = F.coalesce(F.col("__least") > 0, F.lit(False))
    return joined.withColumns({"selected": F.col("__least").isNull(), "locked": locked}).select(changes.columns)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _dotted(name: Column) -> Column:
    """Quote each part of a qualified name."""
    return F.array_join(F.transform(F.split(name, r"\."), _quoted), ".")


def _literal(text: Column) -> Column:
    """A string literal; Spark reads a backslash in one as an escape, so it is doubled."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.when(text.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), plain, F.lit("'")))


# stand for an escaped backslash and an escaped dot while a compound key is taken apart
_SLASH, _DOT = "\ue001", "\ue002"


def _key_parts(key: Column, n: int) -> list[Column]:
    """The parts of a compound key's text (see ``key_text``), null where it has none."""
    if n == 1:
        return [key]
    parts = F.split(F.replace(F.replace(key, F.lit("\\\\"), F.lit(_SLASH)), F.lit("\\."), F.lit(_DOT)), r"\.")

    def plain(part: Column) -> Column:
        return F.when(part != "\\N", F.replace(F.replace(part, F.lit(_DOT), F.lit(".")), F.lit(_SLASH), F.lit("\\")))

    return [plain(F.get(parts, F.lit(i))) for i in range(n)]


def _object_kind(definition: Column) -> Column:
    """What a definition makes: ``VIEW``, ``FUNCTION`` or, without a telling text, ``TABLE``."""
    found = F.regexp_extract(definition, r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+)?(?:TEMPORARY\s+|TEMP\s+)?(VIEW|FUNCTION|SCHEMA|DATABASE)\b", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "TABLE").otherwise(F.upper(found))


def render_changes(changes: DataFrame, table: str | None = None, key: str | list[str] = "key", force_drop: bool = False) -> DataFrame:
    """``(phase, scope, seq, statement)``: one statement per change, ending in ``;``; what is
    deselected, ignored or (unless forced) destructive has none, and blank ones are left out.

    With ``table`` the changes are rows of that table and ``key`` its key column, or columns; new
    rows come from ``<table>_new``. Without, they are schema or definition changes; what a dropped
    definition was is read from its text. Changes that were not ordered before are numbered here.
    """
    rows = to_apply(changes, force_drop)
    kind, col, k, old = F.col("kind"), F.col("column"), F.col("key"), F.col("old_key")
    if table is not None:
        t, names = _dotted(F.lit(table)), [_quoted(F.lit(c)) for c in ([key] if isinstance(key, str) else key)]

        def equal(text: Column, between: str, missing: str) -> Column:
            pairs = [F.concat(c, F.when(p.isNull(), missing).otherwise(F.concat(F.lit(" = "), _literal(p)))) for c, p in zip(names, _key_parts(text, len(names)))]
            return F.concat_ws(between, *pairs)

        def where(text: Column) -> Column:
            return F.concat(F.lit(" WHERE "), equal(text, " AND ", " IS NULL"))

        statement = (
            F.when(kind == "create", F.concat(F.lit("INSERT INTO "), t, F.lit(" SELECT * FROM "), _dotted(F.lit(f"{table}_new")), where(k)))
            .when(kind == "drop", F.concat(F.lit("DELETE FROM "), t, where(k)))
            .when(kind == "rename", F.concat(F.lit("UPDATE "), t, F.lit(" SET "), equal(k, ", ", " = NULL"), where(old)))
            .when(kind == "change", F.concat(F.lit("UPDATE "), t, F.lit(" SET "), _quoted(col), F.lit(" = "), _literal(F.col("new_value")), where(k)))
        )
    else:
        alter = F.concat(F.lit("ALTER TABLE "), _dotted(F.col("scope")))
        replaced = F.regexp_replace(F.col("new_value"), r"(?i)^(\s*CREATE\s+)(VIEW|FUNCTION|TEMPORARY)\b", "$1OR REPLACE $2")
        statement = (
            F.when(kind == "add_column", F.concat(alter, F.lit(" ADD COLUMN "), _quoted(k), F.lit(" "), F.col("new_value")))
            .when(kind == "drop_column", F.concat(alter, F.lit(" DROP COLUMN "), _quoted(k)))
            .when(kind == "rename_column", F.concat(alter, F.lit(" RENAME COLUMN "), _quoted(old), F.lit(" TO "), _quoted(k)))
            .when(kind == "retype_column", F.concat(alter, F.lit(" ALTER COLUMN "), _quoted(k), F.lit(" TYPE "), F.col("new_value")))
            .when(kind == "create", F.concat(F.lit("CREATE TABLE "), _dotted(k), F.lit(" ("), F.col("new_value"), F.lit(")")))
            .when(kind == "rename", F.concat(F.lit("ALTER TABLE "), _dotted(old), F.lit(" RENAME TO "), _dotted(k)))
            .when(kind == "drop", F.concat(F.lit("DROP "), _object_kind(F.col("old_value")), F.lit(" "), _dotted(k)))
            .when(kind == "replace", replaced)
        )
    out = rows.withColumn("statement", F.rtrim(statement)).filter("trim(statement) <> ''")
    out = out.withColumn("statement", F.when(F.col("statement").endswith(";"), F.col("statement")).otherwise(F.concat("statement", F.lit(";"))))
    return out.select("phase", "scope", "seq", "statement")


def write_script(rendered: DataFrame, path: str, by_scope: bool = True) -> None:
    """The dry-run script as text files; read in file-name order they keep phase, scope and sequence,
    or phase and sequence alone (``by_scope=False``) where changes were ordered by what they need."""
    by = ["phase", "scope", "seq"] if by_scope else ["phase", "seq", "scope"]
    rendered.repartitionByRange(*by).sortWithinPartitions(*by).select("statement").write.text(path)


def pull_back(desired: DataFrame, current: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Put chosen rows that exist only in ``current`` back into ``desired``. ``chosen`` is a
    change set (its ``drop`` rows are used), or any DataFrame with a ``key`` text column."""
    if "kind" in chosen.columns:
        chosen = chosen.filter("kind = 'drop'")
    texts = chosen.select(F.col("key").alias("__key")).distinct()
    back = current.withColumn("__key", row_key_text(current, keys)).join(texts, "__key", "left_semi").drop("__key")
    back = back.join(desired.select([field(k) for k in keys]), keys, "left_anti")
    return desired.unionByName(back.select(desired.columns))
