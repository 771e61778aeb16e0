"""Queries: diff, rename detection, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablechange.functions.similarity import jaro, jaro_winkler
from tablechange.operators.changeset import (
    change_edges,
    gate_destructive,
    mark_ignored,
    mentions,
    order_changes,
    pull_back,
    render_changes,
    select_changes,
    visible,
)
from tablechange.operators.closure import impact_closure
from tablechange.operators.diff import (
    change_rows,
    changed,
    created,
    diff,
    diff_bags,
    diff_definitions,
    diff_summary,
    dropped,
)
from tablechange.operators.levels import dependency_levels
from tablechange.operators.matching import diff_with_renames, fold_renames, match_one_to_one, similar_pairs
from tablechange.operators.schemas import diff_schemas
from tablechange.plans import fixtures as fx
from tablechange.plans.registry import query, table
from tablechange.session import scratch_path
from tablechange.sources.hashtree import LEAF_ROWS, diff_hashed, differing_leaves, load_hash_tree, rows_of_leaves, save_hashed_snapshot
from tablechange.sources.inventory import field_inventory, frame_inventory

KEY = ["o_orderkey"]
PAIR = f"WITH o AS ({fx.ORDERS_OLD}), n AS ({fx.ORDERS_NEW})"


@query("diff_created", f"{PAIR} SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_orderkey = n.o_orderkey)")
def q_created(spark: SparkSession, sf: str) -> DataFrame:
    return created(fx.orders_old(spark, sf), fx.orders_new(spark, sf), KEY)


@query("diff_dropped", f"{PAIR} SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.o_orderkey = n.o_orderkey)")
def q_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return dropped(fx.orders_old(spark, sf), fx.orders_new(spark, sf), KEY)


def number_text(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def time_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


ORDER_TEXT = {
    "o_custkey": "CAST({s}.o_custkey AS VARCHAR)",
    "o_orderstatus": "{s}.o_orderstatus",
    "o_totalprice": number_text("{s}.o_totalprice"),
    "o_orderdate": time_text("{s}.o_orderdate"),
    "o_orderpriority": "{s}.o_orderpriority",
}


def order_row_text(side: str) -> str:
    return " || ', ' || ".join(f"'{a}=' || coalesce({t.format(s=side)}, 'NULL')" for a, t in ORDER_TEXT.items())


CHANGED = " UNION ALL ".join(
    f"SELECT o.o_orderkey, '{a}' AS \"column\", {t.format(s='o')} AS old_value, {t.format(s='n')} AS new_value "
    f"FROM o JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.{a} IS DISTINCT FROM n.{a}"
    for a, t in ORDER_TEXT.items()
)


@query("diff_changed", f"{PAIR} {CHANGED}")
def q_changed(spark: SparkSession, sf: str) -> DataFrame:
    return changed(fx.orders_old(spark, sf), fx.orders_new(spark, sf), KEY)


# the change set of the two order snapshots as SQL, for several queries
CHANGES = f"""{PAIR}, chg AS ({CHANGED}), cs AS (
  SELECT 'create' AS kind, CAST(n.o_orderkey AS VARCHAR) AS key, NULL AS "column", NULL AS old_value,
    {order_row_text("n")} AS new_value, false AS destructive, 1 AS phase
  FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_orderkey = n.o_orderkey)
  UNION ALL
  SELECT 'drop', CAST(o.o_orderkey AS VARCHAR), NULL, {order_row_text("o")}, NULL, true, 3
  FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.o_orderkey = n.o_orderkey)
  UNION ALL
  SELECT 'change', CAST(o_orderkey AS VARCHAR), "column", old_value, new_value, false, 2 FROM chg)"""
SHOWN = ["kind", "key", "column", "old_value", "new_value", "destructive", "phase"]


def order_changes_set(spark: SparkSession, sf: str, **options) -> DataFrame:
    return diff(fx.orders_old(spark, sf), fx.orders_new(spark, sf), KEY, fx.ORDER_ATTRS, **options)


@query("diff_full", f"{CHANGES} SELECT * FROM cs")
def q_diff(spark: SparkSession, sf: str) -> DataFrame:
    return order_changes_set(spark, sf).select(SHOWN)


@query("diff_full_digest_first", f"{CHANGES} SELECT * FROM cs")
def q_diff_digest(spark: SparkSession, sf: str) -> DataFrame:
    return order_changes_set(spark, sf, digest_first=True).select(SHOWN)


@query(
    "diff_summary",
    f"""{CHANGES} SELECT kind, "column", count(*) AS n FROM cs GROUP BY 1, 2
    UNION ALL SELECT 'same', NULL, (SELECT count(*) FROM o JOIN n ON o.o_orderkey = n.o_orderkey)
      - (SELECT count(DISTINCT o_orderkey) FROM chg)""",
)
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff_summary(order_changes_set(spark, sf, with_same=True))


@query(
    "diff_bags",
    """WITH o AS (SELECT * FROM lineitem),
    n AS (SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN 'X' ELSE l_linestatus END AS l_linestatus)
          FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 5)
    SELECT 'create' AS change, *, count(*) AS copies FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY ALL
    UNION ALL
    SELECT 'drop', *, count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY ALL""",
)
def q_bags(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "lineitem")
    new = old.filter("l_returnflag <> 'R' OR l_quantity > 5")
    status = F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_linestatus"))
    return diff_bags(old, new.withColumn("l_linestatus", status))


@query(
    "diff_definitions",
    f"""WITH o AS (SELECT doc_id, text FROM documents),
    n AS (SELECT doc_id, CASE WHEN lang = 'en' THEN {fx.EDITED_TEXT} ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)
    SELECT CASE WHEN n.doc_id IS NULL THEN 'drop' ELSE 'replace' END AS kind, CAST(o.doc_id AS VARCHAR) AS key,
      md5(o.text) AS old_md5, md5(n.text) AS new_md5
    FROM o LEFT JOIN n USING (doc_id) WHERE n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text""",
)
def q_definitions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    edited = F.when(F.col("lang") == "en", fx.edited_text()).otherwise(F.col("text"))
    new = docs.filter("doc_id % 10 <> 1").select("doc_id", edited.alias("text"))
    changes = diff_definitions(docs.select("doc_id", "text"), new, "doc_id", "text")
    return changes.select("kind", "key", F.md5("old_value").alias("old_md5"), F.md5("new_value").alias("new_md5"))


# rename detection

NEXT_PART = "SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
NEXT_TURN = """SELECT a.conv_id, a.turn, a.text AS a, b.text AS b
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""


def next_part(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    follower = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return part.select("p_partkey", F.col("p_name").alias("a")).join(follower, "p_partkey")


def next_turn(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    follower = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return talk.select("conv_id", "turn", F.col("text").alias("a")).join(follower, ["conv_id", "turn"])


@query("jaro", f"SELECT p_partkey, round(jaro_similarity(a, b), 9) AS score FROM ({NEXT_PART})")
def q_jaro(spark: SparkSession, sf: str) -> DataFrame:
    return next_part(spark, sf).select("p_partkey", F.round(jaro("a", "b"), 9).alias("score"))


@query("jaro_bytes", f"SELECT conv_id, turn, round(jaro_similarity(a, b), 9) AS score FROM ({NEXT_TURN})")
def q_jaro_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return next_turn(spark, sf).select("conv_id", "turn", F.round(jaro("a", "b", unit="bytes"), 9).alias("score"))


@query("jaro_winkler", f"SELECT p_partkey, round(jaro_winkler_similarity(a, b), 9) AS score FROM ({NEXT_PART})")
def q_jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return next_part(spark, sf).select("p_partkey", F.round(jaro_winkler("a", "b"), 9).alias("score"))


RENAMES = f"""WITH RECURSIVE o AS ({fx.CUSTOMERS_OLD}), n AS ({fx.CUSTOMERS_NEW}),
  gone AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k)),
  come AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.k = o.k)),
  sim AS (SELECT blk, gone.k AS old_name, come.k AS new_name, jaro_winkler_similarity(gone.k, come.k) AS score
          FROM gone JOIN come USING (blk) WHERE jaro_winkler_similarity(gone.k, come.k) > 0.8)"""
# the greedy choice, one pair after the other inside a block
GREEDY = f"""{RENAMES},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY score DESC, md5(old_name || chr(0) || new_name), old_name, new_name) AS i FROM sim),
  walk AS (
    SELECT blk, CAST(0 AS BIGINT) AS i, [''] AS olds, [''] AS news, false AS taken FROM (SELECT DISTINCT blk FROM sim)
    UNION ALL
    SELECT r.blk, r.i,
      CASE WHEN list_contains(w.olds, r.old_name) OR list_contains(w.news, r.new_name) THEN w.olds ELSE list_append(w.olds, r.old_name) END,
      CASE WHEN list_contains(w.olds, r.old_name) OR list_contains(w.news, r.new_name) THEN w.news ELSE list_append(w.news, r.new_name) END,
      NOT (list_contains(w.olds, r.old_name) OR list_contains(w.news, r.new_name))
    FROM walk w JOIN ranked r ON r.blk = w.blk AND r.i = w.i + 1),
  ren AS (SELECT r.* FROM walk w JOIN ranked r USING (blk, i) WHERE w.taken)"""


def gone_and_come(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old, new = fx.customers_old(spark, sf), fx.customers_new(spark, sf)
    return dropped(old, new, ["k"]), created(old, new, ["k"])


@query("similar_pairs", f"{RENAMES} SELECT blk, old_name, new_name, round(score, 9) AS score FROM sim")
def q_similar(spark: SparkSession, sf: str) -> DataFrame:
    gone, come = gone_and_come(spark, sf)
    pairs = similar_pairs(gone, come, "blk", name="k")
    return pairs.select("blk", "old_name", "new_name", F.round("score", 9).alias("score"))


@query("match_one_to_one", f"{GREEDY} SELECT blk, old_name, new_name, round(score, 9) AS score FROM ren")
def q_match(spark: SparkSession, sf: str) -> DataFrame:
    gone, come = gone_and_come(spark, sf)
    chosen = match_one_to_one(similar_pairs(gone, come, "blk", name="k"), "blk")
    return chosen.select("blk", "old_name", "new_name", F.round("score", 9).alias("score"))


FOLDED = f"""{GREEDY}, folded AS (
  SELECT 'create' AS kind, CAST(blk AS VARCHAR) AS scope, k AS key, NULL AS old_key, CAST(NULL AS VARCHAR) AS "column", NULL AS old_value,
    'v=' || {number_text("v")} AS new_value, NULL AS score FROM come WHERE NOT EXISTS (SELECT 1 FROM ren WHERE new_name = k)
  UNION ALL
  SELECT 'drop', CAST(blk AS VARCHAR), k, NULL, NULL, 'v=' || {number_text("v")}, NULL, NULL
    FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE old_name = k)
  UNION ALL
  SELECT 'rename', CAST(r.blk AS VARCHAR), new_name, old_name, NULL, 'v=' || {number_text("g.v")}, 'v=' || {number_text("c.v")}, round(score, 9)
    FROM ren r JOIN gone g ON g.k = old_name JOIN come c ON c.k = new_name
  UNION ALL
  SELECT 'change', CAST(n.blk AS VARCHAR), n.k, NULL, 'v', {number_text("o.v")}, {number_text("n.v")}, NULL
    FROM o JOIN n USING (k) WHERE o.v IS DISTINCT FROM n.v)"""
FOLD_SHOWN = ["kind", "scope", "key", "old_key", "column", "old_value", "new_value"]


@query("fold_renames", f"{FOLDED} SELECT * FROM folded")
def q_fold(spark: SparkSession, sf: str) -> DataFrame:
    changes = diff(fx.customers_old(spark, sf), fx.customers_new(spark, sf), ["k"], ["v"], scope="blk")
    named = [F.col("scope"), F.col("key").alias("name")]
    pairs = similar_pairs(changes.filter("kind = 'drop'").select(named), changes.filter("kind = 'create'").select(named), "scope")
    folded = fold_renames(changes, match_one_to_one(pairs, "scope"))
    return folded.select(*FOLD_SHOWN, F.round("score", 9).alias("score"))


@query(
    "diff_with_renames",
    f"""{FOLDED} SELECT * FROM folded UNION ALL
    SELECT 'change', CAST(r.blk AS VARCHAR), new_name, old_name, 'v', {number_text("g.v")}, {number_text("c.v")}, NULL
    FROM ren r JOIN gone g ON g.k = old_name JOIN come c ON c.k = new_name WHERE g.v IS DISTINCT FROM c.v""",
)
def q_renames(spark: SparkSession, sf: str) -> DataFrame:
    changes = diff_with_renames(fx.customers_old(spark, sf), fx.customers_new(spark, sf), ["k"], ["v"], "blk")
    return changes.select(*FOLD_SHOWN, F.round("score", 9).alias("score"))


# schemas


def desired_orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in fx.ORDERS_DESIRED))


def order_schema_changes(spark: SparkSession, sf: str) -> DataFrame:
    old = frame_inventory(spark, {"orders": table(spark, sf, "orders")})
    return diff_schemas(old, frame_inventory(spark, {"orders": desired_orders(spark)}))


SCHEMA_CHANGES = """SELECT * FROM (VALUES
  ('add_column', 'orders', 'o_channel', NULL, NULL, NULL, 'string', NULL, false),
  ('drop_column', 'orders', 'o_orderstatus', NULL, NULL, 'string', NULL, NULL, true),
  ('rename_column', 'orders', 'o_order_date', 'o_orderdate', NULL, 'timestamp_ntz', 'date',
    round(jaro_winkler_similarity('o_orderdate', 'o_order_date'), 9), false),
  ('rename_column', 'orders', 'o_order_priority', 'o_orderpriority', NULL, 'string', 'string',
    round(jaro_winkler_similarity('o_orderpriority', 'o_order_priority'), 9), false),
  ('retype_column', 'orders', 'o_custkey', NULL, 'type', 'bigint', 'int', NULL, true),
  ('retype_column', 'orders', 'o_totalprice', NULL, 'type', 'double', 'decimal(18,2)', NULL, true),
  ('retype_column', 'orders', 'o_order_date', 'o_orderdate', 'type', 'timestamp_ntz', 'date', NULL, true))
  AS t(kind, scope, key, old_key, "column", old_value, new_value, score, destructive)"""


@query(
    "diff_schemas",
    f"SELECT s.*, (SELECT count(*) FROM orders) AS num_rows FROM ({SCHEMA_CHANGES}) s",
)
def q_schemas(spark: SparkSession, sf: str) -> DataFrame:
    changes = order_schema_changes(spark, sf)
    touched = table(spark, sf, "orders").agg(F.count("*").alias("num_rows")).withColumn("scope", F.lit("orders"))
    shown = changes.select(
        "kind", "scope", "key", "old_key", "column", "old_value", "new_value", F.round("score", 9).alias("score"), "destructive"
    )
    return shown.join(touched, "scope")


_COLUMNS = """SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS t
      FROM (DESCRIBE SELECT * FROM {})"""


@query(
    "diff_table_schemas",
    f"""WITH o AS ({_COLUMNS.format("customer")}), n AS ({_COLUMNS.format("supplier")}),
    ren AS (SELECT o.c AS oc, n.c AS nc, o.t AS ot, n.t AS nt, jaro_winkler_similarity(o.c, n.c) AS s FROM o, n
      WHERE o.c <> n.c AND jaro_winkler_similarity(o.c, n.c) > 0.8)
    SELECT 'rename_column' AS kind, nc AS key, oc AS old_key, ot AS old_value, nt AS new_value, round(s, 9) AS score FROM ren
    UNION ALL SELECT 'drop_column', c, NULL, t, NULL, NULL FROM o WHERE c NOT IN (SELECT oc FROM ren) AND c NOT IN (SELECT c FROM n)
    UNION ALL SELECT 'add_column', c, NULL, NULL, t, NULL FROM n WHERE c NOT IN (SELECT nc FROM ren) AND c NOT IN (SELECT c FROM o)""",
)
def q_table_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The schemas of two given tables as two states of one dataset."""
    old, new = (frame_inventory(spark, {"party": table(spark, sf, t)}) for t in ("customer", "supplier"))
    return diff_schemas(old, new).select("kind", "key", "old_key", "old_value", "new_value", F.round("score", 9).alias("score"))


@query(
    "diff_field_schemas",
    f"""WITH e AS ({fx.EVENTS_DRIFTED}), f AS (
      SELECT DISTINCT ts >= TIMESTAMP '{fx.DRIFT_FROM}' AS late, event_type, unnest(json_keys(props)) AS field FROM e),
    t AS (SELECT *, CASE field WHEN 'k' THEN 'integer' ELSE 'number' END AS type FROM f),
    o AS (SELECT * FROM t WHERE NOT late), n AS (SELECT * FROM t WHERE late),
    both_sides AS (SELECT DISTINCT o.event_type FROM o JOIN n USING (event_type))
    SELECT 'add_column' AS kind, event_type AS scope, field AS key, NULL AS old_value, type AS new_value FROM n
      WHERE event_type IN (FROM both_sides) AND (event_type, field) NOT IN (SELECT (event_type, field) FROM o)
    UNION ALL SELECT 'drop_column', event_type, field, type, NULL FROM o
      WHERE event_type IN (FROM both_sides) AND (event_type, field) NOT IN (SELECT (event_type, field) FROM n)
    UNION ALL SELECT 'drop', event_type, event_type, field || ' ' || type, NULL FROM o WHERE event_type NOT IN (FROM both_sides)
    UNION ALL SELECT 'create', event_type, event_type, NULL, field || ' ' || type FROM n WHERE event_type NOT IN (FROM both_sides)""",
)
def q_field_schemas(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.events_drifted(spark, sf)
    late = F.col("ts") >= F.lit(fx.DRIFT_FROM).cast("timestamp_ntz")

    def inventory(part: DataFrame) -> DataFrame:
        found = field_inventory(part, "props", ["event_type"])
        # fields of an object have no order: number 0
        return found.select(
            F.col("event_type").alias("dataset"), F.lit(0).alias("ordinal"), F.col("field").alias("column"), F.col("json_type").alias("type")
        )

    changes = diff_schemas(inventory(events.filter(~late)), inventory(events.filter(late)))
    return changes.select("kind", "scope", "key", "old_value", "new_value")


# change sets

TYPES = "SELECT p_partkey, p_type FROM part"


def part_changes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return change_rows(
        part.select(F.lit("create").alias("kind"), F.col("p_partkey").cast("string").alias("scope"), F.col("p_type").alias("key"))
    )


@query(
    "mark_ignored",
    """SELECT CAST(p_partkey AS VARCHAR) AS scope, p_type AS key,
      p_type LIKE 'S%' OR p_type LIKE '%O' OR p_type = 'LARGE' AS ignored FROM part""",
)
def q_ignored(spark: SparkSession, sf: str) -> DataFrame:
    return mark_ignored(part_changes(spark, sf), fx.PATTERNS).select("scope", "key", "ignored")


@query(
    "visible_by_pattern_table",
    """SELECT CAST(p_partkey AS VARCHAR) AS scope, p_type AS key FROM part
    WHERE NOT (p_type LIKE 'S%' OR p_type LIKE '%O' OR p_type = 'LARGE')""",
)
def q_visible(spark: SparkSession, sf: str) -> DataFrame:
    patterns = spark.createDataFrame([(p,) for p in fx.PATTERNS], "pattern string")
    return visible(mark_ignored(part_changes(spark, sf), patterns)).select("scope", "key")


@query(
    "mentions",
    "SELECT DISTINCT doc_id, b.text AS name FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def q_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(table(spark, sf, "documents"), table(spark, sf, "benchmark"), def_id="doc_id", text="text", name="text")


CLOSURE = f"""WITH RECURSIVE e AS ({fx.EDGES}), r AS (
  SELECT 'R:' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name = 'AFRICA'
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)"""


@query("impact_closure", f"{CLOSURE} SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def q_closure(spark: SparkSession, sf: str) -> DataFrame:
    return impact_closure(fx.edges(spark, sf), fx.seeds(spark, sf))


@query(
    "select_changes",
    f"""{CLOSURE}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT n.node AS key, r.depth IS NULL AS selected, coalesce(r.depth > 0, false) AS locked FROM nodes n LEFT JOIN r USING (node)""",
)
def q_select(spark: SparkSession, sf: str) -> DataFrame:
    links = fx.edges(spark, sf)
    nodes = links.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    changes = change_rows(nodes.select(F.lit("create").alias("kind"), "key"))
    return select_changes(changes, fx.seeds(spark, sf), links).select("key", "selected", "locked")


@query(
    "select_by_mentions",
    """WITH hit AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE item_id % 3 = 0)
    SELECT 'doc ' || doc_id AS key, doc_id NOT IN (FROM hit) AS selected, doc_id IN (FROM hit) AS locked FROM documents
    UNION ALL SELECT text, bool_and(item_id % 3 <> 0), false FROM benchmark GROUP BY text""",
)
def q_select_by_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as definitions that may mention benchmark texts; some of those are deselected."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc "), "doc_id").alias("key"), F.col("text").alias("new_value"))
    items = table(spark, sf, "benchmark")
    named = items.select(F.col("text").alias("key"), F.lit(None).cast("string").alias("new_value")).distinct()
    changes = change_rows(docs.unionByName(named).withColumn("kind", F.lit("replace")))
    chosen = select_changes(changes, items.filter("item_id % 3 = 0").select("text"), change_edges(changes, whole_word=False))
    return chosen.select("key", "selected", "locked")


@query(
    "gate_destructive",
    f"""{CHANGES} SELECT 'safe' AS mode, kind, count(*) AS n FROM cs WHERE NOT destructive GROUP BY kind
    UNION ALL SELECT 'forced', kind, count(*) FROM cs GROUP BY kind""",
)
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    changes = order_changes_set(spark, sf)
    safe = gate_destructive(changes).groupBy("kind").count().select(F.lit("safe").alias("mode"), "kind", F.col("count").alias("n"))
    forced = gate_destructive(changes, True).groupBy("kind").count()
    return safe.unionByName(forced.select(F.lit("forced").alias("mode"), "kind", F.col("count").alias("n")))


@query(
    "order_changes",
    f"""{CHANGES} SELECT kind, key, "column", phase,
      row_number() OVER (PARTITION BY phase ORDER BY key, "column" NULLS FIRST, kind) AS seq FROM cs""",
)
def q_order(spark: SparkSession, sf: str) -> DataFrame:
    return order_changes(order_changes_set(spark, sf)).select("kind", "key", "column", "phase", "seq")


# dependencies with chains, cycles of three and nodes that need themselves; parts of a cycle reach each other
NEEDS = """SELECT 'C:' || c_custkey AS src, 'C:' || (c_custkey + 1) AS dst FROM customer WHERE c_custkey % 50 BETWEEN 10 AND 17
  UNION ALL SELECT 'C:' || c_custkey, 'C:' || (c_custkey + 1) FROM customer WHERE c_custkey % 50 IN (1, 2)
  UNION ALL SELECT 'C:' || c_custkey, 'C:' || (c_custkey - 2) FROM customer WHERE c_custkey % 50 = 3
  UNION ALL SELECT 'C:' || c_custkey, 'C:' || c_custkey FROM customer WHERE c_custkey % 97 = 0"""
LEVELS = f"""WITH RECURSIVE e AS ({fx.EDGES} UNION ALL {NEEDS}),
  reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
  parts AS (SELECT r.a AS node, min(r.b) AS cycle FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a),
  nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  named AS (SELECT node, cycle, coalesce(cycle, node) AS rep FROM nodes LEFT JOIN parts USING (node)),
  short AS (SELECT DISTINCT s.rep AS src, d.rep AS dst FROM e JOIN named s ON s.node = e.src JOIN named d ON d.node = e.dst WHERE s.rep <> d.rep),
  walk AS (SELECT rep AS node, 0 AS level FROM named UNION SELECT short.dst, level + 1 FROM walk JOIN short ON short.src = walk.node),
  levels AS (SELECT named.node, CAST(max(level) AS INTEGER) AS level, any_value(cycle) AS cycle FROM named JOIN walk ON walk.node = rep GROUP BY named.node)"""


def _needs(spark: SparkSession, sf: str) -> DataFrame:
    customer, key = table(spark, sf, "customer"), F.col("c_custkey")

    def named(number: Column) -> Column:
        return F.concat(F.lit("C:"), number.cast("string"))

    steps = [(key % 50).between(10, 17) | (key % 50).isin(1, 2), key % 50 == 3, key % 97 == 0]
    links = [customer.filter(c).select(named(key).alias("src"), named(key + n).alias("dst")) for c, n in zip(steps, (1, -2, 0))]
    return fx.edges(spark, sf).unionByName(links[0]).unionByName(links[1]).unionByName(links[2])


@query("dependency_levels", f"{LEVELS} SELECT * FROM levels")
def q_levels(spark: SparkSession, sf: str) -> DataFrame:
    return dependency_levels(_needs(spark, sf))


@query(
    "order_by_dependency",
    f"""{LEVELS}, cs AS (SELECT node AS key, level, CASE WHEN number % 3 = 0 THEN 'drop' ELSE 'create' END AS kind
      FROM (SELECT *, CAST(substr(node, 3) AS BIGINT) AS number FROM levels))
    SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'drop' THEN -level ELSE level END, key) AS seq FROM cs""",
)
def q_order_by_dependency(spark: SparkSession, sf: str) -> DataFrame:
    """Creates after what they need, drops before it."""
    needs = _needs(spark, sf)
    nodes = needs.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    kind = F.when(F.substring("key", 3, 20).cast("long") % 3 == 0, "drop").otherwise("create")
    return order_changes(change_rows(nodes.select(kind.alias("kind"), "key")), depends=needs).select("kind", "key", "seq")


@query(
    "render_changes",
    f"""{CHANGES} SELECT phase, CASE kind
      WHEN 'create' THEN 'INSERT INTO `orders` SELECT * FROM `orders_new` WHERE `o_orderkey` = ''' || key || ''';'
      WHEN 'change' THEN 'UPDATE `orders` SET `' || "column" || '` = ' || coalesce('''' || new_value || '''', 'NULL')
        || ' WHERE `o_orderkey` = ''' || key || ''';' END AS statement
    FROM cs WHERE NOT destructive""",
)
def q_render(spark: SparkSession, sf: str) -> DataFrame:
    return render_changes(order_changes_set(spark, sf), "orders", "o_orderkey").select("phase", "statement")


@query(
    "render_schema_changes",
    """SELECT statement, (SELECT count(*) FROM orders) AS num_rows FROM (VALUES
      ('ALTER TABLE `orders` ADD COLUMN `o_channel` string;'),
      ('ALTER TABLE `orders` DROP COLUMN `o_orderstatus`;'),
      ('ALTER TABLE `orders` RENAME COLUMN `o_orderdate` TO `o_order_date`;'),
      ('ALTER TABLE `orders` RENAME COLUMN `o_orderpriority` TO `o_order_priority`;'),
      ('ALTER TABLE `orders` ALTER COLUMN `o_custkey` TYPE int;'),
      ('ALTER TABLE `orders` ALTER COLUMN `o_totalprice` TYPE decimal(18,2);'),
      ('ALTER TABLE `orders` ALTER COLUMN `o_order_date` TYPE date;')) AS t(statement)""",
)
def q_render_schema(spark: SparkSession, sf: str) -> DataFrame:
    script = render_changes(order_schema_changes(spark, sf), force_drop=True).select("scope", "statement")
    touched = table(spark, sf, "orders").agg(F.count("*").alias("num_rows")).withColumn("scope", F.lit("orders"))
    return script.join(touched, "scope").select("statement", "num_rows")


@query("pull_back", f"{PAIR} SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.o_orderkey = n.o_orderkey)")
def q_pull_back(spark: SparkSession, sf: str) -> DataFrame:
    return pull_back(fx.orders_new(spark, sf), fx.orders_old(spark, sf), order_changes_set(spark, sf), KEY)


# two versions that differ in a few rows of a thousand, compared by their hash trees

SPARSE_NEW = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1000 <> 7"""


def _sparse_trees(spark: SparkSession, sf: str) -> str:
    path, key = scratch_path(spark, "hashed"), F.col("o_orderkey") % 1000
    orders = table(spark, sf, "orders")
    save_hashed_snapshot(orders.filter(key != 9), path, 1, KEY)
    new = orders.filter(key != 7).withColumn("o_orderstatus", F.when(key == 5, "X").otherwise(F.col("o_orderstatus")))
    save_hashed_snapshot(new, path, 2, KEY, like=1)
    return path


@query(
    "diff_hash_tree",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 1000 <> 9), n AS ({SPARSE_NEW})
    SELECT 'create' AS kind, CAST(o_orderkey AS VARCHAR) AS key, NULL AS "column", NULL AS was, NULL AS now FROM n ANTI JOIN o USING (o_orderkey)
    UNION ALL SELECT 'drop', CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL FROM o ANTI JOIN n USING (o_orderkey)
    UNION ALL SELECT 'change', CAST(o_orderkey AS VARCHAR), 'o_orderstatus', o.o_orderstatus, n.o_orderstatus FROM o JOIN n USING (o_orderkey)
      WHERE o.o_orderstatus <> n.o_orderstatus""",
)
def q_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = diff_hashed(spark, _sparse_trees(spark, sf), 1, 2)
    one = F.col("kind") == "change"  # whole rows of creates and drops are covered by diff_full
    return found.select("kind", "key", "column", F.when(one, F.col("old_value")).alias("was"), F.when(one, F.col("new_value")).alias("now"))


@query(
    "hash_tree_leaves",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 1000 <> 9), n AS ({SPARSE_NEW}), t AS (
      SELECT o_orderkey FROM ((SELECT * FROM o) EXCEPT (SELECT * FROM n)) UNION SELECT o_orderkey FROM ((SELECT * FROM n) EXCEPT (SELECT * FROM o)))
    SELECT count(*) AS changed, true AS covered, true AS few FROM t""",
)
def q_hash_tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Changed keys, whether the leaves that differ hold all of them, and whether these leaves hold at most
    ``LEAF_ROWS`` rows and as many again for each, which is what a diff reads."""
    path = _sparse_trees(spark, sf)
    old, new = (load_hash_tree(spark, path, v) for v in (1, 2))
    leaves = differing_leaves(spark, old, new)
    read = rows_of_leaves(spark, old, leaves).select(*KEY).unionByName(rows_of_leaves(spark, new, leaves).select(*KEY)).distinct()
    changes = diff(old.rows(spark).drop("__leaf"), new.rows(spark).drop("__leaf"), KEY).select(F.col("key").cast("long").alias("o_orderkey")).distinct()
    both = changes.join(read.withColumn("r", F.lit(1)), KEY, "full_outer").join(changes.withColumn("c", F.lit(1)), KEY, "left")
    changed = F.count("c")
    return both.agg(changed.alias("changed"), (F.count(F.when(F.col("r").isNull(), 1)) == 0).alias("covered"), (F.count("r") <= 2 * LEAF_ROWS * changed).alias("few"))
