"""Queries: inspection, export, ad-hoc SQL, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablechange.functions.render import csv_line, render_text
from tablechange.operators.explore import (
    describe_columns,
    list_datasets,
    prefix_lookup,
    preview,
    row_count,
    run_sql,
    text_widths,
    vocabulary,
)
from tablechange.plans import fixtures as fx
from tablechange.plans.change_queries import number_text, time_text
from tablechange.plans.registry import TABLES, query, register_tables, table
from tablechange.session import scratch_path
from tablechange.sources.export import export_csv, run_stats
from tablechange.sources.inventory import field_inventory
from tablechange.sources.publish import publish, read_dataset
from tablechange.streaming.changes import run_to_table, stream_apply_changes, stream_field_inventory, stream_schema_drift

EVENT_TEXT = {
    "event_id": "CAST(event_id AS VARCHAR)",
    "ts": time_text("ts"),
    "user_id": "CAST(user_id AS VARCHAR)",
    "event_type": "event_type",
    "value": number_text("value"),
    "props": "props",
}
EVENTS_AS_TEXT = "SELECT " + ", ".join(f"{t} AS {c}" for c, t in EVENT_TEXT.items()) + " FROM events"
ORDERS_NEW_AS_TEXT = f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  coalesce({number_text("o_totalprice")}, 'NULL') AS o_totalprice, {time_text("o_orderdate")} AS o_orderdate, o_orderpriority
  FROM ({fx.ORDERS_NEW})"""


@query("render_text", ORDERS_NEW_AS_TEXT)
def q_render(spark: SparkSession, sf: str) -> DataFrame:
    return render_text(fx.orders_new(spark, sf))


@query("render_text_events", EVENTS_AS_TEXT)
def q_render_events(spark: SparkSession, sf: str) -> DataFrame:
    return render_text(table(spark, sf, "events"))


@query("preview", f"{EVENTS_AS_TEXT} ORDER BY value DESC, event_id LIMIT 5".replace("ORDER BY value", "ORDER BY events.value").replace(", event_id LIMIT", ", events.event_id LIMIT"))
def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    return preview(table(spark, sf, "events"), [F.desc("value"), "event_id"])


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def q_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return row_count(table(spark, sf, "lineitem"))


@query(
    "describe_columns",
    f"""WITH n AS ({fx.ORDERS_NEW}) SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint', (SELECT count(o_orderkey) FROM n)),
    (2, 'o_custkey', 'bigint', (SELECT count(o_custkey) FROM n)), (3, 'o_orderstatus', 'string', (SELECT count(o_orderstatus) FROM n)),
    (4, 'o_totalprice', 'double', (SELECT count(o_totalprice) FROM n)), (5, 'o_orderdate', 'timestamp_ntz', (SELECT count(o_orderdate) FROM n)),
    (6, 'o_orderpriority', 'string', (SELECT count(o_orderpriority) FROM n))) AS t(ordinal, "column", type, non_null)""",
)
def q_describe(spark: SparkSession, sf: str) -> DataFrame:
    return describe_columns(fx.orders_new(spark, sf), counts=True)


@query(
    "list_datasets",
    " UNION ALL ".join(f"SELECT 'view' AS kind, '{t}' AS name, (SELECT count(*) FROM {t}) AS num_rows" for t in sorted(TABLES)),
)
def q_list(spark: SparkSession, sf: str) -> DataFrame:
    register_tables(spark, sf)
    counts = None
    for t in TABLES:
        one = row_count(spark.table(t)).select(F.lit(t).alias("name"), F.col("n").alias("num_rows"))
        counts = one if counts is None else counts.unionByName(one)
    return list_datasets(spark).join(counts, "name").select("kind", "name", "num_rows")


@query(
    "text_widths",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(least(greatest(strlen('{c}'), max(strlen({t}))) + 2, 30) AS INTEGER) AS width FROM events" for c, t in EVENT_TEXT.items())
    + ")",
)
def q_widths(spark: SparkSession, sf: str) -> DataFrame:
    return text_widths(table(spark, sf, "events"))


def csv_sql(c: str) -> str:
    return f"CASE WHEN contains({c}, ',') OR contains({c}, '\"') OR contains({c}, chr(10)) THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(
    "csv_line",
    "SELECT concat_ws(',', " + ", ".join(csv_sql(c) for c in ["CAST(doc_id AS VARCHAR)", "text", "lang", "source", "CAST(n_chars AS VARCHAR)"]) + ") AS line FROM documents",
)
def q_csv_line(spark: SparkSession, sf: str) -> DataFrame:
    return csv_line(table(spark, sf, "documents"))


@query("export_csv", ORDERS_NEW_AS_TEXT)
def q_export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    export_csv(fx.orders_new(spark, sf), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


@query(
    "run_stats",
    """SELECT md5(lower(event_type)) AS fingerprint, count(*) AS runs, round(avg(value), 6) AS mean_seconds, max(value) AS max_seconds
    FROM events GROUP BY 1""",
)
def q_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = run_stats(table(spark, sf, "events"), "event_type", "value")
    return stats.withColumn("mean_seconds", F.round("mean_seconds", 6))


WORDS = r"SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM documents UNION SELECT DISTINCT p_name FROM part"


def words(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "documents").select(F.explode(F.split("text", " ", -1)).alias("term"))
    return vocabulary([text, table(spark, sf, "part").select("p_name")])


@query("vocabulary", WORDS)
def q_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf)


@query(
    "prefix_lookup",
    f"""WITH w AS ({WORDS}), p AS (SELECT DISTINCT substring(n_name, 1, 3) AS prefix FROM nation UNION SELECT DISTINCT lang FROM documents
      UNION SELECT DISTINCT lower(p_type) FROM part)
    SELECT prefix, term FROM w JOIN p ON starts_with(lower(term), lower(prefix))""",
)
def q_prefix(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = (
        table(spark, sf, "nation").select(F.substring("n_name", 1, 3).alias("prefix"))
        .unionByName(table(spark, sf, "documents").select(F.col("lang").alias("prefix")))
        .unionByName(table(spark, sf, "part").select(F.lower("p_type").alias("prefix")))
    )
    return prefix_lookup(words(spark, sf), prefixes)


# ad-hoc SQL: what the tables answer through run_sql, once for Spark and once for DuckDB

PACK: dict[str, tuple[str, str]] = {}


def _pack(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    PACK[name] = (spark_sql, duck_sql or spark_sql)

    @query(name, duck_sql or spark_sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        register_tables(spark, sf, spark_sql)
        return run_sql(spark, spark_sql)[0]


_pack(
    "sql_filter",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' AND o_totalprice > 300000",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 300000",
)
_pack(
    "sql_joins",
    """SELECT n_name, r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
_pack(
    "sql_outer_joins",
    """SELECT c_custkey, s_suppkey, c_nationkey, s_nationkey FROM customer c
    FULL JOIN supplier s ON c.c_custkey = s.s_suppkey""",
)
_pack("sql_left_join", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
_pack("sql_right_join", "SELECT o_orderkey, c_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000")
_pack("sql_semi_join", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
_pack("sql_anti_join", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') u ON o_custkey = c_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') u ON o_custkey = c_custkey")
# an hour reaches into this or the next hour only, so the buckets make it an equi-join
_pack(
    "sql_range_join",
    """WITH b AS (SELECT event_id, user_id, ts, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000L) AS BIGINT) AS h FROM events)
    SELECT a.event_id AS earlier, l.event_id AS later FROM (SELECT event_id, user_id, ts, explode(array(h, h + 1)) AS h FROM b) a
    JOIN b l ON a.user_id = l.user_id AND a.h = l.h AND a.ts < l.ts AND l.ts <= a.ts + INTERVAL 1 HOUR""",
    """SELECT a.event_id AS earlier, l.event_id AS later FROM events a JOIN events l
    ON a.user_id = l.user_id AND a.ts < l.ts AND l.ts <= a.ts + INTERVAL 1 HOUR""",
)
# inside a day by a window per user and day, before it by one row per user and day, so that a
# user with very many events is no single task
_pack(
    "sql_asof_join",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'purchase')),
    days AS (SELECT user_id, day, max(ts) FILTER (WHERE event_type = 'view') AS day_view FROM e GROUP BY user_id, day),
    before AS (SELECT user_id, day, max(day_view) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS earlier FROM days),
    inside AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id, day ORDER BY ts) AS today FROM e)
    SELECT event_id, coalesce(today, earlier) AS last_view FROM inside JOIN before USING (user_id, day) WHERE event_type = 'purchase'""",
    """SELECT p.event_id, v.ts AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
_pack(
    "sql_aggregate",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
      round(avg(l_extendedprice), 4) AS avg_price, count(DISTINCT l_partkey) AS parts,
      count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
_pack(
    "sql_grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""",
)
_pack("sql_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
_pack("sql_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
# windows over one row per customer and month, so that a customer with very many orders is no
# single task; the top order is a partial aggregate
_pack(
    "sql_window",
    """WITH months AS (SELECT o_custkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month,
      sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS top_order, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_custkey, month, top_order, n, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY total DESC, month) AS BIGINT) AS place,
      CAST(sum(total) OVER (PARTITION BY o_custkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving,
      lag(month) OVER (PARTITION BY o_custkey ORDER BY month) AS previous FROM months""",
)
_pack("sql_top_k", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
_pack(
    "sql_set_operations",
    """SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect all', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except all', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""",
)
_pack(
    "sql_scalar_functions",
    """SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS priority, year(o_orderdate) AS y,
      CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, round(sqrt(o_totalprice), 6) AS root,
      concat(o_orderstatus, '-', lpad(CAST(o_custkey AS STRING), 8, '0')) AS code, CAST(abs(o_custkey - 500) AS BIGINT) AS d FROM orders""",
    """SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS priority, CAST(year(o_orderdate) AS INTEGER) AS y,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(sqrt(o_totalprice), 6) AS root,
      concat(o_orderstatus, '-', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS code, CAST(abs(o_custkey - 500) AS BIGINT) AS d FROM orders""",
)
_pack(
    "sql_arrays",
    """SELECT vec_id, round(sqrt(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 0D, (a, x) -> a + x)), 6) AS norm,
      size(filter(embedding, x -> x > 0)) AS positive FROM embeddings""",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
      CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings""",
)
_pack(
    "sql_json",
    "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum, max(from_json(props, 'k INT').k) AS k_max FROM events GROUP BY event_type",
    "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max FROM events GROUP BY event_type",
)
_pack(
    "sql_subquery",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
    WHERE o_totalprice > (SELECT avg(i.o_totalprice) + 1 FROM orders i WHERE i.o_custkey = o.o_custkey)""",
)
_pack(
    "sql_recursive",
    """WITH RECURSIVE place(kind, id, parent) AS (
      SELECT 'region', CAST(r_regionkey AS BIGINT), CAST(NULL AS STRING) FROM region
      UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), concat('region ', n_regionkey) FROM nation
      UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), concat('nation ', c_nationkey) FROM customer),
    walk(node, root, depth) AS (
      SELECT concat(kind, ' ', id), concat(kind, ' ', id), 0 FROM place WHERE parent IS NULL
      UNION ALL SELECT concat(p.kind, ' ', p.id), w.root, w.depth + 1 FROM walk w JOIN place p ON p.parent = w.node)
    SELECT node, root, depth FROM walk""",
    """WITH RECURSIVE place(kind, id, parent) AS (
      SELECT 'region', CAST(r_regionkey AS BIGINT), CAST(NULL AS VARCHAR) FROM region
      UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), concat('region ', n_regionkey) FROM nation
      UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), concat('nation ', c_nationkey) FROM customer),
    walk(node, root, depth) AS (
      SELECT concat(kind, ' ', id), concat(kind, ' ', id), 0 FROM place WHERE parent IS NULL
      UNION ALL SELECT concat(p.kind, ' ', p.id), w.root, w.depth + 1 FROM walk w JOIN place p ON p.parent = w.node)
    SELECT node, root, depth FROM walk""",
)


@query("run_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def q_run_sql(spark: SparkSession, sf: str) -> DataFrame:
    register_tables(spark, sf, "customer")
    sql = "SELECT c_mktsegment, count(*) AS n FROM IDENTIFIER(:t) WHERE c_acctbal > :least GROUP BY c_mktsegment"
    return run_sql(spark, sql, {"t": "customer", "least": 0})[0]


# streams


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return fx.drift(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


# windows that the watermark has closed: those that end at most one day before the last event
CLOSED = f"""WITH e AS ({fx.EVENTS_DRIFTED}), w AS (
  SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start FROM e),
  closed AS (SELECT * FROM w WHERE window_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e))"""


@query(
    "stream_field_inventory",
    f"""{CLOSED}, f AS (SELECT window_start, event_type, props, unnest(json_keys(props)) AS field FROM closed)
    SELECT window_start, event_type, field, CASE field WHEN 'k' THEN 'integer' ELSE 'number' END AS json_type, count(*) AS n
    FROM f GROUP BY 1, 2, 3, 4""",
)
def q_stream_fields(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_field_inventory(event_stream(spark, sf), "ts", "props", ["event_type"])
    return run_to_table(stream, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))


@query(
    "stream_schema_drift",
    f"""{CLOSED}, expected AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS field FROM e WHERE ts < TIMESTAMP '{fx.DRIFT_FROM}'),
    have AS (SELECT window_start, event_id, event_type, unnest(json_keys(props)) AS field FROM closed)
    SELECT window_start, event_type, field, 'new' AS drift, count(*) AS n FROM have
      WHERE (event_type, field) NOT IN (SELECT (event_type, field) FROM expected) GROUP BY 1, 2, 3
    UNION ALL
    SELECT window_start, c.event_type, x.field, 'missing', count(*) FROM closed c JOIN expected x ON x.event_type = c.event_type
      WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.event_id = c.event_id AND h.field = x.field) GROUP BY 1, 2, 3""",
)
def q_stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    early = fx.events_drifted(spark, sf).filter(F.col("ts") < F.lit(fx.DRIFT_FROM).cast("timestamp_ntz"))
    expected = field_inventory(early, "props", ["event_type"]).select("event_type", "field")
    stream = stream_schema_drift(event_stream(spark, sf), expected, "ts", "props", ["event_type"])
    return run_to_table(stream, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))


def _order_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is changed twice, first wrongly; the later change counts."""
    schema = table(spark, sf, "orders").schema
    stream = fx.edited_order(spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf))
    gone = F.col("o_orderkey") % 10 == 7
    twice = stream.withColumn("version", F.explode(F.array(F.lit(2), F.lit(1))))
    twice = twice.withColumn("o_orderstatus", F.when(F.col("version") == 1, "T").otherwise(F.col("o_orderstatus")))
    return twice.withColumn("op", F.when(gone & (F.col("version") == 2), "delete").otherwise("upsert"))


def _apply_stream(spark: SparkSession, sf: str, **layout) -> DataFrame:
    base = scratch_path(spark, "published")
    publish(fx.orders_old(spark, sf), base, "orders", **layout)
    stream_apply_changes(_order_stream(spark, sf), base, "orders", ["o_orderkey"], ["version"], scratch_path(spark, "stream-state"))
    return read_dataset(spark, base, "orders")


@query("stream_apply_changes", fx.ORDERS_NEW)
def q_stream_apply(spark: SparkSession, sf: str) -> DataFrame:
    return _apply_stream(spark, sf)


@query("stream_apply_changes_buckets", fx.ORDERS_NEW)
def q_stream_apply_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _apply_stream(spark, sf, keys=["o_orderkey"], buckets=16)


@query("stream_apply_two_sources", fx.ORDERS_NEW)
def q_stream_apply_two(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams into one dataset, each counting its batches from 0, an ordinary publish in between,
    and the first stream started once more."""
    base, half = scratch_path(spark, "published"), F.col("o_orderkey") % 2
    publish(fx.orders_old(spark, sf), base, "orders")
    states = [scratch_path(spark, "stream-state") for _ in range(2)]
    for part in (0, 1, 0):
        changes = _order_stream(spark, sf).filter(half == part)
        stream_apply_changes(changes, base, "orders", ["o_orderkey"], ["version"], states[part])
        publish(read_dataset(spark, base, "orders"), base, "orders")
    return read_dataset(spark, base, "orders")


def _late_changes(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Three deliveries of changes of all orders: the last state first (version 5, deletes included), then older
    states of every order that come late (2 and 4, also of deleted ones), then one in order (6)."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey") % 10
    last = fx.edited_order(orders).withColumn("version", F.lit(5)).withColumn("op", F.when(key == 7, "delete").otherwise("upsert"))
    late = orders.withColumn("version", F.explode(F.array(F.lit(2), F.lit(4)))).withColumn("o_orderstatus", F.lit("late"))
    late = late.withColumn("op", F.when((key == 3) & (F.col("version") == 4), "delete").otherwise("upsert"))
    after = orders.filter(key == 1).withColumn("version", F.lit(6)).withColumn("op", F.lit("upsert"))
    return [last, late, after.withColumn("o_totalprice", -F.col("o_totalprice"))]


def _apply_late(spark: SparkSession, sf: str, **layout) -> DataFrame:
    base, feed, state = (scratch_path(spark, x) for x in ("published", "feed", "stream-state"))
    publish(fx.orders_old(spark, sf), base, "orders", **layout)
    for delivery in _late_changes(spark, sf):
        delivery.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(delivery.schema).parquet(feed)
        stream_apply_changes(stream, base, "orders", ["o_orderkey"], ["version"], state)
    return read_dataset(spark, base, "orders")


LATE = f"""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 1 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM ({fx.ORDERS_NEW})"""


@query("stream_apply_late", LATE)
def q_stream_apply_late(spark: SparkSession, sf: str) -> DataFrame:
    return _apply_late(spark, sf)


@query("stream_apply_late_buckets", LATE)
def q_stream_apply_late_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _apply_late(spark, sf, keys=["o_orderkey"], buckets=16)
