"""Pairs of states derived from the test tables, as DataFrames and as SQL.

Each pair covers its whole table: the remainders below only say which rows an edit touches, so
that both states, and all kinds of change, occur at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablechange.plans.registry import table

ORDER_ATTRS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# two order snapshots
ORDERS_OLD = "SELECT * FROM orders WHERE o_orderkey % 10 <> 3"
ORDERS_NEW = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 6 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 10 <> 7"""


def edited_order(df: DataFrame) -> DataFrame:
    key = F.col("o_orderkey") % 10
    return df.withColumn("o_orderstatus", F.when(key == 5, "X").otherwise(F.col("o_orderstatus"))).withColumn(
        "o_totalprice", F.when(key != 6, F.col("o_totalprice"))
    )


def orders_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 != 3)


def orders_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_order(table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 != 7))


# renamed customers
CUSTOMERS_OLD = "SELECT c_nationkey AS blk, c_name AS k, c_acctbal AS v FROM customer"
CUSTOMERS_NEW = """SELECT c_nationkey AS blk,
  CASE WHEN c_custkey % 7 = 2 THEN replace(c_name, '#', '-')
       WHEN c_custkey % 7 = 4 THEN 'Acct' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS k,
  CASE WHEN c_custkey % 14 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS v
  FROM customer WHERE c_custkey % 11 <> 5"""


def customers_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("blk"), F.col("c_name").alias("k"), F.col("c_acctbal").alias("v")
    )


def customers_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = (
        F.when(key % 7 == 2, F.replace("c_name", F.lit("#"), F.lit("-")))
        .when(key % 7 == 4, F.concat(F.lit("Acct"), key.cast("string")))
        .otherwise(F.col("c_name"))
    )
    balance = F.when(key % 14 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return (
        table(spark, sf_dir, "customer")
        .filter(key % 11 != 5)
        .select(F.col("c_nationkey").alias("blk"), name.alias("k"), balance.alias("v"))
    )


# a schema change of orders: desired columns in order
ORDERS_DESIRED = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "int"),
    ("o_totalprice", "decimal(18,2)"),
    ("o_order_date", "date"),
    ("o_order_priority", "string"),
    ("o_channel", "string"),
]

# edited documents: lines of some lengths removed, a last line added
END_LINE = "-- end --"
EDITED_TEXT = """array_to_string(list_append(
  list_filter(string_split(text, chr(10)), lambda x: length(x) % 7 <> 0), '-- end --'), chr(10))"""


def edited_text(text: str = "text") -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line: F.length(line) % 7 != 0)
    return F.array_join(F.concat(kept, F.array(F.lit(END_LINE))), "\n")


def documents_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("text").alias("old_text"), edited_text().alias("new_text"))


# events whose properties drift from the middle of January on
DRIFT_FROM = "2024-01-16 00:00:00"
EVENTS_DRIFTED = f"""SELECT event_id, ts, user_id, event_type, value,
  CASE WHEN ts >= TIMESTAMP '{DRIFT_FROM}' AND event_type = 'purchase'
       THEN '{{"k": ' || json_extract_string(props, '$.k') || ', "amount": ' || CAST(value AS VARCHAR) || '}}'
       WHEN ts >= TIMESTAMP '{DRIFT_FROM}' AND event_type = 'view' THEN '{{}}'
       ELSE props END AS props
  FROM events"""


def drift(events: DataFrame) -> DataFrame:
    late = F.col("ts") >= F.lit(DRIFT_FROM).cast("timestamp_ntz")
    more = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "amount": '), F.col("value").cast("string"), F.lit("}")
    )
    props = F.when(late & (F.col("event_type") == "purchase"), more).when(late & (F.col("event_type") == "view"), F.lit("{}"))
    return events.withColumn("props", props.otherwise(F.col("props")))


def events_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(table(spark, sf_dir, "events"))


# templates
TEMPLATE = "doc in ${LANG} from ${SOURCE}, ${MISSING}"

# ignore patterns
PATTERNS = ["S*", "*O", "LARGE"]

# dependencies: region, nation, customer, order
EDGES = """SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer
  UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(name: str, a: str, from_key: str, b: str, to_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(a), F.col(from_key).cast("string")).alias("src"),
            F.concat(F.lit(b), F.col(to_key).cast("string")).alias("dst"),
        )

    return (
        link("nation", "R:", "n_regionkey", "N:", "n_nationkey")
        .unionByName(link("customer", "N:", "c_nationkey", "C:", "c_custkey"))
        .unionByName(link("orders", "C:", "o_custkey", "O:", "o_orderkey"))
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    africa = table(spark, sf_dir, "region").filter("r_name = 'AFRICA'")
    return africa.select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("node"))
