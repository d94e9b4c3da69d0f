"""The given tables, and the migration inputs derived from them (as Spark frames and as SQL)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import spread

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def key_of(kind: str, column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(f"tpch:{kind}:"), value.cast("string"))


class Tables:
    """Lazy access to the parquet tables of one scale, plus the derived inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy rows: these test files hold one row group each."""
        return spread(getattr(self, name))

    # -- snapshot ---------------------------------------------------------------------------------
    @cached_property
    def records(self) -> DataFrame:
        """One record per order; the customer's market segment is its collection."""
        owner = self.customer.select("c_custkey", "c_mktsegment")
        return self.orders.join(owner, F.col("o_custkey") == F.col("c_custkey")).select(
            key_of("order", "o_orderkey").alias("key"),
            key_of("segment", "c_mktsegment").alias("collection"),
            F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
            (F.col("o_orderkey") % 50 == 0).alias("archived"),
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_orderpriority",
            "o_orderdate",
            "o_totalprice",
        )

    @cached_property
    def collections(self) -> DataFrame:
        counted = self.records.groupBy("collection").agg(F.count("*").alias("record_count"))
        name = F.element_at(F.split("collection", ":"), 3)
        return counted.select(
            F.col("collection").alias("key"),
            F.lit("tpch").alias("system"),
            name.alias("id"),
            name.alias("name"),
            "record_count",
        )

    @cached_property
    def fields(self) -> DataFrame:
        """Four declared fields per collection (configuration, a handful of rows)."""
        field = lambda f, n, k, s, p: F.struct(
            F.lit(f).alias("field_id"), F.lit(n).alias("name"), F.lit(k).alias("kind"),
            F.lit(s).alias("source_type"), F.lit(p).alias("pos"),
        )
        declared = F.array(
            field("status", "Status", "status", "status", 0),
            field("priority", "Priority", "select", "select", 1),
            field("ordered", "Order date", "date", "date", 2),
            field("price", "Total price", "number", "number", 3),
        )
        return self.collections.select(F.col("key").alias("collection"), F.inline(declared))

    @cached_property
    def cells(self) -> DataFrame:
        """One row per record and field. The number is kept as text beside its typed value."""
        from waybill.functions.text import number_text

        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        price = F.col("o_totalprice")
        cell = lambda field, kind, text, number: F.struct(
            F.lit(field).alias("field_id"),
            F.lit(kind).alias("kind"),
            text.alias("text"),
            number.alias("number"),
        )
        none = F.lit(None).cast("double")
        return self.records.select(
            F.col("key").alias("record"),
            "collection",
            F.inline(
                F.array(
                    cell("status", "status", F.col("o_orderstatus"), none),
                    cell("priority", "select", F.col("o_orderpriority"), none),
                    cell("ordered", "date", day, none),
                    cell("price", "number", number_text(price), price),
                )
            ),
        )

    # -- plan -------------------------------------------------------------------------------------
    @cached_property
    def actions(self) -> DataFrame:
        """One create action per order, in order-key sequence."""
        k = F.col("o_orderkey")
        skip = k % 10 == 0
        return self.orders.select(
            F.concat(F.lit("act_"), k).alias("id"),
            k.alias("seq"),
            F.lit("create_task").alias("kind"),
            F.concat(F.lit("Create task "), k).alias("label"),
            key_of("order", k).alias("source"),
            key_of("order", k).alias("idempotency_key"),
            F.concat(F.lit("dest:list:"), "o_orderstatus").alias("scope"),
            F.when(skip, F.lit("skip")).otherwise(F.lit("execute")).alias("disposition"),
            F.when(skip, F.lit("skipped"))
            .when(k % 7 == 0, F.lit("lossy"))
            .when(k % 3 == 0, F.lit("transformed"))
            .otherwise(F.lit("supported"))
            .alias("outcome"),
            F.when(skip, F.lit(0)).otherwise(F.lit(1)).alias("estimated_requests"),
            "o_custkey",
            "o_orderstatus",
            "o_orderpriority",
            "o_orderdate",
            "o_totalprice",
        )

    @cached_property
    def id_map(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.orders.where(k % 10 == 0).select(
            key_of("order", k).alias("source_key"),
            F.concat(F.lit("dest:list:"), "o_orderstatus").alias("scope"),
            F.concat(F.lit("dst-"), k).alias("destination_id"),
        )

    # -- findings ---------------------------------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        """One finding per order line. ``seq`` is a total order struct: line keys repeat."""
        from waybill import vocab

        rank = F.col("l_linenumber") % 6
        outcome = vocab.lookup(rank, dict(enumerate(vocab.OUTCOMES)))
        return self.spread("lineitem").select(
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate",
            ).alias("seq"),
            F.concat(F.lit("CODE_"), "l_returnflag").alias("code"),
            outcome.alias("outcome"),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), F.lit("error"))
            .when(F.col("l_quantity") > 20, F.lit("warning"))
            .otherwise(F.lit("info"))
            .alias("severity"),
            F.when(F.col("l_linestatus") == "O", F.lit("destination"))
            .otherwise(F.lit("data"))
            .alias("category"),
            F.concat(F.lit("part "), "l_partkey").alias("message"),
            key_of("order", "l_orderkey").alias("entity"),
            F.concat(F.lit("tpch:supp:"), F.col("l_suppkey") % 4).alias("collection"),
            F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("field_"), F.col("l_suppkey") % 5))
            .alias("field"),
            F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("bigint")).alias(
                "count"
            ),
        )

    # -- destination ------------------------------------------------------------------------------
    @cached_property
    def destination(self) -> DataFrame:
        """The orders as the destination holds them, with known faults."""
        k = F.col("o_orderkey")
        return self.orders.where(k % 97 != 0).select(
            F.concat(F.lit("dst-"), k).alias("destination_id"),
            F.when(k % 83 == 0, F.lit(None).cast("double"))
            .when(k % 89 == 0, F.col("o_totalprice") + 1)
            .otherwise(F.col("o_totalprice"))
            .alias("price"),
            F.when(k % 79 == 0, F.lower("o_orderstatus"))
            .otherwise(F.col("o_orderstatus"))
            .alias("status"),
            F.when(k % 71 == 0, F.concat(F.lit("x"), "o_orderpriority"))
            .otherwise(F.col("o_orderpriority"))
            .alias("priority"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
        )

    # -- event log --------------------------------------------------------------------------------
    @cached_property
    def log(self) -> DataFrame:
        """The event table as a run log: a user is a run, the event id its order."""
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("run_"), "user_id").alias("run_id"),
            "ts",
            F.when(kind == "error", F.lit("error")).otherwise(F.lit("info")).alias("level"),
            F.when(kind == "purchase", F.lit("action_succeeded"))
            .when(kind == "error", F.lit("action_failed"))
            .when(kind == "signup", F.lit("approved"))
            .when(kind == "click", F.lit("in_flight"))
            .otherwise(F.lit("progress"))
            .alias("type"),
            F.concat(F.lit("act_"), (F.col("event_id") % 40)).alias("action_id"),
            "value",
            "props",
        )

    # -- relations --------------------------------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        """Part to supplier as one integer key space, plus the line that states it."""
        return self.lineitem.select(
            F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id")
        )

    # -- pages ------------------------------------------------------------------------------------
    @cached_property
    def page_tree(self) -> DataFrame:
        """Region, nation and customer as pages: (key, parent, title, pos)."""
        region = self.region.select(
            key_of("region", "r_regionkey").alias("key"),
            F.lit(None).cast("string").alias("parent"),
            F.col("r_name").alias("title"),
            F.col("r_regionkey").cast("bigint").alias("pos"),
        )
        nation = self.nation.select(
            key_of("nation", "n_nationkey").alias("key"),
            key_of("region", "n_regionkey").alias("parent"),
            F.col("n_name").alias("title"),
            F.col("n_nationkey").cast("bigint").alias("pos"),
        )
        customer = self.customer.select(
            key_of("customer", "c_custkey").alias("key"),
            key_of("nation", "c_nationkey").alias("parent"),
            F.col("c_name").alias("title"),
            F.col("c_custkey").alias("pos"),
        )
        return region.unionByName(nation).unionByName(customer)

    @cached_property
    def raw_blocks(self) -> DataFrame:
        """Conversation turns as raw page blocks. Every third turn sits under the one before."""
        turn = F.col("turn")
        nested = turn % 3 == 2
        parent_id = F.concat(F.lit("b"), "conv_id", F.lit("-"), turn - 1)
        kind = (
            F.when(F.col("role") == "system", F.lit("callout"))
            .when(turn % 4 == 0, F.lit("heading_4"))
            .when(turn % 4 == 1, F.lit("numbered_list_item"))
            .when(turn % 4 == 2, F.lit("to_do"))
            .when(F.col("conv_id") % 3 == 0, F.lit("meeting_notes"))
            .otherwise(F.lit("paragraph"))
        )
        return self.spread("conversations").select(
            key_of("page", "conv_id").alias("doc"),
            F.concat(F.lit("b"), "conv_id", F.lit("-"), "turn").alias("block_id"),
            F.when(nested, parent_id).alias("parent_id"),
            turn.cast("int").alias("pos"),
            F.when(nested, F.array((turn - 1).cast("int"), turn.cast("int")))
            .otherwise(F.array(turn.cast("int")))
            .alias("path"),
            F.when(nested, F.lit(1)).otherwise(F.lit(0)).alias("depth"),
            kind.alias("type"),
            F.col("text"),
            F.col("role"),
            F.col("conv_id"),
            turn,
        )


# -- the same inputs for the SQL side ---------------------------------------------------------------
RECORDS = """records AS (
  SELECT 'tpch:order:' || o_orderkey AS key, 'tpch:segment:' || c_mktsegment AS collection,
         'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
         o_orderkey % 50 = 0 AS archived, o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

COLLECTIONS = """collections AS (
  SELECT collection AS key, 'tpch' AS system, split_part(collection, ':', 3) AS id,
         split_part(collection, ':', 3) AS name, count(*)::BIGINT AS record_count
  FROM records GROUP BY collection)"""

FIELDS = """fields AS (
  SELECT key AS collection, f.* FROM collections CROSS JOIN (VALUES
    ('status', 'Status', 'status', 'status', 0), ('priority', 'Priority', 'select', 'select', 1),
    ('ordered', 'Order date', 'date', 'date', 2),
    ('price', 'Total price', 'number', 'number', 3)) f(field_id, name, kind, source_type, pos))"""

PRICE_TEXT = "regexp_replace(o_totalprice::VARCHAR, '\\.0$', '')"

CELLS = f"""cells AS (
  SELECT key AS record, collection, 'status' AS field_id, 'status' AS kind, o_orderstatus AS text,
         NULL::DOUBLE AS number FROM records
  UNION ALL SELECT key, collection, 'priority', 'select', o_orderpriority, NULL FROM records
  UNION ALL SELECT key, collection, 'ordered', 'date', created_at, NULL FROM records
  UNION ALL SELECT key, collection, 'price', 'number', {PRICE_TEXT}, o_totalprice FROM records)"""

ACTIONS = """actions AS (
  SELECT 'act_' || o_orderkey AS id, o_orderkey AS seq, 'create_task' AS kind,
         'Create task ' || o_orderkey AS label, 'tpch:order:' || o_orderkey AS source,
         'tpch:order:' || o_orderkey AS idempotency_key, 'dest:list:' || o_orderstatus AS scope,
         CASE WHEN o_orderkey % 10 = 0 THEN 'skip' ELSE 'execute' END AS disposition,
         CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'lossy'
              WHEN o_orderkey % 3 = 0 THEN 'transformed' ELSE 'supported' END AS outcome,
         CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS estimated_requests,
         o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice
  FROM orders)"""

ID_MAP = """id_map AS (
  SELECT 'tpch:order:' || o_orderkey AS source_key, 'dest:list:' || o_orderstatus AS scope,
         'dst-' || o_orderkey AS destination_id
  FROM orders WHERE o_orderkey % 10 = 0)"""

SEQ = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)

FINDINGS = f"""findings AS (
  SELECT {SEQ}, 'CODE_' || l_returnflag AS code,
         ['supported', 'transformed', 'lossy', 'unsupported', 'skipped', 'failed']
           [l_linenumber % 6 + 1] AS outcome,
         CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'error'
              WHEN l_quantity > 20 THEN 'warning' ELSE 'info' END AS severity,
         CASE WHEN l_linestatus = 'O' THEN 'destination' ELSE 'data' END AS category,
         'part ' || l_partkey AS message, 'tpch:order:' || l_orderkey AS entity,
         'tpch:supp:' || l_suppkey % 4 AS collection,
         CASE WHEN l_suppkey % 5 <> 0 THEN 'field_' || l_suppkey % 5 END AS field,
         CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT END AS count
  FROM lineitem)"""

DESTINATION = """destination AS (
  SELECT 'dst-' || o_orderkey AS destination_id,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1
              ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 79 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 71 = 0 THEN 'x' || o_orderpriority ELSE o_orderpriority END
           AS priority,
         strftime(o_orderdate, '%Y-%m-%d') AS ordered
  FROM orders WHERE o_orderkey % 97 <> 0)"""

LOG = """log AS (
  SELECT event_id AS id, 'run_' || user_id AS run_id, ts,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
         CASE event_type WHEN 'purchase' THEN 'action_succeeded' WHEN 'error' THEN 'action_failed'
              WHEN 'signup' THEN 'approved' WHEN 'click' THEN 'in_flight' ELSE 'progress' END
           AS type,
         'act_' || event_id % 40 AS action_id, value, props
  FROM events)"""

EDGES = "edges AS (SELECT l_partkey AS from_id, l_suppkey AS to_id FROM lineitem)"

PAGE_TREE = """page_tree AS (
  SELECT 'tpch:region:' || r_regionkey AS key, NULL::VARCHAR AS parent, r_name AS title,
         r_regionkey::BIGINT AS pos FROM region
  UNION ALL SELECT 'tpch:nation:' || n_nationkey, 'tpch:region:' || n_regionkey, n_name,
         n_nationkey::BIGINT FROM nation
  UNION ALL SELECT 'tpch:customer:' || c_custkey, 'tpch:nation:' || c_nationkey, c_name,
         c_custkey FROM customer)"""

RAW_BLOCKS = """raw_blocks AS (
  SELECT 'tpch:page:' || conv_id AS doc, 'b' || conv_id || '-' || turn AS block_id,
         CASE WHEN turn % 3 = 2 THEN 'b' || conv_id || '-' || (turn - 1) END AS parent_id,
         turn::INT AS pos, CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS depth,
         CASE WHEN role = 'system' THEN 'callout' WHEN turn % 4 = 0 THEN 'heading_4'
              WHEN turn % 4 = 1 THEN 'numbered_list_item' WHEN turn % 4 = 2 THEN 'to_do'
              WHEN conv_id % 3 = 0 THEN 'meeting_notes' ELSE 'paragraph' END AS type,
         text, role, conv_id, turn
  FROM conversations)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
