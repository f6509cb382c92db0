"""The relational tables as one property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """node_id, type, name, vec_id of regions, nations, customers, suppliers, orders and parts; parts and customers point at vectors by their key."""
    t = lambda n: table(spark, folder, n)
    none = F.lit(None).cast("bigint")
    parts = [
        t("region").select(_id("r", "r_regionkey").alias("node_id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"), none.alias("vec_id")),
        t("nation").select(_id("n", "n_nationkey"), F.lit("Nation"), "n_name", F.col("n_nationkey").cast("bigint")),
        t("customer").select(_id("c", "c_custkey"), F.lit("Customer"), "c_name", F.col("c_custkey").cast("bigint")),
        t("supplier").select(_id("s", "s_suppkey"), F.lit("Supplier"), "s_name", F.col("s_suppkey").cast("bigint")),
        t("orders").select(_id("o", "o_orderkey"), F.lit("Order"), _id("Order ", "o_orderkey"), none),
        t("part").select(_id("p", "p_partkey"), F.lit("Part"), "p_name", F.col("p_partkey").cast("bigint")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, type, weight: customer placed order, order contains part (weight: quantity), and places from the whole to its parts and back."""
    t = lambda n: table(spark, folder, n)
    one = F.lit(1.0)
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    parts = [
        t("orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), one.alias("weight")),
        lines.select(_id("o", "l_orderkey"), _id("p", "l_partkey"), F.lit("CONTAINS"), F.col("q")),
        t("nation").select(_id("r", "n_regionkey"), _id("n", "n_nationkey"), F.lit("HAS_NATION"), one),
        t("supplier").select(_id("n", "s_nationkey"), _id("s", "s_suppkey"), F.lit("HAS_SUPPLIER"), one),
        t("customer").select(_id("c", "c_custkey"), _id("n", "c_nationkey"), F.lit("LIVES_IN"), one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


NODES_SQL = """nodes AS (
    SELECT 'r' || r_regionkey AS node_id, 'Region' AS type, r_name AS name, CAST(NULL AS BIGINT) AS vec_id FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, CAST(n_nationkey AS BIGINT) FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, CAST(c_custkey AS BIGINT) FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, CAST(s_suppkey AS BIGINT) FROM supplier
    UNION ALL SELECT 'o' || o_orderkey, 'Order', 'Order ' || o_orderkey, NULL FROM orders
    UNION ALL SELECT 'p' || p_partkey, 'Part', p_name, CAST(p_partkey AS BIGINT) FROM part
)"""

EDGES_SQL = """edges AS (
    SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type, CAST(1 AS DOUBLE) AS weight FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS', sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'HAS_NATION', CAST(1 AS DOUBLE) FROM nation
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'HAS_SUPPLIER', CAST(1 AS DOUBLE) FROM supplier
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', CAST(1 AS DOUBLE) FROM customer
)"""
