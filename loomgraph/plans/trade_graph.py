"""A graph derived from the star-schema tables, on which the graph queries run.

Regions, nations, customers, orders, suppliers and parts are nodes.  CONTAINS goes from regions down
to orders and suppliers; CALLS from an order to the parts it returned in bulk; IMPORTS from a nation
to the two nations it sells most to, IMPORTS_STRONG to those well above its mean; EXTENDS to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.navigator import Navigator
from loomgraph.session import stored

REPOSITORY = "T"
_STEP = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [
        ("region", "Region", "r_regionkey", "r_name"),
        ("nation", "Nation", "n_nationkey", "n_name"),
        ("customer", "Customer", "c_custkey", "c_name"),
        ("orders", "Order", "o_orderkey", "o_orderstatus"),
        ("supplier", "Supplier", "s_suppkey", "s_name"),
        ("part", "Part", "p_partkey", "p_name"),
    ]
    parts = []
    for rank, (name, kind, key, label) in enumerate(kinds):
        node_id = _node(kind.lower(), key)
        parts.append(
            table(spark, sf_dir, name).select(
                F.lit(REPOSITORY).alias("repository_id"),
                node_id.alias("id"),
                F.lit(kind).alias("type"),
                F.col(label).alias("name"),
                node_id.alias("qualified_name"),
                F.lit(None).cast("string").alias("file_id"),
                F.lit(True).alias("exported"),
                F.lit(None).cast("string").alias("path"),
                F.lit(None).cast("string").alias("language"),
                (F.col(key).cast("bigint") + rank * _STEP).alias("ord"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a (seller's nation), b (buyer's), revenue, rank within the seller, and the seller's mean."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    # Sums up per order and seller before the larger join.
    sold = lines.join(sellers, "l_suppkey").groupBy("l_orderkey", "a").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    pairs = sold.join(orders, "l_orderkey").join(buyers, "o_custkey").filter("a <> b").groupBy("a", "b").agg(F.sum("revenue").alias("revenue"))
    own = Window.partitionBy("a")
    return pairs.select(
        F.col("a").cast("bigint").alias("a"),
        F.col("b").cast("bigint").alias("b"),
        "revenue",
        F.row_number().over(own.orderBy(F.desc("revenue"), "b")).alias("rank"),
        (F.sum("revenue").over(own).cast("double") / F.count("*").over(own)).alias("mean"),
    )


def _edges(rows: DataFrame, src: str, a: str, dst: str, b: str, relation: str, order: Column) -> DataFrame:
    return rows.select(
        F.lit(REPOSITORY).alias("repository_id"), _node(src, a).alias("src"), _node(dst, b).alias("dst"), F.lit(relation).alias("relation"), F.lit("{}").alias("metadata_json"), order.cast("bigint").alias("ord")
    )


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    orders, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    return (
        _edges(nation, "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS", F.col("n_nationkey"))
        .unionByName(_edges(customer, "nation", "c_nationkey", "customer", "c_custkey", "CONTAINS", F.col("c_custkey") + _STEP))
        .unionByName(_edges(orders, "customer", "o_custkey", "order", "o_orderkey", "CONTAINS", F.col("o_orderkey") + 2 * _STEP))
        .unionByName(_edges(supplier, "nation", "s_nationkey", "supplier", "s_suppkey", "CONTAINS", F.col("s_suppkey") + 3 * _STEP))
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_partkey").distinct()
    return _edges(rows, "order", "l_orderkey", "part", "l_partkey", "CALLS", F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000)


def imports(spark: SparkSession, sf_dir: str, strong: bool = False, sold: DataFrame | None = None) -> DataFrame:
    rows = (trade(spark, sf_dir) if sold is None else sold).filter("rank <= 2 and revenue > 1.5 * mean" if strong else "rank <= 2")
    return _edges(rows, "nation", "a", "nation", "b", "IMPORTS", F.col("a") * 10 + F.col("rank"))


def extends(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    return _edges((trade(spark, sf_dir) if sold is None else sold).filter("rank = 1"), "nation", "a", "nation", "b", "EXTENDS", F.col("a"))


def navigator(spark: SparkSession, sf_dir: str, *parts: str) -> Navigator:
    """The graph with the named groups of edges only, so a query reads no table it doesn't need.

    What nations sell each other (625 rows at most) is added up once a query, as its edges are read many times.
    """
    sold = stored(trade(spark, sf_dir), "trade") if {"imports", "extends", "strong"} & set(parts) else None
    make = {
        "contains": contains, "calls": calls, "imports": lambda s, d: imports(s, d, sold=sold), "extends": lambda s, d: extends(s, d, sold), "strong": lambda s, d: imports(s, d, True, sold),
    }
    edges = [make[p](spark, sf_dir) for p in parts]
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return Navigator(nodes(spark, sf_dir), out)


# The same graph as common table expressions for the SQL twins.
SQL_NODES = """
t_nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS name, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, n_nationkey + 1000000000000 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_custkey + 2000000000000 FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderstatus, o_orderkey + 3000000000000 FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, s_suppkey + 4000000000000 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_partkey + 5000000000000 FROM part)"""
SQL_CONTAINS = """
t_contains AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONTAINS' AS relation FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CONTAINS' FROM orders
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier)"""
SQL_CALLS = """
t_calls AS (
  SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'CALLS' AS relation
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"""
SQL_TRADE = """
t_pairs AS (
  SELECT s_nationkey AS a, c_nationkey AS b, sum(l_extendedprice::DECIMAL(18,2)) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL),
t_trade AS (
  SELECT a, b, revenue, row_number() OVER (PARTITION BY a ORDER BY revenue DESC, b) AS rank,
         sum(revenue) OVER (PARTITION BY a)::DOUBLE / count(*) OVER (PARTITION BY a) AS mean FROM t_pairs),
t_imports AS (SELECT 'nation:' || a AS src, 'nation:' || b AS dst, 'IMPORTS' AS relation FROM t_trade WHERE rank <= 2),
t_strong AS (SELECT 'nation:' || a AS src, 'nation:' || b AS dst, 'IMPORTS' AS relation FROM t_trade WHERE rank <= 2 AND revenue > 1.5 * mean),
t_extends AS (SELECT 'nation:' || a AS src, 'nation:' || b AS dst, 'EXTENDS' AS relation FROM t_trade WHERE rank = 1)"""
