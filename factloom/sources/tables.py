"""Typed roles over the landed Parquet tables.

A role is a narrow projection whose expressions are valid Spark SQL and DuckDB SQL alike, so that a query and its oracle
start from the same rows. Column pruning and filters reach the scans, as roles are plain projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: role -> (tables joined from left to right as (table, left key, right key), expressions)
ROLES: dict[str, tuple[list[tuple[str, str, str]], list[str]]] = {
    "actors": (
        [("supplier", "", ""), ("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")],
        [
            "s_suppkey AS actor_id",
            "s_name AS name",
            "n_name AS country",
            "CASE r_name WHEN 'AFRICA' THEN 'C1' WHEN 'AMERICA' THEN 'C2' WHEN 'ASIA' THEN 'A1' WHEN 'EUROPE' THEN 'T1' ELSE '' END AS class",
            "s_acctbal >= 0 AS active",
            "s_suppkey % 10 = 0 AS is_reference",
            "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE r_name END AS parent",
            "s_acctbal AS balance",
        ],
    ),
    "evidence": (
        [("lineitem", "", "")],
        [
            "l_orderkey * 8 + l_linenumber AS evidence_id",
            "l_orderkey AS offer_id",
            "l_suppkey AS actor_id",
            "l_partkey AS part_id",
            "CASE l_returnflag WHEN 'A' THEN 'existing' WHEN 'N' THEN 'radar' ELSE 'pending' END AS bucket",
            "CASE WHEN l_linestatus = 'F' THEN 'validated' ELSE 'review' END AS status",
            "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END AS confidence",
            "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'de' END AS lang",
            "l_tax < 0.04 AS verbatim",
            "CASE l_linenumber % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'observed_only' ELSE 'unknown' END AS date_confidence",
            "CAST(l_shipdate AS DATE) AS created",
            "l_extendedprice AS amount",
            "l_quantity AS quantity",
        ],
    ),
    "offers": (
        [("orders", "", "")],
        [
            "o_orderkey AS offer_id",
            "o_custkey AS buyer_id",
            "CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status",
            "CAST(substr(o_orderpriority, 1, 1) AS INT) AS precedence",
            "CAST(o_orderdate AS DATE) AS published",
            "o_totalprice AS price",
        ],
    ),
    "parts": (
        [("part", "", "")],
        ["p_partkey AS part_id", "nullif(p_type, 'PROMO') AS market", "p_brand AS component", "p_name AS label", "p_size AS size", "p_retailprice AS list_price"],
    ),
    "buyers": (
        [("customer", "", "")],
        ["c_custkey AS buyer_id", "c_name AS buyer", "c_nationkey AS nation_id", "c_mktsegment AS segment", "c_acctbal AS balance"],
    ),
    "runs": (
        [("events", "", "")],
        ["event_id", "CAST(ts AS DATE) AS day", "user_id", "event_type", "value", "props"],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, expressions = ROLES[name]
    df = table(spark, sf_dir, tables[0][0])
    for t, left, right in tables[1:]:
        other = table(spark, sf_dir, t)
        df = df.join(other, df[left] == other[right])
    return df.selectExpr(*expressions)


def role_sql(name: str) -> str:
    tables, expressions = ROLES[name]
    source = tables[0][0] + "".join(f" JOIN {t} ON {left} = {right}" for t, left, right in tables[1:])
    return f"{name} AS (SELECT {', '.join(expressions)} FROM {source})"


def with_roles(sql: str, *names: str) -> str:
    """The statement behind the CTEs of the named roles; a statement that begins with WITH goes on from them."""
    ctes = ",\n".join(role_sql(n) for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
