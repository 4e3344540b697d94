"""Mixed-type tables derived from the star-schema parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FROZEN_SCORE = """
least(1.0D, greatest(0.0D,
    0.25D * o_totalprice / 500000.0D
  + 0.25D * (10000.0D - c_acctbal) / 11000.0D
  + (case when o_orderpriority = '1-URGENT'  then 0.2D else 0.0D end)
  + (case when c_mktsegment    = 'MACHINERY' then 0.2D else 0.0D end)
  + (case when o_orderstatus   = 'F'         then 0.2D else 0.0D end)))
"""

LABEL_RULE = """
case when (case when o_totalprice > 300000 then 1 else 0 end)
        + (case when c_acctbal < 2000 then 1 else 0 end)
        + (case when o_orderpriority = '1-URGENT' then 1 else 0 end)
        + (case when c_mktsegment = 'MACHINERY' then 1 else 0 end)
        + (case when o_orderstatus = 'F' then 1 else 0 end) >= 3
     then 1 else 0 end
"""

ORDER_FEATURES = [
    "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_month",
    "c_nationkey", "o_totalprice", "c_acctbal",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: key, four discrete and three numeric features, label, score."""
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )
    return joined.selectExpr(
        "o_orderkey as row_id", "o_orderstatus", "o_orderpriority", "c_mktsegment",
        "month(o_orderdate) as o_month", "c_nationkey", "o_totalprice", "c_acctbal",
        f"{LABEL_RULE} as label", f"{FROZEN_SCORE} as score",
    )


def docs_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .selectExpr("doc_id", "lang", "source", "n_chars", "1 - quality as label")
    )


def customer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_nationkey",
        "case when c_acctbal >= 0 then c_acctbal end as c_acctbal",
        "case when c_custkey % 17 <> 0 then c_mktsegment end as c_mktsegment",
    )


def lineitem_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as id", "event_id as seq", "event_type as status", "ts as updated", "props as payload",
    )
