"""Graphs, communities and queries derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import dealt, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str, min_parts: int = 1) -> DataFrame:
    """``u, v``: u < v once for each order of at least ``min_parts`` different parts that they share; about two rows a line of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()
    # One row for each order: its parts, a missing one counted but paired with none.
    orders = dealt(lines.filter("l_orderkey is not null"), n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.max(F.col("l_partkey").isNull().cast("int")).alias("none"))
    first = orders.filter(F.size("parts") + F.col("none") >= min_parts).select("parts", F.posexplode("parts").alias("i", "u"))
    return dealt(first.select("u", F.explode(F.expr("slice(parts, i + 2, size(parts))")).alias("v")), 2 * n, "u", "v")


def copart_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, w``: parts that share w orders."""
    return _pairs(spark, sf_dir).groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"))


def copart(spark: SparkSession, sf_dir: str, min_parts: int = 1) -> DataFrame:
    """``u, v``: parts that share an order of at least ``min_parts`` different parts."""
    return _pairs(spark, sf_dir, min_parts).distinct()


def copart7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(copart(spark, sf_dir, 7), "copart7")


def copart2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(copart_weighted(spark, sf_dir).filter("w >= 2").select("u", "v"), "copart2")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``community, node``: parts by brand."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("node"))


def brand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, node``: the smallest part of each brand."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("node")).select(F.col("node").alias("query_id"), "node")


# The same tables in SQL, as common table expressions.
SQL_LINES = "l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
SQL_COPART = SQL_LINES + ", e AS MATERIALIZED (SELECT DISTINCT a.p AS u, b.p AS v FROM l a JOIN l b ON a.o = b.o AND a.p < b.p)"
SQL_COPART7 = SQL_LINES + ", k AS (SELECT o FROM l GROUP BY o HAVING count(*) >= 7), e AS MATERIALIZED (SELECT DISTINCT a.p AS u, b.p AS v FROM l a JOIN l b ON a.o = b.o AND a.p < b.p JOIN k ON a.o = k.o)"
SQL_COPART2 = SQL_LINES + ", e AS MATERIALIZED (SELECT a.p AS u, b.p AS v FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2)"
SQL_ADJ = "adj AS MATERIALIZED (SELECT u AS s, v AS d FROM e UNION ALL SELECT v, u FROM e)"
SQL_BRANDS = "c AS (SELECT p_brand AS community, p_partkey AS node FROM part)"
SQL_QUERIES = "q AS (SELECT min(p_partkey) AS node FROM part GROUP BY p_brand)"
