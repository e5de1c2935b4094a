"""The logical tables of a recommendation store over the star schema.

An order is an impression of its customer: its parts are shown, a returned line is a click. Parts
are articles, their type is the category and their brand the subcategory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedforge.operators.order import dealt

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, pos, item, label, score, p: a row for each article of an impression."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = read(spark, sf_dir, "lineitem")
    # what a task sorts does not grow with the table
    return dealt(lines, lines.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("row_id"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        F.col("l_partkey").alias("item"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").cast("double").alias("score"),
        (F.col("l_quantity") / 51).alias("p"),
        "l_discount",
        "l_tax",
        "l_extendedprice",
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, user_id, t, inview and labels (lists in the order shown)."""
    lists = (
        shown(spark, sf_dir)
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "item", "label"))).alias("s"))
        .select("row_id", F.transform("s", lambda x: x["item"]).alias("inview"), F.transform("s", lambda x: x["label"]).alias("labels"))
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("t"))
    return orders.join(lists, "row_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))


def candidates(spark: SparkSession, sf_dir: str, method: str = "a") -> DataFrame:
    """row_id, item, score, rank: two stand-in retrieval methods over the shown articles; scores may be negative."""
    s = shown(spark, sf_dir)
    chosen = s.filter("l_discount >= 0.05") if method == "a" else s.filter("l_discount < 0.07")
    score = (F.max("l_tax") - 0.04) if method == "a" else F.max("p")
    per = chosen.groupBy("row_id", "item").agg(F.round(score, 6).alias("score"))
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "item")
    return per.withColumn("rank", F.row_number().over(w))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, click_time, item, seq: returned lines at their order's time."""
    s = shown(spark, sf_dir).filter("label = 1")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("click_time"))
    return s.join(o, "row_id").select("user_id", "click_time", "item", (F.col("row_id") * 100 + F.col("pos")).alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


#: The same tables in SQL.
SQL = """
shown as (
  select l_orderkey as row_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
    l_shipdate, l_returnflag, l_linestatus) - 1 as pos, l_partkey as item, (l_returnflag = 'R')::int as label, l_quantity::double as score, l_quantity / 51 as p,
    l_discount, l_tax, l_extendedprice from lineitem
), lists as (
  select row_id, list(item order by pos) as inview, list(label order by pos) as labels from shown group by row_id
), impressions as (
  select o_orderkey as row_id, o_custkey as user_id, o_orderdate as t, inview, labels from orders join lists on o_orderkey = row_id
), cand_a as (
  select *, row_number() over (partition by row_id order by score desc, item) as rank from (
    select row_id, item, round(max(l_tax) - 0.04, 6) as score from shown where l_discount >= 0.05 group by all)
), cand_b as (
  select *, row_number() over (partition by row_id order by score desc, item) as rank from (
    select row_id, item, round(max(p), 6) as score from shown where l_discount < 0.07 group by all)
), clicks as (
  select o_custkey as user_id, o_orderdate as click_time, item, row_id * 100 + pos as seq from shown join orders on o_orderkey = row_id where label = 1
), ranked as (
  select s.row_id, s.pos, s.item, s.label, coalesce(c.score, 0) as score, row_number() over (partition by s.row_id order by (c.score is not null)::int desc, c.score desc,
    c.rank asc nulls last, s.pos) as rank, c.score is not null as retrieved from shown s left join cand_a c using (row_id, item)
)"""
