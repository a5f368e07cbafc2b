"""The test tables seen as trajectories: an order is a row, its customer the group, its line items the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag"]


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, uid, source and the token arrays reward, value, mask, old_logp, rollout_logp, pi2."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_ORDER).alias("t"))
    grouped = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("t")).alias("t"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")

    def each(f) -> Column:
        return F.transform("t", f)

    return orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderpriority").alias("source"),
        each(lambda t: t["l_extendedprice"] / 997).alias("reward"),
        each(lambda t: t["l_quantity"]).alias("value"),
        each(lambda t: F.when(t["l_returnflag"] != "N", 1).otherwise(0)).alias("mask"),
        each(lambda t: -10 * t["l_discount"]).alias("old_logp"),
        each(lambda t: -10 * t["l_tax"]).alias("rollout_logp"),
        each(lambda t: t["l_tax"]).alias("pi2"),
    )


def long(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """One row a token: keys, pos and the arrays' values rounded to 6 digits."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    one = df.select(*keys, F.posexplode(zipped).alias("pos", "t"))
    return one.select(*keys, F.col("pos").cast("bigint").alias("pos"), *[F.round(F.col(f"t.{c}") + 0.0, 6).alias(c) for c in columns])


TOK = """tok as (select o.o_orderkey as row_id, o.o_custkey as uid, o.o_orderpriority as source,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag) - 1 as bigint) as pos,
  l_extendedprice / 997 as reward, l_quantity as value, case when l_returnflag <> 'N' then 1 else 0 end as mask,
  -10 * l_discount as old_logp, -10 * l_tax as rollout_logp, l_tax as pi2
  from orders o join lineitem l on o.o_orderkey = l.l_orderkey)"""
ROWS = """per_row as (select row_id, uid, sum(reward) as score, sum(mask) as len, count(*) as t from tok group by 1, 2)"""
