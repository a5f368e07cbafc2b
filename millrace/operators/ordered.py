"""Work along an order of all rows: rows are dealt into ranges of the whole key, and what one range ends with is carried on.

A key of a third of all rows fills a third of the ranges instead of one task. Functions here write the dealt rows once, so they
run jobs while a plan is built; what they carry is a table with a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import written

_INDEX_BITS = 33  # what monotonically_increasing_id() leaves to rows of a partition
#: Columns that ``deal`` adds.
ADDED = ("range_", "slot_", "index_")


def deal(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``range_``, ``slot_`` and ``index_``: rows sorted by ``order`` are dealt into ranges and numbered in each.

    Order columns may have any type that can be sorted; nulls come first unless the column says otherwise. Rows alike in
    all of them are split by a hash of the whole row, so that only rows alike in all columns have to stay together.
    ``slot_`` names the range in such a way that Spark's hash partitioning by it gives each range a task of its own.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    keys = [*[F.col(c) if isinstance(c, str) else c for c in order], F.xxhash64(*hashable)]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    held = written(placed, "dealt").withColumn("range_", F.shiftright("at_", _INDEX_BITS).cast("int")).withColumn("index_", F.col("at_").bitwiseAND((1 << _INDEX_BITS) - 1))
    return held.drop("at_").join(F.broadcast(_slots(spark, parts)), "range_", "left")


def _slots(spark: SparkSession, parts: int) -> DataFrame:
    """(range_, slot_) for all ranges: the smallest number that is hashed to the range's place. A row a range."""
    numbers = spark.range(32 * parts).select(F.col("id").cast("int").alias("slot_"))
    return numbers.groupBy(F.pmod(F.hash("slot_"), F.lit(parts)).alias("range_")).agg(F.min("slot_").alias("slot_"))


def along(*more: str) -> Window:
    """The order within a range, or within those rows of it that share ``more``."""
    return Window.partitionBy("slot_", "range_", *more).orderBy("index_")


def offsets(dealt: DataFrame) -> DataFrame:
    """(range_, before_): the rows of all earlier ranges."""
    counts = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    return counts.select("range_", (F.sum("n_").over(Window.partitionBy().orderBy("range_")) - F.col("n_")).alias("before_"))


def number_rows(df: DataFrame, *order: Column | str, out: str = "row_id") -> DataFrame:
    """Dense positions from 0 in the given order; rows alike in all columns are numbered in any order."""
    dealt = deal(df, *order)
    numbered = dealt.join(F.broadcast(offsets(dealt)), "range_").withColumn(out, F.col("before_") + F.col("index_"))  # a row a range
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


#: Most rows that are found by a limit, whose rows meet in one task.
LIMITED = 100_000


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in the given order. More than LIMITED are found by their numbers, so that no task gathers them."""
    if n <= LIMITED:
        return df.orderBy(*order).limit(n)
    return number_rows(df, *order, out="number_").where(F.col("number_") < n).drop("number_")


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in range(len(keys)):
        out = out & F.col(a)[f"k{k}"].eqNullSafe(F.col(b)[f"k{k}"])
    return out


def carry(dealt: DataFrame, keys: list[str], state: Column, fold) -> DataFrame:
    """(range_, first_, carried_) for rows dealt by ``keys`` and more: what earlier ranges hold for the key that a range begins with.

    ``state`` aggregates the rows of a key in a range, ``fold`` (an aggregate of a column, used as a window function) combines
    the states of neighbouring ranges; only each range's last key can go on in the next. A row a range.
    """
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keys)])
    ends = dealt.groupBy("range_").agg(F.min_by(key, "index_").alias("first_"), F.max_by(key, "index_").alias("last_"))
    tails = dealt.withColumn("key_", key).join(F.broadcast(ends), "range_").where(_same("key_", "last_", keys)).groupBy("range_").agg(state.alias("state_"))  # a row a range
    held = ends.join(tails, "range_")
    running = held.withColumn("so_far_", fold("state_").over(Window.partitionBy("last_").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy().orderBy("range_")
    before = running.withColumn("earlier_", F.lag("last_").over(line)).withColumn("carried_", F.lag("so_far_").over(line))
    return before.select("range_", "first_", F.when(_same("earlier_", "first_", keys), F.col("carried_")).alias("carried_"))


def carried_on(dealt: DataFrame, keys: list[str], seams: DataFrame) -> DataFrame:
    """``dealt`` with ``carried_``: the carried state for rows of the key that their range begins with, null for others."""
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keys)])
    joined = dealt.withColumn("key_", key).join(F.broadcast(seams), "range_")  # a row a range
    return joined.withColumn("carried_", F.when(_same("key_", "first_", keys), F.col("carried_"))).drop("key_", "first_")


def number_within(df: DataFrame, keys: list[str], *order: Column | str, out: str = "place_") -> DataFrame:
    """Positions from 0 within the rows of each key, in the given order; null keys are a key."""
    dealt = deal(df, *keys, *order)
    seams = carry(dealt, keys, F.count("*"), F.sum)
    placed = carried_on(dealt, keys, seams).withColumn(out, (F.row_number().over(along(*keys)) - 1 + F.coalesce("carried_", F.lit(0))).cast("bigint"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def last_before(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """``out``: the last value that isn't null among the earlier rows of the same key, in the given order."""
    dealt = deal(df.withColumn("value_", value), *keys, *order)
    seams = carry(dealt, keys, F.max_by("value_", F.when(F.col("value_").isNotNull(), F.col("index_"))), lambda c: F.last(c, ignorenulls=True))
    here = F.last("value_", ignorenulls=True).over(along(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return carried_on(dealt, keys, seams).withColumn(out, F.coalesce(here, "carried_")).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def run_places(df: DataFrame, value: str, order: list[Column | str], within: list[str], out: str) -> DataFrame:
    """``out``: the place of a row in its run of equal neighbouring values, from 0; a run also ends where ``within`` changes."""
    dealt = deal(df, *within, *order)
    held = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate([*within, value])])
    line = Window.partitionBy().orderBy("range_")
    ends = dealt.groupBy("range_").agg(F.count("*").alias("n_"), F.max_by(held, "index_").alias("tail_"))
    seams = ends.select("range_", (F.sum("n_").over(line) - F.col("n_")).alias("before_"), F.lag("tail_").over(line).alias("tail_"))
    joined = dealt.join(F.broadcast(seams), "range_").withColumn("held_", held).withColumn("number_", F.col("before_") + F.col("index_"))  # a row a range
    previous = F.coalesce(F.lag("held_").over(along()), F.col("tail_"))
    marked = joined.withColumn("previous_", previous)
    begins = F.when(F.col("previous_").isNull() | ~_same("held_", "previous_", [*within, value]), F.col("number_"))
    begun = marked.withColumn("begin_", begins).withColumn("start_", F.max("begin_").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    latest = begun.groupBy("range_").agg(F.max("begin_").alias("latest_"))
    carried = latest.select("range_", F.max("latest_").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    done = begun.join(F.broadcast(carried), "range_").withColumn(out, F.col("number_") - F.coalesce("start_", "carried_"))  # a row a range
    return done.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
