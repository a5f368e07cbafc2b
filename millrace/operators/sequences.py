"""Windows over sequences: runs, transitions, first completion, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import run_places


def run_counter(df: DataFrame, value: str, order: str, within: list[str] | None = None, out: str = "rollout_n") -> DataFrame:
    """Place of a row in its run of equal neighbouring values, from 0; a run starts anew when the value changes.

    Runs are looked for within the groups of ``within``, or along all rows, in the order of ``order``, which may have any
    type. Rows are dealt into ranges whose ends are carried on (``ordered``), so a group may have any number of rows.
    """
    return run_places(df, value, [order], within or [], out)


def transitions(df: DataFrame, trajectory: str, step: str, columns: list[str]) -> DataFrame:
    """Each step with the next one's values as ``next_*``; the last step has none and goes."""
    w = Window.partitionBy(trajectory).orderBy(step)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("more_", F.lead(step).over(w).isNotNull())
    return out.where("more_").drop("more_")


def first_complete_mask(df: DataFrame, trajectory: str, step: str, complete: str, out: str = "mask") -> DataFrame:
    """1 up to and with the first complete step; all ones if none is."""
    w = Window.partitionBy(trajectory).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.when(F.coalesce(F.max(F.col(complete).cast("int")).over(w), F.lit(0)) == 0, 1).otherwise(0))


def sparse_rewards(df: DataFrame, trajectory: str, step: str, complete: str, penalty: float = 0.1) -> DataFrame:
    """Done, valid, reward and a positive flag of each step: only the last step but one can be a forced end."""
    w = Window.partitionBy(trajectory)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(step))
    any_ = F.max(F.col(complete).cast("int")).over(w) == 1
    marked = first_complete_mask(df, trajectory, step, complete, "valid").withColumn("n_", n).withColumn("k_", k).withColumn("positive", any_)
    done = F.col(complete) | (F.col("k_") == F.col("n_") - 1)
    reward = F.when(F.col("k_") == F.col("n_") - 1, -1.0).otherwise(F.col(complete).cast("double") - penalty * F.col("valid"))
    return marked.withColumn("done", done).withColumn("reward", reward).drop("n_", "k_")
