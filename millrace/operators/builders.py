"""Training rows from raw tables: the canonical prompt row and its variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import hashed_int


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_rows(df: DataFrame, source: str, question: Column, truth: Column, index: Column, split: str, ability: str = "math", style: str = "rule", system: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """data_source, prompt, ability, reward_model and extra_info of each row; ``extra`` adds fields to extra_info."""
    messages = F.array(*([message("system", F.lit(system))] if system else []), message("user", question))
    info = F.struct(F.lit(split).alias("split"), index.alias("index"), *[c.alias(k) for k, c in (extra or {}).items()])
    return df.select(
        F.lit(source).alias("data_source"), messages.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    )


def tools_kwargs(tool: str, truth: Column) -> Column:
    return F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))


def patch_info(df: DataFrame, **fields: Column) -> DataFrame:
    """extra_info with fields added or replaced."""
    info = F.col("extra_info")
    for name, value in fields.items():
        info = info.withField(name, value)
    return df.withColumn("extra_info", info)


def chat_rows(question: Column, answer: Column) -> Column:
    return F.array(message("user", question), message("assistant", answer))


def unpivot_preferences(df: DataFrame) -> DataFrame:
    """(prompt, response) of chosen and rejected, chosen first."""
    return df.select("*", F.posexplode(F.array("chosen", "rejected")).alias("which", "response")).drop("chosen", "rejected")


def positional_split(df: DataFrame, n: int, share: float = 0.75) -> DataFrame:
    """``train`` for the first rows by dense row_id, ``test`` for the others."""
    return df.withColumn("split", F.when(F.col("row_id") < int(n * share), "train").otherwise("test"))


def hash_split(df: DataFrame, key: str, test_tenths: int = 1, seed=0) -> DataFrame:
    return df.withColumn("split", F.when(hashed_int(seed, key) % 10 < test_tenths, "test").otherwise("train"))


def rename_roles(messages: Column) -> Column:
    """gpt and human under their common names; others fail."""
    role = lambda m: F.when(m["role"] == "gpt", "assistant").when(m["role"] == "human", "user").otherwise(F.raise_error(F.concat(F.lit("unknown role "), m["role"])))
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), m["content"].alias("content")))


def oversample(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def place_answer(choices: Column, answer: Column, key: str, seed=0) -> tuple[Column, Column]:
    """Choices with the right answer at a place drawn by hash, and that place from 0."""
    at = (hashed_int(seed, key) % (F.size(choices) + 1)).cast("int")
    return F.array_insert(choices, at + 1, answer), at


def stratified_split(df: DataFrame, task: str, key: str, held_out: Column, most: int = 40, share: float = 0.8, tests: int = 10, seed=0) -> DataFrame:
    """``ood`` for held-out tasks; of each other task the first rows by hash train, the next are ``id_test``, the rest unused."""
    w = Window.partitionBy(task)
    rank = F.row_number().over(w.orderBy(hashed_int(seed, key), key))
    trained = F.least(F.floor(F.count("*").over(w) * share), F.lit(most))
    df = df.withColumn("rank_", rank).withColumn("train_", trained)
    split = F.when(held_out, "ood").when(F.col("rank_") <= F.col("train_"), "train").when(F.col("rank_") <= F.col("train_") + tests, "id_test").otherwise("unused")
    return df.withColumn("split", split).drop("rank_", "train_")


def task_offsets(trials: DataFrame, task: str = "task", n: str = "trials") -> DataFrame:
    """Running bins of trials: a row a task, so one ordered window does."""
    w = Window.partitionBy().orderBy(task)
    return trials.withColumn("high", F.sum(n).over(w)).withColumn("low", F.col("high") - F.col(n))


def lookup_bins(ids: DataFrame, bins: DataFrame, id_col: str = "id") -> DataFrame:
    """The bin of each id and its offset there; bins are as few as tasks."""
    return ids.join(F.broadcast(bins), (F.col(id_col) >= F.col("low")) & (F.col(id_col) < F.col("high"))).withColumn("offset", F.col(id_col) - F.col("low"))
