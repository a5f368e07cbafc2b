"""Rows on their way into and out of generation: samples, paddings, group filters, evaluation, batch balance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import arrays as A
from .batch import chunk, pad_to_divisor
from .partition import balance, workload


def offline_generation(df: DataFrame, call: Callable[[list[str]], list[str]], n: int, prompt: str = "prompt", key: str = "row_id") -> DataFrame:
    """``df`` with ``responses``: ``n`` answers of an outside model to each prompt, in the order of their sample number.

    ``call`` gets the prompts of an Arrow batch, each once a sample; answers are joined back by key, so prompts may be
    generated anywhere.
    """
    samples = df.select(key, F.col(prompt).alias("prompt_")).withColumn("sample_", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(response_=call(part["prompt_"].tolist()))

    schema = StructType([*samples.schema.fields, StructField("response_", StringType())])
    found = samples.mapInPandas(ask, schema).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_", "response_"))).alias("s_"))
    return df.join(found.select(key, F.transform("s_", lambda s: s["response_"]).alias("responses")), key, "left")


def evaluate(df: DataFrame, score: Callable[[Column], Column], source: str = "data_source", responses: str = "responses") -> DataFrame:
    """Source, mean score over its rows of the mean over each row's responses, and rows; rows without responses score null."""
    scores = F.transform(responses, score)
    mean = F.try_divide(A.total(scores), F.size(responses))
    return df.select(F.col(source), mean.alias("m_")).groupBy(source).agg(F.avg("m_").alias("score"), F.count("*").alias("n"))


def filter_groups(df: DataFrame, group: str, metric: str, want: int, batches: int = 1, most_batches: int = 0) -> DataFrame:
    """Rows of the first ``want`` groups, by their smallest row_id, whose metric isn't the same in all rows.

    With fewer such groups another batch has to be generated, which is an error after ``most_batches`` (0: none).
    """
    mixed = df.groupBy(group).agg(F.min(metric).alias("low_"), F.max(metric).alias("high_"), F.min("row_id").alias("first_")).where("low_ < high_ or (low_ is null) <> (high_ is null)")
    chosen = mixed.orderBy("first_").limit(want).select(group)
    if most_batches and batches >= most_batches and chosen.count() < want:
        raise ValueError(f"fewer than {want} groups after {batches} batches")
    return df.join(chosen, group, "left_semi")


def padding_row(df: DataFrame, template: dict[str, Column]) -> DataFrame:
    """One row of ``df``'s columns that trains nothing: the template's values, zeros and empty texts elsewhere, ``is_padding`` set."""
    kinds = {"string": F.lit(""), "boolean": F.lit(False)}
    values = []
    for name, kind in df.dtypes:
        plain = F.array().cast(kind) if kind.startswith("array") else kinds.get(kind, F.lit(0)).cast(kind) if not kind.startswith(("struct", "map")) else F.lit(None).cast(kind)
        values.append(template.get(name, plain).cast(kind).alias(name))
    return df.sparkSession.range(1).select(*values, F.lit(True).alias("is_padding"))


def chunks_with_padding(df: DataFrame, n: int, parts: int) -> tuple[DataFrame, int]:
    """Equal chunks of ``n`` rows filled up from the head, and how many rows were added."""
    padded = pad_to_divisor(df, n, parts)
    added = -n % parts
    return chunk(padded, n + added, parts), added


def response_block(values: Column, prompt: Column, response: Column, width: int, pad=0.0) -> Column:
    """Of values of a whole sequence those that predict its response: a block of ``width``, padded on the right or cut there."""
    own = A.shifted_response(values, F.greatest(prompt, F.lit(1)), response)
    return A.fit_length(own, width, pad, left_pad=False, truncation="right")


def response_mask(attention: Column, width: Column | int) -> Column:
    """The last ``width`` places of the attention mask."""
    n = F.lit(width) if isinstance(width, int) else width
    return F.slice(attention, F.size(attention) - n + 1, n)


def left_aligned(values: Column, mask: Column, pad) -> Column:
    """Padding first, then the unmasked values in their order."""
    kept = A.compact(values, mask)
    return F.concat(F.array_repeat(F.lit(pad), F.size(values) - F.size(kept)), kept)


def loop_output(prompt: Column, response: Column, mask: Column, logp: Column, prompt_width: int, response_width: int, pad: int) -> Column:
    """Struct of one finished turn: ids, attention, response mask and log-probabilities at fixed widths."""
    p, r = A.fit_length(prompt, prompt_width, pad), A.fit_length(response, response_width, pad, left_pad=False)
    on_p = A.fit_length(F.transform(prompt, lambda _: F.lit(1)), prompt_width, 0)
    on_r = A.fit_length(F.transform(response, lambda _: F.lit(1)), response_width, 0, left_pad=False)
    own = F.zip_with(A.fit_length(mask, response_width, 0, left_pad=False), on_r, lambda a, b: a * b)
    return F.struct(F.concat(p, r).alias("ids"), F.concat(on_p, on_r).alias("attention"), own.alias("mask"), A.fit_length(logp, response_width, 0.0, left_pad=False).alias("logp"))


def penalised_rewards(scores: Column, logp: Column, ref: Column, ratio: float) -> Column:
    """Token scores less ``ratio`` times the log ratio to the reference."""
    return F.zip_with(scores, F.zip_with(logp, ref, lambda a, b: a - b), lambda s, d: s - d * ratio)


def image_timing(seconds: Column, images: Column, gpus: int) -> Column:
    """Struct of milliseconds an image and images a second and device."""
    return F.struct(F.try_divide(seconds * 1000, images).alias("ms_per_image"), F.try_divide(images, seconds * gpus).alias("images_per_gpu"))


def rank_order(df: DataFrame, batch: str, length: str, ranks: int, key: str = "row_id") -> DataFrame:
    """``part`` and ``place``: rows dealt to ranks in equal numbers by workload; within a rank short ones are at both ends.

    By ascending workload, the even places come first and the odd ones follow in reverse.
    """
    dealt = balance(df.withColumn("work_", workload(F.col(length))), batch, "work_", ranks, True, key=key)
    own = Window.partitionBy(batch, "part")
    ranked = dealt.withColumn("rank_", F.row_number().over(own.orderBy("work_", key)) - 1).withColumn("n_", F.count("*").over(own))
    place = F.when(F.col("rank_") % 2 == 0, F.col("rank_") / 2).otherwise(F.col("n_") - 1 - (F.col("rank_") - 1) / 2)
    return ranked.withColumn("place", place.cast("bigint")).drop("work_", "rank_", "n_")


def should_pause(queued: int, capacity: int, stale: int, limit: int) -> bool:
    """Whether generation waits: the queue is full, or as many samples are stale as may be."""
    return queued >= capacity or stale >= limit


def valid_blocks(df: DataFrame, valid: str, positive: str) -> DataFrame:
    """Steps that may enter a pool, with ``kind`` positive or negative."""
    return df.where(F.col(valid)).withColumn("kind", F.when(F.col(positive), "positive").otherwise("negative"))


def searched_rows(df: DataFrame, source: Column, truth: Column | None, golden: Column) -> DataFrame:
    """data_source, ground truth and tool arguments of a searched question: the truth that is there, else the golden answers, else none."""
    answers = F.coalesce(*([truth] if truth is not None else []), golden, F.array().cast("array<string>"))
    create = F.struct(answers.alias("ground_truth"), F.concat(F.lit("searchR1_"), source).alias("data_source"))
    return df.withColumn("data_source", F.concat(F.lit("searchR1_"), source)).withColumn("ground_truth", answers).withColumn("tools_kwargs", F.struct(F.struct(create.alias("create_kwargs")).alias("search")))


def choice_rows(df: DataFrame, context: Column, ending: Column, choices: Column, label: Column) -> DataFrame:
    """query, choices and the number of the right one; rows without a label go."""
    kept = df.where(F.length(label) > 0)
    opened = F.concat(F.upper(F.left(ending, F.lit(1))), F.lower(F.substr(ending, F.lit(2))))
    return kept.withColumn("query", F.concat(context, F.lit(" "), opened)).withColumn("choices", choices).withColumn("gold", label.cast("int"))
