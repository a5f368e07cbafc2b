"""Sources: prompt, conversation and preference tables from parquet or JSON, step folders, generators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.batch import hashed
from ..operators.ordered import first_rows


@dataclass
class ReadOptions:
    """How prompt tables are read; ``limit`` counts before over-long prompts go, so fewer rows may remain."""

    prompt_key: str = "prompt"
    limit: int = -1
    shuffle: bool = False
    seed: int = 0
    max_prompt_length: int | None = None
    length: Callable[[Column], Column] | None = None
    columns: list[str] = field(default_factory=list)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    raise ValueError(f"neither parquet nor JSON: {path}")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files' rows, missing columns being null. ``file_no`` is the place in ``paths`` of the path that a row comes from."""
    out = None
    for k, p in enumerate(paths):
        df = read_any(spark, p).withColumn("file_no", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def content_length(prompt: Column) -> Column:
    """Characters of all messages; stands in for a tokenizer, which callers give."""
    return F.aggregate(prompt, F.lit(0), lambda a, m: a + F.length(m["content"]))


def drop_overlong(df: DataFrame, key: str, most: int, length: Callable[[Column], Column] = content_length) -> DataFrame:
    """Rows whose prompt has a length of ``most`` at most; an unknown length counts as too long."""
    return df.where(F.coalesce(length(F.col(key)), F.lit(most + 1)) <= most)


def load_prompts(spark: SparkSession, paths: list[str], options: ReadOptions, order: list[str]) -> DataFrame:
    """Concatenate, limit (first rows in ``order``, or drawn by hash), then drop over-long prompts."""
    df = read_many(spark, paths)
    if options.columns:
        df = df.select(*options.columns)
    if options.limit > 0:
        keys = [hashed(options.seed, *order)] if options.shuffle else []
        df = first_rows(df, options.limit, *keys, *order)
    if options.max_prompt_length is not None:
        df = drop_overlong(df, options.prompt_key, options.max_prompt_length, options.length or content_length)
    return df


def load_conversations(spark: SparkSession, paths: list[str], limit: int = -1, order: list[str] | None = None) -> DataFrame:
    """All conversations, or the first ``limit`` in ``order``, without which they come file by file in the order of their text."""
    df = read_many(spark, paths)
    keys = order or ["file_no", F.to_json(F.struct(*[c for c in df.columns if c != "file_no"]))]
    return first_rows(df, limit, *keys) if limit > 0 else df


def load_preferences(spark: SparkSession, paths: list[str], prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    return read_many(spark, paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def read_steps(spark: SparkSession, folder: str, masks: list[str] | None = None) -> DataFrame:
    """A folder of ``<step>.jsonl``; strings are masked by the patterns, and ``step`` is the file's number."""
    df = spark.read.json(f"{folder.rstrip('/')}/*.jsonl").withColumn("step", F.regexp_extract(F.input_file_name(), r"(\d+)\.jsonl$", 1).cast("int"))
    for name, kind in df.dtypes:
        if kind == "string":
            for p in masks or []:
                df = df.withColumn(name, F.regexp_replace(name, p, "*"))
    return df


def append_rows(rows: DataFrame, path: str, prompt_key: str = "prompt", most: int | None = None, length: Callable[[Column], Column] = content_length) -> None:
    """Append generated prompts to a live parquet table, over-long ones being dropped first."""
    (rows if most is None else drop_overlong(rows, prompt_key, most, length)).write.mode("append").parquet(path)


def batch_appender(generate: Callable[[DataFrame], DataFrame], path: str, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: what ``generate`` makes of each finished batch joins the live table, each batch once.

    A batch that is run again replaces its own earlier rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = generate(batch)
        most = options.get("most")
        kept = rows if most is None else drop_overlong(rows, options.get("prompt_key", "prompt"), most, options.get("length", content_length))
        kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_no={number}")

    return put


def stored_generation(spark: SparkSession, path: str, train_step: int) -> DataFrame | None:
    """The stored batch that the index names for ``train_step``; none if there is no such line or folder."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        step = last_generation(spark.read.parquet(f"{path.rstrip('/')}/index"), train_step).first()["gen_step"]
        return spark.read.parquet(f"{path.rstrip('/')}/gen_step={step}") if step is not None else None
    except (AnalysisException, Py4JJavaError):
        return None


def load_pools(spark: SparkSession, path: str) -> DataFrame | None:
    """A snapshot of ring pools; none if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def last_generation(index: DataFrame, train_step: int) -> DataFrame:
    """The last gen_step that the index (line_no, train_step, gen_step) has for exactly this step."""
    return index.where(F.col("train_step") == train_step).agg(F.max_by("gen_step", "line_no").alias("gen_step"))


class GeneratorSource(DataSource):
    """``format("prompt_generator")``: numbered prompts made in ``partitions`` tasks, for options rows, partitions, prefix."""

    @classmethod
    def name(cls) -> str:
        return "prompt_generator"

    def schema(self) -> str:
        return "row_id bigint, prompt string"

    def reader(self, schema):
        return _GeneratorReader(int(self.options.get("rows", 100)), int(self.options.get("partitions", 4)), self.options.get("prefix", "prompt "))


class _GeneratorReader(DataSourceReader):
    def __init__(self, rows: int, parts: int, prefix: str):
        self.rows, self.parts, self.prefix = rows, parts, prefix

    def partitions(self):
        return [InputPartition((k * self.rows // self.parts, (k + 1) * self.rows // self.parts)) for k in range(self.parts)]

    def read(self, partition):
        for k in range(*partition.value):
            yield k, f"{self.prefix}{k}"
