"""Batch algebra: rows are identified by ``row_id``, dense from 0 unless a function says otherwise.

A frame has no positions of its own, so whatever depends on order uses that column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import number_rows


def row_count(df: DataFrame) -> int:
    return df.count()


def _checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing when a row doesn't hold ``condition``."""
    return df.where(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


# ---- columns


def select(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*columns)


def pop(df: DataFrame, columns: list[str], key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The named columns with the key, and what is left."""
    taken = select(df, [key, *[c for c in columns if c != key]])
    return taken, df.drop(*[c for c in columns if c != key])


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names for {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def get(df: DataFrame, column: str, default=None) -> Column:
    return F.col(column) if column in df.columns else F.lit(default)


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c[len(prefix) :]) for c in df.columns if c.startswith(prefix)])


def prefix_keys(entries: Column, prefix: str) -> Column:
    """Keys of a map with ``prefix`` in front, once."""
    return F.transform_keys(entries, lambda k, _: F.when(k.startswith(prefix), k).otherwise(F.concat(F.lit(prefix), k)))


def assign(df: DataFrame, **values) -> DataFrame:
    """Constants as columns; a list gives a value to each row by its row_id."""
    for name, value in values.items():
        if isinstance(value, list):
            rows = df.sparkSession.createDataFrame(list(enumerate(value)), ["row_id", name])
            df = df.drop(name).join(rows, "row_id", "left")
        else:
            df = df.withColumn(name, F.lit(value))
    return df


def schema_text(df: DataFrame) -> str:
    return df.schema.treeString()


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""
    from pyspark.sql.types import StructType

    def paths(schema: StructType, at: tuple[str, ...]) -> list[Column]:
        found = []
        for field in schema.fields:
            path = (*at, field.name)
            if isinstance(field.dataType, StructType):
                found += paths(field.dataType, path)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)))
        return found

    return df.select(*paths(df.schema, ()))


# ---- rows


def gather(df: DataFrame, indices: list[int]) -> DataFrame:
    """Rows by index, repeated and ordered as asked; the new row_id is the place in ``indices``."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "place bigint, row_id bigint")
    return df.join(wanted, "row_id").drop("row_id").withColumnRenamed("place", "row_id")


def gather_by(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """As gather, the indices being a frame (place, row_id)."""
    return df.join(wanted, "row_id").drop("row_id").withColumnRenamed("place", "row_id")


def where_mask(df: DataFrame, mask: str | Column) -> DataFrame:
    return df.where(mask)


def cut(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows of Python's slice over ``n`` rows, numbered anew from 0."""
    first, last, stride = slice(start, stop, step).indices(n)
    at = F.col("row_id")
    if stride > 0:
        inside = (at >= first) & (at < last) & ((at - first) % stride == 0)
    else:
        inside = (at <= first) & (at > last) & ((first - at) % -stride == 0)
    return df.where(inside).withColumn("row_id", F.floor((at - first) / stride).cast("bigint"))


def reorder(df: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (place, row_id) is a permutation of the rows."""
    return gather_by(df, places)


def inverse(places: DataFrame) -> DataFrame:
    """The permutation that undoes ``places``."""
    return places.select(F.col("row_id").alias("place"), F.col("place").alias("row_id"))


def repeat(df: DataFrame, times: int, n: int | None = None, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: AABB if interleaved, ABAB otherwise (which needs the number of rows ``n``)."""
    copies = df.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("copy_", F.lit(0)).limit(0)
    if interleave:
        place = F.col("row_id") * times + F.col("copy_")
    else:
        place = F.col("copy_") * (df.count() if n is None else n) + F.col("row_id")
    return copies.withColumn("row_id", place.cast("bigint")).drop("copy_")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says; the new place has the old row_id and the copy's number."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def unfold_columns(df: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """Array columns in ``parts`` equal pieces, a row for each; other columns are repeated. Lengths must be divisible."""
    for c in columns:
        df = df.withColumn(c, F.when(F.size(c) % parts != 0, F.raise_error(F.lit(f"{c} can't be divided by {parts}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    out = df.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        width = (F.size(c) / parts).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("part_") * width + 1, width))
    return out.withColumn("row_id", F.col("row_id") * parts + F.col("part_")).drop("part_")


def fold(df: DataFrame, size: int) -> DataFrame:
    """``size`` neighbouring rows as one; columns become arrays in order of row_id."""
    columns = [c for c in df.columns if c != "row_id"]
    grouped = df.groupBy(F.floor(F.col("row_id") / size).cast("bigint").alias("fold_")).agg(F.array_sort(F.collect_list(F.struct("row_id", *columns))).alias("rows_"))
    return grouped.select(F.col("fold_").alias("row_id"), *[F.col(f"rows_.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Undo fold."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    one = df.select("row_id", F.posexplode(zipped).alias("pos_", "t_"))
    return one.select((F.col("row_id") * size + F.col("pos_")).cast("bigint").alias("row_id"), *[f"t_.{c}" for c in columns])


def pad_to_divisor(df: DataFrame, n: int, divisor: int) -> DataFrame:
    """Rows up to the next multiple, by going through the rows from the head again; ``is_pad`` marks them."""
    missing = -n % divisor
    marked = df.withColumn("is_pad", F.lit(False))
    if not missing or not n:
        return marked
    copies = df.withColumn("place_", F.explode(F.sequence(F.lit(0), F.lit(-(-missing // n) - 1)))).withColumn("place_", F.col("place_") * n + F.col("row_id"))
    extra = copies.where(F.col("place_") < missing).withColumn("row_id", F.col("place_") + n).drop("place_").withColumn("is_pad", F.lit(True))
    return marked.unionByName(extra)


def unpad(df: DataFrame) -> DataFrame:
    return df.where("not is_pad").drop("is_pad")


def pad_with(df: DataFrame, n: int, extra: int, candidate: str = "last") -> DataFrame:
    """``extra`` copies of the first row or (any other word) the last at the end."""
    if extra <= 0 or not n:
        return df
    source = df.where(F.col("row_id") == (0 if candidate == "first" else n - 1))
    places = F.explode(F.sequence(F.lit(n).cast("bigint"), F.lit(n + extra - 1).cast("bigint")))
    return df.unionByName(source.withColumn("row_id", places))


def upsample(df: DataFrame, n: int, multiple: int, template: dict) -> DataFrame:
    """Masked stand-ins up to the next multiple, as a group of their own; ``is_padding`` marks them. Values not given are null."""
    missing = -n % multiple
    marked = df.withColumn("is_padding", F.lit(False))
    if not missing:
        return marked
    rows = df.sparkSession.range(n, n + missing).withColumnRenamed("id", "row_id")
    for field in df.schema.fields:
        if field.name != "row_id":
            rows = rows.withColumn(field.name, F.lit(template.get(field.name)).cast(field.dataType))
    return marked.unionByName(rows.withColumn("is_padding", F.lit(True)))


# ---- tables


def union_columns(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """The columns of both for each row; shared ones must be equal (nulls and NaN alike), and rows must match one to one."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    other = right.withColumnsRenamed({c: f"{c}__right" for c in shared}).withColumnRenamed(key, f"{key}__right")
    joined = left.join(other, F.col(key) == F.col(f"{key}__right"), "full")
    same = F.col(key).isNotNull() & F.col(f"{key}__right").isNotNull()
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__right"))
    return _checked(joined, same, f"rows or shared columns differ: {shared}").drop(f"{key}__right", *[f"{c}__right" for c in shared])


def concat(frames: list[DataFrame], counts: list[int], allow_missing: bool = False) -> DataFrame:
    """Rows of all frames one after another; ``counts`` are their numbers of rows."""
    out, before = None, 0
    for df, n in zip(frames, counts, strict=True):
        moved = df.withColumn("row_id", F.col("row_id") + before)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=allow_missing)
        before += n
    return out


def chunk(df: DataFrame, n: int, chunks: int, even: bool = True) -> DataFrame:
    """``chunk`` number of each row: equal parts; ``n`` must be divisible unless ``even`` is off (the first are larger then)."""
    if n % chunks and even:
        raise ValueError(f"{n} rows can't be cut in {chunks} equal chunks")
    size, more = divmod(n, chunks)
    edge = more * (size + 1)
    at = F.col("row_id")
    number = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(1, size)))
    return df.withColumn("chunk", number.cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("row_id") / size).cast("int"))


def shards(df: DataFrame, n: int, parts: int) -> DataFrame:
    """Equal neighbouring shards; the remainder is dropped."""
    size = n // parts
    return df.where(F.col("row_id") < size * parts).withColumn("shard", F.floor(F.col("row_id") / max(1, size)).cast("int"))


def for_rank(df: DataFrame, rank: int, ranks: int) -> DataFrame:
    return df.where(F.col("row_id") % ranks == rank)


def hashed(seed, *columns) -> Column:
    """A key whose order is a shuffle that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hashed_int(seed, *columns) -> Column:
    return F.conv(F.substring(hashed(seed, *columns), 1, 8), 16, 10).cast("bigint")


def batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, drop_last: bool = True) -> DataFrame:
    """``epoch``, ``batch`` and ``place`` of each row: in order, or shuffled for each epoch by hash.

    Rows are numbered by ranges of epoch and order, so no task holds an epoch.
    """
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.col("row_id").cast("double") if seed is None else hashed_int(seed, "epoch", "row_id").cast("double")
    ends = many.agg(F.min(key), F.max(key), F.count("*")).first()
    n = ends[2] // epochs
    width = (ends[1] or 0.0) - (ends[0] or 0.0) + 1
    ordered = many.withColumn("range_key_", F.col("epoch") * width + key - (ends[0] or 0.0)).withColumn("full_key_", F.col("row_id").cast("string") if seed is None else hashed(seed, "epoch", "row_id"))
    order = ["range_key_", "row_id"] if seed is None else ["range_key_", "full_key_", "row_id"]
    numbered = number_rows(ordered, *order, out="number_").drop("range_key_", "full_key_")
    out = numbered.withColumn("place", F.col("number_") - F.col("epoch") * n).withColumn("batch", F.floor(F.col("place") / size).cast("bigint")).drop("number_")
    return out.where(F.col("batch") < n // size) if drop_last else out


def as_rows(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A frame of equally long columns."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("columns differ in length")
    names = list(columns)
    return spark.createDataFrame([(k, *row) for k, row in enumerate(zip(*columns.values(), strict=True))], ["row_id", *names])


def byte_size(df: DataFrame) -> int:
    """The planner's estimate of the rows' bytes; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def merge_options(a: dict, b: dict) -> dict:
    """Both dicts; a key in both must have equal values."""
    differing = sorted(k for k in a.keys() & b.keys() if a[k] != b[k])
    if differing:
        raise ValueError(f"values differ for {differing}")
    return {**a, **b}


def as_columns(rows: list[dict], names: list[str]) -> dict[str, list]:
    """Rows as columns; a row must have exactly these names."""
    for row in rows:
        if set(row) != set(names):
            raise KeyError(f"expected {sorted(names)}, found {sorted(row)}")
    return {n: [row[n] for row in rows] for n in names}


def jagged(df: DataFrame, column: str, out: str = "offset") -> DataFrame:
    """``out``: where each row's values begin when all are laid end to end in the order of row_id.

    Lengths are summed by ranges first, so no task sees all rows.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = sorted(set(df.agg(F.percentile_approx("row_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    dealt = df.withColumn("range_", F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= F.col("row_id"))) if marks else F.lit(0)).withColumn("len_", F.size(column).cast("bigint"))
    before = Window.partitionBy().orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range_").agg(F.sum("len_").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = Window.partitionBy("range_").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("own_", F.coalesce(F.sum("len_").over(within), F.lit(0))).join(F.broadcast(sums), "range_")  # a row a range
    return placed.withColumn(out, (F.col("before_") + F.col("own_")).cast("bigint")).drop("range_", "len_", "own_", "before_")


def first_of(frames: list[DataFrame]) -> DataFrame:
    """The first of frames that hold the same row of settings."""
    return frames[0].limit(1)


def fields_of(df: DataFrame, keys: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """The named fields of the rows with these keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi").select(key, *fields)


def prompt_items(df: DataFrame, prompt: str = "prompt", negative: str = "negative_prompt", media: tuple[str, ...] = ("images", "videos")) -> DataFrame:
    """Rows as a rollout takes them: raw_prompt (and raw_negative_prompt), index, tools_kwargs and interaction_kwargs lifted from extra_info, media gone.

    What extra_info lacks is 0 or an empty object; kwargs come as JSON.
    """
    info = df.schema["extra_info"].dataType.fieldNames() if "extra_info" in df.columns else []

    def lifted(name: str) -> Column:
        return F.coalesce(F.to_json(F.col(f"extra_info.{name}")), F.lit("{}")) if name in info else F.lit("{}")

    index = F.coalesce(F.col("extra_info.index").cast("bigint"), F.lit(0)) if "index" in info else F.lit(0).cast("bigint")
    out = df.withColumn("raw_prompt", F.col(prompt)).withColumn("index", index).withColumn("tools_kwargs", lifted("tools_kwargs")).withColumn("interaction_kwargs", lifted("interaction_kwargs"))
    if negative in df.columns:
        out = out.withColumn("raw_negative_prompt", F.col(negative))
    return out.drop(*media)
