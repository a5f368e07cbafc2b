"""Statistics of batches, timings and validation runs; long tables (step, key, value) take the place of dicts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from ..functions import arrays as A


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str, horizon: float | None = None, tokens: float | None = None, rows: float | None = None) -> DataFrame:
    """One row, ``loss``: aggregated token losses. ``tokens`` and ``rows`` override the counts of a distributed batch."""
    s, n = A.masked_sum(F.col(loss), F.col(mask)), A.count_on(F.col(mask))
    per = df.select(s.alias("s"), n.alias("n"), F.size(mask).alias("width"))
    counted = F.lit(rows) if rows is not None else F.count_if(F.col("n") > 0)
    if mode == "token-mean":
        value = F.sum("s") / (F.lit(tokens) if tokens is not None else F.sum("n"))
    elif mode in ("seq-mean-token-sum", "seq-mean-token-sum-norm"):
        value = F.sum(F.when(F.col("n") > 0, F.col("s")).otherwise(0.0)) / counted
        if mode.endswith("norm"):
            value = value / (F.lit(horizon) if horizon is not None else F.max("width"))
    elif mode == "seq-mean-token-mean":
        value = F.sum(F.when(F.col("n") > 0, F.col("s") / (F.col("n") + 1e-8)).otherwise(0.0)) / counted
    else:
        raise ValueError(f"unknown aggregation {mode}")
    return per.agg(value.alias("loss"))


def data_metrics(df: DataFrame, width: int, critic: bool = True) -> DataFrame:
    """One row of batch statistics from score, reward, advantages, returns, value (arrays), mask and prompt_length."""
    n = A.count_on(F.col("mask"))
    per = df.select(
        A.total(F.col("score")).alias("score"), A.total(F.col("reward")).alias("reward"), n.alias("len"), "prompt_length",
        *[A.compact(F.col(c), F.col("mask")).alias(c) for c in ("advantages", "returns", *["value"] * critic)],
    )
    live = F.col("len") > 0

    def three(name: str, value: Column) -> list[Column]:
        return [F.avg(value).alias(f"{name}/mean"), F.max(value).alias(f"{name}/max"), F.min(value).alias(f"{name}/min")]

    def tokens(name: str, c: str) -> list[Column]:
        return [
            (F.sum(A.total(F.col(c))) / F.sum(F.size(c))).alias(f"{name}/mean"),
            F.max(F.array_max(c)).alias(f"{name}/max"),
            F.min(F.array_min(c)).alias(f"{name}/min"),
        ]

    length = F.col("len").cast("double")
    out = [
        *three("score", F.col("score")), *three("reward", F.col("reward")), *tokens("advantages", "advantages"), *tokens("returns", "returns"),
        *three("response_length", length), F.avg((F.col("len") == width).cast("double")).alias("response_length/clip_ratio"),
        F.avg((F.col("len") == 0).cast("double")).alias("response/aborted_ratio"),
        *three("response_length_non_aborted", F.when(live, length)), *three("score_non_aborted", F.when(live, F.col("score"))),
        *three("prompt_length", F.col("prompt_length").cast("double")),
    ]
    if not critic:
        return per.agg(*out)
    out += tokens("value", "value")
    pairs = per.select(F.explode(F.arrays_zip(F.col("returns").alias("r"), F.col("value").alias("v"))).alias("t"))
    explained = pairs.agg((1 - F.var_samp(F.col("t.r") - F.col("t.v")) / (F.var_samp("t.r") + 1e-5)).alias("explained_variance"))
    return per.agg(*out).join(F.broadcast(explained))  # one row each


def variance_proxy(df: DataFrame, gradient_norm: float) -> DataFrame:
    """Proxies of the gradient's signal and noise from advantages, pi2 and old_logp."""
    w = F.zip_with("old_logp", "pi2", lambda lp, p: 1 - 2 * F.exp(lp) + p)
    per = df.select(
        A.masked_mean(F.col("advantages"), F.col("mask")).alias("a"),
        A.masked_sum(w, F.col("mask")).alias("w"),
    )
    n = F.count("*")
    square = F.avg(F.col("a") * F.col("a") * F.col("w"))
    signal = F.lit(float(gradient_norm) ** 2)
    noise = F.greatest(F.lit(0.0), F.when(n > 1, (square - signal) / (n - 1)).otherwise(0.0))
    return per.agg(signal.alias("proxy1_signal_strength"), square.alias("proxy2_total_power"), noise.alias("proxy3_pure_noise"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def timing_per_token(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """``key, seconds`` with milliseconds a token; generation is divided by response tokens, other sections by all."""
    known = ["gen", "ref", "values", "adv", "update_critic", "update_actor"]
    joined = timings.where(F.col("key").isin(known)).join(F.broadcast(tokens))  # one row
    n = F.when(F.col("key") == "gen", F.col("response_tokens")).otherwise(F.col("all_tokens"))
    return joined.select("key", F.col("seconds").alias("timing_s"), F.try_divide(F.col("seconds") * 1000, n).alias("per_token_ms"))


def throughput(tokens: Column, seconds: Column, gpus: int) -> Column:
    return F.try_divide(tokens, seconds * gpus)


def reduce_by_name(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Maximum of keys that contain ``max``, else minimum of those that contain ``min`` (as ``timing`` does), else the mean."""
    return df.groupBy(key).agg(F.when(F.col(key).contains("max"), F.max(value)).when(F.col(key).contains("min"), F.min(value)).otherwise(F.avg(value)).alias(value))


#: Keys whose rule is set by name (fixed values).
WINDOW_RULES = {
    "sum": ["training/rollout_probs_diff_count"],
    "last": ["fully_async/count/stale_samples_processed", "fully_async/count/current_param_version", "training/global_step"],
}


def window_rule(key: Column) -> Column:
    """Aggregation of a metric over a window of steps: names first, then parts of names in this order."""
    rule = F.when(F.lit(False), F.lit(""))
    for name, keys in WINDOW_RULES.items():
        rule = rule.when(key.isin(keys), name)
    lowered = F.lower(key)
    for part, name in (("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"), ("weighted_avg", "weighted_avg")):
        rule = rule.when(lowered.contains(part), name)
    return rule.otherwise("avg")


def aggregate_window(df: DataFrame, window: str = "window", key: str = "key", value: str = "value", step: str = "step", samples: str = "samples") -> DataFrame:
    """One row a window and metric by ``window_rule``."""
    rule = window_rule(F.col(key))
    v = F.col(value)
    return df.groupBy(window, key).agg(
        F.when(rule == "sum", F.sum(v))
        .when(rule == "max", F.max(v))
        .when(rule == "min", F.min(v))
        .when(rule == "last", F.max_by(v, F.col(step)))
        .when(rule == "weighted_avg", F.try_divide(F.sum(v * F.col(samples)), F.sum(samples)))
        .otherwise(F.avg(v))
        .alias(value)
    )


def metric_value(kind: str, value: Column) -> Column:
    """Aggregate of a list of values."""
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[kind.lower()](value)


def aggregate_ranks(df: DataFrame, kind: str, step: str = "step", value: str = "value") -> DataFrame:
    """Values of several ranks by step: means over ranks, then sum or mean over steps; extremes over all."""
    kind = kind.lower()
    if kind in ("min", "max"):
        return df.agg(metric_value(kind, F.col(value)).alias(value))
    return df.groupBy(step).agg(F.avg(value).alias(value)).agg(metric_value(kind, F.col(value)).alias(value))


# ---- validation


def val_mean_std(df: DataFrame, keys: tuple[str, ...] = ("source", "uid", "var"), value: str = "value") -> DataFrame:
    """Count, mean@n and std@n (ddof 0) of each prompt and variable."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


#: Drawn places that a task keeps.
KEPT_PLACES = 4_000_000
#: Drawn places of all groups that are scored at a time.
SCORED_PLACES = 500_000


def drawn_places(n: int, k: int, draws: int, seed: int) -> np.ndarray:
    """Places from 0 to n - 1 of ``draws`` samples of size ``k``: HASH(seed, k, b, j) modulo n for draw j of sample b."""
    first = (int(hashlib.md5(f"{seed}:{k}:{b}:{j}".encode()).hexdigest()[:8], 16) % n for b in range(draws) for j in range(k))
    return np.fromiter(first, dtype=np.int32, count=draws * k).reshape(draws, k)


def group_scores(values: np.ndarray, labels: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of one size, a row each: best and worst value of each sample, and the value of the label with most votes.

    ``labels`` are numbers. Of equally frequent labels the one drawn first wins; its value is the one drawn first for it.
    """
    drawn, codes = values[:, places], labels[:, places]
    k = places.shape[1]
    most, at = np.full(drawn.shape[:2], -1, dtype=np.int64), np.zeros(drawn.shape[:2], dtype=np.int64)
    for code in np.unique(labels):
        hit = codes == code
        votes, first = hit.sum(axis=2), hit.argmax(axis=2)
        rank = np.where(votes > 0, votes * (k + 1) - first, -1)
        at = np.where(rank > most, first, at)
        most = np.maximum(most, rank)
    return drawn.max(axis=2), drawn.min(axis=2), np.take_along_axis(drawn, at[:, :, None], axis=2)[:, :, 0]


def sampled_scores(values: np.ndarray, labels: list, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``group_scores`` of one group with labels of any type."""
    known: dict = {}
    best, worst, vote = group_scores(values[None], np.array([[known.setdefault(x, len(known)) for x in labels]]), places)
    return best[0], worst[0], vote[0]


def bootstrap(df: DataFrame, keys: tuple[str, ...], value: str, pred: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """best@k, worst@k and maj@k of each group: mean and standard deviation (ddof 0) over ``draws`` samples with replacement.

    Rows have ``pos`` from 0 in their group, k is 2, 4, 8 ... below the group's size n, and n. Places are alike for all
    groups of a size, so a task draws them once and scores equal samples once, for many groups at a time.
    """
    g = list(keys)
    row = F.struct("pos", F.col(value).cast("double").alias("v"), (F.col(pred).cast("string") if pred else F.lit("")).alias("p"))
    groups = df.groupBy(*g).agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") > 1)
    groups = groups.select(*g, F.transform("rows", lambda r: r["v"]).alias("v"), F.transform("rows", lambda r: r["p"]).alias("p"))
    names = [f"{m}_{x}" for m in ("best", "worst", "maj") for x in ("mean", "std")]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out, owners = [], []
            sizes: dict[int, list[tuple]] = {}
            for i, (values, labels) in enumerate(zip(batch.column("v").to_pylist(), batch.column("p").to_pylist(), strict=True)):
                known: dict = {}
                codes = [known.setdefault(x, len(known)) for x in labels]
                sizes.setdefault(len(values), []).append((i, [np.nan if v is None else v for v in values], codes))
            for n, same in sizes.items():
                for k in [*(2**e for e in range(1, 21) if 2**e < n), n]:
                    if (n, k) not in held:
                        if sum(x[0].size for x in held.values()) > KEPT_PLACES:
                            held.clear()
                        held[n, k] = np.unique(drawn_places(n, k, draws, seed), axis=0, return_counts=True)
                    places, times = held[n, k]
                    step = max(1, SCORED_PLACES // places.size)
                    for begin in range(0, len(same), step):
                        which, values, codes = zip(*same[begin : begin + step], strict=True)
                        moments = []
                        for x in group_scores(np.array(values, dtype=np.float64), np.array(codes), places):
                            mean = (x * times).sum(axis=1) / draws
                            moments += [mean, np.sqrt(((x - mean[:, None]) ** 2 * times).sum(axis=1) / draws)]
                        out.extend((n, k, *m) for m in zip(*(x.tolist() for x in moments), strict=True))
                        owners.extend(which)
            if out:
                columns = list(zip(*out, strict=True))
                taken = [batch.column(c).take(pa.array(owners)) for c in g]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[2:])], names=[*g, "n", "k", *names])

    schema = groups.select(*g).schema.add("n", LongType()).add("k", IntegerType())
    for name in names:
        schema = schema.add(name, DoubleType())
    out = groups.mapInArrow(sample, schema)
    return out if pred else out.drop("maj_mean", "maj_std")


def majority(df: DataFrame, keys: tuple[str, ...], pred: str, value: str, pos: str = "pos") -> DataFrame:
    """Value of the label with most votes; of equals the one seen first, and of its values the first."""
    votes = df.groupBy(*keys, pred).agg(F.count("*").alias("c"), F.min(pos).alias("first"), F.min_by(value, pos).alias("v"))
    return votes.groupBy(*keys).agg(F.max_by("v", F.struct("c", (-F.col("first")).alias("early"))).alias("value"))


def label_core(df: DataFrame) -> DataFrame:
    """``section`` of (source, var, metric): ``val-core`` for mean, maj and best at the largest n of the chief variable, else ``val-aux``.

    The chief variable of a source is acc if it is there, else reward.
    """
    w = Window.partitionBy("source")
    n = F.regexp_extract("metric", "@([0-9]+)", 1)
    sized = df.withColumn("n_", F.when(n != "", n.cast("int")))
    marked = sized.withColumn("top_", F.max("n_").over(Window.partitionBy("source", "var"))).withColumn("acc_", F.max((F.col("var") == "acc").cast("int")).over(w))
    chief = F.when(F.col("acc_") == 1, "acc").otherwise("reward")
    core = (F.col("var") == chief) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("n_") == F.col("top_"))
    return marked.withColumn("section", F.when(F.coalesce(core, F.lit(False)), "val-core").otherwise("val-aux")).drop("n_", "top_", "acc_")


# ---- others


#: Rows of a bracket that are sorted at once.
BRACKET_ROWS = 100_000


def order_statistic(df: DataFrame, value: str, rank: int) -> float | None:
    """The value of the given rank from 0 in ascending order, nulls apart; null if there are fewer values.

    Values are bracketed by approximate quantiles, which narrows a table by a factor of thousands with one pass that
    keeps a bounded state, until a bracket of one value or of at most BRACKET_ROWS is left.
    """
    left, n = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x")), None
    while True:
        n = left.count() if n is None else n
        if not 0 <= rank < n:
            return None
        if n <= BRACKET_ROWS:
            return sorted(r[0] for r in left.collect())[rank]
        at = (rank + 0.5) / n
        low, high = left.agg(F.percentile_approx("x", [max(0.0, at - 2e-3), min(1.0, at + 2e-3)], 5000)).first()[0]
        under, inside = left.agg(F.count_if(F.col("x") < low), F.count_if((F.col("x") >= low) & (F.col("x") <= high))).first()
        if rank < under:
            left, n = left.where(F.col("x") < low), under
        elif rank >= under + inside:
            left, rank, n = left.where(F.col("x") > high), rank - under - inside, n - under - inside
        elif low == high:
            return low
        elif inside == n:  # nothing narrowed: more equal values at an end than the accuracy tells apart
            ends = left.agg(F.count_if(F.col("x") == low), F.count_if(F.col("x") == high)).first()
            if rank < ends[0]:
                return low
            if rank >= n - ends[1]:
                return high
            left, rank, n = left.where((F.col("x") > low) & (F.col("x") < high)), rank - ends[0], n - ends[0] - ends[1]
        else:
            left, rank, n = left.where((F.col("x") >= low) & (F.col("x") <= high)), rank - under, inside


def quantile(df: DataFrame, value: str, at: float) -> float | None:
    """Linearly interpolated between two order statistics."""
    return order_statistics(df, value, (at,))[0]


def order_statistics(df: DataFrame, value: str, at: tuple[float, ...]) -> list[float | None]:
    """The linearly interpolated quantile for each share, exactly, in three reads of the table for all of them together.

    One pass brackets all ranks by approximate quantiles, one counts what lies under and in the brackets, one fetches the
    values in them, at most BRACKET_ROWS a bracket. A bracket with more is narrowed further by itself; null if there are no values.
    """
    x = F.col(value)
    width = 2e-3
    fractions = [f for p in at for f in (max(0.0, p - width), min(1.0, p + width))]
    n, marks = df.agg(F.count(value), F.percentile_approx(value, fractions, 5000)).first()
    if not n:
        return [None] * len(at)
    brackets = list(zip(marks[::2], marks[1::2], strict=True)) if n > BRACKET_ROWS else [(None, None)] * len(at)
    counts = [0, n] * len(at)
    if n > BRACKET_ROWS:
        counts = list(df.agg(*[c for low, high in brackets for c in (F.count_if(x < low), F.count_if((x >= low) & (x <= high)))]).first())
    small = [k for k in range(len(at)) if counts[2 * k + 1] <= BRACKET_ROWS]
    held: dict = {}
    if small:
        wanted = F.lit(False)
        for low, high in {brackets[k] for k in small}:
            wanted = wanted | (F.lit(True) if low is None else (x >= low) & (x <= high))
        values = sorted(r[0] for r in df.where(x.isNotNull() & wanted).select(x).collect())
        held = {k: [v for v in values if brackets[k][0] is None or brackets[k][0] <= v <= brackets[k][1]] for k in small}
    found = []
    for k, p in enumerate(at):
        place, under = (n - 1) * p, counts[2 * k]
        ranks = (int(place), min(n - 1, int(place) + 1))
        low, high = (held[k][r - under] if k in held and 0 <= r - under < len(held[k]) else order_statistic(df, value, r) for r in ranks)
        found.append(low + (high - low) * (place - int(place)))
    return found


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row of linearly interpolated percentiles; exact, as no state holds all values."""
    return df.sparkSession.createDataFrame([order_statistics(df, value, at)], ", ".join(f"p{round(100 * p)} double" for p in at))


def slowest(df: DataFrame, parts: list[str]) -> DataFrame:
    """Least, mean and most of each timing, and the whole row with the largest sum."""
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    stats = [f(p).alias(f"{p}/{name}") for p in parts for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.agg(*stats, F.max_by(F.struct(*df.columns), total).alias("slowest"))


def topk_ratio(df: DataFrame, value: str, share: float = 0.1) -> DataFrame:
    """Minimum, maximum, and the share of values above the quantile ``1 - share``."""
    q = quantile(df, value, 1 - share)
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg((F.col(value) > F.lit(q)).cast("double")).alias("share"))


def log_prob_debug(df: DataFrame) -> DataFrame:
    """Largest, mean and standard deviation (ddof 1) of masked probability differences, and their correlation; null without tokens."""
    tokens = df.select(F.explode(F.arrays_zip(F.col("old_logp").alias("a"), F.col("rollout_logp").alias("b"), F.col("mask").alias("m"))).alias("t")).where("t.m != 0")
    a, b = F.exp("t.a"), F.exp("t.b")
    d = F.abs(a - b)
    return tokens.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr(a, b).alias("pearson"), F.count("*").alias("n"))


def zero_std_ratio(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of groups without spread, their mean spread (ddof 0) and mean size."""
    per = df.groupBy(key).agg(F.stddev_pop(value).alias("s"), F.count("*").alias("n"))
    return per.agg(F.avg((F.col("s") == 0).cast("double")).alias("zero_std_ratio"), F.avg("s").alias("std_mean"), F.avg("n").alias("group_size"))


def unbalance(df: DataFrame, chunk: str, length: str) -> DataFrame:
    """Smallest, largest and mean sum of the chunks."""
    per = df.groupBy(chunk).agg(F.sum(length).alias("s"))
    return per.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.avg("s").alias("mean"))


def flops(df: DataFrame, length: str, parameters: float, layers: int, heads: int, head_dim: int, seconds: float) -> DataFrame:
    """Achieved TFLOPS of a dense decoder: weights and attention."""
    tokens, squares = F.sum(length), F.sum(F.col(length) * F.col(length))
    return df.agg(((6.0 * parameters * tokens + 12.0 * squares * head_dim * heads * layers / 2) / seconds / 1e12).alias("tflops"))


def special_window_metrics(df: DataFrame, gpus: int) -> DataFrame:
    """Metrics that follow from others, for a row of aggregated metrics a window, where what they need is there."""
    has = set(df.columns)

    def c(name: str) -> Column:
        return F.col(f"`{name}`")

    out = {}
    if {"global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min"} <= has:
        out["global_seqlen/minmax_diff"] = c("global_seqlen/max") - c("global_seqlen/min")
    if {"perf/throughput", "perf/total_num_tokens", "perf/time_per_step"} <= has:
        out["perf/throughput"] = F.try_divide(c("perf/total_num_tokens"), c("perf/time_per_step") * gpus)
    if {"timing_s/gen", "timing_s/step"} <= has:
        out["fully_async/trainer/idle_ratio"] = F.try_divide(c("timing_s/gen"), c("timing_s/step"))
    return df.withColumns(out) if out else df


def positive_trajectory_length(df: DataFrame, done: str = "done", positive: str = "positive") -> DataFrame:
    """Mean place of the first end (1 where there is none) of the rows with any positive step; 0 without such rows."""
    length = F.greatest(F.array_position(done, True), F.lit(1))
    return df.agg(F.coalesce(F.avg(F.when(F.exists(positive, lambda p: p), length)), F.lit(0.0)).alias("length"))


def mean_max_min_std(df: DataFrame, value: str) -> DataFrame:
    """Over all rows of all tasks; standard deviation with ddof 1."""
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def stale_rows(df: DataFrame, version: str, current: Column | str, by: str) -> DataFrame:
    """Rows of each batch whose version is behind, and their running number; a row a batch is ordered."""
    now = F.col(current) if isinstance(current, str) else current
    per = df.groupBy(by).agg(F.count_if(now - F.col(version) >= 1).alias("stale"))
    return per.withColumn("stale_so_far", F.sum("stale").over(Window.orderBy(by)))


def without_padding(df: DataFrame, padding: str) -> DataFrame:
    """The rows that aren't padding, or all rows if all are."""
    real = df.agg(F.count_if(~F.coalesce(F.col(padding), F.lit(False))).alias("real_"))
    return df.join(F.broadcast(real)).where((F.col("real_") == 0) | ~F.coalesce(F.col(padding), F.lit(False))).drop("real_")  # one row


def validate(df: DataFrame, variables: list[str], pred: str | None = "pred", draws: int = 1000, seed: int = 42) -> DataFrame:
    """The metric table of a validation run: section, source, var, metric and value.

    Rows have source, uid, pos (from 0 in each source and uid), the numeric ``variables`` and, for votes, ``pred``. Each
    prompt has mean@n and, with several rows, std@n and best, worst and maj at 2, 4, 8 ... and n with their
    deviations; values are means over the prompts of a source.
    """
    found = None
    for var in variables:
        held = df.where(F.col(var).isNotNull())
        plain = val_mean_std(held.withColumn("var", F.lit(var)), ("source", "uid", "var"), var)
        rows = [plain.select("source", F.concat(F.lit("mean@"), "n").alias("metric"), F.col("mean").alias("value")), plain.where("n > 1").select("source", F.concat(F.lit("std@"), "n").alias("metric"), F.col("std").alias("value"))]
        drawn = bootstrap(held, ("source", "uid"), var, pred, draws, seed)
        for name in ("best", "worst", *["maj"] * bool(pred)):
            for part in ("mean", "std"):
                rows.append(drawn.select("source", F.concat(F.lit(f"{name}@"), "k", F.lit(f"/{part}")).alias("metric"), F.col(f"{name}_{part}").alias("value")))
        for r in rows:
            one = r.withColumn("var", F.lit(var))
            found = one if found is None else found.unionByName(one)
    table = found.groupBy("source", "var", "metric").agg(F.avg("value").alias("value"))
    return label_core(table).select("section", "source", "var", "metric", "value")


def mean_by_source(df: DataFrame, row: str, source: str, score: str) -> DataFrame:
    """Source, mean over its rows of their responses' mean score, and number of rows."""
    per = df.groupBy(row, source).agg(F.avg(score).alias("m_"))
    return per.groupBy(source).agg(F.avg("m_").alias("score"), F.count("*").alias("n"))


def differing_tokens(a: Column, b: Column, mask: Column) -> Column:
    """How many unmasked places of two arrays differ."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda z: (z["m"] == 1) & (z["a"] != z["b"]))).cast("bigint")
