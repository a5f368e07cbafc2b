"""Advantage estimators: grouped statistics by window, scans inside arrays, global whitening by one aggregate.

Frames have ``row_id``, ``uid``, ``reward`` (array<double>) and ``mask`` (array<int>) unless a function says otherwise;
estimators add ``advantages`` and ``returns`` of the same length. Group statistics are aggregated from scores alone and joined
back, so token arrays are neither sorted nor gathered by group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .staging import written

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str):
    """Name an estimator; a name can't be given to two functions."""

    def put(f):
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = f
        return f

    return put


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def advantage(df: DataFrame, name: str, **options) -> DataFrame:
    return estimator(name)(df, **options)


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", A.total(F.col("reward")))


def _spread(df: DataFrame, value: Column) -> DataFrame:
    """The same value at each unmasked token."""
    out = df.withColumn("value_", value)
    out = out.withColumn("advantages", F.transform("mask", lambda m: F.col("value_") * m))
    return out.withColumn("returns", F.col("advantages")).drop("value_")


def group_mean_std(df: DataFrame, value: str, key: str, eps: float = 1e-6) -> DataFrame:
    """Mean, standard deviation (ddof 1, variance not under ``eps``) and count by key; single rows have 0 and 1."""
    return (
        df.groupBy(key)
        .agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
        .select(key, F.when(F.col("n") <= 1, 0.0).otherwise(F.col("m")).alias("mean"), F.when(F.col("n") <= 1, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(eps)))).alias("std"), F.col("n").alias("count"))
    )


def _with_groups(df: DataFrame, **statistics: Column) -> DataFrame:
    """``df`` with aggregates over all rows of its ``uid`` (null being one of them) as columns."""
    stats = df.groupBy(F.col("uid").alias("uid_")).agg(*[c.alias(name) for name, c in statistics.items()])
    return df.join(stats, F.col("uid").eqNullSafe(F.col("uid_"))).drop("uid_")


def whiten(df: DataFrame, value: str, mask: str = "mask", shift_mean: bool = True, out: str | None = None) -> DataFrame:
    """Masked whitening over all rows; mean and centred moment are one row, which is joined back."""
    tokens = df.select(F.explode(A.compact(F.col(value), F.col(mask))).alias("x"))
    sums = tokens.agg(F.count("*").alias("n_"), F.coalesce(F.avg("x"), F.lit(0.0)).alias("avg_"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("var_"))
    mean = F.col("avg_") * F.col("n_") / (F.col("n_") + 1e-8)
    off = F.col("avg_") - mean
    var = (F.col("var_") + off * off) * F.col("n_") / (F.col("n_") + 1e-8) * F.col("n_") / (F.col("n_") - 1)
    stats = sums.select(mean.alias("mean_"), F.pow(var + 1e-8, -0.5).alias("scale_"))
    back = F.lit(0.0) if shift_mean else F.col("mean_")
    joined = df.join(F.broadcast(stats))  # one row
    return joined.withColumn(out or value, F.transform(value, lambda v: (v - F.col("mean_")) * F.col("scale_") + back)).drop("mean_", "scale_")


def _masked(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.zip_with(column, "mask", lambda v, m: v * m))


def _mean(column: str = "m_") -> Column:
    """A group's mean; that of a single row is 0."""
    return F.when(F.col("n_") == 1, 0.0).otherwise(F.col(column))


def _std(deviation: Column) -> Column:
    """A group's deviation; that of a single row is 1."""
    return F.when(F.col("n_") == 1, 1.0).otherwise(deviation)


@register_estimator("grpo")
def grpo(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Score less the group's mean, over its standard deviation (ddof 1); a single row has mean 0 and deviation 1."""
    df = _with_groups(_scored(df), n_=F.count("*"), m_=F.avg("score"), d_=F.stddev_samp("score"))
    centred = F.col("score") - _mean()
    return _spread(df, centred / (_std(F.col("d_")) + eps) if by_std else centred).drop("n_", "m_", "d_")


@register_estimator("grpo_vectorized")
def grpo_vectorized(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """As grpo, with the variance not under ``eps``."""
    df = _with_groups(_scored(df), n_=F.count("*"), m_=F.avg("score"), v_=F.var_samp("score"))
    centred = F.col("score") - _mean()
    return _spread(df, centred / (_std(F.sqrt(F.greatest("v_", F.lit(eps)))) + eps) if by_std else centred).drop("n_", "m_", "v_")


@register_estimator("gdpo")
def gdpo(df: DataFrame, components: list[str], weights: list[float] | None = None, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """grpo for each component column (a score a row), weighted, summed and whitened over all tokens."""
    means, spreads = [f"m{k}_" for k in range(len(components))], [f"d{k}_" for k in range(len(components))]
    df = _with_groups(df, n_=F.count("*"), **{m: F.avg(c) for m, c in zip(means, components, strict=True)}, **{d: F.stddev_samp(c) for d, c in zip(spreads, components, strict=True)})
    parts = F.lit(0.0)
    for c, m, d, weight in zip(components, means, spreads, weights or [1.0] * len(components), strict=True):
        centred = F.col(c) - _mean(m)
        parts = parts + weight * (centred / (_std(F.col(d)) + eps) if by_std else centred)
    out = _masked(whiten(_spread(df, parts).drop("n_", *means, *spreads), "advantages"), "advantages")
    return out.withColumn("returns", F.col("advantages"))


@register_estimator("grpo_passk")
def grpo_passk(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The best row of a group gets its lead over the second; of equals the smallest row_id is best. A group of one fails.

    The best row is found first, the second among the others, both by aggregation.
    """
    df = _with_groups(_scored(df), n_=F.count("*"), best_=F.max(F.struct(F.col("score"), (-F.col("row_id")).alias("back"))), d_=F.stddev_samp("score"))
    first = (F.col("score") == F.col("best_.score")) & (F.col("row_id") == -F.col("best_.back"))
    df = _with_groups(df.withColumn("first_", first), next_=F.max(F.when(~F.col("first_"), F.col("score"))))
    lead = F.col("score") - F.col("next_")
    best = lead / (F.col("d_") + eps) if by_std else lead
    value = F.when(F.col("n_") < 2, F.raise_error(F.lit("a group needs two rows")).cast("double")).when(F.col("first_"), best).otherwise(0.0)
    return _spread(df, value).drop("n_", "best_", "first_", "next_", "d_")


@register_estimator("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    """Score less the group's mean (0 for a single row), whitened over all tokens."""
    df = _with_groups(_scored(df), n_=F.count("*"), m_=F.avg("score"))
    out = _masked(whiten(_spread(df, F.col("score") - _mean()).drop("n_", "m_"), "advantages"), "advantages")
    return out.withColumn("returns", F.col("advantages"))


@register_estimator("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Score less the mean of the group's other rows; a single row keeps its score."""
    df = _with_groups(_scored(df), n_=F.count("*"), m_=F.avg("score"))
    value = F.when(F.col("n_") > 1, (F.col("score") - F.col("m_")) * F.col("n_") / (F.col("n_") - 1)).otherwise(F.col("score"))
    return _spread(df, value).drop("n_", "m_")


@register_estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """As rloo, but a single row gets 0."""
    df = _with_groups(_scored(df), n_=F.count("*"), s_=F.sum("score"))
    value = F.when(F.col("n_") > 1, (F.col("n_") * F.col("score") - F.col("s_")) / F.greatest(F.col("n_") - 1, F.lit(1))).otherwise(0.0)
    return _spread(df, value).drop("n_", "s_")


@register_estimator("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the group's mean weighted by lengths; a single row has baseline 0."""
    df = _scored(df).withColumn("len_", A.count_on(F.col("mask")))
    df = _with_groups(df, n_=F.count("*"), m_=F.try_divide(F.sum(F.col("len_") * F.col("score")), F.sum("len_")))
    return _spread(df, F.col("score") - _mean()).drop("len_", "n_", "m_")


@register_estimator("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha * (score - group mean) / f_norm; alpha is the rows over the rows with a score other than 0."""
    df = _scored(df)
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha_"))
    df = _with_groups(df, n_=F.count("*"), m_=F.avg("score")).join(F.broadcast(alpha))  # one row
    return _spread(df, F.col("alpha_") * (F.col("score") - _mean()) / f_norm).drop("n_", "m_", "alpha_")


@register_estimator("remax")
def remax(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Reverse cumulative reward less the row's baseline."""
    items = F.zip_with("reward", "mask", lambda r, m: F.struct((r * m).alias("r")))
    out = df.withColumn("returns", A.reverse_scan(items, F.struct(F.lit(0.0).alias("out")), lambda s, x: F.struct((s["out"] + x["r"]).alias("out"))))
    return out.withColumn("advantages", F.zip_with("returns", "mask", lambda r, m: r - F.col(baseline) * m))


@register_estimator("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted reverse sum, whose carry a masked token resets after it is stored; whitened over all tokens."""
    items = F.zip_with("reward", "mask", lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    start = F.struct(F.lit(0.0).alias("carry"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + gamma * s["carry"]
        return F.struct((now * x["m"]).alias("carry"), now.alias("out"))

    out = df.withColumn("returns", A.reverse_scan(items, start, step))
    return _masked(whiten(out, "returns", out="advantages"), "advantages")


@register_estimator("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, value: str = "value", whitened: bool = True) -> DataFrame:
    """Generalised advantage; masked tokens are passed over and keep the carry. Returns are taken before whitening."""
    items = F.transform(F.arrays_zip(F.col("reward").alias("r"), F.col(value).alias("v"), F.col("mask").alias("m")), lambda z: z)
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["out"]
        m = x["m"].cast("double")
        return F.struct((x["v"] * m + s["next"] * (1 - m)).alias("next"), (now * m + s["out"] * (1 - m)).alias("out"))

    out = df.withColumn("advantages", A.reverse_scan(items, start, step))
    out = out.withColumn("returns", F.zip_with("advantages", value, lambda a, v: a + v))
    return whiten(out, "advantages") if whitened else out


#: Rows that go on at a step of running sums; fewer are summed each for itself.
_TOGETHER = 8


def _running(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sums within rows, each added up from its first value; all rows take a step together."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    out, sums, at = np.zeros(len(values)), np.zeros(len(starts)), 0
    while (n := int(np.searchsorted(-lengths, -at))) > _TOGETHER:
        places = starts[:n] + at
        sums[:n] += values[places]
        out[places] = sums[:n]
        at += 1
    for row in range(n):
        out[starts[row] + at : starts[row] + lengths[row]] = np.cumsum(np.concatenate([sums[row : row + 1], values[starts[row] + at : starts[row] + lengths[row]]]))[1:]
    return out


def _baseline_scans(dense: bool):
    def scans(tokens: pa.Array) -> pa.Array:
        """Return to go, running weight and place of each token; after a null all are null."""
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        flat = tokens.flatten()
        nulls = {c: x.is_null().to_numpy(zero_copy_only=False) for c, x in zip(flat.type.names, flat.flatten(), strict=True)}
        r, m, lp, p2, *w = (pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy() for x in flat.flatten())
        starts = np.cumsum(lengths) - lengths

        def listed(values: np.ndarray, *names: str, back: bool = False) -> pa.Array:
            missing = np.logical_or.reduce([nulls[c] for c in names]) if names else np.zeros(len(values), bool)
            values, missing = (values[::-1], missing[::-1]) if back else (values, missing)
            first, length = (len(values) - starts - lengths, lengths) if back else (starts, lengths)
            values = _running(values, first, length)
            missing = _running(missing.astype(np.float64), first, length) > 0 if missing.any() else missing
            return pa.array(values[::-1] if back else values, mask=missing[::-1] if back else missing)

        squares = w[0] * w[0] if w else 1.0
        togo = listed(r * m, "r", "m", back=True)
        grown = listed((1 - 2 * np.exp(lp) + p2) * squares * m, "lp", "p2", "m", *["w"] * bool(w))
        places = pc.subtract(listed(m, "m"), 1.0) if dense else pa.array(np.arange(len(m)) - np.repeat(starts, lengths))
        offsets = pa.array(np.concatenate([starts, [len(m)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (togo, grown, places.cast(pa.int32()))]
        return pa.StructArray.from_arrays(lists, ["togo", "grown", "places"])

    return scans


def _baseline_arrays(df: DataFrame, weight: str | None, dense: bool) -> DataFrame:
    """``df`` with token arrays: return to go, running weight and place (counted over unmasked tokens if ``dense``)."""
    fields = {"r": "reward", "m": "mask", "lp": "old_logp", "p2": "pi2"} | ({"w": weight} if weight else {})
    tokens = F.arrays_zip(*[F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")).alias(f) for f, c in fields.items()])
    scans = F.arrow_udf(_baseline_scans(dense), "togo array<double>, grown array<double>, places array<int>")
    done = df.withColumn("scans_", scans(tokens))
    whole = F.col("reward").isNotNull() & F.col("mask").isNotNull()
    return done.select(*[F.col(f"`{c}`") for c in df.columns], F.when(whole, F.col("scans_.togo")).alias("togo_"), F.when(whole, F.col("scans_.grown")).alias("grown_"), F.when(whole, F.col("scans_.places")).alias("places_"))


@register_estimator("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, weight: str | None = None, tail: bool = True, eps: float = 1e-8, dense: bool = False) -> DataFrame:
    """Return to go less, for each group and place, the mean weighted by accumulated path variance.

    Single rows have baseline 0; so has the tail of a group's only longest row beyond the second length (``tail``).
    With ``dense`` places count unmasked tokens only. Frames also have old_logp and pi2 (sum of squared probabilities).
    Rows with their scans are written once, as groups, lengths and the result each read them. Sums by group and place are
    aggregated map-side; a group's baselines come back to its rows as one array.
    """
    rows = written(_baseline_arrays(df, weight, dense), "rows")
    spans = rows.select("uid", A.count_on(F.col("mask")).alias("len"))
    sizes = (spans.where("len > 0") if dense else spans).groupBy("uid", "len").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("uid").agg(F.sum("n").alias("rows"), F.max("len").alias("top"), F.max_by("n", "len").alias("tops"))
    others = sizes.join(tops.select("uid", "top"), "uid").where("len < top").groupBy("uid").agg(F.max("len").alias("below"))
    limits = tops.join(others, "uid", "left").select("uid", "rows", F.when(F.col("tops") == 1, F.col("below")).alias("second"))
    tokens = rows.select("uid", F.explode(F.arrays_zip(F.col("togo_").alias("g"), F.col("mask").alias("m"), F.col("grown_").alias("w"), F.col("places_").alias("place"))).alias("t"))
    at = tokens.groupBy("uid", F.col("t.place").alias("place")).agg(F.sum(F.col("t.g") * F.col("t.w") * F.col("t.m")).alias("gw"), F.sum(F.col("t.w") * F.col("t.m")).alias("w"))
    base = F.when(F.col("rows") == 1, 0.0).when(F.lit(tail) & F.col("second").isNotNull() & (F.col("place") >= F.col("second")), 0.0).otherwise(F.col("gw") / (F.col("w") + eps))
    listed = at.join(limits, "uid", "left").select("uid", F.struct("place", base.alias("base")).alias("b")).groupBy("uid").agg(F.array_sort(F.collect_list("b")).alias("bases_"))
    out = rows.join(listed, "uid", "left")  # a group's places follow one another, so the first tells where each is
    first = F.get("bases_", F.lit(0))["place"]
    zipped = F.arrays_zip(F.col("togo_").alias("g"), F.col("mask").alias("m"), F.col("places_").alias("p"))
    value = F.transform(zipped, lambda t: (t["g"] - F.get(F.col("bases_"), t["p"] - first)["base"]) * t["m"] + 0.0)
    back = F.transform(zipped, lambda t: t["g"] * t["m"] + 0.0) if dense else F.transform("togo_", lambda g: g + 0.0)
    empty = F.array().cast("array<double>")
    return out.withColumn("advantages", F.coalesce(value, empty)).withColumn("returns", F.coalesce(back, empty)).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("advantages", "returns")], "advantages", "returns")


@register_estimator("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df: DataFrame, **options) -> DataFrame:
    return optimal_token_baseline(df, dense=True, **options)


@register_estimator("flow_grpo")
def flow_grpo(df: DataFrame, eps: float = 1e-4, by_std: bool = True, global_std: bool = True) -> DataFrame:
    """For scores a row (``score``) that hold at each of its steps: the mean is the group's, the deviation all rows' or the group's."""
    t = F.size("mask")
    df = df.withColumn("t_", t)
    df = _with_groups(df, n_=F.sum("t_"), m_=F.sum(F.col("score") * F.col("t_")) / F.sum("t_"), rows_=F.count("*"))
    if global_std:
        spread = df.select(F.explode(F.array_repeat("score", F.col("t_"))).alias("x")).agg(F.stddev_samp("x").alias("d_"))
        df = df.join(F.broadcast(spread))  # one row
    else:
        away = F.col("score") - F.col("m_")
        df = _with_groups(df, q_=F.sum(away * away * F.col("t_")))
        df = df.withColumn("d_", F.when(F.col("rows_") == 1, 1.0).otherwise(F.sqrt(F.col("q_") / (F.col("n_") - 1)))).drop("q_")
    value = (F.col("score") - F.col("m_")) / (F.col("d_") + eps) if by_std else F.col("score") - F.col("m_")
    return _spread(df, value).drop("n_", "m_", "t_", "rows_", "d_")


def multi_trajectory(df: DataFrame, key: str = "key", by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Keys are ``uid_session_index``. grpo over the last row of each session; every row of a session then gets its value."""
    parts = r"^(.*)_([^_]*)_(\d+)$"
    df = df.withColumn("session_", F.regexp_extract(key, parts, 2)).withColumn("index_", F.regexp_extract(key, parts, 3).cast("int"))
    df = df.withColumn("uid", F.regexp_extract(key, parts, 1))
    last = Window.partitionBy("uid", "session_").orderBy(F.desc("index_"))
    finals = grpo(df.withColumn("rank_", F.row_number().over(last)).where("rank_ = 1"), eps=eps, by_std=by_std)
    first = F.element_at(A.compact(F.col("advantages"), F.col("mask")), 1)
    values = finals.select("uid", "session_", F.when(A.count_on(F.col("mask")) > 0, first).otherwise(0.0).alias("value_"))
    return _spread(df.join(values, ["uid", "session_"]).withColumn("v_", F.col("value_")), F.col("v_")).drop("v_", "session_", "index_")


def apply_kl_penalty(df: DataFrame, beta: float, kind: str = "kl") -> tuple[DataFrame, DataFrame]:
    """Rewards less beta times the divergence of old_logp from ref_logp; and the mean over rows of their masked means."""
    kl = F.zip_with(A.kl_penalty(F.col("old_logp"), F.col("ref_logp"), kind), "mask", lambda k, m: k * m)
    out = df.withColumn("kl", kl).withColumn("reward", F.zip_with("reward", "kl", lambda r, k: r - beta * k))
    return out, out.agg(F.avg(A.masked_mean(F.col("kl"), F.col("mask"))).alias("current_kl"))


class AdaptiveKL:
    """Coefficient that moves towards a target divergence."""

    def __init__(self, value: float, target: float, horizon: int):
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, steps: int) -> None:
        error = max(-0.2, min(0.2, current / self.target - 1))
        self.value *= 1 + error * steps / self.horizon


class FixedKL:
    def __init__(self, value: float):
        self.value = value

    def update(self, current: float, steps: int) -> None:
        pass


def kl_controller(kind: str, value: float, target: float = 0.1, horizon: int = 10000):
    if kind == "fixed":
        return FixedKL(value)
    if kind == "adaptive":
        return AdaptiveKL(value, target, horizon)
    raise NotImplementedError(kind)
