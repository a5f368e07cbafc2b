"""Importance weights, rejection masks and divergence metrics between old_logp and rollout_logp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

BOUND = 20.0
#: Rejection options (fixed values): level and divergence; the largest of k1 isn't one.
OPTIONS = ("token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def parse_weight_threshold(spec) -> tuple[float | None, float]:
    """(lower, upper): a number or ``"u"`` has an upper bound only, ``"l_u"`` both."""
    if isinstance(spec, bool) or not isinstance(spec, (int, float, str)):
        raise TypeError(f"not a threshold: {spec!r}")
    parts = [float(x) for x in str(spec).split("_")]
    if not 1 <= len(parts) <= 2 or any(not x > 0 for x in parts) or parts != sorted(parts):
        raise ValueError(f"not a threshold: {spec!r}")
    return (None, parts[0]) if len(parts) == 1 else (parts[0], parts[1])


def parse_rejection_thresholds(options: list[str], spec) -> list[tuple[float | None, float]]:
    """A threshold for each option, or one for all; k1 options have a band, by default from 1/u."""
    given = [x.strip() for x in str(spec).split(",")]
    if len(given) not in (1, len(options)):
        raise ValueError(f"{len(given)} thresholds for {len(options)} options")
    found = []
    for option, one in zip(options, given * (len(options) if len(given) == 1 else 1), strict=True):
        if option not in OPTIONS:
            raise ValueError(f"unknown option {option}")
        lower, upper = parse_weight_threshold(one)
        if option.endswith("k1"):
            found.append((lower if lower is not None else 1 / upper, upper))
        elif lower is not None:
            raise ValueError(f"{option} takes an upper bound only")
        else:
            found.append((None, upper))
    return found


def log_ratio() -> Column:
    return F.zip_with("old_logp", "rollout_logp", lambda a, b: a - b)


def importance_weights(df: DataFrame, level: str = "token", threshold="2.0", normalize: bool = False, out: str = "weights") -> DataFrame:
    """``out``: a weight a token (``sequence``: the row's at each of its tokens), truncated at the upper bound, or 0 outside a band."""
    lower, upper = parse_weight_threshold(threshold)
    d = log_ratio()
    if level == "token":
        raw = F.transform(d, lambda x: F.exp(A.clamp(x, -BOUND, BOUND)))
    elif level == "sequence":
        total = A.masked_sum(d, F.col("mask"))
        raw = F.transform("mask", lambda m: F.exp(A.clamp(total, -BOUND, BOUND)))
    else:
        raise ValueError(f"unknown level {level}")
    weights = F.zip_with(raw, "mask", lambda w, m: w * m)
    if lower is None:
        bounded = F.transform(weights, lambda w: F.least(w, F.lit(upper)))
    else:
        bounded = F.transform(weights, lambda w: F.when((w < lower) | (w > upper), 0.0).otherwise(w))
    df = df.withColumn(out, bounded)
    if normalize:
        if level == "token":
            mean = F.sum(A.masked_sum(F.col(out), F.col("mask"))) / (F.sum(A.count_on(F.col("mask"))) + 1e-8)
        else:
            mean = F.avg(A.masked_mean(F.col(out), F.col("mask")))
        df = df.join(F.broadcast(df.agg(mean.alias("mean_"))))  # one row
        df = df.withColumn(out, F.transform(out, lambda w: F.when(F.col("mean_") > 1e-8, w / F.col("mean_")).otherwise(w))).drop("mean_")
    return df


def weight_metrics(df: DataFrame, weights: str = "weights", level: str = "token", threshold="2.0") -> DataFrame:
    """Statistics of unbounded and bounded weights: means, extremes, shares out of the band, spread, effective sample size."""
    lower, upper = parse_weight_threshold(threshold)
    lower = 1 / upper if lower is None else lower
    d = log_ratio()
    if level == "token":
        values = A.compact(F.transform(d, lambda x: F.exp(A.clamp(x, -BOUND, BOUND))), F.col("mask"))
    else:
        values = F.array(F.exp(A.clamp(A.masked_sum(d, F.col("mask")), -BOUND, BOUND)))
    raw = df.select(F.explode(values).alias("w"))
    n = F.count("*")
    return raw.agg(
        F.avg("w").alias("mean"), F.max("w").alias("max"), F.min("w").alias("min"),
        F.avg((F.col("w") > upper).cast("double")).alias("share_high"), F.avg((F.col("w") < lower).cast("double")).alias("share_low"),
        F.stddev_pop(A.clamp(F.col("w"), lower, upper)).alias("std"),
        (1 / (F.avg(F.col("w") * F.col("w")) / (F.avg("w") * F.avg("w")))).alias("effective_share"), n.alias("n"),
    )


def _divergence(kind: str, d: Column) -> Column:
    if kind == "k1":
        return -d
    if kind == "k2":
        return 0.5 * d * d
    c = A.clamp(d, -BOUND, BOUND)
    return F.exp(c) - 1 - c


def rejection_mask(df: DataFrame, options: str, thresholds, out: str = "mask") -> DataFrame:
    """``out``: the mask where all of the comma-separated options accept. A row without tokens is kept as it is."""
    names = [x.strip() for x in options.split(",")]
    keep = None
    for name, (lower, upper) in zip(names, parse_rejection_thresholds(names, thresholds), strict=True):
        level, _, kind = name.rpartition("_")
        stat = F.transform(log_ratio(), _one(kind))
        if kind == "k1":
            low, high = math.log(lower), math.log(upper)
        else:
            low, high = None, upper
        inside = _bounds(low, high)
        if level == "token":
            flags = F.transform(stat, inside)
        else:
            mask = F.col("mask")
            value = {"seq_sum": lambda: A.masked_sum(stat, mask), "seq_mean": lambda: A.masked_mean(stat, mask), "seq_max": lambda: F.array_max(A.compact(stat, mask))}[level]()
            flags = F.transform("mask", lambda m: F.coalesce(inside(value), F.lit(True)))
        keep = flags if keep is None else F.zip_with(keep, flags, lambda a, b: a & b)
    return df.withColumn(out, F.zip_with("mask", keep, lambda m, k: m * k.cast("int")))


def _one(kind: str):
    return lambda d: _divergence(kind, d)


def _bounds(low: float | None, high: float):
    return lambda x: (x <= high) if low is None else (x >= low) & (x <= high)


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """Perplexities, divergences and chi-square of the two policies; k3 isn't clamped here."""
    m, d = F.col("mask"), log_ratio()
    per = df.where(A.count_on(m) > 0).select(
        A.masked_mean(F.col("old_logp"), m).alias("a"), A.masked_mean(F.col("rollout_logp"), m).alias("b"), A.masked_sum(d, m).alias("s"),
        A.compact(d, m).alias("d"),
    )
    n = F.sum(F.size("d"))

    def over_tokens(f) -> Column:
        return F.sum(A.total(F.transform("d", f))) / n

    gap = F.col("b") - F.col("a")
    return per.agg(
        F.avg(F.exp(-F.col("a"))).alias("training_ppl"), F.avg(-F.col("a")).alias("training_log_ppl"), F.avg(F.exp(-F.col("b"))).alias("rollout_ppl"), F.avg(-F.col("b")).alias("rollout_log_ppl"),
        over_tokens(lambda x: -x).alias("kl"), over_tokens(lambda x: F.exp(x) - x - 1).alias("k3_kl"),
        F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"), F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"), F.avg(F.exp(gap)).alias("ppl_ratio"),
        (over_tokens(lambda x: F.exp(2 * A.clamp(x, -BOUND, BOUND))) - 1).alias("chi2_token"), (F.avg(F.exp(2 * A.clamp(F.col("s"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def correct(df: DataFrame, level: str | None = None, threshold="2.0", normalize: bool = False, options: str | None = None, thresholds=None) -> DataFrame:
    """Weights and rejection together; weights are taken from the mask before rejection."""
    if level:
        df = importance_weights(df, level, threshold, normalize)
    return rejection_mask(df, options, thresholds) if options else df


def bypass(df: DataFrame) -> DataFrame:
    """The rollout policy in place of the old one."""
    return df.withColumn("old_logp", F.col("rollout_logp"))


def rejection_metrics(df: DataFrame, option: str, threshold) -> DataFrame:
    """One row of statistics of one rejection option: token and row values, shares beyond its bounds, shares rejected.

    Rows without tokens count in no statistic; a table without any token fails.
    """
    lower, upper = parse_rejection_thresholds([option], threshold)[0]
    level, _, kind = option.rpartition("_")
    low, high = (math.log(lower), math.log(upper)) if kind == "k1" else (None, upper)
    m = F.col("mask")
    stat = F.transform(log_ratio(), _one(kind))
    value = {"token": lambda: A.masked_mean(stat, m), "seq_sum": lambda: A.masked_sum(stat, m), "seq_mean": lambda: A.masked_mean(stat, m), "seq_max": lambda: F.array_max(A.compact(stat, m))}[level]()
    rows = df.where(A.count_on(m) > 0).select(A.compact(stat, m).alias("tokens"), value.alias("row_value"))
    if level != "token":
        rows = rows.select(F.transform("tokens", lambda _: F.col("row_value")).alias("tokens"), "row_value")
    x, r, n = F.col("x"), F.col("row_value"), F.count("*")
    inside = _bounds(low, high)

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    bounded = A.clamp(x, 0.0 if low is None else low, high)
    token = rows.select(F.explode("tokens").alias("x")).agg(
        F.when(n == 0, F.raise_error(F.lit("no valid token")).cast("double")).otherwise(F.avg("x")).alias("mean"),
        F.max("x").alias("token_max"), F.min("x").alias("token_min"), share(x > high).alias("token_high"), (share(x < low) if low is not None else F.lit(0.0)).alias("token_low"),
        F.coalesce(F.stddev_pop(bounded), F.lit(0.0)).alias("std"), share(~inside(x)).alias("masked_fraction"),
    )
    kept = rows.withColumn("ok", F.forall("tokens", inside))
    whole = kept.agg(
        F.avg(r).alias("seq_mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("seq_std"), F.max(r).alias("seq_max"), F.min(r).alias("seq_min"), F.max(F.abs(r)).alias("seq_max_deviation"),
        share(r > high).alias("seq_fraction_high"), (share(r < low) if low is not None else F.lit(None).cast("double")).alias("seq_fraction_low"), share(~F.col("ok")).alias("seq_masked_fraction"),
    )
    both = token.join(F.broadcast(whole))  # one row each
    names = {"max": "max", "min": "min", "fraction_high": "high", "fraction_low": "low"}
    top = {k: F.col(f"token_{v}") if level == "token" else F.coalesce(F.col(f"seq_fraction_{v}") if v in ("high", "low") else F.col(f"seq_{v}"), F.lit(0.0)) for k, v in names.items()}
    return both.select("mean", *[c.alias(k) for k, c in top.items()], "std", "masked_fraction", *whole.columns)
