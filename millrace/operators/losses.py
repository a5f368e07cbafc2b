"""Policy and value losses as column expressions (values only; nothing is differentiated).

Frames have old_logp, logp, advantages (array<double>) and mask (array<int>), and weights if importance weights apply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import offpolicy
from .batch import hashed_int
from .metrics import agg_loss
from .ordered import first_rows
from .staging import written

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_loss(name: str):
    """Name a loss; a later one takes an earlier one's place."""

    def put(f):
        LOSSES[name] = f
        return f

    return put


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}; known: {sorted(LOSSES)}")
    return LOSSES[name](df, **options)


def _tokens(df: DataFrame, f: Callable[[Column, Column, Column], tuple[Column, Column]], mode: str, weighted: bool = False, clamped: bool = True) -> DataFrame:
    """One row: loss, clip_share and kl, with ``f`` of (log ratio, struct of the token's values) giving loss and a clipped flag."""
    fields = ["old_logp", "logp", "advantages", *(["weights"] if weighted else [])]
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in fields])

    def each(t: Column) -> Column:
        d = t["logp"] - t["old_logp"]
        d = A.clamp(d, -20.0, 20.0) if clamped else d
        loss, clipped = f(d, t)
        return F.struct((loss * t["weights"] if weighted else loss).alias("loss"), clipped.cast("double").alias("clipped"), (-d).alias("kl"))

    done = df.withColumn("token_", F.transform(zipped, each)).withColumn("loss_", F.col("token_.loss"))
    main = agg_loss(done, "loss_", "mask", mode)
    n = F.sum(A.count_on(F.col("mask"))) + 1e-8
    others = done.agg((F.sum(A.masked_sum(F.col("token_.clipped"), F.col("mask"))) / n).alias("clip_share"), (F.sum(A.masked_sum(F.col("token_.kl"), F.col("mask"))) / n).alias("kl"))
    return main.join(F.broadcast(others))  # one row each


def _clipped(d: Column, adv: Column, low: float, high: float) -> tuple[Column, Column]:
    ratio = F.exp(d)
    return -adv * ratio, -adv * A.clamp(ratio, 1 - low, 1 + high)


@register_loss("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    """Clipped ratio; for negative advantages the loss is bounded by ``c`` times the advantage."""

    def f(d, t):
        plain, clipped = _clipped(d, t["advantages"], low, high)
        upper = F.greatest(plain, clipped)
        return F.when(t["advantages"] < 0, F.least(-t["advantages"] * c, upper)).otherwise(upper), clipped > plain

    return _tokens(df, f, mode, weighted)


@register_loss("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 20.0, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    """Tokens count while their probability has moved by the divergence at most."""

    def f(d, t):
        moved = F.exp(t["logp"]) - F.exp(t["old_logp"])
        valid = F.when(t["advantages"] > 0, moved <= high).otherwise(moved >= -low)
        return -t["advantages"] * F.least(F.exp(d), F.lit(c)) * t["logp"] * valid.cast("double"), ~valid

    return _tokens(df, f, mode, weighted)


@register_loss("dppo_kl")
def dppo_kl(df: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 20.0, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    """As dppo_tv, by the divergence of token against rest."""

    def f(d, t):
        new, old = F.exp(t["logp"]), F.exp(t["old_logp"])
        kl = old * (t["old_logp"] - t["logp"]) + (1 - old) * F.log((1 - old + 1e-8) / (1 - new + 1e-8))
        valid = F.when(t["advantages"] > 0, (kl <= high) | (new <= old)).otherwise((kl <= low) | (new >= old))
        return -t["advantages"] * F.least(F.exp(d), F.lit(c)) * t["logp"] * valid.cast("double"), ~valid

    return _tokens(df, f, mode, weighted)


@register_loss("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "seq-mean-token-mean") -> DataFrame:
    """The ratio is that of the sequence (its mean log ratio, at most 10); the aggregation is always by sequence."""
    mean = A.masked_sum(F.zip_with("logp", "old_logp", lambda a, b: a - b), F.col("mask")) / F.greatest(A.count_on(F.col("mask")), F.lit(1))
    df = df.withColumn("ratio_", F.exp(F.least(mean, F.lit(10.0))))
    loss = F.transform("advantages", lambda a: F.greatest(-a * F.col("ratio_"), -a * A.clamp(F.col("ratio_"), 1 - low, 1 + high)))
    return agg_loss(df.withColumn("loss_", loss), "loss_", "mask", "seq-mean-token-mean")


@register_loss("sapo")
def sapo(df: DataFrame, positive: float = 1.0, negative: float = 1.05, mode: str = "seq-mean-token-mean", weighted: bool = False) -> DataFrame:
    """A soft gate in place of clipping; its temperature depends on the advantage's sign."""

    def f(d, t):
        tau = F.when(t["advantages"] > 0, positive).otherwise(negative)
        return -t["advantages"] * 4 / tau / (1 + F.exp(-tau * (F.exp(d) - 1))), F.lit(False)

    return _tokens(df, f, mode, weighted)


@register_loss("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    return _tokens(df, lambda d, t: (-t["logp"] * t["advantages"], F.lit(False)), mode, weighted)


@register_loss("reinforce")
def reinforce(df: DataFrame, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    return _tokens(df, lambda d, t: (-t["advantages"] * t["logp"], F.lit(False)), mode, weighted)


@register_loss("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", weighted: bool = False) -> DataFrame:
    def f(d, t):
        ratio = F.exp(d)
        bounded = A.clamp(ratio, 1 - low, 1 + high)
        return -bounded * t["advantages"] * t["logp"], ratio != bounded

    return _tokens(df, f, mode, weighted)


@register_loss("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Geometric mean of the pessimistically bounded ratios times the mean advantage, averaged over rows."""
    zipped = F.arrays_zip(F.col("logp").alias("a"), F.col("old_logp").alias("b"), F.col("advantages").alias("v"))

    def bounded(t: Column) -> Column:
        d, s = t["a"] - t["b"], F.signum(t["v"])
        return s * F.least(s * d, s * A.clamp(d, -low, high))

    m = F.col("mask")
    per = df.select(F.exp(A.masked_mean(F.transform(zipped, bounded), m)).alias("ratio"), A.masked_mean(F.col("advantages"), m).alias("adv"))
    return per.agg(F.avg(-F.col("adv") * F.col("ratio")).alias("loss"))


def _long(df: DataFrame) -> tuple[DataFrame, int]:
    """Unmasked tokens in rows of their own, with the covariance term of advantage and log-probability; and their number.

    Tokens are written once: where a cut lies takes several reads of them.
    """
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in ("old_logp", "logp", "advantages", "mask")])
    long = written(df.select("row_id", F.posexplode(zipped).alias("pos", "t")).select("row_id", "pos", "t.*").where("mask != 0").drop("mask"), "tokens")
    means = long.agg(F.avg("advantages"), F.avg("logp"), F.count("*")).first()
    return long.withColumn("cov", (F.col("advantages") - F.lit(means[0])) * (F.col("logp") - F.lit(means[1]))), means[2]


def _highest(long: DataFrame, value: str, k: int) -> Column:
    """Whether a token is among the ``k`` with the largest ``value``, of equals the first rows and places; a value of null is none.

    Counts over brackets of approximate quantiles find the bracket in which the cut lies; only its rows are ordered. The last
    row above the cut tells for each token on which side it is, so tokens are neither joined nor gathered.
    """
    n = long.agg(F.count(value)).first()[0]
    if k >= n:
        return F.col(value).isNotNull()
    share = k / n
    marks = long.agg(F.percentile_approx(value, [max(0.0, 1 - share * (2 - j / 32)) for j in range(65)], 100_000)).first()[0]
    marks = sorted(set(marks))
    counts = long.agg(*[F.count_if(F.col(value) >= m) for m in marks]).first()
    sure = next((j for j, c in enumerate(counts) if c <= k), len(marks))
    above = counts[sure] if sure < len(marks) else 0
    inside = F.lit(True) if sure == 0 else F.col(value) >= marks[sure - 1]
    certain = F.lit(False) if sure == len(marks) else F.col(value) >= marks[sure]
    edge = first_rows(long.where(inside & ~certain & F.col(value).isNotNull()).select(value, "row_id", "pos"), k - above, F.desc(value), "row_id", "pos")
    cut = edge.orderBy(value, F.desc("row_id"), F.desc("pos")).first()
    if cut is None:
        return F.coalesce(certain, F.lit(False))
    held = {c: F.lit(cut[c]).cast(long.schema[c].dataType) for c in (value, "row_id", "pos")}
    place, last = F.struct("row_id", "pos"), F.struct(held["row_id"].alias("row_id"), held["pos"].alias("pos"))
    return F.coalesce((F.col(value) > held[value]) | ((F.col(value) == held[value]) & (place <= last)), F.lit(False))


@register_loss("kl_cov")
def kl_cov(df: DataFrame, share: float = 0.0002, coefficient: float = 1.0) -> DataFrame:
    """The tokens of largest covariance pay for their divergence; token mean. Of equals the first rows and places count."""
    long, n = _long(df)
    top = _highest(long, "cov", max(1, int(n * share)))
    d = F.col("logp") - F.col("old_logp")
    loss = -F.col("advantages") * F.exp(d) + F.when(top, coefficient * F.abs(d)).otherwise(0.0)
    return long.agg(F.avg(loss).alias("loss"))


@register_loss("clip_cov")
def clip_cov(df: DataFrame, share: float = 0.0002, low: float = 0.2, high: float = 0.2, least: float = 1.0, most: float = 5.0, seed: int = 0) -> DataFrame:
    """Some tokens of middling covariance that aren't clipped are dropped, drawn by hash; token mean."""
    long, n = _long(df)
    plain, clipped = _clipped(F.col("logp") - F.col("old_logp"), F.col("advantages"), low, high)
    can = (F.col("cov") > least) & (F.col("cov") < most) & ~(clipped > plain)
    long = long.withColumn("draw_", F.when(can, -hashed_int(seed, "row_id", "pos")))
    dropped = _highest(long, "draw_", max(1, int(n * share)))
    return long.agg(F.avg(F.when(dropped, 0.0).otherwise(F.greatest(plain, clipped))).alias("loss"))


@register_loss("flow_grpo")
def flow_grpo(df: DataFrame, clip: float = 1e-4, most: float = 5.0) -> DataFrame:
    """Bounded advantages, clipped ratio, plain mean over all steps."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in ("old_logp", "logp", "advantages")])
    long = df.select(F.explode(zipped).alias("t"))
    a = A.clamp(F.col("t.advantages"), -most, most)
    plain, clipped = _clipped(F.col("t.logp") - F.col("t.old_logp"), a, clip, clip)
    return long.agg(F.avg(F.greatest(plain, clipped)).alias("loss"), F.avg((clipped > plain).cast("double")).alias("clip_share"))


def value_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger squared error of the prediction and of the prediction kept near the old value."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in ("vpreds", "value", "returns")])

    def each(t: Column) -> Column:
        near = A.clamp(t["vpreds"] - t["value"], -clip, clip) + t["value"]
        a, b = (t["vpreds"] - t["returns"]) * (t["vpreds"] - t["returns"]), (near - t["returns"]) * (near - t["returns"])
        return F.struct((0.5 * F.greatest(a, b)).alias("loss"), (b > a).cast("double").alias("clipped"))

    done = df.withColumn("token_", F.transform(zipped, each)).withColumn("loss_", F.col("token_.loss"))
    share = done.agg((F.sum(A.masked_sum(F.col("token_.clipped"), F.col("mask"))) / (F.sum(A.count_on(F.col("mask"))) + 1e-8)).alias("clip_share"))
    return agg_loss(done, "loss_", "mask", mode).join(F.broadcast(share))  # one row each


def entropy_loss(df: DataFrame, entropies: str = "entropy", mode: str = "token-mean") -> DataFrame:
    return agg_loss(df, entropies, "mask", mode)


def sft_loss(df: DataFrame, tokens: float | None = None, ranks: int = 1) -> DataFrame:
    """Negative log-probability of unmasked tokens, each mask belonging to the place before."""
    rolled = F.concat(F.slice("mask", F.lit(2), F.greatest(F.lit(0), F.size("mask") - 1)), F.array(F.lit(0)))
    s = F.sum(A.masked_sum(F.col("logp"), rolled))
    n = F.lit(tokens) if tokens is not None else F.sum(A.count_on(rolled))
    return df.agg((-s / n * ranks).alias("loss"))


def image_kl(mean: Column, ref: Column, deviation: Column) -> Column:
    d = F.zip_with(mean, ref, lambda a, b: (a - b) * (a - b))
    return A.total(d) / F.size(d) / (2 * deviation * deviation)


def distillation_topk(df: DataFrame, floor: float | None = None) -> DataFrame:
    """Forward divergence over the teacher's likeliest ids: student_logp (by id), teacher_ids, teacher_logp."""
    own = F.transform("teacher_ids", lambda i: F.element_at("student_logp", i + 1))
    own = F.transform(own, lambda v: F.greatest(v, F.lit(floor))) if floor is not None else own
    return df.withColumn("loss", A.total(F.zip_with("teacher_logp", own, lambda p, q: F.exp(p) * (p - q))))


def loss_range(df: DataFrame, loss: str, mask: str = "mask") -> DataFrame:
    kept = A.compact(F.col(loss), F.col(mask))
    return df.agg(F.min(F.array_min(kept)).alias("min"), F.max(F.array_max(kept)).alias("max"))


def valid_mean(x: Column, valid: Column) -> Column:
    return F.sum(x * valid) / F.greatest(F.sum(valid), F.lit(1))




@register_loss("bypass_mode")
def bypass_mode(df: DataFrame, loss_type: str = "ppo_clip", level: str | None = None, threshold="2.0", normalize: bool = False, options: str | None = None, thresholds=None, mode: str = "token-mean") -> DataFrame:
    """The rollout's own log-probabilities are old_logp: rejection first, then clipping, or REINFORCE with importance weights.

    Weights and rejection compare logp with old_logp. Clipping holds the ratio already and takes no weights.
    """
    if loss_type not in ("ppo_clip", "reinforce"):
        raise ValueError(f"unknown loss type {loss_type}")
    compared = df.withColumn("behaviour_", F.col("old_logp")).withColumn("rollout_logp", F.col("old_logp")).withColumn("old_logp", F.col("logp"))
    fixed = offpolicy.correct(compared, level, threshold, normalize, options, thresholds).withColumn("old_logp", F.col("behaviour_")).drop("behaviour_")
    if loss_type == "reinforce":
        return reinforce(fixed, mode=mode, weighted=bool(level))
    return vanilla(fixed, mode=mode)


def ppo_loss(df: DataFrame, name: str = "vanilla", entropy: str | None = None, entropy_coefficient: float = 0.0, kl: str | None = None, kl_coefficient: float = 0.0, mode: str = "token-mean", **options) -> DataFrame:
    """One row: loss, pg_loss, entropy_loss and kl_loss (null where not asked for).

    The loss is the policy loss less entropies of the column ``entropy`` plus the divergence ``kl`` of logp from ref_logp.
    """
    out = policy_loss(df, name, **options).select(F.col("loss").alias("pg_loss"))
    nothing = F.lit(None).cast("double")
    if entropy:
        out = out.join(F.broadcast(agg_loss(df, entropy, "mask", mode).select(F.col("loss").alias("entropy_loss"))))  # one row each
    if kl:
        priced = df.withColumn("kl_", A.kl_penalty(F.col("logp"), F.col("ref_logp"), kl))
        out = out.join(F.broadcast(agg_loss(priced, "kl_", "mask", mode).select(F.col("loss").alias("kl_loss"))))
    out = out.withColumns({c: nothing for c in ("entropy_loss", "kl_loss") if c not in out.columns})
    loss = F.col("pg_loss") - entropy_coefficient * F.coalesce("entropy_loss", F.lit(0.0)) + kl_coefficient * F.coalesce("kl_loss", F.lit(0.0))
    return out.select(loss.alias("loss"), "pg_loss", "entropy_loss", "kl_loss")


def critic_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """value_loss with the masked mean of the predictions."""
    mean = df.agg((F.sum(A.masked_sum(F.col("vpreds"), F.col("mask"))) / (F.sum(A.count_on(F.col("mask"))) + 1e-8)).alias("vpred_mean"))
    return value_loss(df, clip, mode).join(F.broadcast(mean))  # one row each


def diffusion_loss(df: DataFrame, name: str = "flow_grpo", kl_coefficient: float | None = None, accumulation: int = 1, **options) -> DataFrame:
    """Policy loss of denoising steps, with image_kl of the columns mean, ref_mean and deviation if a coefficient is given, by accumulation step."""
    out = policy_loss(df, name, **options).select(F.col("loss").alias("pg_loss"))
    if kl_coefficient is None:
        return out.select((F.col("pg_loss") / accumulation).alias("loss"), "pg_loss", F.lit(None).cast("double").alias("kl_loss"))
    kl = df.agg(F.avg(image_kl(F.col("mean"), F.col("ref_mean"), F.col("deviation"))).alias("kl_loss"))
    return out.join(F.broadcast(kl)).select(((F.col("pg_loss") + kl_coefficient * F.col("kl_loss")) / accumulation).alias("loss"), "pg_loss", "kl_loss")  # one row each


# ---- distillation

DISTILLATIONS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register_distillation(*names: str):
    """Name a function that adds ``distill_``, the loss of each token; a name can't be given twice."""

    def put(f):
        for name in names:
            if DISTILLATIONS.get(name, f) is not f:
                raise ValueError(f"distillation loss {name} is registered already")
            DISTILLATIONS[name] = f
        return f

    return put


@register_distillation("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")
def distillation_estimate(df: DataFrame, name: str) -> DataFrame:
    """Divergence of logp from teacher_logp by a one-sample estimate."""
    return df.withColumn("distill_", A.kl_penalty(F.col("logp"), F.col("teacher_logp"), name))


@register_distillation("forward_kl_topk")
def distillation_given(df: DataFrame, name: str) -> DataFrame:
    """The forward divergences in topk_kl, which are negative only because the likeliest ids don't hold all mass."""
    return df.withColumn("distill_", F.transform("topk_kl", lambda v: F.greatest(v, F.lit(0.0))))


def distillation_loss(df: DataFrame, name: str, most: float | None = None, policy: str | None = None, mode: str = "token-mean", **options) -> DataFrame:
    """One row: loss, and loss_min, loss_max and abs_loss of the tokens before they are bounded by ``most``.

    The loss is aggregated, or, with ``policy``, that policy loss with the negative token losses as advantages.
    """
    if name not in DISTILLATIONS:
        raise ValueError(f"unknown distillation loss {name}; known: {sorted(DISTILLATIONS)}")
    df = DISTILLATIONS[name](df, name)
    tokens = df.select(F.explode(A.compact(F.col("distill_"), F.col("mask"))).alias("x"))
    spread = tokens.agg(F.min("x").alias("loss_min"), F.max("x").alias("loss_max"), F.avg(F.abs("x")).alias("abs_loss"))
    if most is not None:
        df = df.withColumn("distill_", F.transform("distill_", lambda v: A.clamp(v, -most, most)))
    if policy:
        loss = policy_loss(df.withColumn("advantages", F.transform("distill_", lambda v: -v)), policy, **options).select("loss")
    else:
        loss = agg_loss(df, "distill_", "mask", mode)
    return loss.join(F.broadcast(spread))  # one row each


def distillation_ppo_loss(df: DataFrame, name: str, coefficient: float = 1.0, task_rewards: bool = True, distillation: dict | None = None, **options) -> DataFrame:
    """One row: loss, distillation_loss and pg_loss; without task rewards the loss is the distillation's alone."""
    own = distillation_loss(df, name, **(distillation or {})).select(F.col("loss").alias("distillation_loss"))
    both = ppo_loss(df, **options).select(F.col("loss").alias("task_"), "pg_loss").join(F.broadcast(own))  # one row each
    loss = F.col("task_") + coefficient * F.col("distillation_loss") if task_rewards else F.col("distillation_loss")
    return both.select(loss.alias("loss"), "distillation_loss", "pg_loss")
