"""Off-policy and loss queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import losses as L
from ..operators import offpolicy as O
from .binding import TOK, long, trajectories
from .catalog import query

_D = "greatest(least(old_logp - rollout_logp, 20), -20)"




query("is_token_truncate", f"with {TOK} select row_id, pos, round(least(exp({_D}) * mask, 1.2) + 0.0, 6) as weights from tok")(
    lambda spark, sf_dir: long(O.importance_weights(trajectories(spark, sf_dir), "token", "1.2"), "weights")
)
_SEQ = f"{TOK}, seq as (select *, exp(greatest(least(sum((old_logp - rollout_logp) * mask) over (partition by row_id), 20), -20)) * mask as w from tok)"
query("is_seq", f"with {_SEQ} select row_id, pos, round(least(w, 2.0) + 0.0, 6) as weights from seq")(
    lambda spark, sf_dir: long(O.importance_weights(trajectories(spark, sf_dir), "sequence", 2.0), "weights")
)
query("is_band", f"with {TOK} select row_id, pos, round(case when exp({_D}) * mask < 0.6 or exp({_D}) * mask > 1.7 then 0 else exp({_D}) * mask end + 0.0, 6) as weights from tok")(
    lambda spark, sf_dir: long(O.importance_weights(trajectories(spark, sf_dir), "token", "0.6_1.7"), "weights")
)
query(
    "is_batch_norm",
    f"with {TOK}, w as (select row_id, pos, mask, least(exp({_D}) * mask, 1.2) as w from tok), m as (select sum(w * mask) / (sum(mask) + 1e-8) as m from w) select row_id, pos, round(w / m + 0.0, 6) as weights from w, m",
)(lambda spark, sf_dir: long(O.importance_weights(trajectories(spark, sf_dir), "token", 1.2, normalize=True), "weights"))
query(
    "is_seq_batch_norm",
    f"with {_SEQ}, per as (select row_id, sum(least(w, 2.0) * mask) / (sum(mask) + 1e-8) as m from seq group by 1), m as (select avg(m) as m from per) select row_id, pos, round(least(w, 2.0) / m + 0.0, 6) as weights from seq, m",
)(lambda spark, sf_dir: long(O.importance_weights(trajectories(spark, sf_dir), "sequence", 2.0, normalize=True), "weights"))

_STATS = ("mean", "max", "min", "share_high", "share_low", "std", "effective_share")


@query(
    "is_metrics",
    f"with {TOK}, w as (select exp({_D}) as w from tok where mask = 1) select round(avg(w), 6) as mean, round(max(w), 6) as max, round(min(w), 6) as min, round(avg(case when w > 2 then 1.0 else 0 end), 6) as share_high, round(avg(case when w < 0.5 then 1.0 else 0 end), 6) as share_low, round(stddev_pop(greatest(least(w, 2), 0.5)), 6) as std, round(1 / (avg(w * w) / (avg(w) * avg(w))), 6) as effective_share from w",
)
def is_metrics(spark, sf_dir):
    return O.weight_metrics(trajectories(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in _STATS])


_KINDS = {"k1": "-(old_logp - rollout_logp)", "k2": "0.5 * (old_logp - rollout_logp) ** 2", "k3": f"exp({_D}) - 1 - ({_D})"}
#: Thresholds at which each option rejects some of the test rows.
_THRESHOLDS = {
    "token_k1": "0.613_1.617", "token_k2": "0.0817", "token_k3": "0.0913", "seq_sum_k1": "0.411_2.319", "seq_sum_k2": "0.2171", "seq_sum_k3": "0.2331",
    "seq_mean_k1": "0.7131_1.4173", "seq_mean_k2": "0.0817", "seq_mean_k3": "0.0913", "seq_max_k2": "0.1213", "seq_max_k3": "0.1317",
}


def _rejection(option: str):
    level, _, kind = option.rpartition("_")
    spec = _THRESHOLDS[option]
    lower, upper = O.parse_rejection_thresholds([option], spec)[0]
    bound = f"between ln({lower!r}) and ln({upper!r})" if kind == "k1" else f"<= {upper!r}"
    stat = {
        "token": "k",
        "seq_sum": "sum(k * mask) over (partition by row_id)",
        "seq_mean": "sum(k * mask) over (partition by row_id) / (sum(mask) over (partition by row_id) + 1e-8)",
        "seq_max": "max(k) filter (mask = 1) over (partition by row_id)",
    }[level]
    sql = f"with {TOK}, s as (select row_id, pos, mask, {_KINDS[kind]} as k from tok), v as (select *, {stat} as v from s) select row_id, pos, case when coalesce(v {bound}, true) then mask else 0 end as mask from v"

    def run(spark, sf_dir):
        df = O.rejection_mask(trajectories(spark, sf_dir), option, spec)
        return df.select("row_id", F.posexplode("mask").alias("pos", "mask")).select("row_id", F.col("pos").cast("bigint").alias("pos"), "mask")

    query(f"rs_{option}", sql)(run)


for _option in O.OPTIONS:
    _rejection(_option)


@query(
    "offpolicy_metrics",
    f"""with {TOK}, t as (select *, old_logp - rollout_logp as d from tok where mask = 1),
per as (select row_id, sum(old_logp) / (count(*) + 1e-8) as a, sum(rollout_logp) / (count(*) + 1e-8) as b, sum(d) as s from t group by 1)
select round(avg(exp(-a)), 6) as training_ppl, round(avg(exp(-b)), 6) as rollout_ppl, (select round(avg(-d), 6) from t) as kl, (select round(avg(exp(d) - d - 1), 6) from t) as k3_kl,
round(avg(b - a), 6) as log_ppl_diff, round(max(b - a), 6) as log_ppl_diff_max, round(avg(exp(b - a)), 6) as ppl_ratio,
(select round(avg(exp(2 * greatest(least(d, 20), -20))) - 1, 6) from t) as chi2_token, round(avg(exp(2 * greatest(least(s, 20), -20))) - 1, 5) as chi2_seq from per""",
)
def offpolicy_metrics(spark, sf_dir):
    out = O.offpolicy_metrics(trajectories(spark, sf_dir))
    names = ("training_ppl", "rollout_ppl", "kl", "k3_kl", "log_ppl_diff", "log_ppl_diff_max", "ppl_ratio", "chi2_token")
    return out.select(*[F.round(c, 6).alias(c) for c in names], F.round("chi2_seq", 5).alias("chi2_seq"))


def policy(spark, sf_dir):
    """Trajectories with logp and advantages: the rollout's log-probabilities, and values around 25."""
    return trajectories(spark, sf_dir).withColumn("logp", F.col("rollout_logp")).withColumn("advantages", F.transform("value", lambda v: (v - 25.3) / 10))


_P = f"{TOK}, p as (select *, rollout_logp as logp, (value - 25.3) / 10 as adv, greatest(least(rollout_logp - old_logp, 20), -20) as d from tok)"


def _loss(name: str, loss: str, clipped: str = "false", by_row: bool = False, rows: str = "p", **options):
    if by_row:
        total = f"(select sum(s) / count(*) filter (n > 0) from (select row_id, sum(({loss}) * mask) / (sum(mask) + 1e-8) as s, sum(mask) as n from {rows} group by 1))"
    else:
        total = f"(select sum(({loss}) * mask) / sum(mask) from {rows})"
    sql = f"with {_P} select round({total}, 6) as loss, (select round(sum(case when {clipped} then mask else 0 end) / (sum(mask) + 1e-8), 6) from p) as clip_share"
    query(f"loss_{name}", sql)(lambda spark, sf_dir: L.policy_loss(policy(spark, sf_dir), name, **options).select(F.round("loss", 6).alias("loss"), F.round("clip_share", 6).alias("clip_share")))


_RATIO, _CUT = "-adv * exp(d)", "-adv * greatest(least(exp(d), 1.2), 0.8)"
_loss("vanilla", f"case when adv < 0 then least(-adv * 3, greatest({_RATIO}, {_CUT})) else greatest({_RATIO}, {_CUT}) end", f"{_CUT} > {_RATIO}")
_TV = "case when adv > 0 then exp(logp) - exp(old_logp) <= 0.2 else exp(logp) - exp(old_logp) >= -0.2 end"
_loss("dppo_tv", f"case when {_TV} then -adv * least(exp(d), 20) * logp else 0 end", f"not ({_TV})")
_BK = "(exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)))"
_KL = f"case when adv > 0 then {_BK} <= 0.2 or exp(logp) <= exp(old_logp) else {_BK} <= 0.2 or exp(logp) >= exp(old_logp) end"
_loss("dppo_kl", f"case when {_KL} then -adv * least(exp(d), 20) * logp else 0 end", f"not ({_KL})")
_TAU = "case when adv > 0 then 1.0 else 1.05 end"
_loss("sapo", f"-adv * 4 / ({_TAU}) / (1 + exp(-({_TAU}) * (exp(d) - 1)))", by_row=True)
_loss("gpg", "-logp * adv")
_loss("reinforce", "-adv * logp")
_loss("cispo", "-greatest(least(exp(d), 1.2), 0.8) * adv * logp", "exp(d) <> greatest(least(exp(d), 1.2), 0.8)")


@query(
    "loss_gspo",
    f"""with {_P}, r as (select *, exp(least(sum((logp - old_logp) * mask) over w / greatest(sum(mask) over w, 1), 10)) as ratio from p window w as (partition by row_id)),
per as (select row_id, sum(mask) as n, sum(greatest(-adv * ratio, -adv * greatest(least(ratio, 1.2), 0.8)) * mask) / (sum(mask) + 1e-8) as s from r group by 1) select round(sum(s) / count(*) filter (n > 0), 6) as loss from per""",
)
def loss_gspo(spark, sf_dir):
    return L.policy_loss(policy(spark, sf_dir), "gspo").select(F.round("loss", 6).alias("loss"))


@query(
    "loss_geo_mean",
    f"""with {_P}, b as (select *, sign(adv) * least(sign(adv) * d, sign(adv) * greatest(least(d, 0.4), -0.4)) as m from p),
per as (select row_id, exp(sum(m * mask) / (sum(mask) + 1e-8)) as r, sum(adv * mask) / (sum(mask) + 1e-8) as a from b group by 1) select round(avg(-a * r), 6) as loss from per""",
)
def loss_geo_mean(spark, sf_dir):
    return L.policy_loss(policy(spark, sf_dir), "geo_mean").select(F.round("loss", 6).alias("loss"))


_COV = f"{_P}, u as (select * from p where mask = 1), c as (select *, (adv - (select avg(adv) from u)) * (logp - (select avg(logp) from u)) as cov from u)"


@query(
    "loss_kl_cov",
    f"with {_COV}, r as (select *, row_number() over (order by round(cov, 9) desc, row_id, pos) <= greatest(1, floor((select count(*) from u) * 0.01)) as top from c) select round(avg(-adv * exp(d) + case when top then abs(d) else 0 end), 5) as loss from r",
)
def loss_kl_cov(spark, sf_dir):
    return L.policy_loss(policy(spark, sf_dir), "kl_cov", share=0.01).select(F.round("loss", 5).alias("loss"))


@query(
    "loss_clip_cov",
    f"""with {_COV}, can as (select row_id, pos from c where cov > 0.1 and cov < 0.5 and not ({_CUT} > {_RATIO}) order by md5('0:' || row_id || ':' || pos), row_id, pos limit (select greatest(1, floor((select count(*) from u) * 0.01))::bigint))
select round(avg(case when can.row_id is not null then 0 else greatest({_RATIO}, {_CUT}) end), 6) as loss from c left join can on can.row_id = c.row_id and can.pos = c.pos""",
)
def loss_clip_cov(spark, sf_dir):
    return L.policy_loss(policy(spark, sf_dir), "clip_cov", share=0.01, least=0.1, most=0.5).select(F.round("loss", 6).alias("loss"))


@query("loss_flow_grpo", f"with {_P}, b as (select greatest(least(adv, 2), -2) as a, exp(d) as r from p) select round(avg(greatest(-a * r, -a * greatest(least(r, 1.1), 0.9))), 6) as loss, round(avg(case when -a * greatest(least(r, 1.1), 0.9) > -a * r then 1.0 else 0 end), 6) as clip_share from b")
def loss_flow_grpo(spark, sf_dir):
    return L.policy_loss(policy(spark, sf_dir), "flow_grpo", clip=0.1, most=2.0).select(F.round("loss", 6).alias("loss"), F.round("clip_share", 6).alias("clip_share"))


@query(
    "value_loss",
    f"with {TOK}, v as (select *, value + 3 * l as vp, greatest(least(3 * l, 0.5), -0.5) + value as near from (select *, old_logp as l from tok)) select round(sum(0.5 * greatest((vp - reward) ** 2, (near - reward) ** 2) * mask) / sum(mask), 6) as loss, round(sum(case when (near - reward) ** 2 > (vp - reward) ** 2 then mask else 0 end) / (sum(mask) + 1e-8), 6) as clip_share from v",
)
def value_loss(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("vpreds", F.zip_with("value", "old_logp", lambda v, x: v + 3 * x)).withColumn("returns", F.col("reward"))
    return L.value_loss(df).select(F.round("loss", 6).alias("loss"), F.round("clip_share", 6).alias("clip_share"))


_LOGITS = "lg as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as k from embeddings), z as (select vec_id, max(x) as top, ln(sum(exp(x))) as lse, ln(sum(exp(2 * x))) as l2, max(x) filter (k = 3) as third from lg group by 1)"


@query("entropy_logits", f"with {_LOGITS} select vec_id, round((select lse) - (select sum(exp(x - lse) * x) from lg where lg.vec_id = z.vec_id), 6) as entropy, round(exp(l2 - 2 * lse), 6) as sum_pi_squared, round(third - lse, 6) as logp from z")
def entropy_logits(spark, sf_dir):
    from .binding import load

    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.select("vec_id", F.round(A.entropy(F.col("x")), 6).alias("entropy"), F.round(A.sum_pi_squared(F.col("x")), 6).alias("sum_pi_squared"), F.round(A.logprob_of(F.col("x"), F.lit(3)), 6).alias("logp"))


@query("sft_loss", f"with {TOK}, r as (select *, coalesce(lead(mask) over (partition by row_id order by pos), 0) as m from tok) select round(-sum(old_logp * m) / sum(m), 6) as loss from r")
def sft_loss(spark, sf_dir):
    return L.sft_loss(trajectories(spark, sf_dir).withColumn("logp", F.col("old_logp"))).select(F.round("loss", 6).alias("loss"))


@query("loss_range", f"with {TOK} select round(min(reward), 6) as min, round(max(reward), 6) as max from tok where mask = 1")
def loss_range(spark, sf_dir):
    return L.loss_range(trajectories(spark, sf_dir), "reward").select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))
