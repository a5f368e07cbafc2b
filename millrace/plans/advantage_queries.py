"""Estimator queries, one row a token, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import advantage as adv
from .binding import ROWS, TOK, load, long, trajectories
from .catalog import query


def _outcome_sql(value: str, stats: str = "count(*) over w as n, avg(score) over w as m, stddev_samp(score) over w as d, var_samp(score) over w as v, sum(score) over w as s") -> str:
    """Each row's value from its group's statistics, times the mask at each token."""
    return f"""with {TOK}, {ROWS},
stats as (select *, {stats} from per_row window w as (partition by uid)),
valued as (select row_id, {value} as a from stats)
select t.row_id, t.pos, round(v.a * t.mask + 0.0, 6) as advantages from tok t join valued v using (row_id)"""


def _whitened_sql(value: str, masked: str = "* mask", extra: str = "") -> str:
    """A value a row, whitened over all unmasked tokens: moments are sums over rows, as a row's tokens have one value."""
    return f"""with {TOK}, {ROWS},
stats as (select *, count(*) over w as n, avg(score) over w as m, stddev_samp(score) over w as d{extra} from per_row window w as (partition by uid)),
valued as (select row_id, len, {value} as a from stats),
sums as (select sum(len) as k, sum(a * len) as s, sum(a * a * len) as q from valued),
spread as (select s / (k + 1e-8) as mean, (q - 2 * s / (k + 1e-8) * s + (s / (k + 1e-8)) ** 2 * k) / (k + 1e-8) * k / (k - 1) as var from sums)
select row_id, pos, round((a * mask - (select mean from spread)) / sqrt((select var from spread) + 1e-8) {masked} + 0.0, 6) as advantages from tok join valued using (row_id)"""


_MEAN = "case when n = 1 then 0 else m end"


@query("adv_grpo", _outcome_sql(f"(score - {_MEAN}) / (case when n = 1 then 1 else d end + 1e-6)"))
def adv_grpo(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "grpo"), "advantages")


@query("adv_grpo_nostd", _outcome_sql(f"score - {_MEAN}"))
def adv_grpo_nostd(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "grpo", by_std=False), "advantages")


@query("adv_grpo_vectorized", _outcome_sql(f"(score - {_MEAN}) / (case when n = 1 then 1 else sqrt(greatest(v, 1e-6)) end + 1e-6)"))
def adv_grpo_vectorized(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "grpo_vectorized"), "advantages")


@query("adv_rloo", _outcome_sql("case when n > 1 then score * n / (n - 1) - m * n / (n - 1) else score end"))
def adv_rloo(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "rloo"), "advantages")


@query("adv_rloo_vectorized", _outcome_sql("case when n > 1 then (n * score - s) / (n - 1) else 0 end"))
def adv_rloo_vectorized(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "rloo_vectorized"), "advantages")


@query("adv_opo", _outcome_sql("score - case when n = 1 then 0 else ls / nullif(l, 0) end", "count(*) over w as n, sum(len * score) over w as ls, sum(len) over w as l"))
def adv_opo(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "opo"), "advantages")


@query("adv_gpg", _outcome_sql(f"(select count(*) / greatest(count(*) filter (score <> 0), 1) from per_row) * (score - {_MEAN})"))
def adv_gpg(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "gpg"), "advantages")


def _paired(spark, sf_dir):
    """Trajectories of groups with two rows at least."""
    df = trajectories(spark, sf_dir)
    return df.join(df.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid"), "uid", "left_semi")


@query(
    "adv_passk",
    _outcome_sql(
        "case when r = 1 then (score - nxt) / (d + 1e-6) else 0 end",
        "row_number() over (partition by uid order by score desc, row_id) as r, lead(score) over (partition by uid order by score desc, row_id) as nxt, stddev_samp(score) over w as d, count(*) over w as n",
    ).replace("from stats)", "from stats where n > 1)"),
)
def adv_passk(spark, sf_dir):
    return long(adv.advantage(_paired(spark, sf_dir), "grpo_passk"), "advantages")


@query("adv_rpp_baseline", _whitened_sql(f"score - {_MEAN}"))
def adv_rpp_baseline(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "reinforce_plus_plus_baseline"), "advantages")


@query(
    "adv_gdpo",
    _whitened_sql(
        f"(score - {_MEAN}) / (case when n = 1 then 1 else d end + 1e-6) + 0.5 * (len - case when n = 1 then 0 else ml end) / (case when n = 1 then 1 else dl end + 1e-6)",
        extra=", avg(len) over w as ml, stddev_samp(len) over w as dl",
    ),
)
def adv_gdpo(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("first", A.total(F.col("reward"))).withColumn("second", A.count_on(F.col("mask")).cast("double"))
    return long(adv.advantage(df, "gdpo", components=["first", "second"], weights=[1.0, 0.5]), "advantages")


@query(
    "adv_remax",
    f"""with {TOK} select row_id, pos, round(sum(reward * mask) over (partition by row_id order by pos rows between current row and unbounded following) - 5.0 * mask + 0.0, 6) as advantages,
round(sum(reward * mask) over (partition by row_id order by pos rows between current row and unbounded following), 6) as returns from tok""",
)
def adv_remax(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir).withColumn("baseline", F.lit(5.0)), "remax"), "advantages", "returns")


def _scan_sql(columns: str, first: str, following: str) -> str:
    """A scan from each row's last token to its first."""
    return f"""with recursive {TOK}, sized as (select *, max(pos) over (partition by row_id) as last from tok),
scan as (select row_id, pos, {columns}, {first} from sized where pos = last
  union all select t.row_id, t.pos, {", ".join("t." + c.strip() for c in columns.split(","))}, {following} from scan s join sized t on t.row_id = s.row_id and t.pos = s.pos - 1)"""


@query(
    "adv_rpp",
    _scan_sql("mask", "reward as g, reward * mask as carry", "t.reward + 0.9 * s.carry, (t.reward + 0.9 * s.carry) * t.mask")
    + """, sums as (select sum(mask) as k, sum(g * mask) / (sum(mask) + 1e-8) as mean from scan),
spread as (select sum((g - (select mean from sums)) ** 2 * mask) / ((select k from sums) + 1e-8) * (select k from sums) / ((select k from sums) - 1) as var from scan)
select row_id, pos, round((g - mean) / sqrt(var + 1e-8) * mask + 0.0, 6) as advantages, round(g, 6) as returns from scan, sums, spread""",
)
def adv_rpp(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "reinforce_plus_plus", gamma=0.9), "advantages", "returns")


@query(
    "adv_gae",
    _scan_sql(
        "mask, value",
        "(reward - value) * mask as a, value * mask as nxt",
        "(t.reward + 0.99 * s.nxt - t.value + 0.99 * 0.95 * s.a) * t.mask + s.a * (1 - t.mask), t.value * t.mask + s.nxt * (1 - t.mask)",
    )
    + """, sums as (select sum(mask) as k, sum(a * mask) / (sum(mask) + 1e-8) as mean from scan),
spread as (select sum((a - (select mean from sums)) ** 2 * mask) / ((select k from sums) + 1e-8) * (select k from sums) / ((select k from sums) - 1) as var from scan)
select row_id, pos, round((a - mean) / sqrt(var + 1e-8) + 0.0, 6) as advantages, round(a + value, 6) as returns from scan, sums, spread""",
)
def adv_gae(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "gae", gamma=0.99, lam=0.95), "advantages", "returns")


def _baseline_sql(dense: bool) -> str:
    rows = "where mask <> 0" if dense else ""
    place = "sum(mask) over run - 1" if dense else "pos"
    length = "sum(mask)" if dense else "count(*)"
    return f"""with {TOK}, togo as (select *, sum(reward * mask) over (partition by row_id order by pos rows between current row and unbounded following) as g from tok),
grown as (select *, sum((1 - 2 * exp(old_logp) + pi2) * mask) over run as w, {place} as place from togo {rows} window run as (partition by row_id order by pos rows unbounded preceding)),
lens as (select row_id, uid, {length} as len from tok {rows} group by 1, 2),
ranked as (select *, row_number() over (partition by uid order by len desc) as r, count(*) over (partition by uid) as n from lens),
limits as (select uid, max(n) as n, max(len) filter (r = 1) as top, max(len) filter (r = 2) as second from ranked group by 1),
based as (select row_id, uid, pos, place, mask, g, sum(g * w * mask) over p / (sum(w * mask) over p + 1e-8) as b from grown window p as (partition by uid, place)),
done as (select b.row_id, b.pos, (g - case when n = 1 then 0 when top > second and place >= second then 0 else b end) * mask as a from based b join limits using (uid))
select t.row_id, t.pos, round(coalesce(d.a, 0) + 0.0, 6) as advantages from tok t left join done d using (row_id, pos)"""


@query("adv_otb", _baseline_sql(False).replace("case when l_returnflag <> 'N' then 1 else 0 end as mask", "1 as mask"))
def adv_otb(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    return long(adv.optimal_token_baseline(df.withColumn("mask", F.transform("mask", lambda m: F.lit(1)))), "advantages")


@query("adv_tir_otb", _baseline_sql(True))
def adv_tir_otb(spark, sf_dir):
    return long(adv.advantage(trajectories(spark, sf_dir), "tir_optimal_token_baseline"), "advantages")


@query(
    "adv_flow_grpo",
    f"""with {TOK}, {ROWS}, sums as (select sum(t) as n, sum(score * t) as s from per_row),
spread as (select sqrt(sum(t * (score - (select s / n from sums)) ** 2) / ((select n from sums) - 1)) as d from per_row),
stats as (select *, sum(score * t) over (partition by uid) / sum(t) over (partition by uid) as m from per_row)
select t.row_id, t.pos, round((s.score - s.m) / (d + 1e-4) * t.mask + 0.0, 6) as advantages from tok t join stats s using (row_id), spread""",
)
def adv_flow_grpo(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("score", A.total(F.col("reward")))
    return long(adv.advantage(df, "flow_grpo"), "advantages")


@query(
    "adv_multi_trajectory",
    f"""with {TOK}, keyed as (select *, 'u' || (uid % 100) || '_' || (row_id % 3) || '_' || row_id as key, 'u' || (uid % 100) as grp, row_id % 3 as session from tok),
{ROWS.replace("from tok group by 1, 2", "from keyed group by 1, 2").replace("uid,", "grp || '#' || session as uid,")},
finals as (select uid, score, len, row_number() over (partition by uid order by row_id desc) as r, split_part(uid, '#', 1) as grp from per_row),
stats as (select *, count(*) over w as n, avg(score) over w as m, stddev_samp(score) over w as d from finals where r = 1 window w as (partition by grp)),
valued as (select uid, case when len > 0 then (score - {_MEAN}) / (case when n = 1 then 1 else d end + 1e-6) else 0 end as a from stats)
select k.key, k.pos, round(v.a * k.mask + 0.0, 6) as advantages from keyed k join valued v on v.uid = k.grp || '#' || k.session""",
)
def adv_multi_trajectory(spark, sf_dir):
    key = F.concat(F.lit("u"), F.col("uid") % 100, F.lit("_"), F.col("row_id") % 3, F.lit("_"), F.col("row_id"))
    return long(adv.multi_trajectory(trajectories(spark, sf_dir).withColumn("key", key)), "advantages", keys=("key",))


@query(
    "group_mean_std",
    f"with {TOK}, {ROWS} select uid, round(case when count(*) <= 1 then 0 else avg(score) end, 6) as mean, round(case when count(*) <= 1 then 1 else sqrt(greatest(var_samp(score), 1e-6)) end, 6) as std, count(*) as count from per_row group by uid",
)
def group_mean_std(spark, sf_dir):
    df = trajectories(spark, sf_dir).select("uid", A.total(F.col("reward")).alias("score"))
    return adv.group_mean_std(df, "score", "uid").select("uid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


_KL = {
    "k1": "old_logp - rollout_logp",
    "abs": "abs(old_logp - rollout_logp)",
    "k2": "0.5 * (old_logp - rollout_logp) ** 2",
    "k3": "greatest(least(exp(greatest(least(rollout_logp - old_logp, 20), -20)) - greatest(least(rollout_logp - old_logp, 20), -20) - 1, 10), -10)",
}


@query("kl_penalty_k1_k2_k3", f"with {TOK} select row_id, pos, {', '.join(f'round({v} + 0.0, 6) as {k}' for k, v in _KL.items())} from tok")
def kl_penalties(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    for k in _KL:
        df = df.withColumn(k, A.kl_penalty(F.col("old_logp"), F.col("rollout_logp"), k))
    return long(df, *_KL)


@query(
    "kl_in_reward",
    f"with {TOK}, per as (select row_id, sum((old_logp - rollout_logp) * mask) / (sum(mask) + 1e-8) as k from tok group by 1) select round(avg(k), 6) as current_kl from per",
)
def kl_in_reward(spark, sf_dir):
    _, current = adv.apply_kl_penalty(trajectories(spark, sf_dir).withColumnRenamed("rollout_logp", "ref_logp"), 0.1)
    return current.select(F.round("current_kl", 6).alias("current_kl"))


@query(
    "masked_whiten",
    f"""with {TOK}, sums as (select sum(mask) as k, sum(reward * mask) / (sum(mask) + 1e-8) as mean from tok),
spread as (select sum((reward - (select mean from sums)) ** 2 * mask) / ((select k from sums) + 1e-8) * (select k from sums) / ((select k from sums) - 1) as var from tok)
select row_id, pos, round((reward - mean) / sqrt(var + 1e-8) + mean, 6) as reward from tok, sums, spread""",
)
def masked_whiten(spark, sf_dir):
    return long(adv.whiten(trajectories(spark, sf_dir), "reward", shift_mean=False), "reward")


@query(
    "grpo_orders",
    """select o_orderkey as row_id, round((o_totalprice - case when n = 1 then 0 else m end) / (case when n = 1 then 1 else d end + 1e-6), 6) as advantage
from (select *, count(*) over w as n, avg(o_totalprice) over w as m, stddev_samp(o_totalprice) over w as d from orders window w as (partition by o_custkey))""",
)
def grpo_orders(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.array("o_totalprice").alias("reward"), F.array(F.lit(1)).alias("mask"))
    return adv.advantage(df, "grpo").select("row_id", F.round(F.col("advantages")[0], 6).alias("advantage"))
