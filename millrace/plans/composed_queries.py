"""Queries of composed losses, run control, streams' results and conversation helpers, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scoring as S
from ..functions import text as T
from ..operators import advantage as adv
from ..operators import batch as B
from ..operators import builders as D
from ..operators import losses as L
from ..operators import metrics as M
from ..operators import offpolicy as O
from ..operators import partition as P
from ..operators import rewards as R
from ..operators import sampling as SA
from ..operators import sequences as Q
from ..sources import readers, sinks
from ..streaming import stateful as ST
from .binding import TOK, load, long, trajectories
from .catalog import query
from .metric_queries import _VAL, _validation
from .policy_queries import _CUT, _P, _RATIO, policy


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(F.col(f"`{c}`").cast("double") + 0.0, digits).alias(c) for c in df.columns])


def _joined(column):
    return F.array_join(column.cast("array<string>"), ",")


# ---- losses

_VANILLA = f"case when adv < 0 then least(-adv * 3, greatest({_RATIO}, {_CUT})) else greatest({_RATIO}, {_CUT}) end"
_REJECTED = f"""{_P}, s as (select *, sum((old_logp - logp) * mask) over (partition by row_id) / (sum(mask) over (partition by row_id) + 1e-8) as v from p),
q as (select * exclude (mask), case when v between ln(0.7131) and ln(1.4173) then mask else 0 end as mask from s)"""


@query("loss_bypass_clip", f"with {_REJECTED} select round(sum(({_VANILLA}) * mask) / sum(mask), 6) as loss, round(sum(case when {_CUT} > {_RATIO} then mask else 0 end) / (sum(mask) + 1e-8), 6) as clip_share from q")
def loss_bypass_clip(spark, sf_dir):
    return _rounded(L.policy_loss(policy(spark, sf_dir), "bypass_mode", options="seq_mean_k1", thresholds="0.7131_1.4173").select("loss", "clip_share"))


@query("loss_bypass_reinforce", f"with {_P} select round(sum(-adv * logp * least(exp(d) * mask, 1.5) * mask) / sum(mask), 6) as loss from p")
def loss_bypass_reinforce(spark, sf_dir):
    return _rounded(L.policy_loss(policy(spark, sf_dir), "bypass_mode", loss_type="reinforce", level="token", threshold="1.5").select("loss"))


@query(
    "ppo_loss_total",
    f"""with {_P}, k as (select *, greatest(least(old_logp - 0.05 - logp, 20), -20) as x from p),
a as (select sum(({_VANILLA}) * mask) / sum(mask) as pg, sum(value * mask) / sum(mask) as e, sum(greatest(least(exp(x) - x - 1, 10), -10) * mask) / sum(mask) as kl from k)
select round(pg - 0.01 * e + 0.1 * kl, 6) as loss, round(pg, 6) as pg_loss, round(e, 6) as entropy_loss, round(kl, 6) as kl_loss from a""",
)
def ppo_loss_total(spark, sf_dir):
    df = policy(spark, sf_dir).withColumn("ref_logp", F.transform("old_logp", lambda x: x - 0.05))
    return _rounded(L.ppo_loss(df, "vanilla", entropy="value", entropy_coefficient=0.01, kl="k3", kl_coefficient=0.1))


@query(
    "critic_loss_total",
    f"""with {TOK}, v as (select *, value + 3 * old_logp as vp, greatest(least(3 * old_logp, 0.5), -0.5) + value as near from tok)
select round(sum(0.5 * greatest((vp - reward) ** 2, (near - reward) ** 2) * mask) / sum(mask), 6) as loss, round(sum(vp * mask) / (sum(mask) + 1e-8), 6) as vpred_mean from v""",
)
def critic_loss_total(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("vpreds", F.zip_with("value", "old_logp", lambda v, x: v + 3 * x)).withColumn("returns", F.col("reward"))
    return _rounded(L.critic_loss(df).select("loss", "vpred_mean"))


@query(
    "diffusion_loss_total",
    f"""with {_P}, b as (select *, greatest(least(adv, 2), -2) as a, exp(d) as r from p), pg as (select avg(greatest(-a * r, -a * greatest(least(r, 1.1), 0.9))) as x from b),
kl as (select avg(v) as x from (select row_id, avg((old_logp - rollout_logp) ** 2) / (2 * 0.7 * 0.7) as v from tok group by 1)) select round((pg.x + 0.3 * kl.x) / 4, 6) as loss, round(kl.x, 6) as kl_loss from pg, kl""",
)
def diffusion_loss_total(spark, sf_dir):
    df = policy(spark, sf_dir).withColumn("mean", F.col("old_logp")).withColumn("ref_mean", F.col("rollout_logp")).withColumn("deviation", F.lit(0.7))
    return _rounded(L.diffusion_loss(df, kl_coefficient=0.3, accumulation=4, clip=0.1, most=2.0).select("loss", "kl_loss"))


def _taught(spark, sf_dir):
    return policy(spark, sf_dir).withColumn("teacher_logp", F.col("old_logp")).withColumn("topk_kl", F.transform("value", lambda v: v - 25))


_SPREAD = "(select round(min(x), 6) from d where mask = 1) as loss_min, (select round(max(x), 6) from d where mask = 1) as loss_max, (select round(avg(abs(x)), 6) from d where mask = 1) as abs_loss"


@query("distill_k1_bounded", f"with {_P}, d as (select *, logp - old_logp as x from p) select round(sum(greatest(least(x, 0.3), -0.3) * mask) / sum(mask), 6) as loss, {_SPREAD} from d")
def distill_k1_bounded(spark, sf_dir):
    return _rounded(L.distillation_loss(_taught(spark, sf_dir), "k1", most=0.3))


@query("distill_topk", f"with {_P}, d as (select *, greatest(value - 25, 0) as x from p) select round(sum(x * mask) / sum(mask), 6) as loss, {_SPREAD} from d")
def distill_topk(spark, sf_dir):
    return _rounded(L.distillation_loss(_taught(spark, sf_dir), "forward_kl_topk"))


@query("distill_by_policy", f"with {_P}, d as (select *, least(0.5 * (logp - old_logp) ** 2, 0.02) as x from p) select round(sum(x * logp * mask) / sum(mask), 6) as loss from d")
def distill_by_policy(spark, sf_dir):
    return _rounded(L.distillation_loss(_taught(spark, sf_dir), "k2", most=0.02, policy="reinforce").select("loss"))


@query(
    "distill_with_task",
    f"with {_P}, a as (select sum(({_VANILLA}) * mask) / sum(mask) as pg, sum(0.5 * (logp - old_logp) ** 2 * mask) / sum(mask) as x from p) select round(pg + 0.5 * x, 6) as loss, round(x, 6) as distillation_loss, round(pg, 6) as pg_loss from a",
)
def distill_with_task(spark, sf_dir):
    return _rounded(L.distillation_ppo_loss(_taught(spark, sf_dir), "k2", coefficient=0.5))


@query(
    "distill_forward_topk",
    "with e as (select vec_id, embedding::double[] as x from embeddings) select vec_id, round(exp(-0.5) * (-0.5 - x[1]) + exp(-1.5) * (-1.5 - x[4]), 6) as loss from e",
)
def distill_forward_topk(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("student_logp"))
    e = e.withColumn("teacher_ids", F.array(F.lit(0), F.lit(3))).withColumn("teacher_logp", F.array(F.lit(-0.5), F.lit(-1.5)))
    return L.distillation_topk(e).select("vec_id", F.round("loss", 6).alias("loss"))


@query("entropy_by_mode", f"with {TOK}, per as (select row_id, sum(value * mask) / (sum(mask) + 1e-8) as m, sum(mask) as n from tok group by 1) select round(sum(case when n > 0 then m else 0 end) / count(*) filter (n > 0), 6) as loss from per")
def entropy_by_mode(spark, sf_dir):
    return _rounded(L.entropy_loss(trajectories(spark, sf_dir), "value", "seq-mean-token-mean"))


@query("valid_mean", f"with {TOK} select round(sum(reward * mask) / sum(mask), 6) as mean from tok")
def valid_mean(spark, sf_dir):
    return trajectories(spark, sf_dir).agg(F.round(F.sum(A.masked_sum(F.col("reward"), F.col("mask"))) / F.sum(A.count_on(F.col("mask"))), 6).alias("mean"))


@query(
    "masked_var_rows",
    f"""with {TOK}, n as (select *, sum(mask) over w as n, sum(reward * mask) over w / (sum(mask) over w + 1e-8) as m from tok window w as (partition by row_id))
select row_id, round(sum((reward - m) ** 2 * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1), 4) as var from n where n > 1 group by 1""",
)
def masked_var_rows(spark, sf_dir):
    df = trajectories(spark, sf_dir).where(A.count_on(F.col("mask")) > 1)
    return df.select("row_id", F.round(A.masked_var(F.col("reward"), F.col("mask")), 4).alias("var"))


# ---- off-policy


def _rejection_sql(k: str, value: str, low: str, high: str, by_row: bool) -> str:
    inside = f"x <= {high}" if low == "null" else f"x between {low} and {high}"
    clamp = f"greatest(least(x, {high}), {'0' if low == 'null' else low})"
    share_low = "0.0" if low == "null" else f"avg(case when x < {low} then 1.0 else 0 end)"
    source = "select t.row_id, r.v as x from t join r using (row_id)" if by_row else "select row_id, k as x from t"
    return f"""with {TOK}, t as (select row_id, {k} as k from tok where mask = 1), r as (select row_id, {value} as v from t group by 1), x as ({source}),
bad as (select row_id, bool_or(not ({inside})) as b from x group by 1)
select round(avg(x), 6) as mean, round(max(x), 6) as max, round(min(x), 6) as min, round(stddev_pop({clamp}), 6) as std, round(avg(case when {inside} then 0.0 else 1 end), 6) as masked_fraction,
(select round(avg(v), 6) from r) as seq_mean, (select round(stddev_samp(v), 6) from r) as seq_std, (select round(max(abs(v)), 6) from r) as seq_max_deviation,
(select round(avg(case when v > {high} then 1.0 else 0 end), 6) from r) as seq_fraction_high, (select round(avg(case when b then 1.0 else 0 end), 6) from bad) as seq_masked_fraction,
{'(select round(avg(case when v > ' + high + ' then 1.0 else 0 end), 6) from r)' if by_row else f'round(avg(case when x > {high} then 1.0 else 0 end), 6)'} as fraction_high,
{'(select round(avg(case when v < ' + low + ' then 1.0 else 0 end), 6) from r)' if by_row else f'round({share_low}::double, 6)'} as fraction_low from x"""


_REPORTED = ("mean", "max", "min", "std", "masked_fraction", "seq_mean", "seq_std", "seq_max_deviation", "seq_fraction_high", "seq_masked_fraction", "fraction_high", "fraction_low")
_GAP = "greatest(least(old_logp - rollout_logp, 20), -20)"


@query("rs_metrics_token_k3", _rejection_sql(f"exp({_GAP}) - 1 - {_GAP}", "sum(k) / (count(*) + 1e-8)", "null", "0.0913", False))
def rs_metrics_token_k3(spark, sf_dir):
    return _rounded(O.rejection_metrics(trajectories(spark, sf_dir), "token_k3", "0.0913").select(*_REPORTED))


@query("rs_metrics_seq_mean_k1", _rejection_sql("rollout_logp - old_logp", "sum(k) / (count(*) + 1e-8)", "ln(0.7131)", "ln(1.4173)", True))
def rs_metrics_seq_mean_k1(spark, sf_dir):
    return _rounded(O.rejection_metrics(trajectories(spark, sf_dir), "seq_mean_k1", "0.7131_1.4173").select(*_REPORTED))


@query(
    "weights_and_rejection",
    f"with {TOK}, s as (select *, least(exp({_GAP}) * mask, 1.2) as w from tok) select row_id, pos, round(w + 0.0, 6) as weights, round(case when 0.5 * (old_logp - rollout_logp) ** 2 <= 0.0817 then mask else 0 end::double, 6) as mask from s",
)
def weights_and_rejection(spark, sf_dir):
    return long(O.correct(trajectories(spark, sf_dir), "token", "1.2", options="token_k2", thresholds="0.0817"), "weights", "mask")


@query("bypassed_ratio", f"with {TOK} select row_id, pos, round(rollout_logp + 0.0, 6) as old_logp from tok")
def bypassed_ratio(spark, sf_dir):
    return long(O.bypass(trajectories(spark, sf_dir)), "old_logp")


@query(
    "threshold_specs",
    "select * from (values ('2.0', null::double, 2.0::double), ('0.5_2.0', 0.5, 2.0), ('token_k1:1.25', 0.8, 1.25), ('seq_sum_k3:0.7', null, 0.7)) t(spec, lower, upper)",
)
def threshold_specs(spark, sf_dir):
    rows = [(s, *O.parse_weight_threshold(s)) for s in ("2.0", "0.5_2.0")]
    for s in ("token_k1:1.25", "seq_sum_k3:0.7"):
        option, spec = s.split(":")
        rows.append((s, *O.parse_rejection_thresholds([option], spec)[0]))
    return spark.createDataFrame(rows, "spec string, lower double, upper double")


# ---- metrics


@query(
    "special_window_metrics",
    """with w as (select event_id // 100 as win, max(value) as mx, min(value) as mn, sum(value) as s, count(*) as n from events group by 1)
select win as window, round(mx - mn, 6) as minmax_diff, round(s / (n * 8), 6) as throughput, round(mn / mx, 6) as idle from w""",
)
def special_window_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("window")).agg(
        F.max("value").alias("global_seqlen/max"), F.min("value").alias("global_seqlen/min"), F.lit(0.0).alias("global_seqlen/minmax_diff"), F.sum("value").alias("perf/total_num_tokens"),
        F.count("*").alias("perf/time_per_step"), F.lit(0.0).alias("perf/throughput"), F.min("value").alias("timing_s/gen"), F.max("value").alias("timing_s/step"),
    )
    out = M.special_window_metrics(e, 8)
    return out.select("window", *[F.round(F.col(f"`{c}`"), 6).alias(a) for c, a in (("global_seqlen/minmax_diff", "minmax_diff"), ("perf/throughput", "throughput"), ("fully_async/trainer/idle_ratio", "idle"))])


@query(
    "positive_trajectory_length",
    f"with {TOK}, r as (select row_id, coalesce(min(pos) filter (old_logp < -0.8), 0) + 1 as n, bool_or(value > 45) as good from tok group by 1) select round(avg(n) filter (good), 6) as length from r",
)
def positive_trajectory_length(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("done", F.transform("old_logp", lambda x: x < -0.8)).withColumn("positive", F.transform("value", lambda v: v > 45))
    return _rounded(M.positive_trajectory_length(df))


@query("mean_max_min_std", "select round(avg(l_extendedprice), 4) as mean, round(max(l_extendedprice), 4) as max, round(min(l_extendedprice), 4) as min, round(stddev_samp(l_extendedprice), 4) as std from lineitem")
def mean_max_min_std(spark, sf_dir):
    return _rounded(M.mean_max_min_std(load(spark, sf_dir, "lineitem"), "l_extendedprice"), 4)


@query("stale_rows", "with s as (select event_id // 1000 as batch, count(*) filter (7 - event_id % 9 >= 1) as stale from events group by 1) select batch, stale, sum(stale) over (order by batch)::bigint as stale_so_far from s")
def stale_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("batch"), (F.col("event_id") % 9).alias("version"))
    return M.stale_rows(e, "version", F.lit(7), "batch")


@query("without_padding", "select o_orderkey % 5 as part, count(*) as n from orders where o_orderstatus <> 'P' or o_orderstatus is null group by 1")
def without_padding(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("padding", F.col("o_orderstatus") == "P")
    return M.without_padding(o, "padding").groupBy((F.col("o_orderkey") % 5).alias("part")).agg(F.count("*").alias("n"))


@query(
    "validation_run",
    f"""with {_VAL}, sizes as (select source, uid, count(*) as n from val group by 1, 2),
ks as (select distinct n, k from (select n, unnest(list_append(list_filter([2, 4, 8, 16, 32], lambda x: x < n), n)) as k from sizes where n > 1)),
draws as (select n, k, b, j, (('0x' || substr(md5('42:' || k || ':' || b || ':' || j), 1, 8))::bigint) % n as pos from ks, range(20) tb(b), range(64) tj(j) where j < k),
drawn as (select s.source, s.uid, d.n, d.k, d.b, d.j, f.value as v, f.pred as p from sizes s join draws d on d.n = s.n join val f on f.source = s.source and f.uid = s.uid and f.pos = d.pos),
votes as (select source, uid, k, b, p, count(*) as c, min(j) as first, min_by(v, j) as pv, max(v) as high, min(v) as low from drawn group by all),
samples as (select source, uid, k, b, max(high) as best, min(low) as worst, arg_max(pv, c * 1000 - first) as maj from votes group by all),
booted as (select source, uid, k, avg(best) as bm, stddev_pop(best) as bs, avg(worst) as wm, stddev_pop(worst) as ws, avg(maj) as mm, stddev_pop(maj) as ms from samples group by all),
plain as (select source, uid, count(*) as n, avg(value) as m, stddev_pop(value) as s from val group by 1, 2),
rows as (select source, 'mean@' || n as metric, m as v from plain union all select source, 'std@' || n, s from plain where n > 1
  union all select source, 'best@' || k || '/mean', bm from booted union all select source, 'best@' || k || '/std', bs from booted union all select source, 'worst@' || k || '/mean', wm from booted
  union all select source, 'worst@' || k || '/std', ws from booted union all select source, 'maj@' || k || '/mean', mm from booted union all select source, 'maj@' || k || '/std', ms from booted),
named as (select source, metric, avg(v) as v, cast(regexp_extract(metric, '@([0-9]+)', 1) as int) as n from rows group by 1, 2),
topped as (select *, max(n) over (partition by source) as top from named)
select case when n = top and regexp_matches(metric, '^(mean|maj|best)') then 'val-core' else 'val-aux' end as section, source, 'reward' as var, metric, round(v / 7.0710678, 2) as value from topped""",
)
def validation_run(spark, sf_dir):
    out = M.validate(_validation(spark, sf_dir).withColumnRenamed("value", "reward"), ["reward"], "pred", draws=20)
    return out.withColumn("value", F.round(F.col("value") / 7.0710678, 2))


@query("metric_titles", "select p_partkey as k, split_part(p_type || '/' || p_brand || '/x', '/', 1) as title, p_brand || '/x' as series from part")
def metric_titles(spark, sf_dir):
    title, series = sinks.title_and_series(F.concat("p_type", F.lit("/"), "p_brand", F.lit("/x")))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), title.alias("title"), series.alias("series"))


@query("metric_lines", "select p_partkey as k, 'step:' || p_partkey || ' - a:' || p_size || ' - b:' || (p_size + 1) as line from part")
def metric_lines(spark, sf_dir):
    metrics = F.create_map(F.lit("b"), F.col("p_size") + 1, F.lit("a"), F.col("p_size") + 0)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.metrics_line(F.col("p_partkey"), metrics).alias("line"))


@query("metric_json_lines", """select p_partkey as k, '{"step":' || p_partkey || ',"data":{"size":' || p_size || '}}' as line from part""")
def metric_json_lines(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), sinks.metric_json(F.col("p_partkey"), F.struct(F.col("p_size").alias("size"))).alias("line"))


# ---- balanced batches


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")


@query(
    "dynamic_batches",
    "select doc_id // 64 as batch, count(*) as rows, sum(n_chars) as total, least(count(*), ceil(sum(n_chars) / 20000.0))::bigint as micros from documents group by 1",
)
def dynamic_batches(spark, sf_dir):
    out = P.dynamic_batches(_docs(spark, sf_dir), "batch", "n_chars", 20_000)
    return out.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n_chars").cast("decimal(38,0)").alias("total"), F.countDistinct("micro").alias("micros"))


@query("dynamic_batches_restored", "select doc_id // 64 as batch, doc_id as row_id, 2 * n_chars as result from documents")
def dynamic_batches_restored(spark, sf_dir):
    placed = P.dynamic_batches(_docs(spark, sf_dir), "batch", "n_chars", 20_000)
    results = placed.select("batch", "micro", "place", (2 * F.col("n_chars")).alias("result"))
    return P.restore_order(results, "batch", placed).select("batch", "row_id", "result")


@query("group_balance", "select doc_id // 64 as batch, count(*) as rows, sum(n_chars) as total, 4 as parts, 0 as torn from documents group by 1 having count(*) = 64")
def group_balance(spark, sf_dir):
    """Runs of eight rows stay together, and the four parts of a batch hold all rows."""
    docs = _docs(spark, sf_dir).withColumn("uid", F.floor(F.col("row_id") / 8))
    whole = docs.groupBy("batch").count().where("count = 64").select("batch")
    out = P.group_balance(docs.join(whole, "batch", "left_semi"), "batch", "uid", "n_chars", 4)
    torn = out.groupBy("batch", "uid").agg((F.countDistinct("part") - 1).alias("torn")).groupBy("batch").agg(F.sum("torn").cast("int").alias("torn"))
    sums = out.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n_chars").cast("decimal(38,0)").alias("total"), F.countDistinct("part").cast("int").alias("parts"))
    return sums.join(torn, "batch")


@query("rounded_up", "select p_partkey as k, ceil(p_size / 7.0)::bigint as parts, (ceil(p_size / 7.0) * 7)::bigint as padded, 24 as multiple from part")
def rounded_up(spark, sf_dir):
    size, seven = F.col("p_size"), F.lit(7)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), P.ceildiv(size, seven).cast("bigint").alias("parts"), P.round_up(size, seven).alias("padded"), F.lit(P.batch_multiple(8, 3, 4)).alias("multiple"))


@query("inverse_permutation", "select doc_id, doc_id as back from documents")
def inverse_permutation(spark, sf_dir):
    """Rows in another order, and back in their own."""
    docs = B.number_rows(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    places = B.number_rows(docs.select("row_id", (F.col("row_id") * 7919 % 1009).alias("mixed")), "mixed", "row_id", out="place").select("place", "row_id")
    back = B.reorder(B.reorder(docs, places), B.inverse(places))
    return docs.join(back.select("row_id", F.col("doc_id").alias("back")), "row_id").select("doc_id", "back")


# ---- arrays


@query("jagged_offsets", "with d as (select doc_id, len(string_split(text, ' ')) as n from documents where text is not null) select doc_id as row_id, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset from d")
def jagged_offsets(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("row_id"), F.split("text", " ").alias("words"))
    return B.jagged(docs, "words").select("row_id", "offset")


@query("expanded_scalars", f"with {TOK} select row_id, pos, round(uid + 0.0, 6) as uid_at from tok")
def expanded_scalars(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    return long(df.withColumn("uid_at", A.expand(F.col("uid").cast("double"), F.col("mask"))), "uid_at")


@query("cut_responses", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as n from tok) select row_id, pos, round(reward, 6) as reward from n where pos < n")
def cut_responses(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    return long(df.withColumn("reward", A.cut_response(F.col("reward"), F.col("mask"))), "reward")


@query(
    "padded_ids",
    """with p as (select p_partkey as k, list_transform(range(p_size % 9), lambda x: x + 1) as a, p_size % 9 as n from part)
select k, array_to_string(a || list_transform(range(greatest(0, 6 - n)), lambda x: 0), ',') as right_padded, array_to_string(list_transform(range(greatest(0, 6 - n)), lambda x: 0) || a, ',') as left_padded,
array_to_string(list_transform(range(greatest(0, 6 - n)), lambda x: 0) || a[greatest(1, n - 5):], ',') as kept_tail from p""",
)
def padded_ids(spark, sf_dir):
    n = F.col("p_size") % 9
    a = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), a.alias("a"))
    x = F.col("a")
    return p.select("k", _joined(A.pad_right(x, 6, 0)).alias("right_padded"), _joined(A.pad_left(x, 6, 0)).alias("left_padded"), _joined(A.fit_length(x, 6, 0, truncation="left")).alias("kept_tail"))


@query("unpadded_ids", "select p_partkey as k, array_to_string(list_transform(range(p_size % 5 + 1), lambda x: x + 10), ',') as ids from part")
def unpadded_ids(spark, sf_dir):
    n = F.col("p_size") % 5 + 1
    ids = A.pad_left(F.transform(F.sequence(F.lit(0), n - 1), lambda x: x + 10), 8, 0)
    mask = A.pad_left(F.transform(F.sequence(F.lit(0), n - 1), lambda _: F.lit(1)), 8, 0)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _joined(A.drop_left_pad(ids, mask)).alias("ids"))


@query("teacher_rows_padded", "select p_partkey as k, p_size % 3 + 5 + p_size % 4 as rows, '0,0' as first, p_size || ',' || (p_size + 1) as middle from part where p_size % 3 > 0")
def teacher_rows_padded(spark, sf_dir):
    size = F.col("p_size")
    rows = F.array_repeat(F.array(size, size + 1), (size % 4).cast("int") + 1)
    padded = A.pad_rows(rows, size % 3, 4, 0, 2)
    p = load(spark, sf_dir, "part").where(size % 3 > 0)
    return p.select(F.col("p_partkey").alias("k"), F.size(padded).cast("bigint").alias("rows"), _joined(padded[0]).alias("first"), _joined(F.get(padded, size % 3)).alias("middle"))


@query("template_ids", "select p_partkey as k, '1,2' as system, '9,9' as opening, array_to_string([p_size, 3], ',') as flat from part")
def template_ids(spark, sf_dir):
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    nested = F.array(F.array(F.col("p_size"), F.lit(3)))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), _joined(A.system_prefix(ids(1, 2, 5, 6, 7), ids(1, 2, 5, 6, 7, 5, 6, 7))).alias("system"),
        _joined(A.generation_prompt(ids(1, 2, 5), ids(1, 2, 5, 9, 9))).alias("opening"), _joined(A.token_ids(nested, "array<array<int>>")).alias("flat"),
    )


@query(
    "message_masks",
    """with m as (select conv_id, turn, role, list_transform(range(4 + length(text) % 5), lambda x: x + 1) as ids, turn <> 0 and role <> 'system' as cut from conversations)
select conv_id, turn, array_to_string(case when cut then ids[3:] else ids end, ',') as ids, array_to_string(list_transform(range(len(case when cut then ids[3:] else ids end)), lambda k: case when role = 'assistant' and k >= 1 then 1 else 0 end), ',') as mask from m""",
)
def message_masks(spark, sf_dir):
    ids = F.sequence(F.lit(1), 4 + F.length("text") % 5)
    out = T.message_tokens(ids, F.col("turn"), F.col("role"), 2, 1)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", _joined(out["ids"]).alias("ids"), _joined(out["mask"]).alias("mask"))


@query(
    "assistant_masks",
    "select conv_id, sum(case when role = 'assistant' then length(text) % 7 + 1 else 0 end)::bigint as learned, sum(length(text) % 7 + 1)::bigint as tokens from conversations group by 1",
)
def assistant_masks(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", (F.length("text") % 7 + 1).alias("n")))).alias("m"))
    mask = T.assistant_mask(F.col("m"), F.transform("m", lambda m: m["n"]))
    return c.select("conv_id", A.count_on(mask).cast("bigint").alias("learned"), F.size(mask).cast("bigint").alias("tokens"))


@query(
    "preference_pairs",
    """with p as (select p_partkey as k, p_size % 4 + 1 as n from part) select k, array_to_string(([7, 8] || list_transform(range(n), lambda x: 1) || [0] || [9, 9, 9, 9, 9, 9])[:6], ',') as chosen,
array_to_string(([7, 8] || [2, 0] || [9, 9, 9, 9])[:6], ',') as rejected, least(6, n + 3)::bigint as learned from p""",
)
def preference_pairs(spark, sf_dir):
    n = (F.col("p_size") % 4 + 1).cast("int")
    pair = T.preference_pair(F.array(F.lit(7), F.lit(8)), F.array_repeat(F.lit(1), n), F.array(F.lit(2)), 0, 6, 9)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _joined(pair["ids"][0]).alias("chosen"), _joined(pair["ids"][1]).alias("rejected"), A.count_on(pair["mask"][0]).cast("bigint").alias("learned"))


# ---- text


@query("scorer_prompts", "select p_partkey as k, '[user|' || p_name || ']' || '[assistant|' || p_brand || ']' as prompt from part")
def scorer_prompts(spark, sf_dir):
    messages = F.array(D.message("user", F.col("p_name")))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.scorer_prompt(messages, F.concat("p_brand", F.lit("</s>")), end="</s>", template=("[", "|", "]")).alias("prompt"))


@query("numbered_passages", "select p_partkey as k, 'Doc 1 (Title: ' || p_name || ')' || chr(10) || p_type || chr(10) || chr(10) || 'Doc 2 (Title: ' || p_brand || ')' || chr(10) || 'x' as passages from part")
def numbered_passages(spark, sf_dir):
    contents = F.array(F.concat("p_name", F.lit("\n"), "p_type"), F.concat("p_brand", F.lit("\nx")))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.passages(contents).alias("passages"))


@query("cleaned_choices", "select p_partkey as k, p_name || '. ' || p_brand as cleaned, upper(left(p_name, 1)) || lower(substr(p_name, 2)) as capital from part")
def cleaned_choices(spark, sf_dir):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" [title]"), "p_brand", F.lit("[note] "))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.hellaswag_clean(raw).alias("cleaned"), T.capitalise(F.col("p_name")).alias("capital"))


_XML = "<function=find><parameter=q>\n{}\n</parameter><parameter=n>{}</parameter><parameter=ok>{}</parameter><parameter=x>null</parameter></function>"


@query(
    "typed_xml_calls",
    """select event_id as k, 'find' as name, '{"q": "' || event_type || '", "n": ' || (event_id % 100) || ', "ok": ' || case when event_id % 2 = 0 then 'true' else 'false' end || ', "x": null}' as arguments,
'{"q":"' || event_type || '","n":"' || (event_id % 100) || '","ok":"' || case when event_id % 2 = 0 then 'TRUE' else 'no' end || '","x":"null"}' as untyped from events""",
)
def typed_xml_calls(spark, sf_dir):
    parts = _XML.split("{}")
    text = F.concat(F.lit(parts[0]), "event_type", F.lit(parts[1]), (F.col("event_id") % 100).cast("string"), F.lit(parts[2]), F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("no"), F.lit(parts[3]))
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("k"), text.alias("t"))
    typed = T.typed_xml_calls(F.col("t"), {"find": {"q": "string", "n": "integer", "ok": "boolean"}})
    return e.select("k", typed.alias("c"), T.xml_calls(F.col("t"))[0]["arguments"].alias("untyped")).select("k", F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"].alias("arguments"), "untyped")


@query("channel_calls", """select event_id as k, event_type as name, '{"n": ' || event_id || '}' as arguments from events""")
def channel_calls(spark, sf_dir):
    text = F.concat(F.lit("<|channel|>analysis<|message|>to=functions.no json<|message|>{}<|call|><|end|>to=functions."), "event_type", F.lit(' <|constrain|>json<|message|>{"n": '), F.col("event_id").cast("string"), F.lit("}<|call|>"))
    call = T.channel_calls(text)[0]
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("k"), call["name"].alias("name"), call["arguments"].alias("arguments"))


@query("found_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents) select doc_id, line_no::bigint as line_no, length(line)::bigint as n from l where contains(line, 'licens')")
def found_lines(spark, sf_dir):
    out = T.search_lines(load(spark, sf_dir, "documents"), "text", "licens", ["doc_id"])
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("n"))


@query("split_on_words", "select doc_id, len(string_split(text, '. ')) as parts from documents")
def split_on_words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(T.split_on(F.col("text"), ". ")).cast("bigint").alias("parts"))


@query("sorted_by_score", "select o_orderkey as row_id, row_number() over (order by coalesce(case when o_orderkey % 3 = 0 then null else o_totalprice end, o_custkey, 0) desc, o_orderkey) as place from orders qualify place <= 50")
def sorted_by_score(spark, sf_dir):
    """The first page of a viewer."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("score"), F.col("o_custkey").alias("score_1"))
    page = T.by_score(o).limit(50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("score", "score_1", F.lit(0)).desc(), "row_id")).cast("bigint")).select("row_id", "place")


@query("found_request", "select min(o_orderkey) as row_id from orders where o_custkey = (select max(o_custkey) from orders)")
def found_request(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("a-"), F.col("o_custkey").cast("string")).alias("request_id"))
    last = load(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0]
    return T.find_request(o, f"a{last}", ["row_id"]).select("row_id")


# ---- scores


@query("first_hash_answer", "select o_orderkey as k, o_custkey || '000' as answer from orders")
def first_hash_answer(spark, sf_dir):
    text = F.concat(F.lit("work #### "), F.col("o_custkey").cast("string"), F.lit(",000 more"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), S.first_hash_answer(text).alias("answer"))


@query(
    "answer_texts",
    "select p_partkey as k, 'cost ' || p_size || '000 and 2+1/' || p_size as plain, '[' || p_size || ',7)' as interval, (p_size || '500')::double as number, p_size / 100.0::double as share from part",
)
def answer_texts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    plain = S.mixed_numbers(S.strip_commas(F.concat(F.lit("cost "), size, F.lit(",000 and 2 1/"), size)))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), plain.alias("plain"), S.interval_text(F.concat(F.lit("Interval.Ropen("), size, F.lit(", 7)"))).alias("interval"),
        S.is_number(F.concat(size, F.lit("{,}500"))).alias("number"), S.is_number(F.concat(size, F.lit("\\%"))).alias("share"),
    )


@query("source_scores", """select o_orderkey as k, case o_orderkey % 6 when 0 then (o_orderkey % 4 < 2)::int when 1 then (o_orderkey % 4 < 2)::int when 2 then (o_orderkey % 4 < 2)::int when 3 then case when o_orderkey % 4 < 2 then 1 else -1 end when 4 then (o_orderkey % 4 < 2)::int else case when o_orderkey % 4 < 2 then 1.0 else 0.1 end end::double as score from orders""")
def source_scores(spark, sf_dir):
    """Scorers by source: the right answer in rows 0 and 1 of four, a wrong one in the others, which no tolerance of a scorer reaches."""
    k = F.col("o_orderkey")
    given = F.when(k % 4 < 2, F.col("o_custkey")).otherwise(2 * F.col("o_custkey") + 1).cast("string")
    source = F.element_at(F.array(*[F.lit(x) for x in ("openai/gsm8k", "HuggingFaceH4/MATH-500", "searchR1_nq", "math_dapo", "numina_olympiads", "hiyouga/geometry3k")]), (k % 6 + 1).cast("int"))
    solution = F.concat(F.lit("<think>x</think> #### "), given, F.lit(" <answer>"), given, F.lit("</answer> \\boxed{"), given, F.lit("}\nAnswer: "), given)
    return load(spark, sf_dir, "orders").select(k.alias("k"), F.round(S.score_by_source(source, solution, F.col("o_custkey").cast("string")), 6).alias("score"))


@query(
    "code_scores",
    "with s as (select user_id as k, count(*) as n, count(*) filter (value > 50) as ok, count(*) filter (value > 50 and r <= 10) as first from (select *, row_number() over (partition by user_id order by event_id) as r from events) group by 1) select k, round(ok / n, 6) as score, round(first / least(n, 10), 6) as continuous from s",
)
def code_scores(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("s")))).alias("e"))
    statuses = F.transform("e", lambda x: x["s"])
    return e.select("k", F.round(S.code_score(statuses), 6).alias("score"), F.round(S.code_score(statuses, True), 6).alias("continuous"))


@query("code_blocks", "select p_partkey as k, chr(10) || p_name || chr(10) as code from part")
def code_blocks(spark, sf_dir):
    text = F.concat(F.lit("no ```python\nold\n``` then ```python\n"), "p_name", F.lit("\n``` done"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), S.code_block(text).alias("code"))


@query("tool_format_shapes", "select o_orderkey as k, case when o_orderkey % 3 = 0 then 1.0::double else 0.0::double end as score from orders")
def tool_format_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit("<think>a</think>\n<tool_call>\n{}\n</tool_call>")).when(k % 3 == 1, F.lit("<think>a</think>\n<tool_call>{}</tool_call>")).otherwise(F.lit("<think>a</think>\n<response>b</response>"))
    return load(spark, sf_dir, "orders").select(k.alias("k"), S.tool_format(text, F.lit("<tool_call>")).alias("score"))


@query(
    "boxes_within",
    """with b as (select l_orderkey as k, l_linenumber as line, l_quantity * 3 as x, l_quantity * 2 as y, l_quantity * 3 + 30 + l_linenumber as x2, l_quantity * 2 + 40 as y2 from lineitem)
select k, line, least(x2, 150) - x > 0 and least(y2, 120) - y > 0 as valid, case when least(x2, 150) - x >= 28 and least(y2, 120) - y >= 28 then x + y + least(x2, 150) + least(y2, 120) end as corners from b where least(x2, 150) - x >= 28 and least(y2, 120) - y >= 28 or least(x2, 150) <= x""",
)
def boxes_within(spark, sf_dir):
    """Boxes that need no growing, and those that lie outside."""
    x, y = F.col("l_quantity") * 3, F.col("l_quantity") * 2
    x2, y2 = x + 30 + F.col("l_linenumber"), y + 40
    cut = F.least(x2, F.lit(150.0)), F.least(y2, F.lit(120.0))
    box = S.boxes_resized(x, y, x2, y2, F.lit(150), F.lit(120))
    kept = ((cut[0] - x >= 28) & (cut[1] - y >= 28)) | (cut[0] <= x)
    total = F.aggregate(box, F.lit(0.0), lambda a, v: a + v)
    return load(spark, sf_dir, "lineitem").where(kept).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.coalesce(S.boxes_valid(x, y, *cut), F.lit(False)).alias("valid"), total.alias("corners"))


# ---- managers


@query("manager_scores", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as n from tok) select row_id, pos, round(case when pos = n - 1 then uid % 3 else 0 end + 0.0, 6) as reward from n")
def manager_scores(spark, sf_dir):
    df = R.manager("naive")(trajectories(spark, sf_dir), (F.col("uid") % 3).cast("double"))
    return long(df.drop("reward").withColumnRenamed("reward_tensor", "reward"), "reward")


@query("manager_components", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as n from tok) select row_id, pos, round(case when pos = n - 1 then uid % 3 + uid % 5 else 0 end + 0.0, 6) as reward from n")
def manager_components(spark, sf_dir):
    df = R.manager("gdpo")(trajectories(spark, sf_dir), {"first": (F.col("uid") % 3).cast("double"), "second": (F.col("uid") % 5).cast("double")})
    return long(df.drop("reward").withColumnRenamed("reward_tensor", "reward"), "reward")


@query("manager_failures", "select o_orderkey as k, case when o_orderkey % 4 = 0 then 0.0 else 1.5 end::double as acc from orders")
def manager_failures(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array(F.lit(1)).alias("mask"))
    return R.manager("prime")(o, F.when(F.col("k") % 4 != 0, F.lit(1.5))).select("k", "acc")


@query("manager_batch", "select o_orderkey as k, o_totalprice as acc from orders")
def manager_batch(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array(F.lit(1)).alias("mask"), "o_totalprice")
    return R.manager("batch")(o, F.col("o_totalprice")).select("k", "acc")


@query("scored_columns", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as n from tok) select row_id, uid, round(sum(case when pos = n - 1 then 2.5 else 0 end), 6) as total from n group by 1, 2")
def scored_columns(spark, sf_dir):
    df = R.reward_columns(R.scattered_scores(trajectories(spark, sf_dir).withColumn("rm_score", F.lit(2.5))), ["uid"])
    return df.select("row_id", "uid", F.round(A.total(F.col("reward_tensor")), 6).alias("total"))


@query("shown_examples", "select o_orderpriority as source, o_orderkey as k from orders qualify row_number() over (partition by o_orderpriority order by o_orderkey) <= 3")
def shown_examples(spark, sf_dir):
    return R.first_of_each(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 3).select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("k"))


@query("kl_controllers", "select * from (values ('fixed', 0.1::double), ('adaptive', 0.1 * (1 + 0.2 * 64 / 10000.0))) t(kind, value)")
def kl_controllers(spark, sf_dir):
    rows = []
    for kind in ("fixed", "adaptive"):
        c = adv.kl_controller(kind, 0.1, target=0.05, horizon=10_000)
        c.update(0.5, 64)
        rows.append((kind, c.value))
    return spark.createDataFrame(rows, "kind string, value double")


# ---- sources and sinks


@query(
    "read_many_files",
    "select 0 as file_no, count(*) as n, count(lang) as langs from documents union all select 1, count(*), 0 from benchmark",
)
def read_many_files(spark, sf_dir):
    d = sf_dir.rstrip("/")
    out = readers.read_many(spark, [f"{d}/documents.parquet", f"{d}/benchmark.parquet"])
    return out.groupBy("file_no").agg(F.count("*").alias("n"), F.count("lang").alias("langs"))


@query("load_prompts", "select doc_id, file_no from (select doc_id, 0 as file_no, n_chars from documents union all select doc_id, 1, n_chars from documents) where n_chars <= 2000 and doc_id < 100")
def load_prompts(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    options = readers.ReadOptions(prompt_key="text", limit=200, max_prompt_length=2000, length=F.length)
    return readers.load_prompts(spark, [path, path], options, ["doc_id", "file_no"]).select("doc_id", "file_no")


@query("load_conversations", "select conv_id, turn from conversations order by conv_id, turn limit 77")
def load_conversations(spark, sf_dir):
    return readers.load_conversations(spark, [f"{sf_dir.rstrip('/')}/conversations.parquet"], 77, ["conv_id", "turn"]).select("conv_id", "turn")


@query("load_preferences", "select doc_id::varchar as prompt, lang as chosen, source as rejected from documents")
def load_preferences(spark, sf_dir):
    out = readers.load_preferences(spark, [f"{sf_dir.rstrip('/')}/documents.parquet"], "doc_id", "lang", "source")
    return out.withColumn("prompt", F.col("prompt").cast("string"))


@query("generation_rows", "select p_name as input, p_brand as output, p_type as gts, p_size * 3.0::double as score, p_partkey as step from part")
def generation_rows(spark, sf_dir):
    size = F.col("p_size").cast("double")
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("input"), F.col("p_brand").alias("output"), F.col("p_type").alias("ground_truth"), F.array(size, 2 * size).alias("token_level_scores"), F.col("p_partkey").alias("step"))
    return sinks.generation_rows(p)


@query("validation_sample", "select doc_id from documents order by md5('42:' || doc_id || ':' || lang) limit 25")
def validation_sample(spark, sf_dir):
    """A sampling operator: the first rows by hash."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("input"), F.col("lang").alias("output"))
    return sinks.validation_sample(d, 25).select(F.col("input").alias("doc_id"))


@query("prompt_items", """select p_partkey as k, p_name as raw_prompt, case when p_partkey % 2 = 0 then p_size else 0 end::bigint as index, '{"tool":"' || p_brand || '"}' as tools_kwargs, '{}' as interaction_kwargs from part""")
def prompt_items(spark, sf_dir):
    info = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("index"), F.struct(F.col("p_brand").alias("tool")).alias("tools_kwargs"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("prompt"), F.lit("x").alias("images"), info.alias("extra_info"))
    out = B.prompt_items(p)
    assert "images" not in out.columns
    return out.select("k", "raw_prompt", "index", "tools_kwargs", "interaction_kwargs")


@query("fields_of_keys", "select o_orderkey as key, o_totalprice, o_orderstatus from orders where o_custkey % 7 = 0")
def fields_of_keys(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    return B.fields_of(o, o.where("o_custkey % 7 = 0").select("key"), ["o_totalprice", "o_orderstatus"])


@query("nested_columns", "select p_partkey as k, p_size as \"a/b\", p_brand as \"a/c/d\" from part")
def nested_columns(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.struct(F.col("p_size").alias("b"), F.struct(F.col("p_brand").alias("d")).alias("c")).alias("a"))
    return B.flatten(p)


@query("assigned_columns", "select region.r_regionkey as row_id, 5 as fixed, 10 * (region.r_regionkey + 1) as given, 'none' as missing from region")
def assigned_columns(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("row_id"))
    out = B.assign(r, fixed=5, given=[10, 20, 30, 40, 50])
    return out.select("row_id", "fixed", F.col("given").cast("int").alias("given"), B.get(out, "missing", "none").alias("missing"))


@query("rows_of_columns", "select k as row_id, chr(97 + k::int) as a, k * k as b from range(5) t(k)")
def rows_of_columns(spark, sf_dir):
    columns = B.as_columns([{"a": chr(97 + k), "b": k * k} for k in range(5)], ["a", "b"])
    return B.as_rows(spark, columns)


@query("prefixed_keys", "select p_partkey as k, 'val/' || p_brand || ';val/x' as keys from part")
def prefixed_keys(spark, sf_dir):
    entries = F.create_map(F.col("p_brand"), F.lit(1), F.lit("val/x"), F.lit(2))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.map_keys(B.prefix_keys(entries, "val/")), ";").alias("keys"))


@query("merged_settings", "select * from (values ('a', 1), ('b', 2), ('c', 3)) t(name, value)")
def merged_settings(spark, sf_dir):
    rows = spark.createDataFrame(sorted(B.merge_options({"a": 1, "b": 2}, {"b": 2, "c": 3}).items()), "name string, value int")
    return B.first_of([rows.groupBy().agg(F.collect_list(F.struct("name", "value")).alias("r")), rows]).select(F.inline("r"))


# ---- sampling


def _hash(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint)"


@query("allocated_rows", "with r as (select o_orderkey as k, o_orderpriority as task, row_number() over (partition by o_orderpriority order by md5('3:' || o_orderkey), o_orderkey) as r from orders) select k, task from r order by r, task limit 123")
def allocated_rows(spark, sf_dir):
    """A sampling operator: rows dealt round-robin over tasks."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("task"))
    return SA.allocate(o, "task", 123, 3, "k").select("k", "task")


@query(
    "stratified_rows",
    "with r as (select o_orderkey as k, o_orderstatus = 'F' as good, row_number() over (partition by o_orderstatus = 'F' order by md5('5:' || o_orderkey), o_orderkey) as r from orders) select k, good from r where r <= case when good then 30 else 70 end",
)
def stratified_rows(spark, sf_dir):
    """A sampling operator: a fixed share of positive rows."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("good"))
    return SA.stratified(o, "good", 100, 0.3, 5, "k").select("k", "good")


@query("traced_rows", "with s as (select o_custkey from (select distinct o_custkey from orders) order by md5('9:' || o_custkey), o_custkey limit 11) select o_orderkey as k from orders where o_custkey in (select o_custkey from s)")
def traced_rows(spark, sf_dir):
    """A sampling operator: all rows of a few customers."""
    return SA.keep_traced(load(spark, sf_dir, "orders"), "o_custkey", 11, 9).select(F.col("o_orderkey").alias("k"))


@query(
    "curriculum_order",
    f"with s as (select doc_id, case when doc_id % 2 = 0 then toxic else quality end as last from labels) select d.doc_id, row_number() over (order by coalesce(s.last::double, '-inf'::double), {_hash(chr(39) + '1:' + chr(39) + ' || d.doc_id')}, d.doc_id) - 1 as place from documents d left join s using (doc_id)",
)
def curriculum_order(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    scores = labels.select("doc_id", F.lit(0).alias("step"), F.col("quality").cast("double").alias("score")).unionByName(labels.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("step"), F.col("toxic").cast("double").alias("score")))
    return SA.curriculum(load(spark, sf_dir, "documents").select("doc_id"), scores, "doc_id", 1)


@query(
    "sparse_rewards",
    """with s as (select event_id, user_id, value > 90 as c, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by event_id) as k,
coalesce(max(case when value > 90 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 0 as valid, max(case when value > 90 then 1 else 0 end) over (partition by user_id) = 1 as positive from events)
select event_id, c or k = n - 1 as done, positive, round(case when k = n - 1 then -1.0 else c::int - 0.1 * valid::int end, 6)::double as reward from s""",
)
def sparse_rewards(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("complete", F.col("value") > 90)
    out = Q.sparse_rewards(e, "user_id", "event_id", "complete")
    return out.select("event_id", "done", "positive", F.round("reward", 6).alias("reward"))


@query("unpadded_rows", "select doc_id from documents")
def unpadded_rows(spark, sf_dir):
    docs = B.number_rows(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return B.unpad(B.pad_to_divisor(docs, docs.count(), 16)).select("doc_id")


# ---- streams' results


@query("cleared_queue", "select user_id, count(*) as n from events where event_id > 500 or user_id % 2 = 1 group by 1")
def cleared_queue(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id")
    clears = e.where("user_id % 2 = 0").select("user_id").distinct().withColumn("event_id", F.lit(500).cast("bigint"))
    return ST.cleared(e, "user_id", "event_id", clears).groupBy("user_id").agg(F.count("*").alias("n"))


@query("removed_keys", "select event_id from events where user_id % 3 <> 0")
def removed_keys(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return ST.removed(e, e.where("user_id % 3 = 0"), ["user_id"]).select("event_id")


@query("queue_memory", "select event_type, count(*) as entries, sum(strlen(props))::bigint as bytes, round(avg(strlen(props)), 6) as mean_bytes from events group by 1")
def queue_memory(spark, sf_dir):
    return ST.memory_use(load(spark, sf_dir, "events"), "event_type", "props").withColumn("mean_bytes", F.round("mean_bytes", 6))


@query(
    "fed_samples",
    "with n as (select count(*) as n, count(*) + 20 as most from documents), s as (select e as epoch, e * n + row_number() over (partition by e order by doc_id) - 1 as step, doc_id as row_id from documents, range(2) t(e), n) select epoch::int as epoch, step, row_id, 'sample_' || epoch || '_' || step as sample_id, step = most as \"end\" from s, n where step <= most",
)
def fed_samples(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return ST.fed_samples(docs, 2, docs.count() + 20).select("epoch", "step", "row_id", "sample_id", "end")


@query("staleness_resets", "select r_regionkey as version, 3 + r_regionkey as stale, round(6.0, 6)::double as active_time, round(8.0, 6)::double as version_time, round(0.25, 6)::double as idle_ratio from region")
def staleness_resets(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("version"))
    events = r.select("version", F.lit(3).alias("in_flight"), F.col("version").alias("queued"), F.lit(10.0).alias("started"), F.lit(16.0).alias("idle_from"), F.lit(18.0).alias("ended"))
    return ST.staleness_resets(events, r)


@query("queue_statistics", "with q as (select user_id, least(count(*), 4) as size, count(*) as produced from events group by 1) select sum(size)::bigint as size, sum(produced)::bigint as produced, sum(produced - size)::bigint as dropped, 4 as capacity from q")
def queue_statistics(spark, sf_dir):
    held = ST.queue_result(load(spark, sf_dir, "events"), "user_id", "event_id", 4)
    queues = held.groupBy("user_id").agg(F.count("*").alias("size"), F.max("produced").alias("produced"), F.max("dropped").alias("dropped"))
    out = ST.queue_statistics(queues, {"max_queue_size": 4})
    return out.select(F.col("`monitor/queue_size`").alias("size"), F.col("`count/total_generated_samples`").alias("produced"), F.col("`count/dropped_stale_samples`").alias("dropped"), F.col("`static/max_queue_size`").alias("capacity"))


@query("fresh_rows", "select event_id, event_id // 250 as version from events where 9 - event_id // 250 <= 3")
def fresh_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", ST.version_of(F.col("event_id"), 250).alias("version"))
    return ST.fresh(e, "version", 9, 3)


class _Listener(ST.Conversation):
    """Counts characters and ends at the first text with a question mark."""

    def begin(self, key, first):
        self.heard = 0

    def answer(self, text):
        self.heard += len(text)
        return "?" in text, f"{self.heard} heard", self.heard / 10


@query(
    "interactions",
    """with s as (select conv_id, turn, text, sum(length(text)) over w as heard, coalesce(max(contains(text, '?')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as over from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, heard || ' heard' as reply, round(heard / 10.0, 6)::double as score, contains(text, '?') as done from s where over = 0""",
)
def interactions(spark, sf_dir):
    out = ST.conversations(load(spark, sf_dir, "conversations"), _Listener, "conv_id", "turn", "text")
    return out.withColumn("score", F.round("score", 6))
