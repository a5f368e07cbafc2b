"""Metric queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics as M
from .binding import ROWS, TOK, load, trajectories
from .catalog import query


def _r(name: str, alias: str | None = None):
    return F.round(F.col(f"`{name}`").cast("double") + 0.0, 6).alias(alias or name.replace("/", "_"))


_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


@query(
    "agg_loss_modes",
    f"""with {TOK}, per as (select row_id, sum(reward * mask) as s, sum(mask) as n, count(*) as w from tok group by 1),
a as (select sum(s) as s, sum(n) as n, count(*) filter (n > 0) as rows, max(w) as w, sum(case when n > 0 then s / (n + 1e-8) else 0 end) as mm, sum(case when n > 0 then s else 0 end) as ss from per)
select 'token-mean' as mode, round(s / n, 6) as loss from a union all select 'seq-mean-token-sum', round(ss / rows, 6) from a
union all select 'seq-mean-token-sum-norm', round(ss / rows / w, 6) from a union all select 'seq-mean-token-mean', round(mm / rows, 6) from a""",
)
def agg_loss_modes(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    out = None
    for mode in _MODES:
        one = M.agg_loss(df, "reward", "mask", mode).select(F.lit(mode).alias("mode"), _r("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "data_metrics",
    f"""with {TOK}, per as (select row_id, sum(reward) as score, sum(mask) as len, count(*) as t from tok group by 1),
k as (select reward, value, reward - value as diff from tok where mask = 1)
select round(avg(score), 6) as score_mean, round(max(score), 6) as score_max, round(min(score), 6) as score_min, round(avg(len), 6) as response_length_mean, round(max(len), 6) as response_length_max,
round(avg(case when len = 13 then 1.0 else 0 end), 6) as response_length_clip_ratio, round(avg(case when len = 0 then 1.0 else 0 end), 6) as response_aborted_ratio,
round(avg(score) filter (len > 0), 6) as score_non_aborted_mean, round(avg(t), 6) as prompt_length_mean,
(select round(avg(reward), 6) from k) as returns_mean, (select round(max(value), 6) from k) as value_max,
(select round(1 - var_samp(diff) / (var_samp(reward) + 1e-5), 6) from k) as explained_variance from per""",
)
def data_metrics(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    df = df.withColumn("score", F.col("reward")).withColumn("advantages", F.col("reward")).withColumn("returns", F.col("reward")).withColumn("prompt_length", F.size("reward"))
    names = ["score/mean", "score/max", "score/min", "response_length/mean", "response_length/max", "response_length/clip_ratio", "response/aborted_ratio", "score_non_aborted/mean", "prompt_length/mean", "returns/mean", "value/max", "explained_variance"]
    return M.data_metrics(df, 13).select(*[_r(n) for n in names])


@query(
    "timing_metrics",
    f"""with {TOK}, t as (select sum(mask) as r, count(*) as n from tok), s(key, seconds) as (values ('gen', 12.0::double), ('ref', 3.0::double), ('adv', 1.5::double), ('other', 9.0::double))
select key, round(seconds, 6) as timing_s, round(seconds * 1000 / case when key = 'gen' then r else n end, 6) as per_token_ms from s, t where key <> 'other'""",
)
def timing_metrics(spark, sf_dir):
    tokens = trajectories(spark, sf_dir).agg(F.sum(A.count_on(F.col("mask"))).alias("response_tokens"), F.sum(F.size("mask")).alias("all_tokens"))
    timings = spark.createDataFrame([("gen", 12.0), ("ref", 3.0), ("adv", 1.5), ("other", 9.0)], "key string, seconds double")
    return M.timing_per_token(timings, tokens).select("key", _r("timing_s"), _r("per_token_ms"))


@query("throughput", f"with {TOK} select count(*) as tokens, round(count(*) / (7.5 * 8), 6) as per_gpu from tok")
def throughput(spark, sf_dir):
    t = trajectories(spark, sf_dir).agg(F.sum(F.size("mask")).cast("bigint").alias("tokens"))
    return t.select("tokens", F.round(M.throughput(F.col("tokens"), F.lit(7.5), 8), 6).alias("per_gpu"))


@query(
    "variance_proxy",
    f"""with {TOK}, per as (select row_id, sum(reward * mask) / (sum(mask) + 1e-8) as a, sum((1 - 2 * exp(old_logp) + pi2) * mask) as w from tok group by 1),
x as (select 4.0 as p1, avg(a * a * w) as p2, count(*) as n, avg(a * a) as ea, avg(w) as ew from per)
select round(p1::double, 6) as proxy1_signal_strength, round(p2, 6) as proxy2_total_power, round(greatest((p2 - p1) / (n - 1), 0), 6) as proxy3_pure_noise, round(ea, 6) as expected_a_squared, round(ew, 6) as expected_w from x""",
)
def variance_proxy(spark, sf_dir):
    out = M.variance_proxy(trajectories(spark, sf_dir).withColumn("advantages", F.col("reward")), 2.0)
    return out.select(*[_r(c) for c in out.columns])


_EVENTS = "ev as (select event_id, (event_id // 100) as win, case event_type when 'click' then 'timing_s/click' when 'view' then 'view_max' when 'purchase' then 'training/global_step' else event_type || '/mean' end as key, value, event_id % 7 as samples from events)"


def _metric_rows(spark, sf_dir):
    key = F.when(F.col("event_type") == "click", "timing_s/click").when(F.col("event_type") == "view", "view_max").when(F.col("event_type") == "purchase", "training/global_step").otherwise(F.concat("event_type", F.lit("/mean")))
    return load(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("window"), key.alias("key"), "value", (F.col("event_id") % 7).alias("samples"), F.col("event_id").alias("step"))


@query("reduce_by_name", f"with {_EVENTS} select key, round(case when key like '%max%' then max(value) when key like '%min%' then min(value) else avg(value) end, 6) as value from ev group by key")
def reduce_by_name(spark, sf_dir):
    return M.reduce_by_name(_metric_rows(spark, sf_dir)).select("key", _r("value"))


@query(
    "window_aggregator",
    f"with {_EVENTS} select win as window, key, round(case when key like 'timing_s/%' then sum(value) when key = 'training/global_step' then max_by(value, event_id) when key like '%mean%' then avg(value) when key like '%max%' then max(value) else avg(value) end, 6) as value from ev group by 1, 2",
)
def window_aggregator(spark, sf_dir):
    return M.aggregate_window(_metric_rows(spark, sf_dir)).select("window", "key", _r("value"))


@query("metric_ranks", "with s as (select event_id // 8 as step, avg(value) as v from events group by 1) select round(sum(v), 6) as value from s")
def metric_ranks(spark, sf_dir):
    df = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("step"), "value")
    return M.aggregate_ranks(df, "sum").select(_r("value"))


_VAL = "val as (select o_orderpriority as source, o_custkey as uid, o_totalprice as value, o_orderstatus as pred, row_number() over (partition by o_orderpriority, o_custkey order by o_orderkey) - 1 as pos from orders)"


def _validation(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderkey")
    return load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("pred"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"))


@query("val_mean_std", f"with {_VAL} select source, uid, count(*) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from val group by 1, 2")
def val_mean_std(spark, sf_dir):
    return M.val_mean_std(_validation(spark, sf_dir), ("source", "uid")).select("source", "uid", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("val_mean_of_means", f"with {_VAL}, m as (select source, uid, avg(value) as m from val group by 1, 2) select source, round(avg(m), 4) as mean from m group by 1")
def val_mean_of_means(spark, sf_dir):
    return M.val_mean_std(_validation(spark, sf_dir), ("source", "uid")).groupBy("source").agg(F.round(F.avg("mean"), 4).alias("mean"))


@query(
    "val_best_worst_maj",
    f"""with {_VAL}, sizes as (select source, uid, count(*) as n from val group by 1, 2),
ks as (select distinct n, k from (select n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda x: x < n), n)) as k from sizes where n > 1)),
draws as (select n, k, b, j, (('0x' || substr(md5('42:' || k || ':' || b || ':' || j), 1, 8))::bigint) % n as pos from ks, range(1000) tb(b), range((select max(n) from sizes)) tj(j) where j < k),
drawn as (select s.source, s.uid, d.n, d.k, d.b, d.j, f.value as v, f.pred as p from sizes s join draws d on d.n = s.n join val f on f.source = s.source and f.uid = s.uid and f.pos = d.pos),
votes as (select source, uid, n, k, b, p, count(*) as c, min(j) as first, min_by(v, j) as pv, max(v) as high, min(v) as low from drawn group by all),
samples as (select source, uid, n, k, b, max(high) as best, min(low) as worst, arg_max(pv, c * 1000 - first) as maj from votes group by all)
select source, uid, n, k, round(avg(best) / 7.0710678, 2) as best_mean, round(avg(worst) / 7.0710678, 2) as worst_mean, round(avg(maj) / 7.0710678, 2) as maj_mean, round(stddev_pop(best) / 7.0710678, 2) as best_std from samples group by all""",
)
def val_best_worst_maj(spark, sf_dir):
    out = M.bootstrap(_validation(spark, sf_dir), ("source", "uid"), "value", "pred", draws=1000)
    return out.select("source", "uid", "n", "k", *[F.round(F.col(c) / 7.0710678, 2).alias(c) for c in ("best_mean", "worst_mean", "maj_mean", "best_std")])


@query("majority_vote", f"with {_VAL}, v as (select source, uid, pred, count(*) as c, min(pos) as f, min_by(value, pos) as v from val group by all) select source, uid, arg_max(v, c * 1000 - f) as value from v group by all")
def majority_vote(spark, sf_dir):
    return M.majority(_validation(spark, sf_dir), ("source", "uid"), "pred", "value")


@query(
    "val_core_aux",
    """with m(source, var, metric) as (values ('a', 'acc', 'mean@4'), ('a', 'acc', 'best@2/mean'), ('a', 'acc', 'best@4/mean'), ('a', 'acc', 'std@4'), ('a', 'reward', 'mean@4'), ('b', 'reward', 'maj@8/mean'), ('b', 'len', 'mean@8'))
select source, var, metric, case when (source = 'a' and var = 'acc' and metric in ('mean@4', 'best@4/mean')) or (source = 'b' and var = 'reward') then 'val-core' else 'val-aux' end as section from m""",
)
def val_core_aux(spark, sf_dir):
    rows = [("a", "acc", "mean@4"), ("a", "acc", "best@2/mean"), ("a", "acc", "best@4/mean"), ("a", "acc", "std@4"), ("a", "reward", "mean@4"), ("b", "reward", "maj@8/mean"), ("b", "len", "mean@8")]
    return M.label_core(spark.createDataFrame(rows, "source string, var string, metric string"))


@query("percentiles_p50_p95_p99", "select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events")
def percentiles(spark, sf_dir):
    out = M.percentiles(load(spark, sf_dir, "events"), "value")
    return out.select(*[_r(c) for c in out.columns])


@query("slowest_argmax", "select arg_max(l_orderkey, l_extendedprice + l_quantity) as orderkey, max(l_quantity) as quantity_max, min(l_extendedprice) as price_min from lineitem")
def slowest_argmax(spark, sf_dir):
    out = M.slowest(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])
    return out.select(F.col("slowest.l_orderkey").alias("orderkey"), F.col("`l_quantity/max`").alias("quantity_max"), F.col("`l_extendedprice/min`").alias("price_min"))


@query("topk_ratio", "with q as (select quantile_cont(value, 0.9) as q from events) select round(min(value), 6) as min, round(max(value), 6) as max, round(avg(case when value > q then 1.0 else 0 end), 6) as share from events, q")
def topk_ratio(spark, sf_dir):
    out = M.topk_ratio(load(spark, sf_dir, "events"), "value")
    return out.select(*[_r(c) for c in out.columns])


@query("pearson_masked", f"with {TOK}, d as (select exp(old_logp) as a, exp(rollout_logp) as b from tok where mask = 1) select round(max(abs(a - b)), 6) as diff_max, round(avg(abs(a - b)), 6) as diff_mean, round(stddev_samp(abs(a - b)), 6) as diff_std, round(corr(a, b), 6) as pearson, count(*) as n from d")
def pearson_masked(spark, sf_dir):
    out = M.log_prob_debug(trajectories(spark, sf_dir))
    return out.select(*[_r(c) for c in out.columns if c != "n"], "n")


@query("zero_std_ratio", "with g as (select o_custkey, stddev_pop(case o_orderpriority when '1-URGENT' then 1.0 else 0 end) as s, count(*) as n from orders group by 1) select round(avg(case when s = 0 then 1.0 else 0 end), 6) as zero_std_ratio, round(avg(s), 6) as std_mean, round(avg(n), 6) as group_size from g")
def zero_std_ratio(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("v", (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    out = M.zero_std_ratio(o, "o_custkey", "v")
    return out.select(*[_r(c) for c in out.columns])


@query("unbalance_stats", "with c as (select doc_id % 8 as c, sum(n_chars) as s from documents group by 1) select min(s) as min, max(s) as max, max(s) - min(s) as minmax_diff, round(avg(s), 6) as mean from c")
def unbalance_stats(spark, sf_dir):
    out = M.unbalance(load(spark, sf_dir, "documents").withColumn("c", F.col("doc_id") % 8), "c", "n_chars")
    return out.select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in ("min", "max", "minmax_diff")], _r("mean"))


@query("flops_estimate", "select round((6.0 * 1e6 * sum(n_chars) + 6.0 * sum(n_chars * n_chars) * 64 * 4 * 2) / 10.0 / 1e12, 6) as tflops from documents")
def flops_estimate(spark, sf_dir):
    return M.flops(load(spark, sf_dir, "documents"), "n_chars", 1e6, 2, 4, 64, 10.0).select(_r("tflops"))


@query("token_list_diff", f"with {TOK} select row_id, count(*) filter (mask = 1 and cast(value as bigint) <> cast(reward as bigint)) as differing from tok group by 1")
def token_list_diff(spark, sf_dir):
    whole = trajectories(spark, sf_dir).withColumn("a", F.transform("value", lambda v: F.round(v, 0))).withColumn("b", F.transform("reward", lambda v: F.bround(v, 0)))
    return whole.select("row_id", M.differing_tokens(F.col("a"), F.col("b"), F.col("mask")).alias("differing"))


@query("eval_mean_by_source", "with s as (select d.source, avg(l.quality) over (partition by d.doc_id) as m from documents d join labels l using (doc_id)) select source, round(avg(m), 6) as score, count(*) as n from s group by 1")
def eval_mean_by_source(spark, sf_dir):
    """Responses are documents, their ground truth the labels: the mean of each row, then of each source."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    out = M.mean_by_source(docs.join(load(spark, sf_dir, "labels"), "doc_id"), "doc_id", "source", "quality")
    return out.select("source", F.round("score", 6).alias("score"), "n")


@query("group_rows", f"with {TOK}, {ROWS} select uid, count(*) as rows, round(sum(score), 4) as total, sum(len) as tokens from per_row group by 1")
def group_rows(spark, sf_dir):
    df = trajectories(spark, sf_dir).select("uid", A.total(F.col("reward")).alias("score"), A.count_on(F.col("mask")).alias("len"))
    return df.groupBy("uid").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 4).alias("total"), F.sum("len").cast("decimal(38,0)").alias("tokens"))
