"""Scorer, text and partition queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scoring as S
from ..functions import text as T
from ..operators import partition as P
from ..operators import retrieval
from ..operators import sequences as Q
from .binding import TOK, load, trajectories
from .catalog import query

_SOLVED = "s as (select o_orderkey as k, 'The total is ' || o_custkey || case when o_orderkey % 3 = 0 then ' so #### ' || (o_orderkey % 1000) || ',000' when o_orderkey % 3 = 1 then ' #### ' || (o_custkey % 10) else '' end as sol, case when o_orderkey % 2 = 0 then (o_orderkey % 1000) || '000' else cast(o_custkey % 10 as varchar) end as gt from orders)"


def _solved(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit(" so #### "), (k % 1000).cast("string"), F.lit(",000"))).when(k % 3 == 1, F.concat(F.lit(" #### "), (c % 10).cast("string"))).otherwise("")
    truth = F.when(k % 2 == 0, F.concat((k % 1000).cast("string"), F.lit("000"))).otherwise((c % 10).cast("string"))
    return load(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("The total is "), c.cast("string"), tail).alias("sol"), truth.alias("gt"))


@query("score_gsm8k_strict", f"with {_SOLVED}, a as (select k, gt, replace(list_extract(regexp_extract_all(right(sol, 300), '#### (-?[0-9.,]+)', 1), -1), ',', '') as ans from s) select k, case when ans is null then 0.0::double when ans = gt then 1.0::double else 0.1::double end as score from a")
def score_gsm8k_strict(spark, sf_dir):
    return _solved(spark, sf_dir).select("k", S.hash_score(F.col("sol"), F.col("gt"), format_score=0.1).alias("score"))


@query("score_gsm8k_flexible", f"with {_SOLVED}, a as (select k, gt, list_extract(regexp_extract_all(right(sol, 300), '(-?[0-9.,]+)', 1), -1) as ans from s) select k, case when ans = gt then 1.0::double else 0.0::double end as score from a")
def score_gsm8k_flexible(spark, sf_dir):
    return _solved(spark, sf_dir).select("k", S.hash_score(F.col("sol"), F.col("gt"), flexible=True).alias("score"))


@query("score_math_strip", r"""select o_orderkey as k, case when o_orderkey % 4 = 0 then 1.0::double when o_orderkey % 4 = 1 then 1.0::double when o_orderkey % 4 = 2 then 1.0::double else 0.0::double end as score from orders""")
def score_math_strip(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (k % 9 + 1).cast("string")
    solution = (
        F.when(k % 4 == 0, F.concat(F.lit("so \\boxed{\\frac1"), n, F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit("x = \\boxed{1/"), n, F.lit("} units")))
        .when(k % 4 == 2, F.concat(F.lit("\\boxed{ \\dfrac{1}{"), n, F.lit("}}")))
        .otherwise(F.concat(F.lit("\\boxed{\\frac{1}{"), n, F.lit("")))
    )
    truth = F.concat(F.lit("\\frac{1}{"), n, F.lit("}"))
    return load(spark, sf_dir, "orders").select(k.alias("k"), S.boxed_score(solution, truth).alias("score"))


@query("score_dapo", "select o_orderkey as k, case when o_orderkey % 3 < 2 then 1.0::double else -1.0::double end as score, case o_orderkey % 3 when 2 then '[INVALID]' else cast(o_custkey as varchar) end as pred from orders")
def score_dapo(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    solution = F.when(k % 3 == 0, F.concat(F.lit("Thus\nAnswer: $"), c, F.lit("$"))).when(k % 3 == 1, F.concat(F.lit("ANSWER : x = "), c, F.lit(" dollars"))).otherwise(F.lit("no idea"))
    s = S.boxed_or_answer(solution, c)
    return load(spark, sf_dir, "orders").select(k.alias("k"), s["score"].alias("score"), s["pred"].alias("pred"))


_PART = "p as (select p_partkey as k, '<answer> The ' || upper(p_name) || '. </answer>' as sol, case when p_partkey % 2 = 0 then p_name else p_brand end as g from part)"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("<answer> The "), F.upper("p_name"), F.lit(". </answer>")).alias("sol"), F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).alias("g"))


_TAG = "trim(regexp_extract(sol, '(?s)<answer>(.*?)</answer>', 1))"


@query("score_em", f"with {_PART} select k, case when {_NORM.format(_TAG)} = {_NORM.format('g')} then 1.0::double else 0.0::double end as score from p")
def score_em(spark, sf_dir):
    return _answers(spark, sf_dir).select("k", S.question_score(F.col("sol"), F.col("g")).alias("score"))


@query("score_subem", f"with {_PART} select k, case when contains({_NORM.format(_TAG)}, {_NORM.format('g')}) then 1.0::double else 0.0::double end as score from p")
def score_subem(spark, sf_dir):
    return _answers(spark, sf_dir).select("k", S.question_score(F.col("sol"), F.col("g"), part=True).alias("score"))


@query("format_reward", "select o_orderkey as k, case when o_orderkey % 3 = 0 then 1.0::double else 0.0::double end as score from orders")
def format_reward(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit("<think>a\nb</think> so \\boxed{3}")).when(k % 3 == 1, F.lit("<think>a</think> 3")).otherwise(F.lit("x <think>a</think>\\boxed{3}"))
    return load(spark, sf_dir, "orders").select(k.alias("k"), S.think_format(text).alias("score"))


@query(
    "multiset_jaccard",
    """with t as (select p_partkey as k, string_split(p_name, ' ') as a, string_split(p_type, ' ') || [p_name[1:3], p_name[1:3]] as b from part),
u as (select k, a, b, list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda v: least(len(list_filter(a, lambda w: w = v)), len(list_filter(b, lambda w: w = v))))) as s from t)
select k, round(case when list_sort(a) = list_sort(b) then 1 else coalesce(s, 0) / (len(a) + len(b) - coalesce(s, 0)) end, 6) as score from u""",
)
def multiset_jaccard(spark, sf_dir):
    head = F.substring("p_name", 1, 3)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(A.multiset_jaccard(F.split("p_name", " "), F.concat(F.split("p_type", " "), F.array(head, head))), 6).alias("score"))


@query("overlong_penalty", "select doc_id, round(least(-(n_chars - 1500) / 500.0 * 1.0, 0.0) + 0.0, 6) as penalty from documents")
def overlong(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(S.overlong_penalty(F.col("n_chars"), 2000, 500, 1.0) + 0.0, 6).alias("penalty"))


@query("score_at_last_token", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as n from tok) select row_id, pos, case when pos = n - 1 then 1.5 else 0.0 end::double as reward from n")
def score_at_last(spark, sf_dir):
    df = trajectories(spark, sf_dir).select("row_id", F.posexplode(S.score_at_last(F.lit(1.5), F.col("mask"))).alias("pos", "reward"))
    return df.select("row_id", F.col("pos").cast("bigint").alias("pos"), "reward")


@query("numbers_equal", "select o_orderkey as k, o_orderkey % 4 <> 3 as same from orders")
def numbers_equal(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k.cast("string")
    p = F.when(k % 4 == 0, F.concat(n, F.lit("/2"))).when(k % 4 == 1, F.concat(F.lit("("), n, F.lit(", 1+1)"))).when(k % 4 == 2, F.concat(n, F.lit("%"))).otherwise(F.concat(n, F.lit("+1000")))
    r = F.when(k % 4 == 0, (k / 2).cast("string")).when(k % 4 == 1, F.concat(F.lit("("), n, F.lit(",2)"))).otherwise(n)
    return load(spark, sf_dir, "orders").select(k.alias("k"), S.numbers_equal(p, r).alias("same"))


@query("test_case_status", "select o_orderkey as k, case o_orderkey % 6 when 0 then -1 when 1 then -4 when 2 then -3 when 3 then -2 when 4 then 1 else 0 end as status from orders")
def test_case_status(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    status = S.test_status(F.when(k == 0, "down"), F.lit(200), F.when(k == 1, "Error").otherwise("Finished"), F.when(k == 2, "TimeLimitExceeded").when(k == 3, "Error").otherwise("Finished"), F.when(k == 4, "x\n").otherwise("y"), F.lit("x"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), status.alias("status"))


@query("compile_error_spreads", "select event_id, case when bool_or(value > 95) over (partition by user_id order by event_id rows unbounded preceding) then -4 else 1 end as status from events")
def compile_error_spreads(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") > 95, -4).otherwise(1))
    return S.spread_compile_errors(e, "user_id", "event_id", "status").select("event_id", "status")


# ---- text


@query(
    "parse_tool_calls",
    """with t as (select event_id as k, event_type, props, event_id % 3 as m from events)
select k, case when m = 0 then 1 when m = 1 then 2 else 0 end as n, case when m < 2 then event_type end as name, case when m = 2 then 'hi <tool_call>oops</tool_call>'.replace('<tool_call>oops</tool_call>', '') else 'hi ' end as content from t""",
)
def parse_tool_calls(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}</tool_call>"))
    m = F.col("event_id") % 3
    text = F.concat(F.lit("hi "), F.when(m == 0, call).when(m == 1, F.concat(call, call)).otherwise("<tool_call>oops</tool_call>"))
    calls = T.tool_calls(text)
    return e.select(F.col("event_id").alias("k"), F.size(calls).alias("n"), F.get(calls, F.lit(0))["name"].alias("name"), T.without_calls(text).alias("content"))


@query("tool_call_table", "select event_id as k, c as call_no, event_type as name from events, range(2) t(c)")
def tool_call_table(spark, sf_dir):
    """The table function over every event."""
    e = load(spark, sf_dir, "events")
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("event_type"), F.lit('", "arguments": {}}</tool_call>'))
    e.select("event_id", F.concat(call, F.lit(" x "), call).alias("t")).createOrReplaceTempView("calls_of_events")
    spark.udtf.register("parse_tool_calls", T.ParseToolCalls)
    return spark.sql("select event_id as k, cast(p.call_no as bigint) as call_no, p.name from calls_of_events, lateral parse_tool_calls(t) p")


@query("media_placeholder_split", "select p_partkey as k, 3 + (p_partkey % 2) as n, 1 + (p_partkey % 2) as media from part")
def media_placeholder_split(spark, sf_dir):
    k = F.col("p_partkey")
    content = F.concat(F.lit("see <image> and"), F.when(k % 2 == 1, "<video>").otherwise(""))
    parts = T.split_placeholders(content)
    return load(spark, sf_dir, "part").select(k.alias("k"), F.size(parts).cast("bigint").alias("n"), F.size(F.filter(parts, lambda p: p["type"] != "text")).cast("bigint").alias("media"))


@query("render_chat", "select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) || '<|im_start|>assistant' || chr(10) as prompt from conversations group by 1")
def render_chat(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", T.render_chat(F.col("m"), generation=True).alias("prompt"))


@query("last_assistant_turn", "select conv_id, max_by(text, turn) filter (role = 'assistant') as answer, case when bool_or(role = 'tool') then 1 else 0 end as tool_reward from conversations group by 1")
def last_assistant_turn(spark, sf_dir):
    return retrieval.last_answers(load(spark, sf_dir, "conversations"))


@query("tool_response_clip", "select doc_id, case when length(text) > 200 then left(text, 100) || '...(truncated)...' || right(text, 100) else text end as clipped from documents")
def tool_response_clip(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.clip_response(F.col("text"), 200).alias("clipped"))


@query(
    "topk_cosine",
    """with q as (select vec_id as q, embedding::float[64] as e from embeddings where vec_id % 100 = 0), s as (select q, v.vec_id, round(list_cosine_similarity(q.e::double[], v.embedding::double[]), 6) as s from q, embeddings v where v.vec_id <> q.q)
select q, vec_id, s as similarity from (select *, row_number() over (partition by q order by s desc, vec_id) as r from s) where r <= 5""",
)
def topk_cosine(spark, sf_dir):
    """The five nearest vectors of each hundredth one; a stated query set against all rows."""
    e = load(spark, sf_dir, "embeddings")
    out = retrieval.nearest(e, e.where("vec_id % 100 = 0"), 5)
    return out.select(F.col("query").alias("q"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query("mask_regex_json", "select event_id, regexp_replace(props, '[0-9]+', '*', 'g') as masked from events")
def mask_regex_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", T.mask_text(F.col("props"), ["[0-9]+"]).alias("masked"))


@query("sanitize_metric_key", "select distinct regexp_replace(regexp_replace(replace(source || '//best@' || lang || '!', '@', '_at_'), '/+', '/', 'g'), '[^/A-Za-z0-9_.\\- :]', '_', 'g') as key from documents")
def sanitize_metric_key(spark, sf_dir):
    key = F.concat("source", F.lit("//best@"), "lang", F.lit("!"))
    return load(spark, sf_dir, "documents").select(T.sanitize_key(key).alias("key")).distinct()


# ---- runs and partitions


@query(
    "run_counter",
    "with c as (select event_id, user_id % 3 as v, case when lag(user_id % 3) over (order by event_id) = user_id % 3 then 0 else 1 end as ch from events), r as (select *, sum(ch) over (order by event_id) as run from c) select event_id, row_number() over (partition by run order by event_id) - 1 as rollout_n from r",
)
def run_counter(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("v"))
    return Q.run_counter(e, "v", "event_id").select("event_id", "rollout_n")


@query("first_complete_mask", "select event_id, case when coalesce(max(case when value > 80 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 0 then 1 else 0 end as mask from events")
def first_complete_mask(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("complete", F.col("value") > 80)
    return Q.first_complete_mask(e, "user_id", "event_id", "complete").select("event_id", "mask")


@query("workload", "select doc_id, 24576 * n_chars + n_chars * n_chars as workload from documents")
def workload(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", P.workload(F.col("n_chars")).alias("workload"))


def _batches(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")


@query("kk_partition", "select doc_id // 64 as batch, count(*) as rows, sum(n_chars) as total, least(8, count(*)) as parts from documents group by 1")
def kk_partition(spark, sf_dir):
    """Every row is in one part, no part is empty, and all of them together have the batch's sum."""
    parts = P.balance(_batches(spark, sf_dir), "batch", "n_chars", 8)
    return parts.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n_chars").cast("decimal(38,0)").alias("total"), F.countDistinct("part").alias("parts"))


@query("kk_partition_equal", "select doc_id // 64 as batch, 8 as part, count(*) // 8 as rows from documents group by 1 having count(*) = 64")
def kk_partition_equal(spark, sf_dir):
    full = _batches(spark, sf_dir)
    whole = full.groupBy("batch").count().where("count = 64").select("batch")
    parts = P.balance(full.join(whole, "batch", "left_semi"), "batch", "n_chars", 8, equal=True)
    sizes = parts.groupBy("batch", "part").agg(F.count("*").alias("n"))
    return sizes.groupBy("batch").agg(F.count("*").cast("int").alias("part"), F.max("n").alias("rows"))


@query("greedy_partition", "select doc_id // 64 as batch, count(*) as rows, sum(n_chars) as total from documents group by 1")
def greedy_partition(spark, sf_dir):
    parts = P.balance(_batches(spark, sf_dir), "batch", "n_chars", 4, method="least_loaded")
    return parts.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n_chars").cast("decimal(38,0)").alias("total"))


@query("micro_batch_order", "with l as (select doc_id % 9 as part, sum(n_chars) as load from documents group by 1), r as (select *, row_number() over (order by load desc, part) - 1 as r from l) select part, cast(case when r % 2 = 0 then 4 - r // 2 else 5 + r // 2 end as int) as place from r")
def micro_batch_order(spark, sf_dir):
    loads = load(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 9).alias("part")).agg(F.sum("n_chars").alias("load"))
    return P.order_parts(loads).select("part", "place")
