"""Queries of generation, evaluation and batch layout, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scoring as S
from ..functions import text as T
from ..operators import batch as B
from ..operators import builders as D
from ..operators import metrics as M
from ..operators import retrieval
from ..operators import rollout as R
from ..streaming import stateful as ST
from .binding import TOK, load, long, trajectories
from .catalog import query
from .composed_queries import _docs, _joined, _rounded


def _echo(prompts: list[str]) -> list[str]:
    return [p.upper() for p in prompts]


@query("offline_generation", "select p_partkey as k, upper(p_name) || ';' || upper(p_name) as responses from part")
def offline_generation(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("prompt"))
    return R.offline_generation(p, _echo, 2).select(F.col("row_id").alias("k"), F.array_join("responses", ";").alias("responses"))


@query(
    "evaluated_responses",
    """with s as (select o_orderpriority as data_source, ((o_custkey % 5 = 1)::int + (o_custkey % 5 = 2)::int + (o_custkey % 5 = 0)::int) / 3.0 as m from orders)
select data_source, round(avg(m), 6) as score, count(*) as n from s group by 1""",
)
def evaluated_responses(spark, sf_dir):
    given = F.array(*[F.concat(F.lit("so #### "), F.lit(str(k))) for k in (1, 2, 0)])
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("data_source"), given.alias("responses"), (F.col("o_custkey") % 5).cast("string").alias("gt"))
    out = R.evaluate(o, lambda r: S.hash_score(r, F.col("gt")))
    return out.select("data_source", F.round("score", 6).alias("score"), "n")


@query(
    "filtered_groups",
    "with g as (select o_custkey, min(o_orderkey) as f from orders group by 1 having min(o_orderpriority) < max(o_orderpriority) order by f limit 40) select o_orderkey as row_id from orders where o_custkey in (select o_custkey from g)",
)
def filtered_groups(spark, sf_dir):
    """The groups of a training batch, whose size is given."""
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    return R.filter_groups(o, "o_custkey", "o_orderpriority", 40).select("row_id")


@query("padding_rows", "select 0::bigint as row_id, '1,2' as ids, '0,0' as mask, '' as note, true as is_padding")
def padding_rows(spark, sf_dir):
    df = spark.createDataFrame([], "row_id bigint, ids array<int>, mask array<int>, note string")
    out = R.padding_row(df, {"ids": F.array(F.lit(1), F.lit(2)), "mask": F.array(F.lit(0), F.lit(0))})
    return out.select("row_id", _joined(F.col("ids")).alias("ids"), _joined(F.col("mask")).alias("mask"), "note", "is_padding")


@query("padded_chunks", "with n as (select count(*) as n from documents), c as (select k, ceil(n / 7.0)::bigint as size from n, range(7) t(k)) select k::int as chunk, size as rows from c")
def padded_chunks(spark, sf_dir):
    docs = B.number_rows(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    out, _ = R.chunks_with_padding(docs, docs.count(), 7)
    return out.groupBy("chunk").agg(F.count("*").alias("rows"))


@query("response_blocks", f"with {TOK}, n as (select *, count(*) over (partition by row_id) as n from tok), w as (select row_id, p, coalesce(max(reward) filter (pos = p + greatest(n // 2, 1) - 1 and p < n - greatest(n // 2, 1)), 0) as reward from n, range(8) t(p) group by 1, 2) select row_id, p as pos, round(reward, 6) as reward from w")
def response_blocks(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    head = F.greatest(F.floor(F.size("reward") / 2).cast("int"), F.lit(1))
    return long(df.withColumn("reward", R.response_block(F.col("reward"), head, F.size("reward") - head, 8)), "reward")


@query("response_masks", f"with {TOK}, n as (select *, count(*) over (partition by row_id) as n from tok) select row_id, sum(case when pos >= n - least(n, 2) then mask else 0 end)::bigint as learned from n group by 1")
def response_masks(spark, sf_dir):
    mask = R.response_mask(F.col("mask"), F.least(F.size("mask"), F.lit(2)))
    return trajectories(spark, sf_dir).select("row_id", A.count_on(mask).cast("bigint").alias("learned"))


@query("left_aligned", f"with {TOK}, n as (select *, sum(mask) over (partition by row_id) as m, count(*) over (partition by row_id) as n, sum(mask) over (partition by row_id order by pos) as k from tok), v as (select row_id, n - m + k - 1 as pos, reward from n where mask = 1), z as (select row_id, pos, 0.0 as reward from n where pos < n - m) select row_id, pos::bigint as pos, round(reward, 6) as reward from (select * from v union all select * from z)")
def left_aligned(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    return long(df.withColumn("reward", R.left_aligned(F.col("reward"), F.col("mask"), 0.0)), "reward")


@query(
    "loop_outputs",
    """with p as (select p_partkey as k, list_transform(range(p_size % 4 + 1), lambda x: 7) as r from part)
select k, array_to_string([0, 5, 6] || r || list_transform(range(6 - len(r)), lambda x: 0), ',') as ids, array_to_string([0, 1, 1] || list_transform(r, lambda x: 1) || list_transform(range(6 - len(r)), lambda x: 0), ',') as attention,
array_to_string([0] || list_transform(r[2:], lambda x: 1) || list_transform(range(6 - len(r)), lambda x: 0), ',') as mask from p""",
)
def loop_outputs(spark, sf_dir):
    n = (F.col("p_size") % 4 + 1).cast("int")
    r = F.array_repeat(F.lit(7), n)
    mask = F.transform(r, lambda _, k: F.when(k == 0, 0).otherwise(1))
    out = R.loop_output(F.array(F.lit(5), F.lit(6)), r, mask, F.array_repeat(F.lit(-0.5), n), 3, 6, 0)
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), out.alias("o"))
    return p.select("k", _joined(F.col("o.ids")).alias("ids"), _joined(F.col("o.attention")).alias("attention"), _joined(F.col("o.mask")).alias("mask"))


@query("penalised_rewards", f"with {TOK} select row_id, pos, round(reward - 0.3 * (old_logp - rollout_logp) + 0.0, 6) as reward from tok")
def penalised_rewards(spark, sf_dir):
    df = trajectories(spark, sf_dir)
    return long(df.withColumn("reward", R.penalised_rewards(F.col("reward"), F.col("old_logp"), F.col("rollout_logp"), 0.3)), "reward")


@query("image_timing", "select p_partkey as k, round(p_size * 1000.0 / (p_partkey % 5 + 1), 6)::double as ms_per_image, round((p_partkey % 5 + 1) / (p_size * 4.0), 6)::double as images_per_gpu from part")
def image_timing(spark, sf_dir):
    out = R.image_timing(F.col("p_size"), F.col("p_partkey") % 5 + 1, 4)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(out["ms_per_image"], 6).alias("ms_per_image"), F.round(out["images_per_gpu"], 6).alias("images_per_gpu"))


@query("rank_orders", "select doc_id // 64 as batch, 8 as parts, 8::bigint as rows, true as bowl from documents group by 1 having count(*) = 64")
def rank_orders(spark, sf_dir):
    """Eight equal parts a batch, in each of which workloads rise to the middle and fall again."""
    docs = _docs(spark, sf_dir)
    whole = docs.groupBy("batch").count().where("count = 64").select("batch")
    out = R.rank_order(docs.join(whole, "batch", "left_semi"), "batch", "n_chars", 8)
    per = out.groupBy("batch", "part").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("place", "n_chars"))).alias("s"))
    first, second = F.transform(F.slice("s", 1, 4), lambda x: x["n_chars"]), F.transform(F.slice("s", 5, 4), lambda x: x["n_chars"])
    bowl = (first == F.sort_array(first)) & (second == F.sort_array(second, asc=False))
    return per.groupBy("batch").agg(F.count("*").cast("int").alias("parts"), F.max("rows").alias("rows"), F.min(bowl.cast("int")).alias("b")).select("batch", "parts", "rows", (F.col("b") == 1).alias("bowl"))


@query("pause_decisions", "select * from (values (4, 2, true), (1, 9, true), (1, 2, false)) t(queued, stale, pause)")
def pause_decisions(spark, sf_dir):
    rows = [(q, s, R.should_pause(q, 4, s, ST.admission_limit(4, 0.5, 1))) for q, s in ((4, 2), (1, 9), (1, 2))]
    return spark.createDataFrame(rows, "queued int, stale int, pause boolean")


@query("valid_blocks", "select event_type, case when value > 50 then 'positive' else 'negative' end as kind, count(*) as n from events where event_id % 3 <> 0 group by 1, 2")
def valid_blocks(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("valid", F.col("event_id") % 3 != 0).withColumn("good", F.col("value") > 50)
    return R.valid_blocks(e, "valid", "good").groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@query("searched_rows", """select p_partkey as k, 'searchR1_' || p_brand as data_source, case when p_partkey % 2 = 0 then p_name when p_partkey % 3 = 0 then p_type else '' end as truth, case when p_partkey % 2 = 0 then p_name when p_partkey % 3 = 0 then p_type else '' end as tool_truth from part""")
def searched_rows(spark, sf_dir):
    k = F.col("p_partkey")
    out = R.searched_rows(load(spark, sf_dir, "part"), F.col("p_brand"), F.when(k % 2 == 0, F.array("p_name")), F.when(k % 3 == 0, F.array("p_type")))
    return out.select(k.alias("k"), "data_source", F.array_join("ground_truth", ";").alias("truth"), F.array_join("tools_kwargs.search.create_kwargs.ground_truth", ";").alias("tool_truth"))


@query("choice_rows", "select p_partkey as k, p_name || ' ' || upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) as query, p_type || ';x' as choices, p_size % 4 as gold from part where p_partkey % 3 <> 0")
def choice_rows(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise((F.col("p_size") % 4).cast("string"))
    out = R.choice_rows(load(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), F.array("p_type", F.lit("x")), label)
    return out.select(F.col("p_partkey").alias("k"), "query", F.array_join("choices", ";").alias("choices"), F.col("gold").cast("int").alias("gold"))


@query("media_prompt_rows", "select p_partkey as k, 'geo' as data_source, p_name as question, p_brand as truth, p_brand as tool_truth, length(p_name)::int as bytes from part")
def media_prompt_rows(spark, sf_dir):
    """Prompt rows that carry images as binary arrays, and their tool's arguments."""
    extra = {"tools_kwargs": D.tools_kwargs("calc", F.col("p_brand")), "images": F.array(F.col("p_name").cast("binary"))}
    out = D.prompt_rows(load(spark, sf_dir, "part"), "geo", F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), "train", extra=extra)
    info = "extra_info"
    return out.select(
        F.col(f"{info}.index").alias("k"), "data_source", F.col("prompt")[0]["content"].alias("question"), F.col("reward_model.ground_truth").alias("truth"),
        F.col(f"{info}.tools_kwargs.calc.create_kwargs.ground_truth").alias("tool_truth"), F.octet_length(F.col(f"{info}.images")[0]).alias("bytes"),
    )


@query("renamed_roles", "select conv_id, turn, case role when 'user' then 'user' else 'assistant' end as role from conversations where role in ('user', 'assistant')")
def renamed_roles(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    raw = F.array(F.struct(F.when(F.col("role") == "user", "human").otherwise("gpt").alias("role"), F.col("text").alias("content")))
    return c.select("conv_id", "turn", D.rename_roles(raw)[0]["role"].alias("role"))


@query("tool_turns", "select conv_id, max_by(text, turn) filter (role = 'tool') as answer, coalesce(max((role = 'tool')::int), 0) as reward from conversations group by 1")
def tool_turns(spark, sf_dir):
    """The last text of a tool in each conversation; its presence is the reward."""
    return retrieval.last_answers(load(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") == "tool", "assistant").otherwise("other")), role="said").join(
        load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max((F.col("role") == "tool").cast("int")).alias("reward")), "conv_id"
    ).select("conv_id", "answer", "reward")


@query("retrieved_passages", "select p_partkey as k, 'Doc 1 (Title: ' || p_name || ')' || chr(10) || p_type || chr(10) || '---' || chr(10) || 'Doc 1 (Title: ' || p_brand || ')' || chr(10) || 'x' as passages from part")
def retrieved_passages(spark, sf_dir):
    """Passages of two queries, with a line between them."""
    one, two = F.array(F.concat("p_name", F.lit("\n"), "p_type")), F.array(F.concat("p_brand", F.lit("\nx")))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.array(T.passages(one), T.passages(two)), "\n---\n").alias("passages"))


@query("batch_sizes", "select count(*) as rows, 2 as columns from region")
def batch_sizes(spark, sf_dir):
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    assert "r_name" in B.schema_text(r) and B.byte_size(r) > 0
    return spark.createDataFrame([(B.row_count(r), len(r.columns))], "rows bigint, columns int")


@query("diffusion_groups", "with g as (select o_custkey, stddev_pop(round(o_totalprice / 1e5, 0)) as s, count(*) as n from orders group by 1) select round(avg((s = 0)::int), 6) as zero_std_ratio, round(avg(n), 6) as group_size from g")
def diffusion_groups(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1e5, 0))
    return _rounded(M.zero_std_ratio(o, "o_custkey", "v").select("zero_std_ratio", "group_size"))
