"""Sources, builders, streams' batch results and relational breadth, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import builders as D
from ..operators import rewards as R
from ..operators import lexical, retrieval, staging
from ..operators.ordered import number_rows
from ..sources import readers, sinks
from ..sources.metric_sink import read_metrics, write_metrics
from ..sources.range_stream import read_rows_once
from ..streaming import stateful as ST
from .batch_queries import ORD, orders
from .binding import TOK, load, trajectories
from .catalog import query


@query("scan_count", "select count(*) as n from lineitem")
def scan_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("scan_parquet_multi", "select 0 as file_no, count(*) as n from documents union all select 1, count(*) from labels")
def scan_parquet_multi(spark, sf_dir):
    files = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("documents", "labels")]
    return readers.read_many(spark, files).groupBy("file_no").agg(F.count("*").alias("n"))


@query("scan_pruned", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_returnflag = 'R'")
def scan_pruned(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1996-01-01' and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("json_roundtrip", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_roundtrip(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    again = e.select(F.to_json(F.struct("event_id", F.col("p.k").alias("k"))).alias("line"))
    return again.select(F.from_json("line", "event_id bigint, k bigint").alias("x")).select("x.*")


@query("generator_source", "select row_number() over (order by doc_id) - 1 as row_id, 'p' || (row_number() over (order by doc_id) - 1) as prompt, doc_id from documents")
def generator_source(spark, sf_dir):
    """A generated prompt for each document, in their order."""
    docs = number_rows(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    spark.dataSource.register(readers.GeneratorSource)
    return spark.read.format("prompt_generator").option("rows", docs.count()).option("prefix", "p").load().join(docs, "row_id")


@query("document_stream", "select doc_id, length(text) as n, (row_number() over (order by doc_id) - 1) // 70 as batch_no from documents")
def document_stream(spark, sf_dir):
    """All documents as a stream of ranges of 70 rows, stopped after the first and started again."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return read_rows_once(spark, docs, "doc_id", staging.folder(spark, "stream"), 70).select("doc_id", "n", "batch_no")


@query("metrics_written", "select cast(ts as date) as step, event_type as key, round(sum(value), 4) as value, count(*) as n, 2 as targets from events group by 1, 2")
def metrics_written(spark, sf_dir):
    """Metrics of all events written to two targets and read back from both, of which a job that is run again replaces itself."""
    e = load(spark, sf_dir, "events")
    metrics = e.groupBy(F.to_date("ts").alias("step"), F.col("event_type").alias("key")).agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))
    root = staging.folder(spark, "metrics")
    targets = [f"{root}/log.jsonl", f"{root}/table"]
    for _ in range(2):
        write_metrics(metrics, targets, "first")
    log, table = (read_metrics(metrics, t).drop("job") for t in targets)
    return log.unionByName(table).groupBy("step", "key", "value", "n").agg(F.count("*").cast("int").alias("targets"))


@query("limit_then_filter", "with f as (select * from documents order by doc_id limit 500) select doc_id, length(text) as n from f where length(text) <= 1500")
def limit_then_filter(spark, sf_dir):
    options = readers.ReadOptions(prompt_key="text", limit=500, max_prompt_length=1500, length=F.length)
    out = readers.load_prompts(spark, [f"{sf_dir.rstrip('/')}/documents.parquet"], options, ["doc_id"])
    return out.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("last_generation", "select max_by(event_id, event_id) as gen_step from events where user_id = 7")
def last_generation(spark, sf_dir):
    index = load(spark, sf_dir, "events").select(F.col("user_id").alias("train_step"), F.col("event_id").alias("gen_step"), F.col("event_id").alias("line_no"))
    return readers.last_generation(index, 7)


@query("metric_long_table", "select event_type as step, 'total' as key, round(sum(value), 4) as value from events group by 1 union all select event_type, 'n', count(*) from events group by 1")
def metric_long_table(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").cast("double").alias("n"))
    return sinks.metric_rows(e)


@query("validation_table", "with s as (select user_id as step, event_id, value, row_number() over (partition by user_id order by event_id) as n from events) select step, max(event_id) filter (n = 1) as first_input, max(event_id) filter (n = 2) as second_input, max(value) filter (n = 2) as second_score from s group by 1")
def validation_table(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("step"), F.row_number().over(w).alias("sample"), F.col("event_id").alias("input"), F.col("event_type").alias("output"), F.col("value").alias("score"))
    wide = sinks.wide_samples(e.where("sample <= 2"), 2)
    return wide.select("step", F.col("1_input").alias("first_input"), F.col("2_input").alias("second_input"), F.col("2_score").alias("second_score"))


# ---- builders


@query("build_prompt_rows", "select o_orderkey as index, 'orders' as data_source, 'What is the total of order ' || o_orderkey || '?' as content, cast(o_custkey as varchar) as ground_truth, 'train' as split from orders")
def build_prompt_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rows = D.prompt_rows(o, "orders", F.concat(F.lit("What is the total of order "), F.col("o_orderkey").cast("string"), F.lit("?")), F.col("o_custkey").cast("string"), F.col("o_orderkey"), "train")
    return rows.select(F.col("extra_info.index").alias("index"), "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"))


@query("build_sft_unpivot", "with p as (select source, min(doc_id) filter (quality = 1) as chosen, min(doc_id) filter (quality = 0) as rejected from documents join labels using (doc_id) group by 1) select source, which, case when which = 0 then chosen else rejected end as response from p, (values (0), (1)) t(which)")
def build_sft_unpivot(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    p = d.groupBy("source").agg(F.min(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("chosen"), F.min(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("rejected"))
    return D.unpivot_preferences(p).select("source", "which", "response")


@query("split_positional_75_25", f"with {ORD}, c as (select count(*) as n from ord) select case when row_id < cast(floor(n * 0.75) as bigint) then 'train' else 'test' end as split, count(*) as n from ord, c group by 1")
def split_positional(spark, sf_dir):
    df = orders(spark, sf_dir)
    return D.positional_split(df, df.count()).groupBy("split").agg(F.count("*").alias("n"))


@query("split_hash_90_10", "select o_orderkey, case when ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::bigint % 10 < 1 then 'test' else 'train' end as split from orders")
def split_hash(spark, sf_dir):
    return D.hash_split(load(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("oversample_replicate", "select p_partkey, copy from part, (select unnest([1, 2, 3]) as copy)")
def oversample(spark, sf_dir):
    return D.oversample(load(spark, sf_dir, "part"), 3).select("p_partkey", "copy")


@query("nested_patch_struct", "select o_orderkey as index, true as need_tools_kwargs, cast(o_custkey as varchar) as truth from orders")
def nested_patch(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rows = D.prompt_rows(o, "orders", F.lit("q"), F.col("o_custkey").cast("string"), F.col("o_orderkey"), "train")
    rows = D.patch_info(rows, need_tools_kwargs=F.lit(True), tools_kwargs=D.tools_kwargs("code_interpreter", F.col("reward_model.ground_truth")))
    return rows.select(F.col("extra_info.index").alias("index"), F.col("extra_info.need_tools_kwargs").alias("need_tools_kwargs"), F.col("extra_info.tools_kwargs.code_interpreter.create_kwargs.ground_truth").alias("truth"))


@query("place_right_answer", "select p_partkey, cast(('0x' || substr(md5('0:' || p_partkey), 1, 8))::bigint % 4 as int) as place from part")
def place_right_answer(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    choices, at = D.place_answer(F.array("p_brand", "p_type", F.lit("none")), F.lit("right"), "p_partkey")
    return p.select("p_partkey", (F.array_position(choices, "right") - 1).cast("int").alias("place"))


@query(
    "stratified_split",
    """with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::bigint, o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, case when o_custkey % 10 = 0 then 'ood' when r <= least(floor(n * 0.8), 40) then 'train' when r <= least(floor(n * 0.8), 40) + 1 then 'id_test' else 'unused' end as split from r""",
)
def stratified_split(spark, sf_dir):
    return D.stratified_split(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_custkey") % 10 == 0, tests=1).select("o_orderkey", "split")


@query("bin_lookup", "with b as (select n_nationkey as task, n_nationkey + 1 as trials, sum(n_nationkey + 1) over (order by n_nationkey) as high from nation) select e.event_id, b.task, e.event_id - (high - trials) as offset from events e join b on e.event_id >= high - trials and e.event_id < high")
def bin_lookup(spark, sf_dir):
    trials = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), (F.col("n_nationkey") + 1).alias("trials"))
    return D.lookup_bins(load(spark, sf_dir, "events").select("event_id"), D.task_offsets(trials), "event_id").select("event_id", "task", "offset")


@query("reward_overlong_manager", f"with {TOK}, n as (select row_id, sum(mask) as n from tok group by 1) select row_id, round(case when n > 0 then 1 + least(-(n - 4) / 4.0 * 0.5, 0) else 0 end + 0.0, 6) as reward, n > 4 as overlong from n")
def reward_overlong(spark, sf_dir):
    out = R.manager("dapo")(trajectories(spark, sf_dir), F.lit(1.0), 8, 4, 0.5)
    return out.select("row_id", F.round(F.aggregate("reward_tensor", F.lit(0.0), lambda a, v: a + v) + 0.0, 6).alias("reward"), "overlong")


# ---- streams' results


@query("queue_drop_oldest_final", "with r as (select *, row_number() over (partition by event_type order by event_id desc) as r, count(*) over (partition by event_type) as n from events) select event_type, event_id, n as produced, greatest(n - 100, 0) as dropped from r where r <= 100")
def queue_final(spark, sf_dir):
    return ST.queue_result(load(spark, sf_dir, "events"), "event_type", "event_id", 100).select("event_type", "event_id", "produced", "dropped")


@query("count_window_agg", "with r as (select *, (row_number() over (partition by event_type order by event_id) - 1) // 50 as w from events) select event_type, w as window, round(sum(value), 4) as total from r group by 1, 2 having count(*) = 50")
def count_window_agg(spark, sf_dir):
    return ST.count_windows(load(spark, sf_dir, "events"), "event_type", "event_id", 50, F.round(F.sum("value"), 4).alias("total"))


@query("ring_pool_last_n", "with r as (select *, row_number() over (partition by user_id, value > 50 order by event_id desc) as r from events) select user_id, value > 50 as positive, event_id from r where r <= 5")
def ring_pool(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("positive", F.col("value") > 50)
    return ST.ring_pools(e, ["user_id", "positive"], "event_id", 5).select("user_id", "positive", "event_id")


@query("keyed_upsert_latest", "select user_id, event_type, max(event_id) as event_id from events group by 1, 2")
def keyed_upsert(spark, sf_dir):
    return ST.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("barrier_ready_groups", "with s as (select event_id, event_id // 20 as g, case when value > 97 then 'running' when value > 20 then 'success' else 'failed' end as status from events) select event_id from s where status = 'success' and g not in (select g from s where status = 'running')")
def barrier(spark, sf_dir):
    status = F.when(F.col("value") > 97, "running").when(F.col("value") > 20, "success").otherwise("failed")
    e = load(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 20).alias("g"), status.alias("status"))
    return ST.ready_groups(e, "g", "status").select("event_id")


@query("stale_filter", "select event_id from events where 20 - event_id // 500 <= 3")
def stale_filter(spark, sf_dir):
    return ST.fresh(load(spark, sf_dir, "events").withColumn("version", F.floor(F.col("event_id") / 500)), "version", 20, 3).select("event_id")


@query("event_tumbling", "select epoch(time_bucket(interval '1 hour', ts))::bigint as start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def event_tumbling(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n", "total")


@query("event_sliding", "with w as (select event_id, value, epoch(time_bucket(interval '30 minutes', ts))::bigint - k * 1800 as start from events, range(2) t(k)) select start, count(*) as n from w group by 1")
def event_sliding(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n")


@query(
    "event_session",
    "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '1 hour' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g) select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, s",
)
def event_session(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n")


@query("dedup_first", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def dedup_first(spark, sf_dir):
    return retrieval.first_by(load(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


# ---- relational breadth


@query("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def join_left(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_full", "select coalesce(d.doc_id, p.page_id) as id, d.doc_id is not null as is_doc, p.page_id is not null as is_page from documents d full join (select page_id + 900 as page_id from pages) p on d.doc_id = p.page_id")
def join_full(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select((F.col("page_id") + 900).alias("page_id"))
    d = load(spark, sf_dir, "documents").select("doc_id")
    return d.join(p, F.col("doc_id") == F.col("page_id"), "full").select(F.coalesce("doc_id", "page_id").alias("id"), F.col("doc_id").isNotNull().alias("is_doc"), F.col("page_id").isNotNull().alias("is_page"))


@query("join_as_of", "select e.event_id, max(f.event_id) as earlier from events e left join events f on f.user_id = e.user_id and f.event_type = 'purchase' and f.event_id < e.event_id where e.event_type = 'click' group by 1")
def join_as_of(spark, sf_dir):
    kind = F.col("event_type")
    return retrieval.as_of(load(spark, sf_dir, "events"), "user_id", "event_id", kind == "click", kind == "purchase", F.col("event_id"), "earlier").select("event_id", "earlier")


@query("agg_cube", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_rollup", "select n_regionkey, n_nationkey, count(*) as n from nation join customer on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)")
def agg_rollup(spark, sf_dir):
    c = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("grouping_sets", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by grouping sets ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupingSets([[F.col("o_orderpriority")], [F.col("o_orderstatus")], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("set_intersect", "select doc_id from documents intersect select page_id from pages")
def set_intersect(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").intersect(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")))


@query("set_except", "select doc_id from documents except select doc_id from labels")
def set_except(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").exceptAll(load(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("window_frames", "select o_orderkey, rank() over w as rank, dense_rank() over w as dense, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 4) as moving from orders window w as (partition by o_custkey order by o_orderpriority)")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    byp = w.orderBy("o_orderpriority")
    moving = F.sum("o_totalprice").over(w.orderBy("o_orderkey").rowsBetween(-2, 0))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(byp).alias("rank"), F.dense_rank().over(byp).alias("dense"), F.round(moving, 4).alias("moving"))


@query("top_k_per_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("approx_distinct", "select true as close")
def approx_distinct(spark, sf_dir):
    """Whether the approximate count is within a tenth of the exact one.

    A sketch doesn't change with repeats, so both are of the distinct keys: beside an exact count, a sketch would be held for each key.
    """
    counts = load(spark, sf_dir, "lineitem").select("l_partkey").distinct().agg(F.approx_count_distinct("l_partkey").alias("approx"), F.count("l_partkey").alias("exact"))
    return counts.select((F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(
    "retrieved_documents",
    f"""with d as (select doc_id, {_WORDS} as words from documents), s as (select doc_id, words, len(words) as length from d where len(words) > 0),
m as (select count(*) as n, sum(length) / count(*) as mean from s), t as (select doc_id, term, count(*)::double as tf from (select doc_id, unnest(words) as term from s) group by all),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_WORDS}) as term from benchmark) group by all),
w as (select term, round(1000 * ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)))::bigint as weight from t, m group by term, n),
r as (select item_id, doc_id as doc, sum(times * weight * round(1000000 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))::bigint)::bigint as score from q join w using (term) join t using (term) join s using (doc_id), m where weight > 0 group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc)::int as rank, doc, score from r qualify row_number() over (partition by item_id order by score desc, doc) <= 10""",
)
def retrieved_documents(spark, sf_dir):
    """The ten documents of all that rank highest for each benchmark item."""
    index, n = lexical.build_index(load(spark, sf_dir, "documents"), "doc_id", "text", 64)
    return lexical.search(index, n, load(spark, sf_dir, "benchmark"), "item_id", "text", 10)
