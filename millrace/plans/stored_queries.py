"""What is written and read again, controllers, managers and helpers, over the given tables."""

from __future__ import annotations

from pathlib import Path
from tempfile import TemporaryDirectory

import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scoring as S
from ..operators import advantage as adv
from ..operators import batch as B
from ..operators import builders as D
from ..operators import losses, staging
from ..operators import rewards as W
from ..operators import rollout as R
from ..sources import readers, sinks
from ..streaming import stateful as ST
from .binding import TOK, load, long, trajectories
from .catalog import query


@query(
    "kl_controller_runs",
    """with recursive d as (select event_type as kind, dense_rank() over (partition by event_type order by cast(ts as date)) as step, avg(value) / 100 as kl, count(*) as n from events group by event_type, cast(ts as date)),
r(kind, step, value) as (select kind, 0::bigint, 0.1::double from (select distinct kind from d) union all
    select r.kind, d.step, r.value * (1 + greatest(-0.2, least(0.2, d.kl / 0.4 - 1)) * d.n / 5000) from r join d on d.kind = r.kind and d.step = r.step + 1)
select kind, step, round(value, 6) as adaptive, 0.1::double as fixed from r where step > 0""",
)
def kl_controller_runs(spark, sf_dir):
    """Both controllers' coefficients after each day of each type of events, which stands for the measured divergence."""
    days = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg((F.avg("value") / 100).alias("kl"), F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        both = [adv.kl_controller(kind, 0.1, target=0.4, horizon=5000) for kind in ("adaptive", "fixed")]
        out = []
        for step, (kl, n) in enumerate(rows.sort_values("day")[["kl", "n"]].itertuples(index=False), 1):
            for controller in both:
                controller.update(kl, n)
            out.append((rows["kind"].iloc[0], step, both[0].value, both[1].value))
        return pd.DataFrame(out, columns=["kind", "step", "adaptive", "fixed"])

    found = days.groupBy("kind").applyInPandas(run, "kind string, step bigint, adaptive double, fixed double")
    return found.select("kind", "step", F.round("adaptive", 6).alias("adaptive"), "fixed")


@query("valid_means", "select event_type, round(sum(value * (event_id % 3 > 0)::int) / greatest(sum((event_id % 3 > 0)::int), 1), 6) as mean, round(sum(value * (value > 1e9)::int) / greatest(sum((value > 1e9)::int), 1), 6) as none from events group by 1")
def valid_means(spark, sf_dir):
    """Means over valid entries, and over none."""
    e = load(spark, sf_dir, "events")
    means = [losses.valid_mean(F.col("value"), valid.cast("int")) for valid in (F.col("event_id") % 3 > 0, F.col("value") > 1e9)]
    return e.groupBy("event_type").agg(*[F.round(m, 6).alias(name) for m, name in zip(means, ("mean", "none"), strict=True)])


@query("generations_dumped", "select event_type as input, props as output, user_id::varchar as gts, round(value + 1, 6) as score, user_id % 5 as step, event_id as id from events")
def generations_dumped(spark, sf_dir):
    """All events as generations, dumped as JSON lines by step and read again."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("input"), F.col("props").alias("output"), F.col("user_id").cast("string").alias("ground_truth"), F.array("value", F.lit(1.0)).alias("token_level_scores"), (F.col("user_id") % 5).alias("step"), F.col("event_id").alias("id"))
    path = staging.folder(spark, "generations")
    sinks.dump_generations(sinks.generation_rows(e, ["id"]), path)
    back = spark.read.schema("input string, output string, gts string, score double, id bigint, step bigint").json(path)
    return back.withColumn("score", F.round("score", 6))


@query("generations_stored", "select event_id, event_id % 3 as gen_step, case when event_id % 3 = 1 then 'first' else 'last' end as found_by from events where event_id % 3 > 0")
def generations_stored(spark, sf_dir):
    """Batches stored by generation step, of which an index tells the last of each training step."""
    e, path = load(spark, sf_dir, "events").select("event_id"), staging.folder(spark, "stored")
    for train_step, gen_step in ((1, 0), (1, 1), (2, 2)):
        sinks.dump_generation_batch(e.where(F.col("event_id") % 3 == gen_step), path, train_step, gen_step)
    first, last = (readers.stored_generation(spark, path, step) for step in (1, 2))
    assert readers.stored_generation(spark, path, 3) is None
    return first.withColumn("found_by", F.lit("first")).unionByName(last.withColumn("found_by", F.lit("last"))).select("event_id", F.col("gen_step").cast("bigint").alias("gen_step"), "found_by")


@query("pools_saved", "select event_id, event_type, good from (select *, value > 50 as good, row_number() over (partition by event_type, value > 50 order by event_id desc) as r from events) where r <= 25")
def pools_saved(spark, sf_dir):
    """Ring pools of all events, saved and loaded."""
    e, path = load(spark, sf_dir, "events").withColumn("good", F.col("value") > 50), staging.folder(spark, "pools")
    sinks.save_pools(ST.ring_pools(e, ["event_type", "good"], "event_id", 25), path)
    return readers.load_pools(spark, path).select("event_id", "event_type", "good")


@query(
    "pools_resampled",
    """with e as (select event_id as seq, user_id % 4 as task, value > 50 as positive, event_id % 2 as batch_no from events where user_id % 4 < 3),
p as (select b, seq, task from (select b, e.*, row_number() over (partition by b, task, positive order by seq desc) as r from e, range(2) t(b) where batch_no <= b) where r <= 30),
o as (select b, seq, task, row_number() over (partition by b, task order by md5('7:' || b || ':' || seq), seq) as r from p),
n as (select batch_no as b, count(*) as n from e group by 1)
select b as batch_no, seq, task from (select o.*, n, row_number() over (partition by b order by r, task) as place from o join n using (b)) where place <= n""",
)
def pools_resampled(spark, sf_dir):
    """Two batches of events enter the pools, the second twice; as many rows are drawn as came, as far as the pools have them."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("task"), (F.col("value") > 50).alias("positive"))
    path = staging.folder(spark, "resampled")
    put = ST.pool_resampler(path, [0, 1, 2], 30, 7)
    for number in (0, 1, 1):
        put(e.where(F.col("seq") % 2 == number), number)
    return spark.read.parquet(f"{path}/drawn").select(F.col("batch_no").cast("bigint").alias("batch_no"), "seq", "task")


@query("live_table", "select doc_id, text as prompt from documents where length(text) <= 900 and doc_id % 2 = 0 union all select doc_id, text || ' more' from documents where length(text) <= 895 and doc_id % 2 = 1")
def live_table(spark, sf_dir):
    """Documents appended to a live table: half of them as they are, half by a generator after each of two batches, one of which comes twice."""
    docs, path = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt")), staging.folder(spark, "live")
    readers.append_rows(docs.where("doc_id % 2 = 0"), f"{path}/rows", "prompt", 900, F.length)
    put = readers.batch_appender(lambda batch: batch.withColumn("prompt", F.concat("prompt", F.lit(" more"))), f"{path}/generated", most=900, length=F.length)
    for number, which in ((0, 1), (1, 3), (1, 3)):
        put(docs.where(F.col("doc_id") % 4 == which), number)
    return spark.read.parquet(f"{path}/rows").unionByName(spark.read.parquet(f"{path}/generated").drop("batch_no"))


@query("limited_rewards", "select p_partkey as k, case when contains(p_name, 'bolt') then 0.0 else length(p_name)::double end as reward, contains(p_name, 'bolt') as failed from part")
def limited_rewards(spark, sf_dir):
    """An outside scorer behind token buckets, asked again when it fails; some requests fail for good."""

    def call(text: str) -> float:
        if "bolt" in text:
            raise W.ClientError(text)
        return float(len(text))

    out = W.rate_limited(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), W.retrying(call), "p_name", 6e9, 6e9)
    return out.drop("p_name")


@query("visual_rewards", "select vec_id, round(embedding[1]::double + embedding[2]::double, 6) as score, 1 as steps, round(embedding[1]::double + embedding[2]::double, 6) as first from embeddings")
def visual_rewards(spark, sf_dir):
    """One reward a row, at its only step, of a score of each embedding."""
    e = load(spark, sf_dir, "embeddings")
    out = W.visual(e, F.get("embedding", F.lit(0)).cast("double") + F.get("embedding", F.lit(1)).cast("double"))
    return out.select("vec_id", F.round("score", 6).alias("score"), F.size("reward_tensor").alias("steps"), F.round(F.get("reward_tensor", F.lit(0)), 6).alias("first"))


@query("custom_scores", "select p_partkey as k, case when p_name = 'red ' || p_type then 1.0 when contains(p_name, 'red') then 0.5 else 0.0 end::double as score from part")
def custom_scores(spark, sf_dir):
    """A scorer from a file, with an option filled in."""
    with TemporaryDirectory() as folder:
        path = Path(folder, "scorer.py")
        path.write_text("from pyspark.sql import functions as F\n\n\ndef score(solution, truth, part):\n    return F.when(solution == F.concat(F.lit('red '), truth), 1.0).when(solution.contains('red'), part).otherwise(0.0)\n")
        scorer = S.load_scorer(str(path), "score", part=0.5)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scorer(F.col("p_name"), F.col("p_type")).cast("double").alias("score"))


@query("shifted_responses", f"with {TOK}, n as (select *, count(*) over (partition by row_id) as n from tok) select row_id, pos - greatest(n // 2, 1) + 1 as pos, round(value, 6) as value from n where pos >= greatest(n // 2, 1) - 1 and pos < n - 1")
def shifted_responses(spark, sf_dir):
    """The values that predict the second half of each row."""
    n = F.size("value")
    prompt = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    return long(trajectories(spark, sf_dir).withColumn("value", A.shifted_response(F.col("value"), prompt, F.greatest(n - prompt, F.lit(0)))), "value")


@query("chat_of_items", "select item_id, 'user,assistant' as roles, text || '|' || length(text) as said from benchmark")
def chat_of_items(spark, sf_dir):
    """Question and answer as two messages."""
    b = load(spark, sf_dir, "benchmark").withColumn("m", D.chat_rows(F.col("text"), F.length("text").cast("string")))
    return b.select("item_id", F.array_join("m.role", ",").alias("roles"), F.array_join("m.content", "|").alias("said"))


@query("padded_documents", "select doc_id, text, false as is_padding from documents union all select 0, 'none', true from range((select (8 - count(*) % 8) % 8 from documents))")
def padded_documents(spark, sf_dir):
    """All documents and as many rows that train nothing as make eights of them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    empty = R.padding_row(docs, {"text": F.lit("none")})
    missing = -docs.count() % 8
    return docs.withColumn("is_padding", F.lit(False)).unionByName(empty.withColumn("n_", F.explode(F.array_repeat(F.lit(1), missing))).drop("n_"))


@query("columns_of_rows", "select p_brand, string_agg(p_name, ';' order by p_partkey) as names, max(p_size) as largest from part group by 1")
def columns_of_rows(spark, sf_dir):
    """The rows of each brand as columns and back."""

    def turned(rows: pd.DataFrame) -> pd.DataFrame:
        columns = B.as_columns(rows.sort_values("p_partkey").to_dict("records"), ["p_partkey", "p_brand", "p_name", "p_size"])
        return pd.DataFrame({"p_brand": columns["p_brand"][:1], "names": [";".join(columns["p_name"])], "largest": [max(columns["p_size"])]})

    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size").groupBy("p_brand").applyInPandas(turned, "p_brand string, names string, largest int")


@query("pauses", "select user_id, count(*) >= 5 or count(*) filter (value > 90) >= 3 as pause from events group by 1")
def pauses(spark, sf_dir):
    """Whether generation would wait, with each user's events as queue and the large ones as stale."""

    @F.pandas_udf("boolean")
    def decide(queued: pd.Series, stale: pd.Series) -> pd.Series:
        return pd.Series([R.should_pause(q, 5, s, ST.admission_limit(2, 0.5, 1)) for q, s in zip(queued, stale, strict=True)])

    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("queued"), F.count_if(F.col("value") > 90).alias("stale"))
    return e.select("user_id", decide("queued", "stale").alias("pause"))
