"""Streams over whole tables, stopped and started again, and the SQL of their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state
from .binding import load
from .catalog import query


@query(
    "stream_queues",
    """with n as (select event_id as "at", user_id % 7 as k, row_number() over (partition by user_id % 7 order by event_id) as n from events)
select k, "at", n <= 40 as done, least(n, 40) as size, n as produced, greatest(n - 40, 0) as dropped from n""",
)
def stream_queues(spark, sf_dir):
    """All events put into queues of 40, of which two thirds come before the stream is stopped."""
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("k"), "event_type")
    out = state.run_in_parts(e, "event_id", 3, lambda s: state.queues(s, "k", "event_id", F.lit("put"), F.col("event_type"), 40), 2)
    return out.select(F.col("key").alias("k"), "at", "done", "size", "produced", "dropped")


@query(
    "stream_queue_reads",
    """with n as (select event_id as "at", user_id % 7 as k, event_type, row_number() over (partition by user_id % 7 order by event_id) as n from events),
p as (select k, event_type, row_number() over (partition by k order by "at") as p from n where n % 3 > 0)
select n.k, n."at", p.event_type as payload, 2 * (n.n // 3) - n.n // 3 as size, n.n // 3 as consumed from n join p on p.k = n.k and p.p = n.n // 3 where n.n % 3 = 0""",
)
def stream_queue_reads(spark, sf_dir):
    """Two events of a key are put, the third takes one out: the entries that are given out, in their order."""
    from ..operators.ordered import number_within

    e = number_within(load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("k"), "event_type"), ["k"], "event_id")
    action = F.when(F.col("place_") % 3 == 2, "get").otherwise("put")
    out = state.run_in_parts(e, "event_id", 2, lambda s: state.queues(s, "k", "event_id", action, F.col("event_type"), 1_000_000), 1)
    return out.where("action = 'get' and done").select(F.col("key").alias("k"), "at", "payload", "size", "consumed")


@query(
    "stream_replay_buffer",
    """with e as (select event_id, event_type as part, user_id % 40 as step, user_id || ':' || event_id % 2 as item, case when value < 2 then 'removed' when value < 60 then 'success' when value < 97 then 'failed' else 'running' end as status,
    case when event_id % 3 = 0 then event_id::varchar end as tags from events),
g as (select *, max(case when status = 'removed' then event_id end) over (partition by part, step, item) as gone from e),
l as (select part, step, item, arg_max(status, event_id) as status, arg_max(tags, event_id) filter (tags is not null) as tags from g where gone is null or event_id > gone group by all),
d as (select part, step from l group by all having count(*) filter (status = 'running') = 0)
select l.part, l.step, l.item, l.tags from l join d using (part, step) where l.status = 'success'""",
)
def stream_replay_buffer(spark, sf_dir):
    """All events as changes of items: what each step has given out last, if it doesn't wait."""
    value = F.col("value")
    status = F.when(value < 2, "removed").when(value < 60, "success").when(value < 97, "failed").otherwise("running")
    item = F.concat_ws(":", "user_id", F.col("event_id") % 2)
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("part"), (F.col("user_id") % 40).alias("step"), item.alias("item"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("tags"))
    out = state.run_in_parts(e, "event_id", 3, lambda s: state.replay_buffer(s, "part", "step", "event_id", "item", F.col("status"), F.col("tags")), 1, idle=False)
    last = out.groupBy("partition", "step").agg(F.max("at").alias("at"))
    return out.join(last, ["partition", "step", "at"]).where("not waits and item is not null").select(F.col("partition").alias("part"), "step", "item", "tags")


@query(
    "replay_buffer_result",
    """with e as (select event_id, event_type as part, user_id % 40 as step, user_id as item, case when value < 90 then 'success' else 'running' end as status from events),
l as (select part, step, item, arg_max(status, event_id) as status from e group by all),
d as (select part, step from l group by all having count(*) filter (status = 'running') = 0)
select l.part, l.step, l.item::varchar as item from l join d using (part, step) where l.status = 'success'""",
)
def replay_buffer_result(spark, sf_dir):
    """The same by batch, of other items."""
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("part"), (F.col("user_id") % 40).alias("step"), "user_id", F.when(F.col("value") < 90, "success").otherwise("running").alias("status"))
    out = state.replay_result(e, "part", "step", "event_id", "user_id", F.col("status"), F.lit(None).cast("string"))
    return out.select(F.col("partition").alias("part"), "step", "item")


class Weigher(state.Tool):
    """Scores each turn by its length; the reward of a session is what its turns have."""

    def create(self, key, first: str) -> str:
        return "0"

    def execute(self, held: str, text: str) -> tuple[str, str, float]:
        return str(int(held) + 1), f"turn {int(held) + 1}", float(len(text) % 7)


GAP_MS = 600_000
_TURNS = """t as (select conv_id, turn, text, conv_id % 2 = 0 and turn = 4 as ends,
    86400000 + (conv_id % 10) * 7000 + turn * 60000 + conv_id % 1000 + case when conv_id % 3 = 0 and turn >= conv_id % 5 + 2 then 2000000 else 0 end as "at" from conversations),
w as (select *, coalesce("at" - lag("at") over (partition by conv_id order by turn) > 600000 or lag(ends) over (partition by conv_id order by turn), false) as over from t),
s as (select *, max(over::int) over (partition by conv_id order by turn) = 1 as shut from w)"""


@query(
    "stream_tool_sessions",
    f"""with {_TURNS},
u as (select conv_id, max("at") as last, count(*) as n, sum(length(text) % 7)::double as reward, bool_or(ends) as ended from s where not shut group by 1)
select conv_id, case when shut then 'refused' else 'turn' end as event, "at", turn as number, case when not shut then 'turn ' || row_number() over (partition by conv_id order by turn) end as reply, case when not shut then (length(text) % 7)::double end as score from s
union all select conv_id, case when ended then 'released' else 'expired' end, case when ended then last else last + 600000 end, n, null, reward from u""",
)
def stream_tool_sessions(spark, sf_dir):
    """Conversations as tool sessions: some are released by their fifth turn, some expire between turns, later turns are refused.

    Times follow from ids, and a last row of no conversation moves the clock on.
    """
    c, k = load(spark, sf_dir, "conversations"), F.col("conv_id")
    at = 86_400_000 + (k % 10) * 7000 + F.col("turn") * 60000 + k % 1000 + F.when((k % 3 == 0) & (F.col("turn") >= k % 5 + 2), 2_000_000).otherwise(0)
    turns = c.select("conv_id", "turn", "text", ((k % 2 == 0) & (F.col("turn") == 4)).alias("ends"), at.alias("at"))
    clock = c.agg(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("").alias("text"), F.lit(True).alias("ends"), F.lit(10**9).cast("bigint").alias("at"))
    timed = turns.unionByName(clock).withColumn("ts", F.timestamp_millis("at"))
    out = state.run_in_parts(timed, "at", 3, lambda s: state.tool_sessions(s, Weigher, "conv_id", "turn", "ts", "text", F.col("ends"), GAP_MS), 1, "append")
    return out.where("key <> -1").select(F.col("key").alias("conv_id"), "event", "at", "number", "reply", "score")


@query("session_turns", f"with {_TURNS} select conv_id, turn, case when shut then 'refused' else 'turn' end as event from s")
def session_turns(spark, sf_dir):
    """Which turns a session takes, by batch."""
    k = F.col("conv_id")
    at = 86_400_000 + (k % 10) * 7000 + F.col("turn") * 60000 + k % 1000 + F.when((k % 3 == 0) & (F.col("turn") >= k % 5 + 2), 2_000_000).otherwise(0)
    c = load(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_millis(at))
    return state.session_result(c, "conv_id", "turn", "ts", (k % 2 == 0) & (F.col("turn") == 4), GAP_MS)
