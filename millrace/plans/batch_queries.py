"""Batch algebra over the test tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import batch as B
from ..operators import retrieval
from .binding import TOK, load, long, trajectories
from .catalog import query


def orders(spark, sf_dir):
    """Orders numbered densely by key."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return B.number_rows(o, "o_orderkey")


ORD = "ord as (select cast(row_number() over (order by o_orderkey) - 1 as bigint) as row_id, o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders)"


@query("proj_select_drop_rename", f"with {ORD} select row_id, o_custkey as uid, o_totalprice as score from ord")
def proj(spark, sf_dir):
    return B.rename(B.select(orders(spark, sf_dir), ["row_id", "o_custkey", "o_totalprice"]), ["o_custkey", "o_totalprice"], ["uid", "score"])


@query("proj_prefix", "select l_orderkey as orderkey, l_partkey as partkey, l_quantity as quantity from (select l_orderkey, l_partkey, l_quantity from lineitem)")
def proj_prefix(spark, sf_dir):
    return B.by_prefix(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_")


_IDX = [5, 3, 3, 0, 700, 12]


@query("gather_index_list", f"with {ORD}, idx as (select unnest({_IDX}) as r, unnest(range({len(_IDX)})) as p) select p as row_id, o_orderkey, o_totalprice from ord join idx on ord.row_id = idx.r")
def gather(spark, sf_dir):
    return B.gather(orders(spark, sf_dir), _IDX).select("row_id", "o_orderkey", "o_totalprice")


@query("slice_step", f"with {ORD} select (row_id - 10) // 7 as row_id, o_orderkey from ord where row_id >= 10 and row_id < (select count(*) from ord) - 5 and (row_id - 10) % 7 = 0")
def slice_step(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.cut(df, df.count(), 10, -5, 7).select("row_id", "o_orderkey")


@query("slice_backwards", f"with {ORD}, c as (select count(*) as n from ord) select (n - 1 - row_id) // 3 as row_id, o_orderkey from ord, c where (n - 1 - row_id) % 3 = 0")
def slice_backwards(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.cut(df, df.count(), step=-3).select("row_id", "o_orderkey")


@query("mask_filter", f"with {ORD} select row_id, o_orderkey from ord where o_orderpriority = '1-URGENT'")
def mask_filter(spark, sf_dir):
    return B.where_mask(orders(spark, sf_dir), F.col("o_orderpriority") == "1-URGENT").select("row_id", "o_orderkey")


@query("reorder_perm", f"with {ORD}, c as (select count(*) as n from ord) select n - 1 - row_id as row_id, o_orderkey from ord, c")
def reorder(spark, sf_dir):
    df = orders(spark, sf_dir)
    n = df.count()
    return B.reorder(df, df.select((n - 1 - F.col("row_id")).alias("place"), "row_id")).select("row_id", "o_orderkey")


@query("repeat_interleave", f"with {ORD} select row_id * 3 + k as row_id, o_orderkey from ord, range(3) t(k)")
def repeat_interleave(spark, sf_dir):
    return B.repeat(orders(spark, sf_dir), 3).select("row_id", "o_orderkey")


@query("repeat_tile", f"with {ORD}, c as (select count(*) as n from ord) select k * n + row_id as row_id, o_orderkey from ord, c, range(3) t(k)")
def repeat_tile(spark, sf_dir):
    return B.repeat(orders(spark, sf_dir), 3, interleave=False).select("row_id", "o_orderkey")


@query("sample_level_repeat", f"with {ORD} select row_id, cast(unnest(range(o_orderkey % 4)) as int) as copy from ord")
def sample_level_repeat(spark, sf_dir):
    return B.repeat_each(orders(spark, sf_dir).withColumn("times", F.col("o_orderkey") % 4), "times").select("row_id", "copy")


@query("unfold_chunks", f"with {ORD} select row_id * 2 + k as row_id, o_orderkey, case when k = 0 then o_custkey + o_orderkey else o_custkey * 2 + o_orderkey * 3 end as total from ord, range(2) t(k)")
def unfold_chunks(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("a", F.array("o_custkey", "o_orderkey", F.col("o_custkey") * 2, F.col("o_orderkey") * 3))
    return B.unfold_columns(df, 2, ["a"]).select("row_id", "o_orderkey", (F.col("a")[0] + F.col("a")[1]).alias("total"))


@query("fold_rows", f"with {ORD} select row_id // 10 as row_id, string_agg(o_orderkey, ',' order by row_id) as keys from ord group by 1")
def fold_rows(spark, sf_dir):
    return B.fold(orders(spark, sf_dir).select("row_id", "o_orderkey"), 10).select("row_id", F.array_join("o_orderkey", ",").alias("keys"))


@query("unfold_rows", f"with {ORD} select row_id, o_orderkey from ord")
def unfold_rows(spark, sf_dir):
    return B.unfold(B.fold(orders(spark, sf_dir).select("row_id", "o_orderkey"), 10), 10, ["o_orderkey"])


@query("pad_to_divisor", f"with {ORD}, c as (select count(*) as n from ord) select row_id, o_orderkey, false as is_pad from ord union all select n + k, o_orderkey, true from c, range(1024) t(k), ord where k < (1024 - n % 1024) % 1024 and ord.row_id = k % n")
def pad_to_divisor(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.pad_to_divisor(df, df.count(), 1024).select("row_id", "o_orderkey", "is_pad")


@query("pad_last_row", f"with {ORD}, c as (select count(*) as n from ord) select row_id, o_orderkey from ord union all select n + k, o_orderkey from c, range(5) t(k), ord where ord.row_id = n - 1")
def pad_last_row(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.pad_with(df, df.count(), 5).select("row_id", "o_orderkey")


@query("upsample_divisible", f"with {ORD}, c as (select count(*) as n from ord) select row_id, o_custkey, o_totalprice, false as is_padding from ord union all select n + k, -1, 0, true from c, range(64) t(k) where k < (64 - n % 64) % 64")
def upsample(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.upsample(df, df.count(), 64, {"o_custkey": -1, "o_totalprice": 0.0}).select("row_id", "o_custkey", "o_totalprice", "is_padding")


@query("positional_union", f"with {ORD} select row_id, o_custkey, o_totalprice, o_totalprice * 2 as twice from ord")
def positional_union(spark, sf_dir):
    df = orders(spark, sf_dir)
    left = df.select("row_id", "o_custkey", "o_totalprice")
    return B.union_columns(left, df.select("row_id", "o_totalprice", (F.col("o_totalprice") * 2).alias("twice")))


@query("union_conflict_check", f"with {ORD} select count(*) filter (o_orderkey % 5 = 0) as conflicts, count(*) as n from ord")
def union_conflict_check(spark, sf_dir):
    df = orders(spark, sf_dir)
    other = df.select("row_id", F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("theirs"))
    return df.join(other, "row_id").agg(F.count_if(~F.col("o_totalprice").eqNullSafe(F.col("theirs"))).alias("conflicts"), F.count("*").alias("n"))


@query("concat_union_all", f"with {ORD}, c as (select count(*) as n from ord) select row_id, o_orderkey, null as extra from ord union all select row_id + n, o_orderkey, 'second' from ord, c")
def concat(spark, sf_dir):
    df = orders(spark, sf_dir).select("row_id", "o_orderkey")
    n = df.count()
    return B.concat([df, df.withColumn("extra", F.lit("second"))], [n, n], allow_missing=True)


@query("chunk_equal", f"with {ORD}, c as (select count(*) as n from ord) select row_id // (n // 5) as chunk, count(*) as rows, sum(o_orderkey) as keys from ord, c group by 1")
def chunk_equal(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.chunk(df, df.count(), 5).groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("o_orderkey").cast("decimal(38,0)").alias("keys"))


@query("split_fixed", f"with {ORD} select cast(row_id // 4096 as int) as chunk, count(*) as rows from ord group by 1")
def split_fixed(spark, sf_dir):
    return B.split(orders(spark, sf_dir), 4096).groupBy("chunk").agg(F.count("*").alias("rows"))


@query("shards_drop_rest", f"with {ORD}, c as (select count(*) // 7 as s from ord) select cast(row_id // s as int) as shard, count(*) as rows, min(o_orderkey) as first from ord, c where row_id < s * 7 group by 1")
def shards(spark, sf_dir):
    df = orders(spark, sf_dir)
    return B.shards(df, df.count(), 7).groupBy("shard").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"))


@query("rank_shard", f"with {ORD} select row_id, o_orderkey from ord where row_id % 8 = 3")
def rank_shard(spark, sf_dir):
    return B.for_rank(orders(spark, sf_dir), 3, 8).select("row_id", "o_orderkey")


@query(
    "mini_batches_shuffled",
    f"""with {ORD}, e as (select epoch, row_id, cast(row_number() over (partition by epoch order by md5('7:' || epoch || ':' || row_id), row_id) - 1 as bigint) as place from ord, range(2) t(epoch)),
b as (select cast(epoch as int) as epoch, place // 1000 as batch, place, row_id, count(*) over (partition by epoch, place // 1000) as n from e) select epoch, batch, place, row_id from b where n = 1000""",
)
def mini_batches(spark, sf_dir):
    return B.batches(orders(spark, sf_dir).select("row_id"), 1000, epochs=2, seed=7).select("epoch", "batch", "place", "row_id")


@query(
    "truncate_middle",
    f"""with {TOK}, n as (select row_id, count(*) as n from tok group by 1)
select row_id, round(sum(case when n <= 5 or pos < 2 or pos >= n - 3 then reward end), 6) as total, count(*) filter (n <= 5 or pos < 2 or pos >= n - 3) as kept from tok join n using (row_id) group by 1""",
)
def truncate_middle(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("cut", A.truncate(F.col("reward"), 5, "middle"))
    return df.select("row_id", F.round(A.total(F.col("cut")), 6).alias("total"), F.size("cut").cast("bigint").alias("kept"))


@query(
    "pad_and_truncate",
    f"""with {TOK}, n as (select row_id, count(*) as n from tok group by 1)
select row_id, string_agg(coalesce(cast(cast(value as bigint) as varchar), '0'), ',' order by k) as tokens from (select n.row_id, k, t.value from n, range(6) r(k) left join tok t on t.row_id = n.row_id and t.pos = k - (6 - least(n, 6)) + case when n > 6 then 0 else 0 end) group by 1""",
)
def pad_and_truncate(spark, sf_dir):
    ids = F.transform("value", lambda v: v.cast("bigint"))
    return trajectories(spark, sf_dir).select("row_id", F.array_join(A.fit_length(ids, 6, 0, left_pad=True, truncation="right"), ",").alias("tokens"))


@query("compact_masked", f"with {TOK} select row_id, coalesce(string_agg(cast(value as bigint), ',' order by pos) filter (mask = 1), '') as kept from tok group by 1")
def compact_masked(spark, sf_dir):
    return trajectories(spark, sf_dir).select("row_id", F.array_join(F.transform(A.compact(F.col("value"), F.col("mask")), lambda v: v.cast("bigint")), ",").alias("kept"))


@query("position_ids", f"with {TOK} select row_id, pos, greatest(sum(mask) over (partition by row_id order by pos) - 1, 0) as position_id from tok")
def position_ids(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("position_id", A.position_ids(F.col("mask")))
    return df.select("row_id", F.posexplode("position_id").alias("pos", "position_id")).select("row_id", F.col("pos").cast("bigint").alias("pos"), F.col("position_id").cast("decimal(38,0)").alias("position_id"))


@query("mask_through_first", f"with {TOK}, hit as (select row_id, min(pos) filter (cast(value as bigint) in (7, 11)) as h from tok group by 1) select row_id, pos, case when h is null or pos <= h then 1 else 0 end as response_mask from tok join hit using (row_id)")
def mask_through_first(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("response_mask", A.mask_through_first(F.transform("value", lambda v: v.cast("bigint")), [7, 11]))
    return df.select("row_id", F.posexplode("response_mask").alias("pos", "response_mask")).select("row_id", F.col("pos").cast("bigint").alias("pos"), "response_mask")


@query("overlong_filter", "select doc_id, n_chars from documents where length(text) <= 2000")
def overlong_filter(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.length("text") <= 2000).select("doc_id", "n_chars")


@query("group_filter_nonconstant", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having max(o_orderpriority) > min(o_orderpriority))")
def group_filter(spark, sf_dir):
    return retrieval.mixed_groups(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey")


@query("semi_final_turn", "select conv_id, turn, role, text from conversations c where turn = (select max(turn) from conversations d where d.conv_id = c.conv_id)")
def semi_final_turn(spark, sf_dir):
    return retrieval.last_rows(load(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("anti_unlabelled", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_unlabelled(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("sampled_rows", "select o_orderkey from orders order by md5('1:' || o_orderkey) limit 500")
def sampled_rows(spark, sf_dir):
    return load(spark, sf_dir, "orders").orderBy(B.hashed(1, "o_orderkey")).limit(500).select("o_orderkey")


@query(
    "resample_weighted",
    """with w as (select o_orderkey, pow(abs(o_totalprice), 2) + 1e-8 as w from orders),
cum as (select o_orderkey, sum(w) over (order by o_orderkey) / sum(w) over () as hi from w),
bins as (select o_orderkey, coalesce(lag(hi) over (order by o_orderkey), 0) as lo, hi from cum),
draws as (select k, ('0x' || substr(md5('5:' || k), 1, 8))::bigint / 4294967296.0 as u from range(1000) t(k))
select k, o_orderkey from draws join bins on u >= lo and u < hi""",
)
def resample_weighted(spark, sf_dir):
    from ..operators.sampling import resample

    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.pow(F.abs("o_totalprice"), 2) + 1e-8).alias("w"))
    return resample(o, "o_orderkey", "w", 1000, seed=5).select("k", "o_orderkey")


@query("flatten_trajectories", f"with {TOK} select row_id, pos, uid, round(reward, 6) as reward from tok")
def flatten_trajectories(spark, sf_dir):
    return long(trajectories(spark, sf_dir), "reward", keys=("row_id", "uid"))


@query("lead_transitions", f"with {TOK}, n as (select *, lead(value) over (partition by row_id order by pos) as following from tok) select row_id, pos, value as state, following as next_state from n where following is not null")
def lead_transitions(spark, sf_dir):
    from ..operators.sequences import transitions

    long_ = long(trajectories(spark, sf_dir), "value")
    return transitions(long_, "row_id", "pos", ["value"]).select("row_id", "pos", F.col("value").alias("state"), F.col("next_value").alias("next_state"))
