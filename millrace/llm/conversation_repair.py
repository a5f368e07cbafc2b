"""Conversation structure repair: cheapest edits on a lattice of turns and grammar states, found by Dijkstra.

The roles of a repaired conversation begin like ``(s?(ua)+)?``. A node of the lattice is (rows read, state of that grammar),
and edges are edits: keep, rerole, delete and insert. The priority key is (cost, audit), the audit being the initials of the
edits, so that of equally cheap repairs the one with the least audit comes first.

Rows of a conversation come to one task in order, as its text has one hash, and pass through it as a stream: what is held are
``SEGMENT`` rows, the audit, and for each of four states a hash of what its cheapest path has written. Nothing else grows with
a conversation, of whatever length.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
RIGHT_PAIRS = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
#: What has been written so far: nothing, the system row, a user row last, an assistant row last. Where each can go.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (NOTHING, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows of one conversation that are searched together.
SEGMENT = 4096


def cheapest(rows: list[tuple[str, bool, bool]], sources: dict[int, tuple[int, str]], last: bool = True) -> dict[int, tuple[int, str, int]]:
    """The cheapest ends of a lattice over ``rows`` of (role initial, must go, truncated): {state: (cost, audit, source state)}.

    ``sources`` are the states before the first row with their cost and audit. If these are the ``last`` rows, the search
    stops at the first accepting end; otherwise at the fourth end, as the rows that follow may need any.
    """
    heap = [(cost, audit, 0, state, state) for state, (cost, audit) in sources.items()]
    heapq.heapify(heap)
    settled, ends = set(), {}
    while heap:
        cost, audit, at, state, source = heapq.heappop(heap)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(rows):
            if not last or state in ACCEPTING:
                ends[state] = (cost, audit, source)
            if len(ends) == (1 if last else 4):
                break
        written = [to for to in NEXT[state].values() if to in ROLE]
        for to in written:
            heapq.heappush(heap, (cost + COST[INSERT], audit + INSERT, at, to, source))
        if at == len(rows):
            continue
        initial, must_go, truncated = rows[at]
        heapq.heappush(heap, (cost + COST[DELETE], audit + DELETE, at + 1, state, source))
        if must_go:
            continue
        cost += TRUNCATED * truncated
        if initial in NEXT[state]:
            heapq.heappush(heap, (cost, audit + KEEP, at + 1, NEXT[state][initial], source))
        for to in written:
            heapq.heappush(heap, (cost + COST[REROLE], audit + REROLE, at + 1, to, source))
    return ends


def apply_edits(rows: Iterable, audit: str, state: int = NOTHING) -> Iterator[tuple[str, str]]:
    """The (role, text) that an audit makes of rows that begin with role and text; it starts in a grammar state."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)[:2]
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = NEXT[state][role[:1]]
        else:
            state = next(to for to in NEXT[state].values() if to in ROLE)
            role = ROLE[state]
        yield role, text


class _Conversation:
    """Faults, cheapest paths and hashes of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.before, self.turns = conv_id, [], None, None
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.audit, self.paths, self.hashes = [], {NOTHING: (0, "")}, {NOTHING: hashlib.sha256()}

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """The next row; ``seen`` tells of an equal one with an earlier turn, one with the same turn comes just before."""
        if len(self.rows) == SEGMENT:
            self.search(False)
        if turn is not None:
            first, latest, distinct = self.turns or (turn, None, 0)
            self.turns = (first, turn, distinct + (turn != latest))
        held = text.rstrip(BLANKS)
        duplicate = seen or self.before == (turn, role, text)
        fault = "blank" if not held else "duplicate" if duplicate else "truncated" if held[-1] not in ENDS else None
        if fault:
            self.counts[fault] += 1
        if self.before and self.before[1][:1] + role[:1] not in RIGHT_PAIRS:
            self.counts["illegal"] += 1
        self.before = (turn, role, text)
        self.rows.append((role, text, fault))

    def search(self, last: bool) -> None:
        """Follow the paths through the rows that are held, and let go of them."""
        lattice = [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, _, fault in self.rows]
        paths, hashes = {}, {}
        for state, (cost, audit, source) in cheapest(lattice, self.paths, last).items():
            written, begun = self.hashes[source].copy(), source != NOTHING
            for role, text in apply_edits(self.rows, audit[len(self.paths[source][1]) :], source):
                written.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True
            paths[state], hashes[state] = (cost, audit), written
        shared = os.path.commonprefix([audit for _, audit in paths.values()])
        self.audit.append(shared)
        self.paths = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in paths.items()}
        self.hashes, self.rows = hashes, []

    def result(self) -> tuple:
        if self.turns:
            first, latest, distinct = self.turns
            self.counts["gaps"] = latest - first + 1 - distinct
        self.search(True)
        ((state, (cost, _)),) = self.paths.items()
        return self.conv_id, *self.counts.values(), cost, "".join(self.audit), self.hashes[state].hexdigest()


def damage(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the damage that the contract lays down, plus ``dropped``.

    By crc32(``conv_id:turn``) % 20 a row is dropped (0: it stays as a mark without role and text), loses its text (1) or its
    marks of ends (2), comes twice (3) or becomes the user's (4). Nulls in ids count as one space there, and in role and text
    become one. Other columns are not looked at.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text, way = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("way")
    read = df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("way"))
    changed = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    damaged = read.select("conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (way == 0).alias("dropped"), copies.alias("copy"))
    return damaged.select("conv_id", "turn", *[F.when(~F.col("dropped"), F.col(c)).alias(c) for c in ("role", "text")], "dropped")


def ordered(df: DataFrame) -> DataFrame:
    """Rows with all of a conversation in one partition, in order (turn, role, text; nulls first), and ``seen``: whether
    an equal role and text has an earlier turn.

    The one shuffle is by conv_id. Both sorts and the window spill to disk.
    """
    names = ["conv_id", "turn", "role", "text"]
    dropped = F.col("dropped") if "dropped" in df.columns else F.lit(False)
    rows = df.select(*names, dropped.alias("dropped")).repartition("conv_id")
    rows = rows.withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    rows = rows.withColumn("seen", F.expr("min(place) over (partition by conv_id, dropped, role, text)") < F.col("place")).drop("place")
    return rows.sortWithinPartitions(*[F.asc_nulls_first(c) for c in names])


def edit_scripts(df: DataFrame) -> DataFrame:
    """A row a conversation: counts of its faults, the cost and audit of its cheapest repair, the hash of the repaired rows.

    Takes (conv_id, turn, role, text) and, if there is one, ``dropped``, which marks rows that only tell of a conversation.
    Null ids are one conversation; null turns come first; null roles and texts count as one space; equal rows are kept apart,
    all but the first being duplicates; rows of one turn go by role and text. A conversation without rows has no faults, no
    edits and the hash of the empty text. A role's initial is its first character, '' has none and fits nowhere. An empty
    table gives no rows; other columns are not looked at.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    filled = df.withColumns({c: F.when(~F.col("dropped") if "dropped" in df.columns else F.lit(True), F.coalesce(c, F.lit(" "))) for c in ("role", "text")})
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        done: list[tuple] = []
        for conv_id, rows in groupby(_rows(batches, types), key=lambda r: r[0]):
            conversation = _Conversation(conv_id)
            for _, turn, role, text, dropped, seen in rows:
                if not dropped:
                    conversation.add(turn, role, text, seen)
            done.append(conversation.result())
            if len(done) == 1000 or len(done[-1][7]) > SEGMENT:
                yield _batch(done, names, types)
                done = []
        if done:
            yield _batch(done, names, types)

    longs = ", ".join(f"{c} bigint" for c in names[1:7])
    return ordered(filled).mapInArrow(repaired, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def _rows(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[tuple]:
    for batch in batches:
        types[:] = [batch.schema.field(0).type]
        for at in range(0, batch.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True)


def _batch(done: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    kinds = [types[0], *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def repaired_rows(df: DataFrame, scripts: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows that the audits of ``edit_scripts`` make of the same table, in order from 0.

    The scripts travel with the rows, one to a conversation, in front of its first row; conversations without a script or
    with nothing left have no rows.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    dropped = F.col("dropped") if "dropped" in df.columns else F.lit(False)
    rows = df.where(~dropped).select("conv_id", F.lit(1).alias("part"), "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    first = scripts.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    together = first.union(rows).repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "part", "turn", "role", "text")])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        out: list[tuple] = []
        for conv_id, rows in groupby(_rows(batches, types), key=lambda r: r[0]):
            head = next(rows)
            if head[1]:
                continue
            for position, (role, text) in enumerate(apply_edits((r[3:5] for r in rows), head[4])):
                out.append((conv_id, position, role, text))
                if len(out) == 1000:
                    yield packed(out, types)
                    out = []
        if out:
            yield packed(out, types)

    def packed(out: list[tuple], types: list) -> pa.RecordBatch:
        kinds = [types[0], pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "position", "role", "text"])

    return together.mapInArrow(edited, f"conv_id {kind}, position bigint, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edit_scripts`` of all ``conversations`` after ``damage``; nulls, repeated rows and empty tables as stated there."""
    return edit_scripts(damage(table(spark, sf_dir, "conversations")))


def oracle_sql() -> str:
    """The contract in DuckDB SQL: keys 'cost, then audit' for the four states, walked row by row."""

    def more(key: str, cost: str, edit: str) -> str:
        return f"lpad(cast(cast(left({key}, 12) as bigint) + {cost} as varchar), 12, '0') || substr({key}, 13) || '{edit}'"

    close = f"least(k2, {more('k0', '3', 'I')}, {more('k1', '3', 'I')}, {more('k3', '3', 'I')})"
    kept = lambda key, initial: f"case when not f.must_go and f.initial = '{initial}' then {more(key, 'f.cut', 'K')} end"
    reroled = lambda key: f"case when not f.must_go then {more(key, '3 + f.cut', 'R')} end"
    gone = lambda key: more(key, "4", "D")
    return rf"""
with recursive bits(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from bits where k < 8),
crc(steps) as (select list(c order by i) from bits where k = 8),
read as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
ways as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: cast(unicode(x) as bigint))),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 20 as way from read, crc),
damaged as (select conv_id, turn, case way when 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from ways, range(2) c(copy) where way <> 0 and (copy = 0 or way = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as held from damaged),
judged as (select *, case when held = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
        when right(held, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from numbered),
faults as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id),
lattice as (select conv_id, i, left(role, 1) as initial, fault in ('blank', 'duplicate') as must_go, case fault when 'truncated' then 3 else 0 end as cut from judged),
walk(conv_id, i, k0, k1, k2, k3) as (
    select conv_id, cast(0 as bigint), '000000000000', cast(null as varchar), {close.replace('k2', 'cast(null as varchar)').replace('k0', "'000000000000'").replace('k1', 'cast(null as varchar)').replace('k3', 'cast(null as varchar)')},
        cast(null as varchar) from faults
    union all
    select w.conv_id, f.i, {gone('k0')}, least({gone('k1')}, {kept('k0', 's')}),
        least({gone('k2')}, {kept('k0', 'u')}, {kept('k1', 'u')}, {kept('c3', 'u')}, {reroled('k0')}, {reroled('k1')}, {reroled('c3')}), least({gone('c3')}, {kept('k2', 'a')}, {reroled('k2')})
    from (select conv_id, i, k0, k1, k2, least(k3, {more('k2', '3', 'I')}) as c3 from (select conv_id, i, k0, k1, {close} as k2, k3 from walk)) w
    join lattice f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1),
found as (select conv_id, least(k0, c3) as best from (
    select conv_id, k0, least(k3, {more('k2', '3', 'I')}) as c3 from (
        select w.conv_id, k0, {close} as k2, k3 from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.n = w.i))),
edits as (select conv_id, j, substr(best, 12 + cast(j as integer), 1) as edit from (select conv_id, best, unnest(range(1, length(best) - 11)) as j from found)),
placed as (select conv_id, edit, j, sum(case edit when 'I' then 0 else 1 end) over (partition by conv_id order by j) as i, sum(case edit when 'D' then 0 else 1 end) over (partition by conv_id order by j) as p from edits),
joined as (select e.conv_id, e.edit, e.p, e.j, r.role, case e.edit when 'I' then '' else r.text end as text,
        max(case when e.p = 1 and e.edit = 'K' and left(r.role, 1) = 's' then 1 else 0 end) over (partition by e.conv_id) as shift
    from placed e left join judged r on r.conv_id is not distinct from e.conv_id and r.i = e.i and e.edit <> 'I' where e.edit <> 'D'),
texts as (select conv_id, string_agg(case when edit = 'K' then role when (p - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p) as repaired from joined group by conv_id)
select c.conv_id, cast(coalesce(f.gaps, 0) as bigint) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated,
    coalesce(f.illegal, 0) as illegal, coalesce(cast(left(b.best, 12) as bigint), 0) as cost, coalesce(substr(b.best, 13), '') as audit, sha256(coalesce(t.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id
left join found b on b.conv_id is not distinct from c.conv_id left join texts t on t.conv_id is not distinct from c.conv_id
"""
