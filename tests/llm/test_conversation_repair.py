"""Repair of conversations against SQL, exhaustive search and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import compare
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair as repair
from millrace.llm import entry

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    """(cost, audit) of (initial, must go, truncated) rows by trying all edits, with up to two inserts a gap."""
    layer = {("", ""): 0}  # (roles, audit) -> cost
    for at in range(len(rows) + 1):
        inserted = dict(layer)
        for _ in range(2):
            for (roles, audit), cost in list(inserted.items()):
                for c in "ua":
                    key = (roles + c, audit + "I")
                    inserted[key] = min(inserted.get(key, 999), cost + 3)
        layer = {k: v for k, v in inserted.items() if re.fullmatch(r"s?(ua)*u?", k[0])}
        if at == len(rows):
            break
        initial, must_go, cut = rows[at]
        after = {}
        for (roles, audit), cost in layer.items():
            moves = [(roles, audit + "D", cost + 4)]
            if not must_go:
                moves += [(roles + initial, audit + "K", cost + 3 * cut)] if initial else []
                moves += [(roles + c, audit + "R", cost + 3 + 3 * cut) for c in "ua"]
            for r, a, c in moves:
                after[r, a] = min(after.get((r, a), 999), c)
        layer = after
    return min((cost, audit) for (roles, audit), cost in layer.items() if re.fullmatch(r"(s?(ua)+)?", roles))


def test_cheapest_exhaustively():
    draw = random.Random(5)
    for _ in range(150):
        rows = [(draw.choice(["s", "u", "a", "u", "a", "t", ""]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 4))]
        ((cost, audit, _),) = repair.cheapest(rows, {repair.NOTHING: (0, "")}).values()
        assert (cost, audit) == by_hand(rows)


def test_against_sql(spark, sf_dir):
    assert not compare.difference(entry.QUERIES["op12_conversation_repair"](spark, sf_dir), compare.connect(sf_dir), entry.ORACLE_SQL["op12_conversation_repair"])


def strange(n, seed=1):
    """Rows with nulls, equal rows, equal turns, odd roles and white space, one conversation having a third of all."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        conv = draw.choice([None, 1, 1, 1, *range(2, 9)]) if k % 3 else 0
        out.append((conv, draw.choice([None, *range(-2, 40)]), draw.choice([None, "", "system", "user", "assistant", "user", "assistant", "tool", "ümlaut"]), draw.choice([None, "", " \t", "Yes.", "no", "Why?\n", "long " * 50 + "!", "\x1c", "a. b! c?"])))
    return out


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_odd_rows(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = strange(240)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("own") for c in ("audit", "cost", "place", "seen", "dropped", "copy", "way")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert not compare.difference(entry.QUERIES["op12_conversation_repair"](spark, str(tmp_path)), compare.connect(str(tmp_path)), entry.ORACLE_SQL["op12_conversation_repair"])


def test_segments_agree(spark, monkeypatch):
    """Long conversations without damage: cut into segments or not, paths and hashes are the same, and rows give the hash."""
    draw = random.Random(9)
    rows = [(k % 2, k, draw.choice(["user", "assistant", "system"]), draw.choice(["", "Yes.", "no", f"{k}.", f"{k}"])) for k in range(600)]
    rows += [(2, k, "user", "") for k in range(300)] + [(3, None, "user", "Same.")] * 300
    df = spark.createDataFrame(rows, COLUMNS)
    whole = {r["conv_id"]: r for r in repair.edit_scripts(df).collect()}
    monkeypatch.setattr(repair, "SEGMENT", 7)
    scripts = repair.edit_scripts(df)
    assert {r["conv_id"]: r for r in scripts.collect()} == whole
    assert whole[2]["audit"] == "D" * 300 and whole[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert whole[3]["duplicate"] == 299 and whole[3]["audit"].count("D") == 299 and whole[3]["gaps"] == 0
    made = {}
    for r in sorted(repair.repaired_rows(df, scripts).collect(), key=lambda r: (r["conv_id"], r["position"])):
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv_id, r in whole.items():
        assert hashlib.sha256("\n".join(made.get(conv_id, [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in made.get(conv_id, [])))


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert not repair.edit_scripts(repair.damage(none)).collect()
    assert not repair.repaired_rows(none, repair.edit_scripts(none)).collect()
    gone = spark.createDataFrame([(None, None, None, None)], COLUMNS).withColumn("dropped", F.lit(True))
    (row,) = repair.edit_scripts(gone).collect()
    assert tuple(row) == (None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
