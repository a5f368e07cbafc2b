"""Each operator against brute force, and on odd and empty tables."""

from __future__ import annotations

import array
import hashlib
import itertools
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import compare
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import entry, fingerprints, graph, language_id, license_scan, packing, personal_data, piece_codec, quality_model, quality_rules, revisits, shingle_join
from millrace.llm.license_texts import LICENSES


def table_of(spark, docs, tmp_path, **others):
    """A folder with these tables, for queries."""
    for name, df in {"documents": docs, **others}.items():
        if df is None:
            continue
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- 1


def test_quality_base(spark, sf_dir, texts):
    for r in entry.QUERIES["op1_quality_rules"](spark, sf_dir).collect():
        expected = brute.quality_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts(spark, sf_dir, docs, texts):
    """Ratios, chunk shares and verdicts of all documents, with fitted limits, against their definition."""
    import zstandard

    limits = quality_rules.fit_limits(docs)
    assert quality_rules.fit_limits(docs.repartition(7)) == limits
    press = zstandard.ZstdCompressor(level=3).compress
    for r in entry.QUERIES["op1_quality_rules"](spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        if not raw:
            assert r["ratio"] is None and not r["kept"]
            continue
        ratio = len(press(raw)) / len(raw)
        low, high = next((lo, hi) for most, lo, hi in limits["bands"] if len(raw) <= most)
        chunks = [raw[k : k + 2048] for k in range(0, len(raw), 2048)] if len(raw) > 2048 else []
        chunks = [c if len(c) >= 1024 else raw[-2048:] for c in chunks]
        ratios = [len(press(c)) / len(c) for c in chunks]
        size = sum(map(len, chunks)) or 1
        under = sum(len(c) for c, x in zip(chunks, ratios, strict=True) if x < limits["chunk_band"][0]) / size
        over = sum(len(c) for c, x in zip(chunks, ratios, strict=True) if x > limits["chunk_band"][1]) / size
        good = not r["base_failed"] and low <= ratio <= high and under <= 0.5 and over <= 0.5
        assert (r["ratio"], r["low_chunks"], r["high_chunks"], r["kept"]) == (pytest.approx(ratio), pytest.approx(under), pytest.approx(over), good)


def test_quality_bands(spark):
    import random

    draw = random.Random(5)
    noise = " ".join("".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(80))
    prose = " ".join(draw.choice("the of and to in quick brown rivers carry old letters between seven quiet towns while painters argue about winter light bread and the price of paper".split()) + draw.choice(["", "s", "ed"]) for _ in range(300))
    row = "abcdefgh " + " ".join(f"k{n}" for n in range(10))
    df = spark.createDataFrame([(1, noise), (2, prose), (3, "\n".join(row + f" {n}" for n in range(400)))], "doc_id int, text string")
    out = {r["doc_id"]: r["quality_rules"] for r in quality_rules.quality_rules(df).collect()}
    assert out[1]["reason"] in ("incompressible", "incompressible chunks") and out[2]["kept"] and not out[3]["kept"]


def test_quality_odd(spark, odd_docs, odd_texts, no_docs):
    out = quality_rules.quality_rules(odd_docs)
    assert out.columns[-1] == "quality_rules" and out.columns.count("quality_rules") == 1
    got = Counter((r["doc_id"], *tuple(r["quality_rules"])[:6]) for r in out.collect())
    assert got == Counter((k, *brute.quality_base(t)) for k, t in odd_texts)
    assert quality_rules.quality_rules(no_docs).count() == 0
    kept = quality_rules.keep_documents(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3}


def test_quality_fitted(spark):
    """Litter of few symbol runs compresses better than prose of its length, by less than the fixed limits ask for."""
    import random

    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("etaoinshrdlucmfw") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    prose = [" ".join(draw.choices(vocabulary, k=draw.randint(420, 470))) for _ in range(400)]
    litter = [" ".join(x + draw.choice(["###", "$$$", "%%%", "&&&"]) for x in draw.choices(vocabulary[:150], k=draw.randint(280, 310))) for _ in range(20)]
    copies = [prose[0]] * 600
    df = spark.createDataFrame(list(enumerate(prose + litter + copies)), "doc_id int, text string").repartition(3)
    limits = quality_rules.fit_limits(df)
    assert quality_rules.keep_documents(df).count() == 1020
    kept = {r["doc_id"] for r in quality_rules.keep_documents(df, **limits).collect()}
    assert not kept & set(range(400, 420)) and len(kept & set(range(400))) >= 396 and kept >= set(range(420, 1020))
    few = quality_rules.fit_limits(df.limit(30))
    assert quality_rules.CHUNK_BAND[0] < few["chunk_band"][0] < limits["chunk_band"][0] and few["chunk_band"][1] == quality_rules.CHUNK_BAND[1]
    assert quality_rules.fit_limits(df.limit(0))["chunk_band"] == quality_rules.CHUNK_BAND


# ---- 2


def test_language_accuracy(spark, sf_dir, docs):
    out = entry.QUERIES["op2_language_id"](spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert out.where("doc_id is not null").count() == docs.count() and out.where("page_id is not null").count() == pages
    joined = out.where("doc_id is not null").join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert joined.where("lang = truth").count() >= 0.98 * docs.count() and joined.where("not kept").count() <= 0.02 * docs.count()


def test_language_held_out(spark, docs):
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 100")
    out = language_id.identify(spark, rest, labelled=train).join(rest.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert out.where("lang = truth").count() >= 0.97 * rest.count()


def test_language_evidence(spark, docs):
    """Declared language and address decide where the text says nothing; hosts pull what has no evidence of its own."""
    rows = [(k, f"https://h{k % 2}.example.{'de' if k % 2 else 'com'}/{'' if k % 2 else 'en/'}{k}", f"<html lang='{'de' if k % 2 else 'en'}'><script>var x</script>{'der die und ist nicht' if k % 2 else 'the and of with that'} {k}</html>") for k in range(40)]
    rows += [(100, "https://h1.example.de/x", '<html lang="de"></html>'), (101, None, None), (102, "https://zz.example.com/fr/1", "<html lang=fr>7</html>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r for r in language_id.identify(spark, docs, pages).where("page_id is not null").collect()}
    assert len(out) == 43 and out[100]["lang"] == "de" and out[101]["lang"] == "und" and not out[101]["kept"]
    assert out[102]["declared"] == "fr" and out[102]["suffix"] == "fr"


def test_language_odd(spark, odd_docs, odd_texts, no_docs):
    out = language_id.identify(spark, odd_docs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(k for k, _ in odd_texts)
    assert {r["doc_id"]: r["lang"] for r in out.where("doc_id in (4, 5)").collect()} == {4: "und", 5: "und"}
    assert language_id.identify(spark, no_docs).count() == 0
    assert language_id.keep_documents(spark, odd_docs).columns == odd_docs.columns


def test_language_posteriors(spark):
    """Fusion against its definition, one row at a time."""
    import math

    import numpy as np

    draw = np.random.default_rng(11)
    hosts = [("a.x.com", "x.com"), ("b.x.com", "x.com"), ("c.y.de", "y.de"), ("lone.z.fr", "z.fr"), ("plain", None), (None, None)]
    rows = []
    for k in range(60):
        host, domain = hosts[0 if k < 30 else k % 6]
        host, domain = hosts[3] if k == 59 else (hosts[0] if host == "lone.z.fr" else (host, domain))
        logs = (draw.normal(0, 2, 3) if k % 9 else np.zeros(3)).tolist()
        alone = (np.exp(logs) / np.exp(logs).sum()).tolist()
        rows.append((f"r{k}", host, domain, ["en", "de", "other", None][k % 4], ["en", None][k % 2], not k % 9, logs, alone))
    df = spark.createDataFrame(rows, "row string, host string, domain string, declared string, suffix string, blank boolean, scores array<double>, alone array<double>")
    out = {r["row"]: r for r in language_id.fuse(df.withColumn("extra", F.lit(1)), ["de", "en"]).collect()}

    def sums(test, but):
        return [sum(r[7][k] for r in rows if test(r) and r is not but) for k in range(3)]

    for r in rows:
        prior = [x + 1 for x in sums(lambda q: True, r)]
        prior = [x / sum(prior) for x in prior]
        for column, weight in ((2, language_id.DOMAIN_WEIGHT), (1, language_id.HOST_WEIGHT)):
            own = sums(lambda q, column=column: r[column] is not None and q[column] == r[column], r)
            prior = [(a + weight * p) / (sum(own) + weight) for a, p in zip(own, prior, strict=True)]
        logs = [x + math.log(p + 1e-9) for x, p in zip(r[6], prior, strict=True)]
        for column in (3, 4):
            if r[column] is not None:
                values = len({q[column] for q in rows if q[column] is not None})
                own, every = sums(lambda q, column=column: q[column] == r[column], r), sums(lambda q, column=column: q[column] is not None, r)
                w = language_id.DECLARED_WEIGHT
                logs = [x + math.log((a + w) / (b + w * values)) for x, a, b in zip(logs, own, every, strict=True)]
        total = sum(map(math.exp, logs))
        want = [math.exp(x) / total for x in logs]
        best = 2 if r[5] and r[3] is None and r[4] is None else want.index(max(want))
        assert (out[r[0]]["lang"], out[r[0]]["posterior"]) == (["de", "en", "und"][best], pytest.approx(want[best], abs=1e-9))
    assert len(out) == 60


def test_language_columns(spark, docs, monkeypatch):
    """Tables without lang, without source, and with more languages than the bound."""
    few = docs.where("doc_id < 60")
    assert language_id.keep_documents(spark, few.drop("lang")).count() == few.count()
    assert language_id.keep_documents(spark, few.withColumn("lang", F.lit(None).cast("string"))).count() == few.count()
    assert language_id.keep_documents(spark, few.drop("lang"), labelled=docs).columns == few.drop("lang").columns
    bare = language_id.keep_documents(spark, few.drop("source"))
    assert bare.columns == few.drop("source").columns and bare.count() >= 0.9 * few.count()
    assert {r["lang"] for r in language_id.identify(spark, few.drop("lang", "source")).collect()} == {"und"}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.identify(spark, few)


def test_language_keeps_by_row(spark, docs):
    """Rows without id, and rows that share one, are judged each by itself."""
    few = docs.where("lang = 'en'").orderBy("doc_id").limit(40)
    text = few.first()["text"]
    extra = spark.createDataFrame([(None, text, None), (None, "", None), (None, None, None), (-5, text, None), (-5, "", None)], "doc_id bigint, text string, lang string")
    both = few.select("doc_id", "text", "lang", "source").unionByName(extra.withColumn("source", F.lit(None).cast("string")))
    kept = Counter((r["doc_id"], r["text"]) for r in language_id.keep_documents(spark, both).collect() if r["doc_id"] in (None, -5))
    assert kept == {(None, text): 1, (-5, text): 1}


# ---- 3


def test_license_sql(spark, sf_dir):
    assert not compare.difference(entry.QUERIES["op3_license_scan"](spark, sf_dir), compare.connect(sf_dir), entry.ORACLE_SQL["op3_license_scan"])


def test_license_copies(spark, sf_dir):
    query = entry.QUERIES["license_scan_copies"](spark, sf_dir)
    assert not compare.difference(query, compare.connect(sf_dir), entry.ORACLE_SQL["license_scan_copies"])
    found = {r["doc_id"]: r["license_id"] for r in query.collect()}
    assert all((k % 6 == 5) == (x is None) for k, x in found.items()) and len({x for x in found.values() if x}) >= 30


def test_license_variants(spark, no_docs):
    mit = LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("\n", "\n\n")),
        (2, mit.replace("sublicense", "sub-licence") + "\n© 1999 Others, all rights reserved"),
        (3, mit + " and more"),
        (4, None),
        (5, "  released UNDER the mit licence!\n"),
        (6, LICENSES["BSD-3-Clause"]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("license_id", F.lit("old"))
    out = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(df).collect()}
    assert out == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "MIT:notice", 6: "BSD-3-Clause"}
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_license_complete(spark, tmp_path):
    whole = {p.stem.replace("--", ":"): p.read_text() for p in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(whole)
    names = sorted(whole)
    filled = whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Some Body")
    terms = whole["GPL-3.0"].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n"
    texts = [*(whole[n] for n in names), filled, terms, "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + LICENSES["MIT"], whole["GPL-2.0"][:-200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = table_of(spark, docs, tmp_path)
    query = entry.QUERIES["op3_license_scan"](spark, folder)
    expected = [*names, "Apache-2.0:filled in", "GPL-3.0:terms", "MIT:title 2", None]
    assert {r["doc_id"]: r["license_id"] for r in query.collect()} == dict(enumerate(expected))
    assert not compare.difference(query, compare.connect(folder), entry.ORACLE_SQL["op3_license_scan"])


# ---- 4


def test_revisits_brute(spark, sf_dir):
    records = [r.asDict() for r in revisits.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("canonical", revisits.canonical_url(F.col("url"))).collect()]
    by = defaultdict(list)
    for r in records:
        if r["status"] == 200:
            by[r["canonical"]].append(r)
    out = {r["record_id"]: r for r in entry.QUERIES["op4_revisits"](spark, sf_dir).collect()}
    revisited = [r for r in records if r["status"] == 304]
    assert len(out) == len(revisited)
    for r in revisited:
        earlier = [x for x in by[r["canonical"]] if x["captured"] < r["captured"]]
        best = max(earlier, key=lambda x: (x["captured"], x["record_id"]), default=None)
        assert out[r["record_id"]]["response_id"] == (best and best["record_id"])
        if best:
            tag = {k.lower(): v for k, v in r["headers"].items()}.get("etag")
            stored = {k.lower(): v for k, v in best["headers"].items()}.get("etag")
            if tag and stored:
                assert out[r["record_id"]]["valid"] == (tag.removeprefix("W/") == stored.removeprefix("W/"))


def test_revisits_cases(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        (1, "http://www.A.com/x/?utm_source=1", at(1), 200, {"ETag": '"a"', "Content-Length": "9", "Age": "1"}, "d"),
        (2, "https://a.com/x#f", at(5), 304, {"etag": 'W/"a"', "content-length": "0", "age": "7"}, None),
        (3, "https://a.com/x", at(5), 200, {"ETag": '"b"'}, "d"),
        (4, "https://a.com/x", at(9), 304, {"etag": '"a"'}, None),
        (5, "https://a.com/never", at(9), 304, None, None),
        (6, None, at(9), 304, {}, None),
        (7, "https://a.com/x", at(9), 304, {}, "d"),
        (7, "https://a.com/x", at(9), 304, {}, "d"),
        (8, "https://a.com/x", None, 304, {}, "d"),
        (9, "https://a.com/x", at(9), 304, {"age": "3"}, None),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, url string, captured timestamp, status int, headers map<string,string>, digest string").withColumn("span", F.lit(1)).withColumn("stored", F.lit(1))
    for spans in (1, 3, 256):
        out = revisits.resolve_revisits(df, spans).collect()
        by = {r["record_id"]: r for r in out}
        assert len(out) == 8 and by[2]["response_id"] == 1 and by[2]["valid"] and by[2]["headers"] == {"etag": 'W/"a"', "content-length": "9", "age": "7"}
        assert by[4]["response_id"] == 3 and not by[4]["valid"] and by[5]["response_id"] is None and by[6]["response_id"] is None and by[8]["response_id"] is None
        assert by[9]["response_id"] == 3 and by[9]["validator"] == "none" and by[9]["valid"] is None and by[9]["headers"] == {"age": "3"}
        assert by[7]["response_id"] == 3 and by[7]["validator"] == "digest" and by[7]["valid"]
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_large_ids(spark, tmp_path):
    """Ids beyond what 32 bits hold, one far off the others in time, and no pages at all."""
    pages = spark.createDataFrame([(k, "http://a.com/x", "y") for k in (1, 2, 3, 800_000_000, 999_999_999_999, 2**61)] + [(None, "u", "v")], "page_id bigint, url string, html string")
    folder = table_of(spark, None, tmp_path, pages=pages)
    assert not compare.difference(entry.QUERIES["op4_revisits"](spark, folder), compare.connect(folder), entry.ORACLE_SQL["op4_revisits"])
    none = table_of(spark, None, tmp_path / "none", pages=pages.limit(0))
    assert entry.QUERIES["op4_revisits"](spark, none).count() == 0


# ---- 5


def tokens_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, expected):
    """``expected``: ids of each document by key (a list for repeated ones)."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for key, lists in expected.items():
        own = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[key])
        want = Counter((s, len(ids[s : s + 2048]), zlib.crc32(array.array("I", ids[s : s + 2048]).tobytes()), len(ids)) for ids in lists for s in range(0, len(ids), 2048))
        assert own == want
    assert set(by_doc) == set(expected)


def test_packing(spark, sf_dir, texts):
    rows = entry.QUERIES["op5_packing"](spark, sf_dir).collect()
    check_packed(rows, {k: [tokens_of(t)] for k, t in texts.items()})
    n = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) >= 0.97 * 2048 * (n - 1)


def test_packing_odd(odd_docs, odd_texts, no_docs):
    expected = defaultdict(list)
    for k, t in odd_texts:
        expected[k].append(tokens_of(t))
    rows = packing.pack(odd_docs, with_ids=True).collect()
    check_packed(rows, expected)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_packing_short(spark):
    """Many empty texts, of one token each, fill whole sequences."""
    rows = packing.pack(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).collect()
    empty = tokens_of("")
    check_packed(rows, {k: [empty] for k in range(5000)})
    assert len(rows) == 5000 and len({r["sequence_id"] for r in rows}) == 3


def test_packing_added_tokens(spark):
    """The string of an added token is its id, as an untouched tokenizer has it."""
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>\n <|endoftext", "<|endoftext|> " * 3000]
    check_packed(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect(), {k: [tokens_of(t)] for k, t in enumerate(texts)})
    assert len(tokens_of(texts[0])) == 5 and 50256 in tokens_of(texts[0])


def test_packing_plan_uses_all():
    import random

    draw = random.Random(2)
    for histogram in ({}, {5: 3}, {k: draw.randint(0, 900) for k in range(1, 257)}, {1: 100_000}, {256: 7, 129: 10_000}):
        used = Counter()
        for pattern, times in packing.packing_plan(histogram, 256):
            assert times > 0 and sum(k * m for k, m in pattern.items()) <= 256
            for k, m in pattern.items():
                used[k] += m * times
        assert used == Counter({k: v for k, v in histogram.items() if v})


def test_nnls():
    import numpy as np

    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert packing.nnls(a, np.array([2.0, 3.0])) @ a.T == pytest.approx([2, 3])
    assert packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -1.0])) == pytest.approx([0])


# ---- 6


def check_private(rows, text_of):
    for r in rows:
        found = brute.base_spans(text_of(r))
        counts = Counter(k for k, _, _ in found)
        assert r["base_sha256"] == brute.sha(brute.written(found))
        assert all(r[f"n_{k}"] == counts[k] for k in ("email", "ip", "card", "phone"))
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{s}:{e}" for k, s, e in found} <= set(spans)
        order = [k.name for k in personal_data.KINDS]
        assert spans == sorted(spans, key=lambda s: (order.index(s.split(":")[0]), int(s.split(":")[1])))


def test_private(spark, sf_dir, texts):
    check_private(entry.QUERIES["op6_personal_data"](spark, sf_dir).collect(), lambda r: texts[r["doc_id"]])


def test_private_odd(spark, odd_docs, odd_texts, tmp_path):
    out = entry.QUERIES["op6_personal_data"](spark, table_of(spark, odd_docs, tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, _ in odd_texts)
    known = {k: t for k, t in odd_texts if k is not None}
    check_private([r for r in out if r["doc_id"] is not None], lambda r: known[r["doc_id"]])
    assert any("secret" in r["spans"] for r in out if r["doc_id"] == 14)


def test_private_method_spans(spark, docs, texts):
    """All spans of all documents and of made-up ones, against labelers, classifier and threshold in plain Python."""
    extra = {
        10**6: "Konto DE89 3704 0044 0532 0130 00 bitte; falsch DE88370400440532013000. Dr. Maria Lopez, 078-05-1120, tel (212) 555-0187",
        10**6 + 1: "password: changeme12 api_key='sk_04dbebab91ab85687d33eeaaf9ac' Señora Lucia\n+49 30 1234567890 1.2.3.4 version 1.2.3.4",
        10**6 + 2: "GB82 WEST 1234 5698 7654 32 und FR14 2004 1010 0505 0001 3M02 606; Mr X",
    }
    both = texts | extra
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id bigint, text string"))
    found = {k: brute.candidates(t, personal_data.KINDS) for k, t in both.items()}
    counts = Counter(tuple(sorted((n, c[n]) for n in ("kind", *personal_data.LABELERS, *personal_data.FEATURES))) for own in found.values() for c in own)
    weights = personal_data.train([dict(k) | {"n": n} for k, n in counts.items()])
    base = {k.name for k in personal_data.KINDS if k.base}
    for r in personal_data.personal_data(df, keep=["doc_id"]).collect():
        want = []
        for c in found[r["doc_id"]]:
            odds = sum(weights[t] for t in personal_data.terms(c))
            if c["kind"] in base or 1 / (1 + 2.718281828459045**-odds) >= personal_data.THRESHOLD:
                want.append((c["kind"], c["start"], c["end"]))
        assert [(x["kind"], x["start"], x["end"]) for x in r["personal_data"]] == want
    assert [c["shape"] for c in found[10**6] if c["kind"] == "iban"] == [1, -1]


def test_private_prefix_sums(spark):
    text = " ".join(f"u{k}@h.org" for k in range(1500))
    df = spark.createDataFrame([(1, "ü " + text)], "doc_id bigint, text string")
    spans = personal_data.personal_data(df).first()["personal_data"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] == "email"] == brute.base_spans("ü " + text)


def test_redaction(spark, odd_docs, odd_texts, no_docs):
    out = personal_data.redact(odd_docs)
    assert out.columns == odd_docs.columns
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[4] is None and by[5] == "" and by[9].startswith("<EMAIL>, <PHONE>; <CARD> and ") and "4111" not in by[9] and not brute.base_spans(by[14])
    assert personal_data.redact(no_docs).count() == 0


def test_redaction_of_long_texts(spark, monkeypatch):
    """Sheets of a few code points, with spans across their borders, against plain slicing; overlaps have the first kind."""
    text = "ü mail a@b.cc, " + "long-" * 6 + "address@" + "host." * 8 + "org; 10.0.0.1 " * 3 + "4111 1111 1111 1111 " + "x" * 40
    df = spark.createDataFrame([(1, text), (2, "a@b.cc"), (3, "none"), (4, text * 30)], "doc_id bigint, text string")
    spans = {r["doc_id"]: r["personal_data"] for r in personal_data.personal_data(df).collect()}
    expected = {}
    for r in df.collect():
        out, end = "", 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                out += r["text"][end : s["start"]] + f"<{s['kind'].upper()}>"
            end = max(end, s["end"])
        expected[r["doc_id"]] = out + r["text"][end:]
    for sheet in (3, 17, 4096):
        monkeypatch.setattr(personal_data, "_SHEET", sheet)
        assert {r["doc_id"]: r["text"] for r in personal_data.redact(df).collect()} == expected
    overlapping = [(0, 5, "a"), (2, 9, "b"), (3, 4, "c"), (9, 12, "d"), (20, 30, "e"), (21, 22, "f"), (29, 31, "g")]
    one = spark.createDataFrame([("0123456789" * 4, overlapping)], "t string, s array<struct<start:bigint,end:bigint,kind:string>>")
    for sheet in (1, 4, 100):
        monkeypatch.setattr(personal_data, "_SHEET", sheet)
        assert one.select(personal_data._redacted(F.col("t"), personal_data._disjoint(F.col("s")))).first()[0] == "<A><D>23456789<E>123456789"


def test_names_that_clash(spark, odd_docs):
    """Columns with the names that operators use inside, and a text column in other letters."""
    taken = ("__quality_rules__", "__gone__", "__rejected__", "__found__", "__personal_data__", "__merged__", "_own_0")
    docs = odd_docs.where("doc_id < 11").withColumns({c: F.lit(c) for c in taken})
    for made in (quality_rules.keep_documents(docs), shingle_join.one_of_each(docs), language_id.keep_documents(spark, docs), personal_data.redact(docs)):
        assert made.columns == docs.columns
        assert {tuple(r) for r in made.select(*taken).distinct().collect()} <= {taken}
    plain = {r["doc_id"]: r["text"] for r in personal_data.redact(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in personal_data.redact(docs, "Text").collect()} == plain and "<EMAIL>" in plain[9]
    with pytest.raises(ValueError, match="0 columns"):
        personal_data.redact(docs, "body")


def test_reliabilities_find_the_better_labeler():
    """A vote that agrees with the others counts for more than one that doesn't."""
    base = {"length_bin": 1, "digit_bin": 1, "upper": 0, "spaced": 0, "quoted": 0, "line_start": 0}
    counts = [
        {"kind": "x", "shape": s, "gazetteer": g, "context": c, "placeholder": 0, "n": n, **base}
        for s, g, c, n in ((1, 1, 1, 400), (1, 1, 0, 300), (-1, 0, 0, 500), (-1, 0, 1, 40), (1, 0, 0, 30))
    ]
    p = personal_data.reliabilities(counts)
    assert p["x", 1, 1, 0, 0] > 0.9 > 0.1 > p["x", -1, 0, 0, 0]
    assert personal_data.train([]) == {}


# ---- 7


def test_quality_model(spark, sf_dir, docs):
    out = entry.QUERIES["op7_quality_model"](spark, sf_dir)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet").collect()}
    big = entry.QUERIES["op7_quality_model"](spark, sf_dir.replace("0.001", "0.01"))
    held = [(r["predicted"], labels[r["doc_id"]]) for r in big.where("held_out").collect() if r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_model_brute(spark, sf_dir, docs, texts):
    """Scores of all documents against the model's definition, one passage at a time."""
    import math

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels)
    assert len(quality_model.training_rows(docs, labels, most=7)) == 7
    rows = quality_model.training_rows(docs, labels, most=50, passages_each=2)
    assert len(rows) == 50 and max(len(bag) for bag, _ in rows) == 2
    w = {k: v.tolist() for k, v in model.weights.items()}
    mean, scale = model.mean.tolist(), model.scale.tolist()

    def times(x, matrix, bias=None):
        return [sum(a * row[j] for a, row in zip(x, matrix, strict=True)) + (bias[j] if bias else 0.0) for j in range(len(matrix[0]))]

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    out = {r["doc_id"]: r["score"] for r in entry.QUERIES["op7_quality_model"](spark, sf_dir).collect()}
    assert set(out) == set(texts)
    for k in sorted(texts)[::7]:
        encodings, raws = [], []
        for part in quality_model.passages((texts[k] or "").encode()):
            x = [max(-6.0, min(6.0, (float(v) - m) / s)) for v, m, s in zip(quality_model.encode_passage(part), mean, scale, strict=True)]
            h = [math.tanh(v) for v in times(x, w["encode"], w["encode_bias"])]
            gated = [math.tanh(a) * sigmoid(b) for a, b in zip(times(h, w["value"]), times(h, w["gate"]), strict=True)]
            encodings.append(h)
            raws.append(sum(a * b for a, b in zip(gated, w["attend"], strict=True)))
        top = max(raws)
        shares = [math.exp(r - top) for r in raws]
        bag = [sum(s * h[j] for s, h in zip(shares, encodings, strict=True)) / sum(shares) for j in range(quality_model.ENCODED)]
        assert out[k] == pytest.approx(sigmoid(sum(a * b for a, b in zip(bag, w["out"], strict=True)) + w["out_bias"][0]), abs=1e-4)


def test_quality_model_slopes():
    """Gradients against differences."""
    import numpy as np

    draw = np.random.default_rng(1)
    x, starts, target, weight = draw.normal(size=(9, quality_model.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0, 1]), np.array([0.3, 0.3, 0.4])
    model = quality_model.AttentionModel.start(x)
    model.weights["out"] = draw.normal(size=quality_model.ENCODED)
    slopes = model.slopes(model.forward(x, starts), starts, target, weight)

    def loss():
        p = model.forward(x, starts)["score"]
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    for name, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        keep, step = w[at], 1e-5
        w[at] = keep + step
        up = loss()
        w[at] = keep - step
        down = loss()
        w[at] = keep
        assert slopes[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_quality_model_odd(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (12, 0), (12, 0), (5, None), (None, 1)], "doc_id bigint, quality int")
    model = quality_model.train(odd_docs, labels)
    out = quality_model.quality_score(odd_docs, model).collect()
    assert len(out) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_model.train(odd_docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_model.quality_score(odd_docs, None).collect()} == {0.5}
    assert quality_model.quality_score(no_docs, model).count() == 0


# ---- 8


def near_pairs(texts):
    sets = {}
    for k, t in texts.items():
        w = brute.WORDS.findall(t or "")
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    places = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            places[g].append(k)
    shared = Counter(p for ks in places.values() for p in itertools.combinations(sorted(ks), 2))
    return {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}


def classes(keys, pairs):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_shingle_join(spark, sf_dir, texts):
    pairs = near_pairs(texts)
    links, groups = Counter(k for p in pairs for k in p), classes(texts, pairs)
    for r in entry.QUERIES["op8_shingle_join"](spark, sf_dir).collect():
        assert (r["n_links"], r["class_id"]) == (links[r["doc_id"]], groups[r["doc_id"]])


def test_shingle_join_blocks(spark, monkeypatch):
    """A family of near copies that fills several blocks, among copies and sizes at the threshold."""
    from conftest import words

    base = words(9, 150).split()
    texts = {}
    for k in range(60):
        w = list(base)
        w[(k * 7) % 150] = f"w{k % 20}"
        texts[k] = " ".join(w[: 150 - (k % 3) * 4])
    texts |= {100 + k: words(50 + k, 80) for k in range(10)}
    monkeypatch.setattr(shingle_join, "BLOCK_TEXTS", 7)
    out = shingle_join.shingle_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    pairs = near_pairs(texts)
    links, groups = Counter(k for p in pairs for k in p), classes(texts, pairs)
    assert len(out) == 70 and all((r["n_links"], r["class_id"]) == (links[r["doc_id"]], groups[r["doc_id"]]) for r in out)


def test_intersections():
    import numpy as np

    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for dense in (1, 5, 100):
        assert (shingle_join.intersections(sets, None, dense) == want).all()
        assert (shingle_join.intersections(sets[:12], sets[12:], dense) == want[:12, 12:]).all()


def test_prefix_depth():
    assert shingle_join.prefix_depth(0.8) == 5 and shingle_join.prefix_depth(0.8, target=0.99) == 7 and shingle_join.prefix_depth(0.1, trees=2) == 1
    deep = [(8, True, 300.0, 300), (8, False, 700.0, 700)]
    depth = lambda found: shingle_join.adapted_depth(found, 0.8, 20, 8, 4, 0.9995)
    assert depth([]) == 5 and depth(deep) == 8 and depth([*deep, (6, False, 2.0, 2)]) == 6 and depth([*deep, (4, True, 2.0, 2)]) == 4
    assert depth([(8, False, 700.0, 700)]) == 5  # no link near the threshold: a pair there has to be expected


def test_forest(spark):
    """Prefixes shared with any other row, over many ranges, against all pairs."""
    import random

    draw = random.Random(12)
    branch = lambda: b"".join(bytes([0, draw.choice([0, 0, 0, 1])]) for _ in range(8))
    rows = {k: branch() + branch() for k in range(300)}
    reps = spark.createDataFrame(list(rows.items()), "rep bigint, signature binary")
    want = {}
    for t in (0, 16):
        for k, x in rows.items():
            n = max(shingle_join.common_prefix(x[t : t + 16], y[t : t + 16]) for j, y in rows.items() if j != k)
            if n >= 4:
                want[t // 16, k] = n
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            out = shingle_join.forest(reps, 2, 8, 4).collect()
            assert {(r["tree"], r["rep"]): r["depth"] for r in out} == want and len(out) == len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_shingle_join_recall(spark, sf_dir, size):
    """Links found, of all that brute force finds."""
    folder = sf_dir.replace("0.001", size)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    links = Counter(k for p in near_pairs(texts) for k in p)
    found = {r["doc_id"]: r["n_links"] for r in entry.QUERIES["op8_shingle_join"](spark, folder).collect()}
    assert all(found[k] <= links[k] for k in texts) and sum(found.values()) >= 0.999 * sum(links.values())


def test_shingle_join_odd(odd_docs, odd_texts, no_docs):
    out = shingle_join.shingle_join(odd_docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, _ in odd_texts)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_links"] == 3 and by[2]["n_copies"] == 2 and by[3]["class_id"] == 1 and by[4]["n_links"] == by[5]["n_links"] == by[6]["n_links"] == 0
    assert shingle_join.shingle_join(no_docs).count() == 0
    kept = shingle_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_components(spark):
    import random

    draw = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100)] + [(200 + draw.randint(0, 60), 200 + draw.randint(0, 60)) for _ in range(50)] + [(None, 5)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [e for e in edges if e[0] is not None]
    assert out == classes({k for e in real for k in e}, real)


# ---- 9


def test_piece_codec(spark, sf_dir, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in entry.QUERIES["op9_piece_codec"](spark, sf_dir).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(array.array("I", ids).tobytes()), True)


def test_ids_of_no_piece(spark):
    codec = piece_codec.PieceCodec()
    (ids,) = [list(memoryview(x).cast("I")) for x in codec.encode_batch(["so it is"])]
    rows = [(1, ids), (2, [*ids, -1, None, 10**6]), (3, []), (4, None), (5, [-1])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").withColumn("text", F.lit("own"))
    assert {r["k"]: r["text"] for r in piece_codec.decode_pieces(df).collect()} == {1: "so it is", 2: "so it is\ufffd\ufffd\ufffd", 3: "", 4: None, 5: "\ufffd"}
    assert piece_codec.decode_pieces(df.limit(0)).columns == ["k", "ids", "text"]


def test_fitted_limits_grow_with_the_number_of_texts():
    from millrace.llm.quality_rules import lowest_usual

    limits = [lowest_usual({1000: n}, 0.3) for n in (0, 1, 10, 100, 1000, 10**6)]
    own = 1000 * (1 - 3.5 * 0.015) / 2000
    assert limits == sorted(limits) and limits[0] == 0.3 and limits[3] == pytest.approx((0.3 + own) / 2) and limits[-1] == pytest.approx(own, abs=1e-4)
    assert lowest_usual({100: 1000}, 0.3) == 0.3


def test_piece_codec_odd(odd_docs, odd_texts, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_codec.encode_pieces(odd_docs)
    rows = encoded.select("doc_id", "ids").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((k, tuple(sp.encode(t or ""))) for k, t in odd_texts)
    back = piece_codec.decode_pieces(encoded, out="again").select("text", "again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert piece_codec.encode_pieces(no_docs).count() == 0


def test_piece_codec_random():
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(6)
    texts = ["".join(draw.choice(" abtheion\n\té▁日'.,0") for _ in range(draw.randint(0, 120))) for _ in range(500)] + [" " * 50, "the" * 200, "\x00a"]
    codec = piece_codec.PieceCodec()
    for _ in range(2):  # the second time from the kept units
        for t, x in zip(texts, codec.encode_batch(texts), strict=True):
            assert x == array.array("I", sp.encode(t)).tobytes()


# ---- 10


def canonical(text):
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").casefold())
    return " ".join(folded.split())


def fingerprint(text):
    raw = canonical(text).encode()
    second = xxhash.xxh64_intdigest(raw, seed=xxhash.xxh64_intdigest(fingerprints.SECOND.encode(), seed=42))
    return f"{xxhash.xxh64_intdigest(raw, seed=42):016x}{second:016x}"


def check_fingerprints(rows, texts):
    order = sorted(texts)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in rows:
        text, after = texts[r["doc_id"]] or "", texts[following[r["doc_id"]]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(text) and r["edited_fingerprint"] == fingerprint(edited)
        assert r["near_edited"] == (canonical(text) == canonical(edited)) and r["near_next"] == (canonical(text) == canonical(after))


def test_fingerprints(spark, sf_dir, texts):
    rows = entry.QUERIES["op10_fingerprints"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_fingerprints(rows, texts)


def test_fingerprints_odd(spark, odd_docs, odd_texts, no_docs, tmp_path):
    rows = entry.QUERIES["op10_fingerprints"](spark, table_of(spark, odd_docs, tmp_path)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in odd_texts)
    check_fingerprints([r for r in rows if r["doc_id"] is not None], {k: t for k, t in odd_texts if k is not None})
    assert entry.QUERIES["op10_fingerprints"](spark, table_of(spark, no_docs, tmp_path / "none")).count() == 0
    one = odd_docs.where("doc_id = 1")
    assert entry.QUERIES["op10_fingerprints"](spark, table_of(spark, one, tmp_path / "one")).first()["near_next"] == 1.0


def test_fingerprint_classes(spark, odd_docs, odd_texts):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "a b c"), (4, "é"), (5, "É"), (6, None), (7, " ")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["class_id"] for r in fingerprints.fingerprints(rows).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    assert fingerprints.fingerprints(odd_docs).count() == len(odd_texts)


def test_equal_hash_different_bytes(spark):
    df = spark.createDataFrame([("h", "a"), ("h", "b"), ("k", "c"), ("k", "c")], "bucket string, value string")
    assert [r[0] for r in fingerprints.differing_buckets(df, "bucket", F.col("value")).collect()] == ["h"]


@pytest.mark.parametrize("hashed", ["one bucket", "by first letter"])
def test_equal_hashes(spark, odd_docs, odd_texts, tmp_path, monkeypatch, hashed):
    """Equal fingerprints mean equal texts even if the hash says nothing."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda value: F.lit("h") if hashed == "one bucket" else F.left(value, F.lit(1)))
    texts = {k: t for k, t in odd_texts if k is not None} | {20: "abcd", 21: "abcd", 22: "abcdabcd", 23: "aabc"}
    more = spark.createDataFrame([(20, "abcd"), (21, "abcd"), (22, "abcdabcd"), (23, "aabc")], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    rows = [r for r in entry.QUERIES["op10_fingerprints"](spark, table_of(spark, docs, tmp_path)).collect() if r["doc_id"] is not None]
    order = sorted(texts)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    seen = defaultdict(set)
    for r in rows:
        text, after = texts[r["doc_id"]] or "", texts[following[r["doc_id"]]] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        seen[r["fingerprint"]].add(canonical(text))
        seen[r["edited_fingerprint"]].add(canonical(edited))
        assert r["near_edited"] == (canonical(text) == canonical(edited)) and r["near_next"] == (canonical(text) == canonical(after))
    assert all(len(x) == 1 for x in seen.values()) and len({x for y in seen.values() for x in y}) == len(seen)
    classes = {r["doc_id"]: r["class_size"] for r in fingerprints.fingerprints(more).collect()}
    assert classes == {20: 2, 21: 2, 22: 1, 23: 1}


def test_shared_folder(spark, monkeypatch):
    """Only a local session does without a folder that all executors share."""
    from millrace.llm import shared

    assert shared.shared_dir(spark)
    monkeypatch.setattr(shared, "_OWN_DIRS", {})
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1024]"):
        class Session:
            conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
            sparkContext = type("Context", (), {"master": master, "applicationId": "a"})

        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session)


def test_rank_among(spark):
    marks = sorted({(k * k * 7) % 1000 for k in range(60)})
    df = spark.range(-5, 1005)
    from millrace.llm.shared import rank_among

    assert all(r[1] == sum(m <= r[0] for m in marks) for r in df.select("id", rank_among(marks, F.col("id"))).collect())


def test_successors(spark):
    ids = [5, -3, 10**15, 7, 8, 9]
    out = {r["doc_id"]: r["next_id"] for r in fingerprints.successors(spark.createDataFrame([(k,) for k in ids], "doc_id bigint")).collect()}
    order = sorted(ids)
    assert out == dict(zip(order, order[1:] + order[:1], strict=True))
