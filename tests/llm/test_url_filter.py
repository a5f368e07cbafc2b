"""URL rules and template trees against SQL, planted branches and odd urls."""

from __future__ import annotations

import random

import compare
import pytest
from pyspark.sql import functions as F

from millrace.llm import entry, url_filter

ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET", "http://a.example.net/", "http://a.example.net/en/x?y#z", "http://example.net/en/", "http://notexample.net/en/",
    "http://xexample.com/de/1", "http://u@sub.example.com:80/de/1", "http://sub.example.com/de", "http://sub.EXAMPLE.com/de/", "http://sub.example.com/DE/", "http://x.org/fr/1", "https://org/fr/", "x://borg/fr/",
    "http://x.org?fr/", "http://x.org#/fr/", "a://b://net/c", "http://ÄÖ.org/ü/\n1", "http://x.org/{n}/1", "http://x.org//", "http://x.org/" + "a" * 70 + "/b", "http://x.org/2024-01-02/deadbeef01/1.html/2/3/4", "http://x.org/%20/ ", "net", "http://net/1",
]


def generated(n, seed=3):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        host = draw.choice(["big.example.com"] * 3 + ["a.example.org", "b.example.org", "x.example.net", "y.example.com"])
        first = draw.choice(["en", "fr", "de", "es", f"slug{draw.randint(0, 400)}", "shop"])
        rest = {"shop": f"{draw.choice(['cart', 'item'])}/{draw.randint(1, 99)}/a/b"}.get(first, f"{draw.randint(1, 9999)}{draw.choice(['', '/', '.html', '?page=2'])}")
        out.append(f"https://{host}/{first}/{rest}")
    return out


def folder(spark, tmp_path, urls):
    rows = [(k if k % 9 else None, u) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({c: F.lit("own") for c in ("html", "host", "template", "label", "shape", "pages", "token")})
    df.write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_against_sql(spark, sf_dir):
    assert not compare.difference(entry.QUERIES["op13_url_filter"](spark, sf_dir), compare.connect(sf_dir), entry.ORACLE_SQL["op13_url_filter"])


@pytest.mark.parametrize("few", [True, False])
def test_odd_and_generated_urls(spark, tmp_path, monkeypatch, few):
    """Also with every template joined as if there were too many to broadcast."""
    if not few:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(url_filter, "HOT", 20)
    sf = folder(spark, tmp_path, ODD * 2 + generated(2500))
    found = entry.QUERIES["op13_url_filter"](spark, sf)
    assert not compare.difference(found, compare.connect(sf), entry.ORACLE_SQL["op13_url_filter"])
    templates = {r["template"] for r in found.select("template").collect()}
    assert any(t.startswith("big.example.com/{~:{n}}/") for t in templates) and "big.example.com/de/{n}" in templates and not any("slug" in t for t in templates if t.startswith("big"))


def test_rules_of_odd_urls(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    found = {r["url"]: r for r in url_filter.filter_urls(df).collect()}
    for url in ODD:
        host, path = "", ""
        if url and "://" in url:
            after = url.split("://", 1)[1]
            cut = min([after.index(c) for c in "/?#" if c in after] or [len(after)])
            host = "".join(c.lower() if c.isascii() else c for c in after[:cut])
            path = after[cut:].split("?")[0].split("#")[0]
        fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        r = found[url]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits, key=len) if fits else None)
        assert r["verdict"] == dict((b, a) for a, b in url_filter.RULES).get(r["rule"], "allow")


def test_labelled_templates(spark):
    """A branch labelled as bad is rejected with its unlabelled pages, one of rare slugs too; mixed and thinly labelled ones stay."""
    rows = []
    for k in range(400):
        rows.append((f"http://h.test/spam/{k}", "block" if k % 2 else None))
        rows.append((f"http://h.test/good/{k}", "allow" if k % 2 else None))
        rows.append((f"http://h.test/mixed/{k}", ("block", "allow", None)[k % 3]))
        rows.append((f"http://slugs.test/buy-{k}-now/{k}", "block" if k % 3 else None))
        rows.append((f"http://thin.test/a/{k}", "block" if k < 5 else None))
        rows.append((f"http://twins.test/{'ab'[k % 2]}/{k}", "block" if k % 4 < 2 else None))
    df = spark.createDataFrame(rows, "url string, label string")
    found = url_filter.filter_urls(df, rules=(), label_col="label")
    assert found.columns == ["url", "label", "host", "path", "rule", "verdict", "template", "purity"] and found.count() == len(rows)
    blocked = {(r["host"], r["path"].split("/")[1][:3]) for r in found.where("verdict = 'block'").collect()}
    assert blocked == {("h.test", "spa"), ("slugs.test", "buy"), ("twins.test", "a"), ("twins.test", "b")}
    assert found.where("verdict = 'block' and label is null").count() > 200
    assert found.where("host = 'twins.test'").select("template").distinct().count() == 1
    assert found.where("host = 'slugs.test'").select("template").distinct().count() == 1


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, verdict string, `__own__` int")
    found = url_filter.filter_urls(none)
    assert not found.collect() and found.columns == ["page_id", "url", "__own__", "host", "path", "rule", "verdict", "template", "purity"]
