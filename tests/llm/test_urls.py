"""URL filtering (op3)."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ragtables.llm import url_rules
from ragtables.llm.queries import op3_url_rules


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "http://example.org", "http://a.example.org/en/12?x=http://b", "ftp://x.com#a/b", "http://É.COM/fr/a", "http://a.com/de/?", "http://notexample.org/es/", "x://y://z/q", "http://com/de/1", "http://a.b.org?x=/es/", "http://a.example.org/en/12?x=http://b"]


def test_fixed_rules_match_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    none = spark.createDataFrame([], "page_id long, blocked boolean")
    rows = {r["page_id"]: r for r in url_rules.url_verdicts(pages, none).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule[1], rule[2] if rule else "allow"), u
    assert url_rules.url_verdicts(pages.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(600):
        host = ("m.spam.example.net", "m.fine.example.net", "www.spam.example.com", "www.other.example.net")[i % 4]
        rows.append((i, f"http://{host}/en/{i}" + ("?utm=1" if i % 3 == 0 else ""), i % 4 == 0 or (i % 4 == 2 and i % 3 == 0)))
    return spark.createDataFrame(rows, "page_id long, url string, blocked boolean")


def with_tokens(df):
    host, path = url_rules.host_and_path(F.col("url"))
    return df.select("url", "blocked", url_rules.tokens(F.col("url"), host, path).alias("tokens"))


def test_mined_rules_match_brute_force(spark, labelled):
    rows = with_tokens(labelled).collect()
    count, bad = Counter(), Counter()
    for r in rows:
        for k in range(1, len(r["tokens"]) + 1):
            for part in combinations(sorted(r["tokens"]), k):
                count[part] += 1
                bad[part] += r["blocked"]
    least = max(url_rules.MIN_SUPPORT * len(rows), url_rules.MIN_ROWS)
    good = {p for p in count if bad[p] >= least and bad[p] / count[p] >= url_rules.MIN_CONFIDENCE}
    want = {p for p in good if not any(set(q) < set(p) for q in good)}
    got = {tuple(r["items"]): (r["token"], r["confidence"]) for r in url_rules.mined_rules(with_tokens(labelled)).collect()}
    assert set(got) == want and want
    for items, (token, confidence) in got.items():
        assert confidence == pytest.approx(bad[items] / count[items])
        assert count[token,] == min(count[t,] for t in items)


def test_mined_rules_decide_where_no_fixed_rule_fits(spark, labelled):
    rows = url_rules.url_verdicts(labelled.select("page_id", "url"), labelled.select("page_id", "blocked")).collect()
    assert all(r["verdict"] == ("block" if r["host"] == "m.spam.example.net" or (r["host"] == "www.spam.example.com" and r["page_id"] % 3 == 0) else "allow") for r in rows)


def test_query_covers_every_page(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["page_id"]: r for r in op3_url_rules(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        host, path, rule = plain_rule(p["url"])
        r = rows[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
