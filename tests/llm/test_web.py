"""WARC archives (op8) and HTML extraction (op10)."""

import hashlib
import html
import re

import duckdb
import pytest

from ragtables.llm import html_text, warc
from ragtables.llm.queries import OP8_SQL, op8_warc, op10_html_text

SF = "/root/testdata/sf0.001"
LONG = "é" * 600
PAGES = [
    (1, "http://a\r\nX: y", LONG), (2, None, LONG), (3, "u", None), (4, "u", "WARC/1.0\r\n\r\n" + "x" * 2000), (5, "u", "WARC/1.0\r\n\r\n" + "x" * 2000),
    (5, "u", "WARC/1.0\r\n\r\n" + "x" * 2000), (None, "u", LONG), (7, "u", "a" * 999), (8, "u", "a" * 999), (9, "u", ""), (10, "u", "b" * 300_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, original int")


def plain_records(rows):
    """Expected rows of the round trip."""
    largest: dict = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            largest[raw] = max(largest.get(raw, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = largest.get(raw) if p is not None and largest.get(raw, p) != p else None
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def columns(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_round_trip_of_awkward_pages(spark):
    assert columns(warc.round_trip(pages(spark)).collect()) == plain_records(PAGES)
    assert warc.round_trip(pages(spark).limit(0)).collect() == []


def test_hot_payload(spark):
    rows = [(i, "u", "c" * 1500 if i % 3 else f"{i}" * 400) for i in range(200)]
    assert columns(warc.round_trip(pages(spark, rows)).collect()) == plain_records(rows)


def test_archives_hold_whole_records(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark), path)
    records = warc.read_archive(spark, path).collect()
    payloads = sorted(bytes(r["payload"]) for r in records if r["record_type"] == "response")
    want = [(h or "").encode() for (p, _, h), r in zip(PAGES, [None] * len(PAGES), strict=True) if p not in (1, 4)]
    assert payloads == sorted(want)
    ids = [r["record_id"] for r in records if r["record_type"] == "response"]
    assert {r["refers_to_id"] for r in records if r["record_type"] == "revisit"} <= set(ids)
    assert all("\r" not in r["target_uri"] for r in records)


def test_broken_archive_is_an_error(spark):
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"nothing", "x"))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({OP8_SQL})").fetchall()
    assert columns(op8_warc(spark, SF).collect()) == sorted(want, key=str)


def test_article_text_of_the_pages(spark):
    rows = {r["page_id"]: r for r in op10_html_text(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", p["html"], re.S)[1]
        inner = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        got = rows[p["page_id"]]
        assert got["text"] == want and got["n_chars"] == len(want) and got["url"] == p["url"]


OTHER = [
    ('<html><head><title>T</title></head><body><header><h1>Site name</h1><nav><a href=/>Home</a><a href=/b>About</a></nav></header><div class="cookie-notice"><p>We use cookies to give you the best experience. By going on you accept them, as we say in the policy.</p></div><div id="content"><h1>The title of it</h1><p>First paragraph of the story, with <b>bold</b> and <a href=x>a link</a> in it.</p><!-- <p>no --><p>Second paragraph is a bit longer, and says more about the same thing, over and over.</p><ul><li>one item of text<li>another item</ul></div><aside class="sidebar"><h3>Related</h3><ul><li><a>Other story</a></li></ul></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I think that this is a very good story, thank you for it.</p></div></section><form><label>Your mail</label><input></form><footer>&copy; 2024 Site &middot; all rights</footer></body></html>',
     "The title of it First paragraph of the story, with bold and a link in it. Second paragraph is a bit longer, and says more about the same thing, over and over. one item of text another item"),
    ('<div class="page"><div class="menu"><a href=1>A</a> <a href=2>B</a></div><div class="post"><h2>Head</h2><div>Some text here, that goes on for a while; it is the article itself, and it is good.</div><div class="ad">Buy now! Cheap offer for you.</div><div>More of the text follows after the advert, which is not part of it.</div></div><div id="footer">Imprint</div></div>',
     "Head Some text here, that goes on for a while; it is the article itself, and it is good. More of the text follows after the advert, which is not part of it."),
    ("<p>caf&eacute;&nbsp;&#39;x&#x27;\n &hellip; a<b>b</b>c <script>var t='</p>';</script>end<p", "café 'x' … abc end"),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_other_layouts(spark, trees):
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(OTHER)] + [(None, None, OTHER[2][0], "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), trees).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None} == {i: t for i, (_, t) in enumerate(OTHER)}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_without_articles_all_text_is_kept(spark):
    df = spark.createDataFrame([(1, "u", "<div>a</div><p>b"), (2, "u", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == {1: "a b", 2: ""}
    assert html_text.main_text(df.limit(0)).collect() == []


def test_decoding_keeps_ancestors_and_is_the_best_choice():
    import itertools
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        keep = html_text.decode(parent, odds)
        assert all(keep[p] for i, p in enumerate(parent) if keep[i] and p >= 0)
        best = max(sum(o for o, k in zip(odds, c, strict=True) if k) for c in itertools.product((0, 1), repeat=n) if all(c[p] for i, p in enumerate(parent) if c[i] and p >= 0))
        assert odds[keep].sum() == pytest.approx(best)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><body><article><p>Main text</p></article>", "Main text"),
        ("<html><head><title>x</title><meta charset=utf-8><link rel=a><style>p{}</style><p>Main<p>text", "Main text"),
        ("<html><head><title>x</title>Main text<p>more", "Main text more"),
        ("<HEAD><TITLE>x</TITLE><noscript><link><p>no</noscript></HEAD><body>Main text</body>", "Main text"),
        ("<head><script>if (a < b) '<p>'</script><title>x<body><p>Main text", "Main text"),
        ('<p>a</p><svg width="1"/><article>Main <svg/>text</article>', "a Main text"),
        ("<p>a<svg><g><path d='1'/></g><title>icon</title><text>no</text></svg>b</p>c", "ab c"),
        ("<p>a<svg><svg>no</svg>no</svg>b</p>", "ab"),
        ("<div><button>OK</div><article>Main text</article>", "Main text"),
        ("<button>OK<p>Main text</p><button>no</button>more", "Main text more"),
        ("<p>a <span><svg><path d=1></span>b <b>c</b></p>d", "a b c d"),
        ("<button>A<button>B</button> Main text", "Main text"),
        ("<p>a<select><option>no<option>no</select> b<select><option>no</p>c", "a b c"),
        ("<div><noscript>no</div>Main<iframe src=x></iframe> <iframe src='y'/>text<object data='z'><p>more", "Main text more"),
        ("<p>a<textarea></p><p>no</textarea>b</p><template><p>no</p></template>c", "ab c"),
        ("<p>a<button><div>no</div>no</button> b<math><mi>x</mi></math></p>", "a b"),
        ("<p>a</p><script>no <p>no", "a"),
        ("<p>a</p><!-- no <p>no", "a"),
        ("<p>a<svg", "a"),
    ],
)
def test_only_dropped_elements_are_lost(page, want):
    nodes = html_text.Nodes()
    nodes.parse(0, page)
    assert " ".join(t for t in nodes.text if t) == want
