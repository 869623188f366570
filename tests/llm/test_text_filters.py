"""Toxicity, extraction, URL rules and mixing: planted cases, brute force and awkward rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from tracewarden.llm import catalog, extraction, mixing, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def sql(name, frame, text):
    con = duckdb.connect()
    con.register(name, frame)
    return con.execute(text).df()


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (f[columns].astype(object).where(f[columns].notna(), None).values.tolist() for f in (got, want))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(a, key=key) == sorted(b, key=key)


# ---- toxicity

def toy_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(300)])
    rows = []
    for i in range(n):
        body = list(rng.choice(words, rng.integers(5, 60)))
        toxic = i % 4 == 0
        if toxic:
            body.insert(int(rng.integers(0, len(body))), f"vile{rng.integers(0, 5)}")
        rows.append((i, " ".join(body), int(toxic)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = toy_texts(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).toPandas()
    assert list(out.columns) == ["doc_id", "text", "held_out", "score", "predicted"]
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.itertuples())
    held = out[out.held_out]
    right = [truth[r.doc_id] == r.predicted for r in held.itertuples()]
    assert np.mean(right) > 0.97
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_classifier_with_awkward_rows(spark):
    rows = toy_texts(200, 2)
    docs = spark.createDataFrame(
        [(1000, None), (1001, ""), (None, "vile1 w1"), (1002, "w1 " * 120_000), (1003, "vile2"), (1003, "vile2")], "doc_id long, text string"
    ).unionByName(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).toPandas()
    assert len(out) == 206 and out.score.notna().all()
    assert out[out.doc_id == 1003].score.nunique() == 1
    assert not out[out.doc_id.isna()].held_out.any()
    none = toxicity.classify(docs, labels.limit(0)).toPandas()
    assert (none.predicted == 0).all() and (none.score == 0).all()
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_training_takes_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1 << 17)
    rng = np.random.default_rng(6)
    words, rows = np.array([f"w{i}" for i in range(300)]), []
    for i in range(4000):  # each of many toxic words is in a few documents
        body = list(rng.choice(words, rng.integers(5, 30)))
        if i % 4 == 0:
            k = (i // 4) % 60
            body.insert(int(rng.integers(0, len(body))), f"{zlib.crc32(str(k).encode()):08x}bad")
        rows.append((i, " ".join(body), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels, sample_docs=240).toPandas()
    held = out[out.held_out].sort_values("doc_id")
    assert np.mean(held.predicted == (held.doc_id % 4 == 0)) > 0.97
    again = toxicity.classify(docs.repartition(5), labels, sample_docs=240).toPandas()
    assert again.sort_values("doc_id").score.tolist() == out.sort_values("doc_id").score.tolist()


def test_long_text_scores_like_its_windows():
    rng = np.random.default_rng(3)
    texts = [toxicity.features(t) for _, t, _ in toy_texts(200, 4)]
    model = toxicity.fit(texts, np.array([y for *_, y in toy_texts(200, 4)], np.float32))
    long = np.concatenate([texts[i] for i in rng.integers(0, 200, 4000)])
    assert len(long) > 2 * toxicity.CHUNK_WORDS
    _, tops, _ = model.maxima(long[:, :3], np.array([0, len(long)]))
    assert model.logits([long])[0] == pytest.approx(float(tops[0] @ model.weights + model.bias), abs=1e-3)


# ---- extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site name and a slogan that is long enough to look like the text of an article, with the and of and to in it.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="ad">Buy this now</div>
<article><h1>A head line</h1><p>The first of the   paragraphs is about the weather and the sea,&nbsp;with a <a href="x">link</a> in it &amp; more of the same to come.
<p>Short.</p><div class="comment">I liked the article and the author, it was the best of all the texts that I have read in years.</div>
<p>The last one is a bit longer again: it has to be, for the sake of the test, and so it goes on until it is done with it.</article>
<aside>See also the other articles on the same subject that we have written in the past years for you.</aside><footer>&copy; us</footer>"""


def test_article_without_furniture():
    assert extraction.main_text(PAGE).split("\n") == [
        "A head line",
        "The first of the paragraphs is about the weather and the sea, with a link in it & more of the same to come.",
        "Short.",
        "The last one is a bit longer again: it has to be, for the sake of the test, and so it goes on until it is done with it.",
    ]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("no markup at all, only a few words of the text that is here and that is long enough for a block of its own", None),
    ("<article>Tiny.</article>", "Tiny."), ("<article><p>a<b>b</b>c</p><script>x</script>", "abc"), ("<article><p>&lt;p&gt; &#0; &bogus; &am", "<p> \ufffd &bogus; &am"),
    ("<nav><article><p>Left open before.</p></article>", "Left open before."), ("<article><p title=\"a>b\">quoted</p>", "quoted"),
    ("<div class='page has-sidebar with-ads'><article><p>Beside it.</p></article><div id='sidebar-2'>no</div></div>", "Beside it."),
    ("<article><p>x<!-- never closed", "x"), ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><![CDATA[a<b]]></article>", "a<b"),
])
def test_odd_pages(page, text):
    got = extraction.main_text(page)
    assert got == text if text is not None else isinstance(got, str)


@pytest.mark.parametrize("attributes, kept", [
    ('style="overflow:hidden"', True), ('style="overflow: hidden"', True), ('data-hidden="false"', True), ('title="hidden gems"', True), ("title='the hidden id=comment'", True),
    ('data-id="comment-7"', True), ('data-role="banner"', True), ('data-class="sidebar"', True), ("data-x=a/hidden", True), ('class="text" class="sidebar"', True),
    ("hidden", False), ('hidden=""', False), ("HIDDEN", False), ('style="overflow:hidden" hidden', False), ("aria-hidden = 'true'", False), ('aria-hidden="false"', True),
    ('data-id="x"id="comment-7"', False), ("role=banner", False),
])
def test_attributes_are_whole_names(attributes, kept):
    page = f"<body><div {attributes}><article><p>Words of the article.</p></article></div></body>"
    assert extraction.main_text(page) == ("Words of the article." if kept else "")


def test_blocks_without_article_take_neighbours():
    good = "The house of the family is in the middle of the town and it was built by a man who had come there with his brother, who is not in it any more. " * 2
    page = f"<body><p>{good}</p><p>So be it.</p><p>{good}</p><ul><li><a href=1>Home</a></li><li><a href=2>News and weather</a></li></ul><p>Call us</p></body>"
    lines = extraction.main_text(page).split("\n")
    assert lines[:3] == [good.strip(), "So be it.", good.strip()] and not any("Home" in line for line in lines)


@pytest.mark.parametrize("inner, text", [
    ('<p>See also <a href=x>Alpha paper</a></p>', "See also Alpha paper"), ('<p><a href=x>Alpha paper</a></p>', "Alpha paper"),
    ('<p>Let <math><mi>x</mi><annotation>x_1</annotation></math> be at least 2.</p>', "Let x be at least 2."),
    ('<p>Press the <button>Save</button> key to end.</p>', "Press the Save key to end."), ("<button>Share</button>", None), ("<p><button>Like</button> | <button>Share</button></p>", None),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>", None),
    ("<p>Sources: <a href=1>one</a>, <a href=2>two</a>, <a href=3>three</a>.</p>", "Sources: one, two, three."), ('<p class="notice">Gone</p>', None),
])
def test_links_and_buttons_inside_an_article(inner, text):
    around = "The house of the family is in the middle of the town and it was built by a man who had come there with his brother."
    got = extraction.main_text(f"<nav><a href=0>Home</a></nav><article><p>{around}</p>{inner}<p>{around}</p></article><footer>x</footer>").split("\n")
    assert got == [around] + ([text] if text else []) + [around]


def test_planted_articles():
    rng = random.Random(3)
    stops = extraction.STOP_WORDS["en"]

    def sentence(n):
        return " ".join(rng.choice(stops) if rng.random() < 0.4 else "w" + str(rng.randrange(500)) for _ in range(n)).capitalize() + "."

    furniture = [
        lambda: "<nav>" + "".join(f"<a href=/{i}>{sentence(1)}</a> " for i in range(5)) + "</nav>", lambda: f"<aside><p>{sentence(30)}</p></aside>",
        lambda: f'<div class="ad">{sentence(20)}</div>', lambda: f'<div id="cookie-notice"><p>{sentence(40)}</p></div>', lambda: f"<form><label>{sentence(4)}</label><input></form>",
        lambda: f"<script>var t = '{sentence(8)}';</script>", lambda: f'<section class="comments"><p>{sentence(50)}</p></section>', lambda: f"<!-- {sentence(9)} -->",
    ]
    for _ in range(300):
        want, body = [], ""
        for _ in range(rng.randrange(1, 12)):
            text, kind = sentence(rng.randrange(8, 60)), rng.randrange(5)
            cut_ = text.split(" ")
            body += (f"<p>{text}", f"<p><b>{text}</b></p>", f"<h2>{text}</h2>", f"<blockquote>{text}</blockquote>",
                     f"<p>{cut_[0]} <a href=x>{' '.join(cut_[1:-1])}</a>\n{cut_[-1]}</p>")[kind]
            want.append(text)
            if rng.random() < 0.3:
                body += rng.choice(furniture)()
        page = "<html><body>" + "".join(rng.choice(furniture)() for _ in range(3)) + f"<article>{body}</article>" + "".join(rng.choice(furniture)() for _ in range(3)) + "<footer>&copy;</footer>"
        assert extraction.main_text(page).split("\n") == want


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "<article>" + "word and the " * 30_000, "")], "page_id long, url string, html string, text string")
    out = extraction.extract(pages).toPandas()
    assert len(out) == 4 and list(out.columns) == ["page_id", "url", "text", "n_chars"]
    assert (out.n_chars == out.text.map(len)).all() and out.n_chars.max() > 300_000
    assert extraction.extract(pages.limit(0)).count() == 0


# ---- URL rules

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://x.net", "http://x.net?q", "http://x.net/?q", "http://net/", "http://notnet/", "ftp://sub.example.com/de/x",
    "http://example.com/de", "http://shop.org/fr/a/b#c", "http://org/fr/", "http://evil.com/net/", "no scheme", None, "", "://", "http://a.net:80/", "a://b://c.net/", "http://a.net/en/" + "x" * 30_000,
    "http://example.netx/en/", "http://example.net/en", "http://xexample.net/EN/",
]


def test_url_rules_match_sql(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, catalog.URL_RULES)).select("page_id", "host", "path", "rule", "verdict").toPandas()
    frame = pages.select("page_id", "url").toArrow()
    same(got, sql("pages", frame, catalog.ORACLES["op7_url_filter"]))


def test_rules_without_tokens_or_path(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://c/x")], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("block", "b"), ("allow", "/x")])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, "unknown").collect()}
    assert got[1] == ("b", "block") or got[1] == ("/x", "allow")
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_filter_is_native(spark):
    plan = url_filter.judge(spark.createDataFrame([(1, "x")], "page_id long, url string"), url_filter.rule_table(spark, catalog.URL_RULES))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


# ---- mixing

def test_mixture_matches_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(0, 400)) if i % 9 else None, None if i % 11 == 0 else f"s{min(int(rng.integers(0, 9)), 3)}") for i in range(600)]
    rows += [(None, "abc", "s9"), (7, "yy", "tiny"), (8, "", "empty"), (8, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.replicate(docs.select("doc_id", "source"), mixing.rates(docs)).select("doc_id", "source", "rate", "copy", "shuffle_key").toPandas()
    want = sql("documents", docs.toArrow(), catalog.ORACLES["op8_poisson_mixture"])
    got.rate, want.rate = got.rate.round(9), want.rate.round(9)
    same(got, want)


def test_counts_follow_the_rates(spark):
    rows = [(i, "x" * 100, "a" if i % 3 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("gone", 5.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts["b"] == pytest.approx(2000 * 0.75 * 3, rel=0.08) or counts["b"] > counts["a"] * 2
    per = mixed.where("source = 'b'").groupBy("doc_id").count().toPandas()["count"]
    spread = np.concatenate([per, np.zeros(2000 - len(per))])
    assert spread.var() == pytest.approx(spread.mean(), rel=0.2)
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    again = [tuple(r) for r in mixing.mix(docs.repartition(7), weights).select("doc_id", "copy").collect()]
    assert again == [tuple(r) for r in mixed.select("doc_id", "copy").collect()]


def test_large_rates_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "small"), (2, "b" * 5000, "large")], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert 2200 < n["small"] < 2800
    assert mixing.mix(docs.limit(0)).count() == 0
