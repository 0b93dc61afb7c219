from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from crawlscope.functions import text as T
from crawlscope.functions import urls as U
from crawlscope.functions.html import _content, _metadata, page_title
from crawlscope.operators import classify as C
from crawlscope.operators import fetching as E
from crawlscope.operators import topics as P


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


URLS = [
    "https://www.Example.com:8080/a?b#c", "http://user:pw@www.x.gr/", "example.com/path", "//cdn.x.gr/y", "https://ελλάδα.gr/", "http://a b.gr/x y",
    "HTTP://WWW.X.gr", "https://www.x.gr/path|bar", "https://x_y.gr/home/", "", None,
]


def test_domain_is_the_network_location(spark):
    want = [None if not u else (urlparse(u).netloc.removeprefix("www.") or None) for u in URLS]
    assert values(spark, U.domain_of, URLS) == want
    assert values(spark, U.domain_of, ["https://[bad/", "http://www."]) == [None, ""]


@pytest.mark.parametrize(
    "tail, landing",
    [("/home", True), ("/home/", True), ("/home//", True), ("/index.html", True), ("/welcome.php", True), ("/home?", True), ("/home#", True), ("/home;p=1", True)]
    + [(t, False) for t in ("", "/", "/Home", "/en/home", "/home?x=1", "/home#a", "/home.html")],
)
def test_landing_paths(spark, tail, landing):
    assert values(spark, U.is_landing_page, ["http://x.gr" + tail]) == [landing]


def test_domain_cleaning(spark):
    assert values(spark, U.clean_domain_for_fetch, ["HTTPS://www.X.gr/a", "x.gr?y=1", "localhost", None]) == ["x.gr", "x.gr?y=1", None, None]
    given = ["https://www.news.example.gr/a?b", "static.example.org", "example.com.gr", "forum.gr", "a.b", "None", ""]
    assert values(spark, U.clean_domain_for_topics, given) == ["news.example.gr", "example.org", "example.cogr", "forugr", None, None, None]
    assert [tuple(r) for r in values(spark, U.domain_features, ["www.Shop.Example.GR", "localhost"])] == [("shop.example.gr", "shop example", "gr"), ("localhost", "localhost", "")]


def test_texts(spark):
    assert values(spark, T.strip, [" a b\t\n", ""]) == ["a b", ""]
    assert values(spark, T.null_words, [" NULL ", "None", "x", None]) == [None, None, "x", None]
    assert values(spark, T.topic_name, [["news", "breaking", "media"], ["data", "machine learning"], ["tv", "ai"], []], "array<string>") == [
        "News, Breaking & Others", "Data Related", "Mixed Content", "Unknown Topic",
    ]
    got = values(spark, lambda c: T.match_category(c, ["News", "Travel"]), ['"travel"', "", "it is News", None, "x"])
    assert [tuple(r) for r in got] == [("Travel", 0.8), ("Other", 0.5), ("News", 0.8), ("Other", 1.0), ("Other", 0.5)]


def test_html():
    import pandas as pd

    page = """<title> A &amp; B </title><meta name="description" content=""><meta property="og:description" content="d">
    <script>no</script><body>all<div class="content">main <b>text</b></div></body>"""
    m = _metadata(pd.Series([page, None])).iloc[0]
    assert (m.title, m.meta_description, m.keywords, m.og_description) == ("A & B", "d", None, "d")
    assert _content(pd.Series([page, ""])).tolist() == ["Title: A & B | Description:  | OG Description: d | Content: main text", None]


def test_scores_and_decisions(spark):
    votes = spark.createDataFrame([(1, 0, "A", 0.5), (1, 1, "B", 0.6), (2, 0, "A", 0.1)], "k int, model int, category string, confidence double")
    boosts = spark.createDataFrame([(1, 0, "A", 0.2), (2, 2, "C", 0.5)], "k int, rank int, category string, boost double")
    got = {r.k: (r.winner, r.score, r.confidence) for r in C.category_scores(votes, boosts, "k").collect()}
    assert got == {1: ("A", 0.7, 0.5), 2: ("C", 0.5, 0.5)}
    counts = {r.k: (r.n_votes, r.n_tied) for r in C.vote_counts(votes, "k").collect()}
    assert counts == {1: (2, 2), 2: (1, 1)}
    rows = spark.createDataFrame([("t", True, 2, 2, 2, 0.5, "A", 0.5, 0), ("t", True, 6, 6, 6, 0.2, "A", 0.5, 0), ("", True, 2, 1, 1, 0.5, "A", 0.5, 3), ("t", True, 3, 2, 1, 0.5, "A", 0.5, 3)], "a string, b boolean, c int, d int, e int, f double, g string, h double, i int")
    out = [tuple(r[0]) for r in rows.select(C.decide(*[F.col(c) for c in "abcdefghi"])).collect()]
    assert out == [("*A", 0.5, False), ("Other", 0.2, False), ("Other", 0.1, False), ("A", 0.5, False)]


def test_delays(spark):
    df = spark.createDataFrame([(1.9, 429), (0.05, 200), (0.1, 404)], "d double, s int")
    assert [r[0] for r in df.select(E.adapted_delay(F.col("d"), F.col("s"))).collect()] == [2.0, 0.05, 0.1]


def test_titles_decode_all_entities(spark):
    pages = ["<title> caf&eacute; &#8211; &amp;lt; </title>", "<p>none</p>", None]
    assert values(spark, page_title, pages) == ["café – &lt;", "", None]
    assert _metadata(__import__("pandas").Series(pages[:1])).iloc[0].title == "café – &lt;"


def test_small_helpers(spark):
    assert values(spark, T.collapse, ["  a \n\u00a0 b "]) == ["a b"]
    df = spark.createDataFrame([(None, "x"), ("n", "site.gr")], "a string, b string")
    assert T.sniff_domain_column(df) == "b" and T.column_report(df)["domain"] is None
    rows = spark.createDataFrame([("", None), (None, "d"), ("t", None)], "t string, d string")
    assert [r[0] for r in rows.select(E.found_metadata(F.col("t"), F.col("d"))).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        P.require_population(49)


def test_terms_are_worked_out_once(spark):
    texts = [("a", "The cat, the cat sat: cat sat"), ("a", "cat x sat cat"), ("b", "Über"), ("b", ""), ("b", None), (None, "cat sat")]
    df = P.terms(spark.createDataFrame(texts, "s string, x string"), "x", "s")
    n, docs = {}, {}
    for topic, text in texts:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if len(w) > 1 and w not in P.STOP_WORDS]
        each = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for t in each:
            n[topic, t] = n.get((topic, t), 0) + 1
        for t in set(each):
            docs[topic, t] = docs.get((topic, t), 0) + 1
    assert {(r.topic, r.term): (r.n, r.df) for r in df.collect()} == {k: (n[k], docs[k]) for k in n}
    # The words and their pairs: a filter that Spark infers from an explosion would work out both once more.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") == 2
