"""Page readers on awkward pages, and native reading against the parser on given ones."""
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from cataloom.functions import html

AWKWARD = [
    "<nav><nav>a</nav>hidden</nav>shown",
    "<p>a < b &amp; c &notin; d</p><script>var x = '</p>';</script>e",
    "before<script>never closed",
    "<svg><title>x</title></svg><title>T &eacute; <b>q</b></title><h1>A<i>B</i></h1>rest<!-- c -->more",
    "<a title='x>y' href='/p?a=1&amp;b=2'>go</a><META NAME='Description' CONTENT='it&rsquo;s &copy;'>",
    "",
    "<header>h</header><footer>f</footer>\n\n<p>  </p>body\u00a0",
]


#: Of each awkward page: visible text; title, first heading, description and body.
TEXTS = ["shown", "a\n<\nb & c \u2209 d\ne", "before", "T é\nq\nA\nB\nrest\nmore", "go", "", "body"]
FIELDS = [
    ("", "", "", "a hidden shown"), ("", "", "", "a < b & c \u2209 d e"), ("", "", "", "before"), ("T é q", "A B", "", "rest more"),
    ("", "", "it\u2019s ©", "go"), ("", "", "", ""), ("", "", "", "h f body"),
]
LINKS = [[], [], [], [], ["https://www.a.nl/p?a=1&b=2"], [], []]


def read_awkward(spark, column):
    df = spark.createDataFrame([(i, f"https://www.a.nl/d{i}/x", page) for i, page in enumerate(AWKWARD)], "i int, url string, html string")
    return [r.v for r in column(df).select("i", "v").orderBy("i").collect()]


def test_visible_text(spark):
    assert read_awkward(spark, lambda df: html.with_visible_text(df, "html", "v")) == TEXTS


def test_identity(spark):
    got = read_awkward(spark, lambda df: html.with_identity(df, "html", "v"))
    assert [(r.title, r.h1, r.meta_description, r.body_preview) for r in got] == FIELDS


def test_open_references(spark):
    """The parser decodes a reference without semicolon; the strict reading keeps it, on both ways through a page."""
    page = "<title>A &amp</title><h1>B&euro; &lt</h1>c &amp;lt; &copy d &#38 && e"
    for tail in ("", "<svg><svg>a</svg>b</svg>"):
        df = spark.createDataFrame([(page + tail,)], "html string")
        strict = df.select(html.keep_open_references(F.col("html")).alias("html"))
        assert html.with_visible_text(df, "html", "v").first().v == "A &\nB\u20ac <\nc &lt; \u00a9 d & && e"
        assert html.with_visible_text(strict, "html", "v").first().v == "A &amp\nB\u20ac &lt\nc &lt; &copy d &#38 && e"
        got = html.with_identity(strict, "html", "v").first().v
        assert (got.title, got.h1, got.body_preview) == ("A &amp", "B\u20ac &lt", "c &lt; &copy d &#38 && e")


def test_links(spark):
    assert read_awkward(spark, lambda df: df.withColumn("v", html.links(F.col("html"), F.col("url")))) == LINKS


def test_native_reading_equals_the_parser(spark, small):
    """A page and the same page with a nested skipped element behind it, which only the parser takes, read alike."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    hard = pages.withColumn("html", F.concat("html", F.lit("<svg><svg>a</svg>b</svg>")))
    for read in (lambda df: html.with_visible_text(df, "html", "v"), lambda df: html.with_identity(df, "html", "v")):
        easy, odd = ({r.page_id: r.v for r in read(df).select("page_id", "v").collect()} for df in (pages, hard))
        assert easy == odd


@pytest.mark.parametrize("base", ["https://a.nl", "https://a.nl/x/y.html?q#f", "http://a.nl:80/x/"])
def test_resolve(spark, base):
    hrefs = ["/p", "p/q", "../z", "./w/../v", "?x=1", "//b.nl/c", "https://c.nl/d", "p?u=../k", "..", "a//b"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select(html.resolve(F.lit(base), F.col("h"))).collect()]
    assert got == [urljoin(base, h) for h in hrefs]
