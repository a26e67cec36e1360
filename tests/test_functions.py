from pyspark.sql import functions as F

from tallyrook.functions import rules as R
from tallyrook.functions import text as X
from tallyrook.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entities(spark):
    assert one(spark, X.decode_entities(F.lit("&#x41;&#66;&#128512; &amp;lt; &LT;b&gt; &nope; &#x110000;"))) == "AB😀 &lt; <b> &nope; &#x110000;"
    assert one(spark, X.decode_entities(F.lit(None).cast("string"))) is None


def test_strip_html(spark):
    assert one(spark, X.strip_html(F.lit("<ul><li>a</li><li>b&amp;c</li></ul><br/>d  e"))) == "a\n b&c\nd e"


def test_normal_text(spark):
    assert one(spark, X.normalize_text(F.lit("Café  Ünï & Co."))) == "caf n co."
    assert one(spark, X.year_month(F.lit("2024"))) == "unknown"
    assert one(spark, X.round2(F.lit(1.005))) == 1.0


def test_paths(spark):
    got = one(spark, X.redact_paths(F.lit("see C:\\Users\\me\\x.txt and /home/me/a.txt at https://u:p@example.com/a/b, \\\\srv\\share")))
    assert got == "see [redacted-path] and [redacted-path] at https://example.com/a/b, [redacted-path]"
    assert len(one(spark, X.redact_paths(F.lit("x" * 5000)))) == 4096
    assert one(spark, X.has_sensitive_path(F.lit("only https://example.com/home/me"))) is False


def test_urls(spark):
    cases = {
        "HTTPS://User:pw@Example.com:443/A/b//?z=1&utm_source=x&a=2#top": "https://example.com/A/b?a=2&z=1",
        "http://example.com": "http://example.com/",
        "http://example.com:8080/x/": "http://example.com:8080/x",
        "Not a URL!": "not a url",
    }
    for url, want in cases.items():
        assert one(spark, U.canonical_url(F.lit(url))) == want
    assert one(spark, U.tracking_count(F.lit("https://e.com/?UTM_x=1&ref=2&q=3"))) == 2
    for host, public in {"a.com": True, "localhost": False, "10.1.2.3": False, "8.8.8.8": True, "172.32.0.1": True, "x.local": False, "intranet": False}.items():
        assert one(spark, U.is_public_host(F.lit(host))) is public
    ranks = [one(spark, U.url_quality(F.lit(u))["rank"]) for u in ("https://a.com/", "http://a.com/", "https://10.0.0.1/", "http://localhost/", "ftp://a.com/", "zzz")]
    assert ranks == [0, 1, 2, 3, 4, 5]


def test_word_boundary_is_ascii(spark):
    assert one(spark, R.says(F.lit("éreact"), ("react",))) is True
    assert one(spark, R.says(F.lit("preact"), ("react",))) is False
    assert one(spark, R.hits(F.lit("React react UI engineer"), R.FRONT_STRONG)) == 2
