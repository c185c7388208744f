"""Scalar functions against input and expected tables."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from crawlscore.functions import robots
from crawlscore.functions import text as tx
from crawlscore.functions import urls

HOME = "https://shop.test/"


def pairs(spark, rows, fn):
    df = spark.createDataFrame(rows, "given string, want string")
    got = df.select("given", "want", fn(F.col("given")).alias("got")).collect()
    assert [(r.given, r.got) for r in got] == [(r.given, r.want) for r in got]


def test_normalize_url(spark):
    good = [
        ("mill.test/grain", "https://mill.test/grain"),
        ("HTTP://Mill.TEST/Grain/Rye", "http://mill.test/Grain/Rye"),
        ("\thttps://mill.test/rye?kg=5#price\n", "https://mill.test/rye?kg=5"),
        ("https://mill.test", "https://mill.test/"),
        ("http://mill.test:443/", "http://mill.test:443/"),
        ("https://mill.test:80/rye", "https://mill.test:80/rye"),
        ("https://baker@mill.test/rye", "https://mill.test/rye"),
        ("www.mühle.test/rye", "https://www.xn--mhle-0ra.test/rye"),
        ("http://192.0.2.7:8080/", "http://192.0.2.7:8080/"),
    ]
    bad = [" \t", "ssh://mill.test/rye", "javascript:alert(1)", "http:///rye", "http://mill.test:70000/"]
    df = spark.createDataFrame(good + [(b, None) for b in bad], "raw string, want string")
    for row in urls.normalize_urls(df, "raw").collect():
        assert row.normalized == row.want, row.raw


def test_absolute(spark):
    base = F.lit("https://mill.test/grain/rye/whole?kg=5")
    pairs(spark, [
        ("flour", "https://mill.test/grain/rye/flour"),
        ("/oven/stone#heat", "https://mill.test/oven/stone"),
        ("../wheat", "https://mill.test/grain/wheat"),
        ("?kg=10", "https://mill.test/grain/rye/whole?kg=10"),
        ("//pictures.mill.test/sack.png", "https://pictures.mill.test/sack.png"),
        ("http://bakery.test/bread", "http://bakery.test/bread"),
        ("#recipe", None), ("tel:+4930123456", None), ("mailto:order@mill.test", None), ("javascript:weigh()", None),
    ], lambda href: urls.absolute(base, href))


def test_site_domain(spark):
    pairs(spark, [
        ("www.shop.com", "shop.com"), ("shop.com", "shop.com"), ("a.b.shop.com", "shop.com"),
        ("www.shop.co.uk", "shop.co.uk"), ("shop.com.bd", "shop.com.bd"),
        (".facebook.com", "facebook.com"), ("localhost", "localhost"),
    ], urls.site_domain)


def test_url_problems_and_clean_url(spark):
    pairs(spark, [
        (f"{HOME}rye-flour/whole", "|"),
        (f"{HOME}RyeFlour", "capital letters|"),
        (f"{HOME}rye_flour", "underscores instead of hyphens|"),
        (f"{HOME}rye%20flour", "spaces|"),
        (f"{HOME}sacks?sid=77f", "session id in the address|"),
        ("http://shop.test/rye", "links to the insecure http:// version|"),
        (f"{HOME}grain/rye/whole/fine/sack", "|more than 4 folders deep"),
        (f"{HOME}order.asp", "|technical ending (asp)"),
    ], lambda u: F.concat(F.array_join(urls.url_problems(u, F.lit(True)), ","), F.lit("|"),
                          F.array_join(urls.url_notes(u), ",")))
    pairs(spark, [(f"{HOME}Rye_Flour//Fine%20Sack?sid=77f&kg=5", f"{HOME}rye-flour/fine-sack?kg=5")],
          urls.clean_url)


def test_alt_problem(spark):
    pairs(spark, [
        ("Two sacks of rye flour by the oven", ""), ("", ""), (None, "no alt text"),
        ("rye-sack.png", "alt text is a file name"), ("Picture", 'alt text "Picture" says nothing'),
    ], tx.alt_problem)


def test_phones(spark):
    pairs(spark, [
        ("Call us: +880 1717-863320 today", "+880 1717-863320"),
        ("Phone (555) 123-4567", "(555) 123-4567"), ("01717863320", "01717863320"),
        ("Copyright 2026. Price 1200000 taka. Order 20261014", ""),
        ("+880 1717-863320 or 01717-863320", "+880 1717-863320"),
    ], lambda t: F.array_join(tx.phones_in(t), ","))


def test_duration_goes_to_the_even_number(spark):
    pairs(spark, [
        ("20", "about 20 minutes"), ("60", "about 1 hour"), ("150", "about 2 hours"),
        ("700", "about 12 hours"), ("720", "about 2 days"), ("1440", "about 3 days"),
    ], lambda m: tx.duration(m.cast("int")))


@pytest.mark.parametrize("a, b, newer", [("3.10", "3.9", True), ("3.5.0", "3.5.0", False), ("3", "3.0", False)])
def test_versions(spark, a, b, newer):
    row = spark.range(1).select(
        (tx.version_tuple(F.lit(a)) > tx.version_tuple(F.lit(b))).alias("x")).head()
    assert row.x is newer


def test_hash_ip_is_hmac(spark):
    want = hmac.new(b"salt", b"10.0.0.1", hashlib.sha256).hexdigest()
    assert spark.range(1).select(tx.hash_ip(F.lit("10.0.0.1"), "salt").alias("h")).head().h == want


def test_robots_decisions(spark):
    text = ("User-agent: GPTBot\nUser-agent: Perplexity # two\nDisallow: /\n\n"
            "User-agent: *\nAllow: /a/open\nDisallow: /a\nDisallow:\n")
    df = spark.createDataFrame([(text,)], "text string").selectExpr(f"{robots.groups_sql('text')} AS g")
    asks = {
        ("GPTBot", "https://x.test/"): False, ("PerplexityBot/1.0", "https://x.test/b"): False,
        ("Other", "https://x.test/a/open/1"): True, ("Other", "https://x.test/a/b"): False,
        ("Other", "https://x.test/b"): True,
    }
    for (agent, url), want in asks.items():
        chr_url = f"'{url}'"
        row = df.selectExpr(f"{robots.allows('g', agent, chr_url)} AS ok").head()
        assert row.ok is want, (agent, url)


def test_escape_and_titles(spark):
    pairs(spark, [('a"<b>&c', "a&quot;&lt;b&gt;&amp;c")], tx.html_escape)
    pairs(spark, [("Pricing | Shop", "Shop"), ("A - B - C", "C"), ("Plain", "Plain")], tx.site_name_from_title)
    pairs(spark, [("Pricing | Shop", "Pricing"), ("Shop", "Shop"), ("A - Shop Ltd", "A")],
          lambda t: tx.title_without_site(t, F.lit("Shop")))
    pairs(spark, [("=1+1", "'=1+1"), ("@x", "'@x"), ("plain", "plain"), (None, "")], tx.safe_cell)
