import re
import sys
import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from cataloom.functions import geo, prices, text, urls, vocab


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalise_text(spark):
    got = values(spark, [("  Huis\t\u00a0Zypendaal ",), ("e\u0301te\u0301",), ("   ",), (None,)], "t string", text.normalise_text(F.col("t")))
    assert got == [("Huis Zypendaal",), ("\u00e9t\u00e9",), (None,), (None,)]


def test_collapse_agrees_with_unicode_white_space(spark):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and re.match(r"\s", chr(c))]
    got = values(spark, [(f"a{c}{c}b",) for c in every], "t string", text.collapse_space(F.col("t")))
    assert {g[0] for g in got} == {"a b"}


def test_residue_classes_cover_every_character_that_needs_python():
    def java(pattern):
        return re.compile(re.sub(r"\\p\{M\}", "".join(map(re.escape, marks)), re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)))

    codes = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    marks = [chr(c) for c in codes if unicodedata.category(chr(c)).startswith("M")]
    seconds = {int(d[1], 16) for d in (unicodedata.decomposition(chr(c)).split() for c in codes) if len(d) == 2 and not d[0].startswith("<")}
    nfc, nfkd = java(text._NFC_RESIDUE), java(text._NFKD_RESIDUE)
    for code in codes:
        char = chr(code)
        if unicodedata.combining(char) or code in seconds or unicodedata.normalize("NFC", char) != char:
            assert nfc.match(char) and code >= 0x300
        base = [p for p in unicodedata.normalize("NFKD", char) if not unicodedata.combining(p)]
        if len(base) > 1 and any(p.isascii() and p.isalnum() for p in base):
            assert nfkd.match(char)


def test_folding_and_tokens(spark):
    got = values(spark, [("ZYPENDA\u00c1L",), ("zypendaa\u0301l",), ("\ufb01ets \u00bd",)], "t string", text.fold(F.col("t")), text.token_key(F.col("t")))
    assert got == [("zypendaal", "zypendaal"), ("zypendaal", "zypendaal"), ("\ufb01ets \u00bd", "fiets12")]
    got = values(spark, [("Nationaal Molenmuseum De Valk", "Den Haag"), ("Museum", None)], "n string, c string", text.distinctive_tokens(F.col("n"), F.col("c")))
    assert got == [(["haag", "molen", "molenmuseum", "valk"],), ([],)]


def test_match_forms(spark):
    got = values(spark, [("\u00e2\u201a\u00ac\u00a012,00 | Adult&nbsp;",)], "t string", text.match_norm_loose(F.col("t")), text.match_norm(F.col("t")))
    assert got == [("\u20ac 12,00 adult", "\u00e2\u201a\u00ac 12,00 | adult")]


def test_clean_city(spark):
    got = values(spark, [("in Laren (Gelderland)",), (" Ammerzoden, Gelderland .",), ("Inverdan",)], "t string", text.clean_city(F.col("t")))
    assert got == [("Laren",), ("Ammerzoden",), ("Inverdan",)]


def test_scrub(spark):
    rows = [("key sk-abcdefghijkl1 and Bearer abcdefghijkl",), ("API_KEY = 'abcdefghijk'",), ("plain",)]
    got = values(spark, rows, "t string", text.scrub(F.col("t")))
    assert got == [(f"key {vocab.SECRET_MARK} and {vocab.SECRET_MARK}",), (vocab.SECRET_MARK,), ("plain",)]


def test_postcodes(spark):
    got = values(spark, [("1071dj",), ("297 bp",), ("99712 KN",), ("",)], "t string", geo.normalise_postcode(F.col("t")))
    assert got == [("1071 DJ",), ("297 BP",), ("99712 KN",), (None,)]
    got = values(spark, [("Laan 1258 | 2597BP Den Haag",), ("297 BP",), ("nothing",)], "t string", geo.extract_postcode(F.col("t")))
    assert got == [("2597 BP",), ("297 BP",), (None,)]
    got = values(spark, [("Plein 12a-3 bis",), ("Plein",)], "t string", geo.house_number(F.col("t")))
    assert got == [("12a-3",), (None,)]


def test_geo(spark):
    got = values(spark, [("POINT(4.123456789 52.1)",), ("POINT(1.0 52.1)",), ("x",)], "t string", geo.parse_wkt_point(F.col("t")))
    assert [tuple(g[0]) if g[0] else None for g in got] == [(52.1, 4.123457), None, None]
    km = values(spark, [(52.3676, 4.9041, 52.0907, 5.1214)], "a double, b double, c double, d double", geo.haversine_km(*map(F.col, "abcd")))[0][0]
    assert 30 < km < 40


def test_urls(spark):
    rows = [("https://www.Museum.nl:8080/a/b/?q=1#x",), ("not a url",), ("//tickets.museum.nl/",), ("",)]
    got = values(spark, rows, "u string", urls.extract_domain(F.col("u")), urls.base_domain(urls.host(F.col("u"))), urls.same_or_subdomain(F.col("u"), F.lit("museum.nl")), urls.is_blocklisted(F.col("u")))
    assert got == [("museum.nl", "museum.nl", False, True), ("", "", False, False), ("tickets.museum.nl", "museum.nl", True, True), ("", "", False, True)]
    got = values(spark, [("httpsmuseum.nl/x",), ("https:/museum.nl",), ("http://a.nl",)], "u string", urls.repair_scheme(F.col("u")))
    assert got == [("https://museum.nl/x",), ("https://museum.nl",), ("http://a.nl",)]
    got = values(spark, [("https://a.nl",), ("/x",), ("#a",), (None,), ("https://www.vriendenloterij.nl",)], "u string", urls.is_external(F.col("u")))
    assert got == [(True,), (False,), (False,), (False,), (False,)]


def test_price_literals(spark):
    got = values(spark, [(Decimal("12.50"),), (Decimal("12.00"),)], "p decimal(9,2)", prices.price_literals(F.col("p")))
    assert sorted(got[0][0]) == ["12,5", "12,50", "12.5", "12.50"]
    assert sorted(got[1][0]) == ["12", "12,-", "12,00", "12-", "12.00"]
    rows = [("entree 15 euro", Decimal("5.00")), ("entree 5,- p.p.", Decimal("5.00")), ("a 15,50", Decimal("15.00"))]
    got = values(spark, rows, "t string, p decimal(9,2)", prices.price_in_text(F.col("t"), F.col("p"), compat=False), prices.price_in_text(F.col("t"), F.col("p")))
    assert got == [(False, True), (True, True), (False, True)]


def test_wilson(spark):
    ci = prices.wilson_interval(F.col("k"), F.col("n"))
    got = values(spark, [(0, 0), (12, 12), (17, 17), (13, 13)], "k int, n int", ci["low"], ci["high"])
    assert got[0] == (0.0, 100.0)
    assert 70 <= got[1][0] <= 80 and got[1][1] == 100.0
    assert got[2] == (81.6, 100.0) and got[3] == (77.2, 100.0)
