"""Functions against values that are known."""

import math

import pytest
from pyspark.sql import functions as F

from loomkit.functions import encoding, geo, hashing, stats, text, validators, web


def value(spark, c):
    return spark.range(1).select(c.alias("v")).head().v


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("make", "want"), [
    (lambda: text.rot13(lit("Hello, World!")), "Uryyb, Jbeyq!"),
    (lambda: text.rot13(lit("")), ""),
    (lambda: text.rot13(lit("naïve Zebra")), "anïir Mroen"),
    (lambda: text.rot13(lit(None).cast("string")), None),
    (lambda: text.slugify(lit("Hello, World!")), "hello-world"),
    (lambda: text.slugify(lit("A B")), "a-b"),
    (lambda: validators.aba_validate(lit("021000021")), True),
    (lambda: validators.aba_validate(lit("021000022")), False),
    (lambda: validators.aba_validate(lit("junk")), False),
    (lambda: validators.aba_validate(lit(None).cast("string")), None),
    (lambda: validators.isin_validate(lit("US0378331005")), True),
    (lambda: validators.isin_validate(lit("US0378331006")), False),
    (lambda: validators.isin_validate(lit("bad")), False),
    (lambda: validators.isin_validate(lit(None).cast("string")), None),
    (lambda: validators.iban_validate(lit("GB82 WEST 1234 5698 7654 32")), True),
    (lambda: validators.iban_validate(lit("GB83 WEST 1234 5698 7654 32")), False),
    (lambda: validators.isbn_validate(lit("0-306-40615-2")), True),
    (lambda: validators.isbn_validate(lit("978-0-306-40615-7")), True),
    (lambda: validators.isbn_validate(lit("080442957X")), True),
    (lambda: validators.isbn_validate(lit("978-0-306-40615-8")), False),
    (lambda: validators.cc_validate(lit("4111 1111 1111 1111")), True),
    (lambda: validators.luhn_validate(lit("79927398713")), True),
    (lambda: F.round(geo.haversine_km(lit(40.7128), lit(-74.0060), lit(34.0522), lit(-118.2437))), 3936.0),
    (lambda: F.round(geo.haversine_mi(lit(40.7128), lit(-74.0060), lit(34.0522), lit(-118.2437))), 2446.0),
    (lambda: geo.haversine_km(lit(1.0), lit(2.0), lit(1.0), lit(2.0)), 0.0),
    (lambda: geo.haversine_km(lit(None).cast("double"), lit(2.0), lit(1.0), lit(2.0)), None),
    (lambda: geo.morton_encode(lit(3), lit(5)), 39),
    (lambda: encoding.base32_encode(lit("Hello").cast("binary")), "JBSWY3DP"),
    (lambda: encoding.base32_decode(lit("JBSWY3DP")).cast("string"), "Hello"),
    (lambda: encoding.base58_encode(lit("Hello World!").cast("binary")), "2NEpo7TZRRrLZSi2U"),
    (lambda: encoding.base58_decode(lit("2NEpo7TZRRrLZSi2U")).cast("string"), "Hello World!"),
    (lambda: encoding.base58_decode(lit("0OIl")), None),
    (lambda: encoding.magic_mime(lit(bytearray(b"\x89PNG\r\n\x1a\nxx"))), "image/png"),
    (lambda: encoding.is_image(lit(bytearray(b"%PDF-1.4"))), False),
    (lambda: encoding.jwt_payload(lit("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiJ4In0.c2ln")), '{"sub":"x"}'),
    (lambda: hashing.murmur3(lit("hello")), 613153351),
    (lambda: hashing.xxh32(lit("")), 46947589),
    (lambda: hashing.sha3_256(lit("")), "a7ffc6f8bf1ed76651c14756a061d662f580ff4de43b49fa82d80a4b80f8434a"),
    (lambda: text.osa(lit("ca"), lit("abc")), 3),
    (lambda: text.damerau_levenshtein(lit("ca"), lit("abc")), 2),
    (lambda: text.indel(lit("kitten"), lit("sitting")), 5),
    (lambda: text.fuzz_ratio(lit("ab"), lit("ab")), 100.0),
    (lambda: text.template_render("{{ a }}-{{ b }}", {"a": lit("x"), "b": lit(2)}), "x-2"),
    (lambda: text.sparkline(F.array(lit(1), lit(2), lit(3))), "▁▄█"),
    (lambda: text.html_to_text(lit("<p>a &amp; <b>b</b></p><script>x</script>")), "a & b"),
    (lambda: text.md_to_html(lit("# T\n\nsome *x* `y`")), "<h1>T</h1>\n<p>some <em>x</em> <code>y</code></p>"),
    (lambda: web.registrable_domain(lit("https://a.b.co.uk/x")), "b.co.uk"),
    (lambda: web.subdomain(lit("https://a.b.example.com:80/x")), "a.b"),
    (lambda: web.public_suffix(lit("http://u@x.com.au?q")), "com.au"),
    (lambda: web.url_pattern_test(lit("/users/7/posts"), "/users/:id/*"), True),
    (lambda: web.url_pattern_match(lit("/users/7"), "/users/:id"), {"id": "7"}),
    (lambda: web.json_schema_valid(lit('{"a": 1}'), {"type": "object", "required": ["b"]}), False),
    (lambda: web.json_to_yaml(lit('{"a": [1, {"b": "x"}]}')), 'a:\n  - 1\n  -\n    b: "x"'),
])
def test_values(spark, make, want):
    assert value(spark, make()) == want


@pytest.mark.parametrize(("make", "want"), [
    (lambda: stats.normal_cdf(lit(1.96), lit(0.0), lit(1.0)), 0.9750021048517795),
    (lambda: stats.normal_quantile(lit(0.975), lit(0.0), lit(1.0)), 1.959963984540054),
    (lambda: stats.binomial_pmf(lit(3), lit(10), lit(0.5)), 0.1171875),
    (lambda: stats.poisson_pmf(lit(2), lit(3.0)), 9 / 2 * math.exp(-3)),
    (lambda: stats.beta_cdf(lit(0.3), lit(2.0), lit(3.0)), 0.3483),
    (lambda: geo.angular_separation(lit(0.0), lit(0.0), lit(90.0), lit(0.0)), 90.0),
    (lambda: geo.equatorial_to_galactic_l(lit(266.40499), lit(-28.93617)), 360.0),
    (lambda: geo.dms_to_deg(lit(-10), lit(30), lit(0)), -10.5),
])
def test_numbers(spark, make, want):
    got = value(spark, make())
    assert abs(got - want) < 1e-3 or abs(got + 360 - want) < 1e-3


def test_tsid_round_trip(spark):
    made = encoding.tsid_from_timestamp(F.lit("2024-05-06 07:08:09.123").cast("timestamp"), F.lit(77))
    row = spark.range(1).select(made.alias("id")).select("id", encoding.tsid_decode(encoding.tsid_encode(F.col("id"))).alias("back"), F.unix_millis(encoding.tsid_timestamp(F.col("id"))).alias("ms")).head()
    assert row.id == row.back and row.ms == 1714979289123


def test_marks_wrapping_and_bars(spark):
    from loomkit.functions import encoding, text

    row = spark.range(1).select(
        text.md_to_text(F.lit("# Head\n\nSome **bold** and *soft* [link](http://x.y) with `code`.\n- one\n2. two")).alias("md"),
        text.wordwrap(F.lit("the quick brown fox jumps over extraordinarily lazy dogs"), 10).alias("wrapped"), text.wordwrap(F.lit(""), 10).alias("none"),
        text.bars(F.array(F.lit(1.0), F.lit(4.0), F.lit(-2.0), F.lit(None))).alias("bars"),
        text.template_valid(F.lit("Dear {{ name }}, {{x}}")).alias("good"), text.template_valid(F.lit("Dear {{ name }")).alias("bad"),
        encoding.magic_matcher_type(F.unhex(F.lit("89504E470D0A1A0A"))).alias("png"), encoding.magic_matcher_type(F.unhex(F.lit("504B0304"))).alias("zip"),
    ).head()
    assert row.md == "Head\n\nSome bold and soft link with code.\none\ntwo"
    assert row.wrapped == "the quick\nbrown fox\njumps over\nextraordinarily\nlazy dogs" and row.none == ""
    assert row.bars == "█" * 5 + "\n" + "█" * 20 + "\n\n"
    assert (row.good, row.bad, row.png, row.zip) == (True, False, "image", "archive")
