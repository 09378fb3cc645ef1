import pytest
from pyspark.sql import functions as F

from pagesieve.functions import text as T
from pagesieve.functions import urls as U
from pagesieve.operators.url_features import metadata_features, url_features

SUFFIXES = ["example", "test", "co.example"]


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "u string").select(fn(F.col("u")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, host, domain",
    [
        ("https://user:pw@WWW.A.Example.:8443/x", "www.a.example", "a.example"), ("//x.a.co.example/y", "x.a.co.example", "a.co.example"), ("go.a.test/path?u=http://b.test", "go.a.test", "a.test"), ("  http://a.test\n", "a.test", "a.test"), ("http://192.0.2.7:80/", "192.0.2.7", "192.0.2.7"),
        ("https://[2001:db8::1]:443/a", "[2001:db8::1]", "[2001:db8::1]"), ("http://co.example/", "co.example", "co.example"), ("http://a_b.test/x|y z", "a_b.test", "a_b.test"), ("", "", None), (None, None, None), ("http://test", "test", "test"), ("me%40x@a.b.test/c", "a.b.test", "b.test"),
    ],
)
def test_hosts(spark, url, host, domain):
    assert _one(spark, url, U.host) == host
    assert _one(spark, url, lambda c: U.registered_domain(c, SUFFIXES)) == domain


def test_suffixes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_SUFFIXES", 2)
    with pytest.raises(ValueError):
        U.suffix_list(spark.createDataFrame([("a",), ("b",), ("c",)], "suffix string"))


def test_url_features(spark):
    df = spark.createDataFrame([("1", "https://a-b.shop.a.test:8443/x//y.html?q=1&r=%20#f", "http://a.test"), ("2", None, None), ("3", "http://xn--x.test/" + "a" * 50_000, "")], "id string, final string, requested string")
    r = {x["id"]: x for x in url_features(df, "final", "requested", SUFFIXES).collect()}
    a = r["1"]
    assert (a["url_subdomain_length"], a["url_explicit_port_present"], a["url_non_default_port_present"], a["url_has_file_extension"], a["url_extra_double_slash_count"], a["url_query_parameter_count"], a["url_path_segment_count"]) == (8, 1, 1, 1, 1, 2, 2)
    assert r["2"]["url_final_url_length"] == 0 and r["2"]["url_character_entropy"] == 0.0 and r["3"]["url_punycode_present"] == 1 and r["3"]["url_longest_token_length"] == 50_000
    assert len([c for c in a.asDict() if c.startswith("url_")]) == 49


def test_redirect_features(spark):
    rows = [("1", "http://a.test", "https://b.test", [(301, "https://a.test"), (302, ""), (302, "https://b.test/x"), (302, "http://c.b.test")]), ("2", "http://a.test", "http://a.test", None), ("3", None, None, [])]
    df = spark.createDataFrame(rows, "id string, r string, f string, h array<struct<status_code:int,url:string>>")
    r = {x["id"]: x for x in metadata_features(df, "r", "f", "h", SUFFIXES).collect()}
    assert (r["1"]["metadata_redirect_count"], r["1"]["metadata_redirect_domain_change_count"], r["1"]["metadata_final_scheme_changed"], r["1"]["metadata_final_host_changed"]) == (3, 1, 1, 1)
    assert r["2"]["metadata_redirect_count"] == 0 and r["2"]["metadata_final_url_changed"] == 0 and r["3"]["metadata_redirect_domain_change_count"] == 0


def test_text_functions(spark):
    assert _one(spark, " a  b\n", T.collapse_ws) == "a b" and _one(spark, None, T.collapse_ws) == ""
    assert _one(spark, " 12 ", T.safe_int) == 12 and _one(spark, "1.5", T.safe_int) is None
    assert _one(spark, "Write to jo.e+x@a.test now", T.redact_email) == "Write to <email>@a.test now"
    assert _one(spark, "A+B%2F100%", T.unquote) == "a+b%2f100%" and _one(spark, "A%2Fb+c", T.unquote) == "a/b+c"
    assert _one(spark, "x" * 100, lambda c: T.truncate_ends(c, 21)) == "x" * 8 + " ... " + "x" * 8
    assert _one(spark, "Please sign\n in, or Sign In", lambda c: T.matched_terms(c, ["sign in", "log", "please"])) == ["please", "sign in"]
    assert _one(spark, "aaab", lambda c: T.longest_char_run(c, 2)) == 2 and _one(spark, "aab", T.entropy) == pytest.approx(0.9182958)
    assert _one(spark, "rnicro-s0ft", lambda c: T.skeleton(c, {"0": "o"})) == "microsoft"
    assert str(_one(spark, "5f5e10000000000000000000", T.object_id_time)) == "2020-09-13 12:26:40" and _one(spark, "zz", T.object_id_time) is None
    assert _one(spark, "2025-01-02T03:04:05Z", T.parse_date) is not None and _one(spark, "no", T.parse_date) is None
