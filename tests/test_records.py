import json

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import brands as B
from pagesieve.operators import answers as A
from pagesieve.operators import stage_a
from pagesieve.sources import readers
from pagesieve.sources.store import Store

PAGE = """<!doctype html><html><head><title> Sign  in </title><meta charset=utf-8><meta http-equiv="refresh" content="5"><link rel="shortcut icon" href="https://b.example/i.ico">
<link rel=stylesheet href="/s.css"><script src="/a.js"></script><script>eval(atob(x))</script></head><body>
<form method="POST" action="https://b.example/take" id=f><label for="m">Mail</label><input id="m" type="email" name="mail" value="secret@x"><label>Word <input type=password></label>
<input type="hidden" name="t"><textarea name=n></textarea><select name="s"><option>A<option>B</select><button type="submit">Send <b>it</b></button><input type=submit value="Go"></form>
<a href="#">one</a> <a href="/two" title="t" aria-label="l">two <script>no</script></a><a></a><iframe src="/f" width=1></iframe><img src="/p.png"><noscript>no script</noscript><p>Last</body></html>"""


def test_observation_of_a_page():
    o = stage_a.observation(PAGE, None, stage_a.Limits())
    form = o["forms"]["items"][0]
    assert o["title"] == "Sign in" and o["forms"]["total_observed"] == 1 and {k: form[k] for k in ("method", "action", "id")} == {"method": "POST", "action": "https://b.example/take", "id": "f"}
    inputs = [dict(i) for i in form["inputs"]]
    assert [i["tag"] for i in inputs] == ["input", "input", "input", "textarea", "select", "input"]
    assert inputs[0] == {"tag": "input", "type": "email", "name": "mail", "id": "m", "label": "Mail"} and inputs[1]["label"] == "Word" and inputs[4]["options_sample"] == "A | B"
    assert form["buttons"] == ["Send it", "Go"] and "secret" not in json.dumps(o)
    assert o["anchors"] == {"total_observed": 3, "items": [{"text": "one", "href": "#"}, {"text": "two", "href": "/two", "title": "t", "aria_label": "l"}]}
    assert o["iframes"]["items"] == [{"src": "/f", "width": "1"}] and [dict(m) for m in o["meta"]] == [{"charset": "utf-8"}, {"http_equiv": "refresh", "content": "5"}]
    assert o["resources"] == {"favicon_hrefs": ["https://b.example/i.ico"], "stylesheet_href_sample": ["/s.css"], "script_src_sample": ["/a.js"], "image_src_sample": ["/p.png"]}
    assert o["visible_text"].endswith("one two Last") and "no script" not in o["visible_text"] and "eval" not in o["visible_text"]


def test_limits_and_edges():
    many = "<a href=x>y</a>" * 150 + "<form>" + "<input name=n>" * 150
    o = stage_a.observation(many, "T" * 400, stage_a.Limits())
    assert o["anchors"]["total_observed"] == 150 and len(o["anchors"]["items"]) == 100 and len(o["forms"]["items"][0]["inputs"]) == 100 and len(o["title"]) == 300
    for nothing in (None, "", "<", "<p", "<!-- x", "</a></b>"):
        assert stage_a.observation(nothing, None, stage_a.Limits())["forms"] == {"total_observed": 0, "items": []}
    assert len(stage_a.observation("<div>" * 5000 + "deep", None, stage_a.Limits())["visible_text"]) == 4


def test_observations_as_a_table(spark):
    df = spark.createDataFrame([("a", PAGE, None, 1), ("b", None, "t", 2)], "id string, html string, title string, observed int")
    rows = {r["id"]: r["observed"] for r in stage_a.observations(df, "id", "html", "title").collect()}
    assert rows["a"]["anchors"]["items"][1]["aria_label"] == "l" and rows["b"]["title"] == "t" and rows["b"]["visible_text"] == ""


def test_relationship(spark):
    rows = [("a.x.test", "b.x.test"), ("x.test", "pay.test"), ("x.test", "in.idp.test"), ("one.test", "two.test"), ("x.test", "y.test"), ("", "y.test"), (None, "y.test")]
    kind = B.relationship(F.col("s"), F.col("t"), F.substring_index("s", ".", -2), F.substring_index("t", ".", -2), [("payment", ["pay.test"]), ("identity", ["idp.test"])], {"b": ["one.test", "two.test"]})
    got = [r[0] for r in spark.createDataFrame(rows, "s string, t string").select(kind).collect()]
    assert got == ["same_registrable_domain", "payment", "identity", "same_organization_or_alias", "unrelated_third_party", "unknown", "unknown"]


def test_claims_and_nearest_alias(spark):
    df = spark.createDataFrame([("Sign in to Blue  Bank online",), ("bluebanking",), ("login",), (None,)], "t string")
    got = [[tuple(c) for c in r[0]] for r in df.select(B.claims(F.col("t"), {"bb": ["blue bank", "blue"], "o": ["online"]}, ["login"])).collect()]
    assert got == [[("bb", "blue bank"), ("o", "online")], [], [], []]
    hosts = spark.createDataFrame([("b1uebank.test",), ("my-bluebank.test",), ("blubank.test",), ("rest.test",)], "h string")
    parts = F.transform(B.label_parts(F.col("h"), F.col("h"), ["www"]), lambda x: B.skeleton(x, "01", "ol"))
    got = [r[0] and (r[0]["kind"], r[0]["brand"]) for r in hosts.select(B.nearest_alias(parts, [("bb", "bluebank", "bluebank")])).collect()]
    assert got == [("exact", "bb"), ("embedded", "bb"), ("similar", "bb"), (None, None)]


@pytest.mark.parametrize(
    "text, verdict, inferred",
    [
        ("Phishing risk factors:\n- a\n- none\nReasoning:\nshort\nVerdict: PHISHING", "phishing", "phishing"), ('{"label": "legitimate", "explanation": "all good", "confidence": 0.5}', "benign", "unparseable"), ("<think>verdict: phishing</think> Verdict - benign", "benign", "benign"),
        ("Verdict: phishing. Verdict: benign", "benign", "benign"), ("the page is phishing", "unknown", "phishing"), ("so much text, uncertain", "unknown", "uncertain"), ("uncertain" + " " * 900 + "x", "unknown", "unparseable"), ("", "unknown", "unparseable"), (None, "unknown", "unparseable"),
    ],
)
def test_answers(spark, text, verdict, inferred):
    r = spark.createDataFrame([(text,)], "t string").select(A.parse_answer(F.col("t")).alias("a"), A.infer_verdict(F.col("t")).alias("i")).first()
    assert r["a"]["verdict"] == verdict and (r["i"] == inferred or text.startswith("{"))


def test_answer_parts():
    a = A.parsed_answer("### PHISHING SIGNALS:\n⚠ one\n- two\n### BENIGN SIGNALS:\n- none detected\n### REASONING:\nshort and\nclear\n### VERDICT: PHISHING")
    assert a == {"verdict": "phishing", "phishing_factors": ["one", "two"], "benign_factors": [], "reasoning": "short and clear"}
    assert A.parsed_answer('{"verdict": "phishing", "reasoning": "Predicted as x\\nf", "confidence": 1}') == {"verdict": "phishing", "phishing_factors": ["f"], "benign_factors": [], "reasoning": "Predicted as x\nf Confidence: 1."}


def test_values_in_nested_json(spark):
    doc = {"rdap": {"x": [{"events": [{"eventAction": "registration", "eventDate": "bad"}, {"eventAction": "Registration", "eventDate": "2020-01-02T03:04:05Z"}, {"eventAction": "expiry", "eventDate": "2030-01-01T00:00:00+01:00"}]}]}}
    rows = [(json.dumps(doc), json.dumps({"a": ["x", {"ip": "10.0.0.1"}]})), ("{cut", "none; 300.1.1.1, 8.8.8.8"), (None, None)]
    df = spark.createDataFrame(rows, "d string, i string").select(A.registration_dates(F.col("d")).alias("d"), A.first_ip(F.col("i")).alias("ip"), A.clean_html(F.lit("<p>a &amp; b<script>x</script><!-- c --> d</p>")).alias("t"))
    got = df.collect()
    assert tuple(got[0]["d"]) == ("2020-01-02 03:04:05", "2029-12-31 23:00:00") and [r["ip"] for r in got] == ["10.0.0.1", "8.8.8.8", None] and got[0]["t"] == "a & b d"
    assert A.clean_text("x" * 100, 50) == "x" * 30 + " ... [truncated]"


def test_humanized_and_grounding(spark):
    df = spark.createDataFrame([("url.long_url",), ("redirect.hop",), ("html.x-y_count",), ("",), (None,)], "f string")
    got = [r[0] for r in df.select(A.humanized(F.col("f"), {"url.long_url": "Long."}, [(r"^redirect\.(.+)$", "Redirects: $1.")], {"html": "page"})).collect()]
    assert got == ["Long.", "Redirects: hop.", "Page x y count.", "Unknown feature.", "Unknown feature."]
    one = spark.createDataFrame([(["a", "b", "c", "d"], 5)], "cited array<string>, n int").select(A.grounding(F.col("cited"), {"a": F.col("n") > 3, "b": F.col("n") > 9, "c": F.lit(None).cast("boolean")})).first()[0]
    assert [tuple(g) for g in one] == [("a", "grounded"), ("b", "ungrounded"), ("c", "rule_error"), ("d", "unchecked")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.all().count() == 0
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, document string")
    s.put(rows)
    s.put(spark.createDataFrame([("b", "new")], "id string, document string"))
    s.delete(rows.where("id = 'c'"))
    assert [(r["id"], r["document"]) for r in s.newest(5).collect()] == [("b", "new"), ("a", "1")] and s.get("c").count() == 0


def test_scans(spark):
    df = spark.createDataFrame([(f"{k:03d}", "x" if k % 3 else "y") for k in range(25)], "id string, g string")
    assert [p.count() for p in readers.keyset_scan(df, "id", 10)] == [10, 10, 5] and list(readers.keyset_scan(df.limit(0), "id", 5)) == []
    assert sorted(r["id"] for r in readers.until_quotas(df, "g", "id", {"x": 2, "y": 1}).collect()) == ["000", "001", "002"]
