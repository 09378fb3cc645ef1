import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import html_features as H
from pagesieve.operators import page_graph as G
from pagesieve.operators import rules as R

GOLDEN = """<html><head><title>Confirm your login</title><meta http-equiv="refresh" content="0"><link rel="icon" href="https://cdn.other.test/i.ico"></head><body>
<form method="POST" action="https://collect.other.test/in"><input type="email" name="e"><input type="password"><input type="hidden" name="t"><button type="submit">Go</button></form>
<a href="#">top</a><a href="https://b.other.test/">away</a><a>none</a><p hidden="hidden">x</p><!-- <form> --><script>var s="<p>"; eval(atob("x")); window.location = "/n"; alert(1)</script></body></html>"""
SUFFIXES = frozenset(["test", "example"])


def test_golden_page():
    f = H.features(GOLDEN, None, "https://login.a.test/x", SUFFIXES)
    want = {"form_count": 1, "post_form_count": 1, "external_form_action_count": 1, "null_form_action_count": 0, "input_count": 3, "text_input_count": 0, "email_input_count": 1, "password_input_count": 1, "hidden_input_count": 1, "hidden_input_ratio": 0.333333, "submit_button_count": 1,
            "credential_form_present": 1, "password_form_external_action_present": 1, "anchors_with_href_count": 2, "anchors_missing_href_count": 1, "null_or_empty_anchor_count": 2, "external_anchor_count": 1, "external_anchor_ratio": 0.5, "favicon_count": 1, "external_favicon_count": 1,
            "script_tag_count": 1, "inline_script_count": 1, "meta_refresh_count": 1, "atob_call_count": 1, "eval_call_count": 1, "javascript_redirect_present": 1, "alert_or_popup_present": 1, "hidden_element_present": 1, "title_length": 18, "paragraph_count": 1, "unique_external_resource_domain_count": 1}
    assert {k: f[k] for k in want} == want


@pytest.mark.parametrize("ref, kind", [(None, "null"), ("#x", "null"), ("/", ""), ("/a", "internal"), ("a/b", "internal"), ("//c.x.test/y", "external"), ("https://b.a.test/", "internal"), ("javascript:void(0)", "null"), ("mailto:x@y", ""), ("http://[bad", "internal")])
def test_link_classes(ref, kind):
    assert H.link_class(ref, "https://login.a.test/x", "a.test", SUFFIXES) == kind


def test_html_edges(spark):
    rows = [("1", None, None, None), ("2", "", "t", ""), ("3", "<p" * 5000, None, "x"), ("4", "<p>a</p>" * 20_000, None, "http://a.test"), ("4", "<p>a</p>" * 20_000, None, "http://a.test")]
    out = H.html_features(spark.createDataFrame(rows, "id string, html string, title string, base string"), "id", "html", "title", "base", ["test"])
    got = {r["id"]: r["html_paragraph_count"] for r in out.collect()}
    assert got == {"1": 0, "2": 0, "3": 0, "4": 20_000} and out.count() == 5
    assert H.classical_features(out, "id").where("number_of_paragraphs = 20000").count() == 2


def test_graph_like_the_iteration(spark):
    rng = random.Random(4)
    refs = ["", "#", "/a", "x/y", "https://a.test/1", "https://b.test/2", "//c.test/3", "mailto:x", "https://sub.a.test/"]
    pages = [(str(k), "https://www.a.test/", [rng.choice(refs) for _ in range(rng.randrange(6))], [rng.choice(refs) for _ in range(rng.randrange(6))]) for k in range(60)]
    out = {r["id"]: r for r in G.graph_scores(spark.createDataFrame(pages, "id string, base string, domain_refs array<string>, resource_refs array<string>"), ["test"]).collect()}

    def relation(r):
        if r in ("", "#", "/") or r.startswith("mailto:"):
            return "null", "<null>"
        if not r.startswith(("http", "//")):
            return "relative", "<relative>"
        d = ".".join(r.split("//")[1].split("/")[0].split(".")[-2:])
        return ("local" if d == "a.test" else "foreign"), d

    worth = {"foreign": 1, "null": 1, "relative": 0.25, "local": -1}
    for i, _, dom, res in pages:
        nodes = {}
        for kind, refs_ in (("d", dom), ("r", res)):
            for r in refs_:
                rel, key = relation(r)
                nodes.setdefault((kind, key), []).append(worth[rel])
        base = {k: sum(v) / len(v) for k, v in nodes.items()}
        s, it = dict(base), 0
        for it in range(1, 51):
            if not s:
                break
            m = sum(s.values()) / len(s)
            new = {k: max(-1, min(1, 0.6 * base[k] + 0.4 * m)) for k in s}
            delta = max(abs(new[k] - s[k]) for k in s)
            s = new
            if delta < 1e-5:
                break
        mean = sum(s.values()) / len(s) if s else 0
        var = sum((x - mean) ** 2 for x in s.values()) / len(s) if s else 0
        assert out[i]["score"] == pytest.approx(mean, abs=2e-6) and out[i]["var"] == pytest.approx(var, abs=2e-6) and out[i]["iters"] == it
        d = [x for (k, _), x in s.items() if k == "d"]
        assert out[i]["dom_mean"] == pytest.approx(sum(d) / len(d) if d else 0, abs=2e-6) and out[i]["domain_object_count"] == len(d)


INPUT = "struct<url:string,final_url:string,title:string,visible_text:string,redirects:array<struct<status_code:int,url:string>>,meta:array<map<string,string>>,forms:struct<total_observed:int,items:array<struct<method:string,action:string,name:string,id:string,text:string,inputs:array<map<string,string>>,buttons:array<string>>>>,anchors:struct<total_observed:int,items:array<struct<text:string,href:string,title:string,aria_label:string>>>,iframes:struct<total_observed:int,items:array<struct<src:string,name:string,id:string,title:string,width:string,height:string,style:string>>>,resources:struct<favicon_hrefs:array<string>,stylesheet_href_sample:array<string>,script_src_sample:array<string>,image_src_sample:array<string>>>"


def test_rules(spark):
    form = ("post", "https://other.test/c", None, None, "Password and email address", [{"type": "password"}, None, {"type": "hidden"}], ["Go"])
    full = ("http://a.test/", "http://x.y.z.a.test/" + "p" * 120, "Login", "Your account is locked.", [(301, "u"), None, (302, "v")], [{"name": "robots", "content": "noindex"}, None], (1, [form, None]), (3, [("Help", "#", None, None), None]), (1, [("s", None, None, None, "0", "0", None)]), (["https://cdn.test/i.ico"], None, None, None))
    df = spark.createDataFrame([("1", full), ("2", None), ("3", (None,) * 10)], f"id string, input {INPUT}")
    p = R.prepare(df, ["test"])
    got = {r["id"]: {f["id"] for f in r["features"]} for r in R.evidence(p).collect()}
    assert {"url.long_url", "url.deep_subdomain", "url.http_not_https", "redirect.multi_hop", "meta.robots_noindex_nofollow", "credential.password_input_present", "form.external_action", "form.hidden_inputs", "content.coercive_urgency_near_form", "iframe.hidden_iframe", "brand.favicon_domain_mismatch", "link.null_or_void_anchors"} <= got["1"]
    assert "page.low_semantic_content" in got["2"] and got["2"] == got["3"]
    top = R.evidence(p, exclude=["credential.password_input_present"], most=2).where("id = '1'").first()["features"]
    assert len(top) == 2 and all(f["severity"] != "low" for f in top)
    assert R.evidence(p, include=["url.long_url"]).where(F.size("features") > 0).count() == 1
    m = {r["id"]: r for r in R.measurements(p).collect()}
    assert m["1"]["password_input_count"] == 1 and m["1"]["redirect_count"] == 2 and m["3"]["anchor_count"] == 0
