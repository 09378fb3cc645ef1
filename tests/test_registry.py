from pyspark.sql import functions as F

from pagesieve.operators import registry, rules

INPUT = (
    "url:string,final_url:string,title:string,visible_text:string,redirects:array<struct<status_code:int,url:string>>,meta:array<map<string,string>>,"
    "forms:struct<total_observed:int,items:array<struct<method:string,action:string,name:string,id:string,text:string,inputs:array<map<string,string>>,buttons:array<string>>>>,"
    "anchors:struct<total_observed:int,items:array<struct<text:string,href:string,title:string,aria_label:string>>>,"
    "iframes:struct<total_observed:int,items:array<struct<src:string,name:string,id:string,title:string,width:string,height:string,style:string>>>,"
    "resources:struct<favicon_hrefs:array<string>,stylesheet_href_sample:array<string>,script_src_sample:array<string>,image_src_sample:array<string>>"
)


def _found(spark, **given):
    empty = dict.fromkeys(("url", "final_url", "title", "visible_text", "redirects", "meta", "forms", "anchors", "iframes", "resources"))
    row = empty | given
    df = spark.createDataFrame([("a", tuple(row.values()))], f"id string, input struct<{INPUT}>")
    features = registry.evidence(rules.prepare(df, ["test", "co.test"])).first()["features"]
    return {f["id"]: f["direction"] for f in features}


def test_login_page(spark):
    form = ("post", "https://other.test/take", None, None, "Sign in with your password", [{"type": "password"}, {"type": "hidden"}], ["Go"])
    got = _found(
        spark, url="http://start.test/", final_url="http://a.b.site.test/login", title="403 Forbidden", visible_text="Urgent: your account is locked. Мы Mail me at x@gmail.com. Invoice here.", redirects=[(301, "x"), (302, "y")],
        meta=[{"name": "robots", "content": "noindex"}, {"name": "generator", "content": "cms"}], forms=(1, [form]), anchors=(4, [("Forgot password", "#", None, None), ("Help", "/help", None, None), ("Sign up", "https://far.test/x", None, None), None]), iframes=(1, [("/f", None, None, None, "0", "0", None)]),
    )
    want = {
        "url.domain_structure": "suspicious", "page.http_login": "suspicious", "redirect.chain_length": "suspicious", "redirect.destination_change": "suspicious", "form.credential_collection": "suspicious", "form.password_cues": "suspicious", "form.action_external_mismatch": "suspicious",
        "link.recovery": "benign", "link.signup": "neutral", "contact.presence": "benign", "contact.free_provider_email": "neutral", "anchors.nonfunctional": "suspicious", "links.external_offsite": "neutral", "urgency.language": "suspicious", "content.transactional_lure": "suspicious",
        "language.mix_or_localization_mismatch": "uncertain", "meta.robots_noindex": "suspicious", "meta.cms_or_security_metadata": "neutral", "iframe.hidden_or_zero_sized": "uncertain", "page.access_blocked_or_error": "uncertain", "anchors.inventory": "neutral",
    }
    assert {k: got.get(k) for k in want} == want
    assert "redirect.https_upgrade" not in got and "page.low_semantic_content" not in got and "navigation.internal" not in got


def test_nothing_there(spark):
    got = _found(spark)
    assert got["page.low_semantic_content"] == "uncertain" and set(got) == {"form.presence", "anchors.inventory", "page.low_semantic_content"}
    assert len(registry.table()) == 50


def test_selection(spark):
    df = spark.createDataFrame([("a", "Cookie policy")], "id string, m_low string")
    assert [f["id"] for f in registry.evidence(df, include=["cookie.notice", "urgency.language"]).first()["features"]] == ["cookie.notice"]
