import json

from pyspark.sql import functions as F

from pagesieve.operators import documents as D

SCHEMA = "id string, url string, title string, html string, metadata struct<url:string,final_url:string,status_code:int>, task struct<url:string>, page struct<url:string,title:string,status:int>, dom struct<data:binary>"


def test_two_shapes(spark):
    rows = [("1", "http://a.test", " A  b ", "<p>", (None, "http://b.test", 200), None, None, None), ("2", None, None, None, None, ("http://c.test",), ("http://d.test", "D", 404), (bytearray("<p>ü".encode()),)), ("3", None, None, None, None, None, None, None), ("4", " ", None, "", (" ", None, None), None, None, None)]
    got = {r["id"]: tuple(r)[1:] for r in D.normalize_document(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"1": ("http://a.test", "http://b.test", 200, "A b", "<p>"), "2": ("http://c.test", "http://d.test", 404, "D", "<p>ü"), "3": (None, None, None, "", None), "4": (None, None, None, "", "")}


def test_paths_and_json(spark):
    schema = spark.createDataFrame([], "a struct<label:string,x:array<struct<Score:int>>>, m map<string,struct<verdict:string>>, my_label string").schema
    assert D.schema_paths(schema) == ["a.label", "a.x[].Score", "m{}.verdict"]
    assert "my_label" in D.schema_paths(schema, ("label",), exact=False)
    df = spark.createDataFrame([('x {"a": {"label": 1}} y',), ("{bad {}",), (None,), ('[1, {"score": 2}]',), ("",)], "t string")
    assert [r["j"] for r in df.select(D.first_json(F.col("t")).alias("j")).collect()] == ['{"a": {"label": 1}}', "{}", None, '{"score": 2}', None]
    assert [r["p"] for r in df.select(D.json_paths(F.col("t")).alias("p")).collect()] == [[], [], [], ["[1].score"], []]


OBSERVATION = (
    "id int, input struct<url:string,final_url:string,title:string,visible_text:string,redirects:array<struct<status_code:int,url:string>>,meta:array<map<string,string>>,"
    "forms:struct<total_observed:int,items:array<struct<method:string,action:string,name:string,id:string,text:string,inputs:array<map<string,string>>,buttons:array<string>>>>,"
    "anchors:struct<total_observed:int,items:array<struct<text:string,href:string,title:string,aria_label:string>>>,"
    "iframes:struct<total_observed:int,items:array<struct<src:string,name:string,id:string,title:string,width:string,height:string,style:string>>>,"
    "resources:struct<favicon_hrefs:array<string>,stylesheet_href_sample:array<string>,script_src_sample:array<string>,image_src_sample:array<string>>>"
)


def test_prune_keeps_every_field_to_its_own_cap(spark):
    long = "x" * 3000
    form = ("post", "data:" + long, "f", None, " a \n b ", [{"type": "text", "value": long}] * 25 + [None], [None, long])
    full = (
        long, " http://b.test/ ", long, "w  " * 2000, [(302, long), None] * 8, [{"name": long, "content": None}, None] * 15, (7, [form, None] * 15), (None, [(long, "", None, "l")] * 40), (50, [("data:" + long, None, None, None, "1", None, None)] * 12),
        (["data:" + long] + ["/i"] * 14, [long] * 25, [long, None] * 12, [long] * 14),
    )
    empty = (None, "", " ", None, None, None, None, (3, None), None, None)
    got = {r["id"]: json.loads(r["o"]) for r in spark.createDataFrame([(1, full), (2, empty), (3, None)], OBSERVATION).select("id", D.prune("input").alias("o")).collect()}
    data = "data:" + "x" * 43 + "<data_uri_truncated>"
    shown = {"method": "post", "action": data, "name": "f", "text": "a b", "inputs": [{"type": "text", "value": long[:240]}] * 20, "buttons": [None, long[:240]]}
    assert got[1] == {
        "url": long[:1000], "final_url": "http://b.test/", "title": long[:300], "visible_text": ("w " * 1250).rstrip(), "redirects": [{"status_code": 302, "url": long[:240]}, None] * 5, "meta": [{"name": long[:240], "content": None}, None] * 10,
        "forms": {"total_observed": 7, "items": [shown, None] * 10}, "anchors": {"total_observed": 40, "items": [{"text": long[:200], "href": "", "aria_label": "l"}] * 20}, "iframes": {"total_observed": 50, "items": [{"src": data, "width": "1"}] * 10},
        "resources": {"favicon_hrefs": [data] + ["/i"] * 9, "script_src_sample": [long[:200], None] * 10, "stylesheet_href_sample": [long[:200]] * 20, "image_src_sample": [long[:120]] * 10},
    }
    nothing = {"redirects": [], "meta": [], "resources": {"favicon_hrefs": [], "script_src_sample": [], "stylesheet_href_sample": [], "image_src_sample": []}} | {k: {"total_observed": 0, "items": []} for k in ("forms", "anchors", "iframes")}
    assert got[2] == nothing | {"anchors": {"total_observed": 3, "items": []}}
    assert got[3] == nothing


def test_banned_paths_by_part_of_the_name_in_whole_lists(spark, tmp_path):
    from pagesieve.plans.document_queries import banned_paths

    deep = [{"href": "/"}] * 150 + [{"WHOIS Server": 1}, {"whois-server": 1}]
    lines = [{"rdap_events": [{"x": 1}], "input": {"whois.registrar": {"Creation-Date": 1}}, "label": 1, "rd ap": 1}, {"anchors": deep}, [{"domainAge": 1, "domain__age": 1}, {"a": [[{"Domain Age (days)": None}]]}]]
    texts = [json.dumps(x) for x in lines] + [json.dumps(json.dumps(lines[0])), '{"rdap": 1', None, '"rdap"', "[" * 900 + '{"registrant": 1}' + "]" * 900]
    spark.createDataFrame([(t,) for t in texts], "payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    got = {r["path"]: r["n"] for r in banned_paths(spark, tmp_path).collect()}
    assert got == {
        "rdap_events": 2, "input.whois.registrar": 2, "input.whois.registrar.Creation-Date": 2, "anchors[].WHOIS Server": 1, "anchors[].whois-server": 1, "[].domain__age": 1, "[].a[][].Domain Age (days)": 1, "[]" * 900 + ".registrant": 1,
    }
    twice = spark.createDataFrame([(json.dumps({"a": [{"rdap": 1}, {"rdap": 2}]}),)], "payload string")
    twice.write.parquet(f"{tmp_path}/b/raw_records.parquet")
    assert [tuple(r) for r in banned_paths(spark, f"{tmp_path}/b").collect()] == [("a[].rdap", 1)]
