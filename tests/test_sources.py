import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from pagesieve.sources import readers, sinks
from pagesieve.streaming import pages as streams


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n{"a": 2}\n')
    df = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b struct<c:string>")
    assert [(r["a"], r["b"]["c"] if r["b"] else None) for r in df.orderBy("a").collect()] == [(1, "x"), (2, None)]
    sinks.jsonl(df, str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), "a int, b struct<c:string>").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert [r["_corrupt"] for r in readers.jsonl(spark, str(tmp_path / "b.jsonl"), "a int", "keep").orderBy("_corrupt").collect()] == [None, '{"a": ']
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", None, 'a,"b"\nc'), ("2", "phishing", "")], "id string, label string, text string")
    sinks.csv(df, str(tmp_path / "c"), ["id", "label", "text", "none"])
    back = readers.csv(spark, str(tmp_path / "c"), "id string, label string, text string, none string", ["id", "text"])
    assert back.count() == 2 and back.where("id = '1'").first()["text"] == 'a,"b"\nc'
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "c"), "id string", ["missing"])
    with pytest.raises(Exception):
        readers.csv(spark, str(tmp_path / "c"), "id string, label string, text string, none string", labels=("label", ["phishing"])).collect()


def test_arff(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2), (3.5, None)], "x double, y int")
    sinks.arff(df, str(tmp_path / "d"), "r")
    back = readers.arff(spark, str(tmp_path / "d"))
    assert back.dtypes == [("x", "double"), ("y", "double")] and {(r["x"], r["y"]) for r in back.collect()} == {(1.0, 2.0), (3.5, None)}


def test_archives_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("s1/html.txt", "<p>é</p>".encode("latin-1"))
        z.writestr("s1/info.txt", "{'url': 'http://a.test/'}")
        z.writestr("s2/html.txt", "<p>x</p>")
    got = {r["page"]: (r["url"], r["html"]) for r in readers.zip_pages(spark, str(tmp_path / "p.zip")).collect()}
    assert got == {"s1": ("http://a.test/", "<p>é</p>"), "s2": ("", "<p>x</p>")}
    (tmp_path / "site" / "deep").mkdir(parents=True)
    (tmp_path / "site" / "deep" / "html.txt").write_text("<b>")
    (tmp_path / "site" / "deep" / "info.txt").write_text("http://b.test/\nmore")
    assert [(r["url"], r["html"]) for r in readers.dir_pages(spark, str(tmp_path / "site")).collect()] == [("http://b.test/", "<b>")]


def test_small_ones(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", bytearray(gzip.compress("ü".encode()))), ("2", None, bytearray(b"x")), ("3", "", None)], "id string, html string, data binary")
    assert [r["t"] for r in df.select("id", readers.gunzip("data").alias("t")).orderBy("id").collect()] == ["ü", "x", None]
    assert readers.html_filter(df).count() == 1
    assert readers.point_lookup(df, "a", ["id", "html"]).count() == 1
    assert readers.capped(df.withColumn("l", F.lit("x")), "l", "id", 2).count() == 2
    with pytest.raises(ValueError):
        readers.collections({"a": df}, "b")
    assert readers.collections({"a": df.select("id"), "b": df.select("html")}).where("source = 'b' and id is null").count() == 3
    assert sinks.markdown(df.select("id").orderBy("id")).splitlines()[2:] == ["| 1 |", "| 2 |", "| 3 |"] and sinks.markdown(df.limit(0)) == "_No rows._"
    changed = sinks.upsert(df, spark.createDataFrame([("2", "new")], "id string, html string"), "id", "html")
    assert {r["id"]: r["html"] for r in changed.collect()} == {"1": "a", "2": "new", "3": ""}
    s = sinks.splits(df.select("id", F.when(F.col("id") == "1", "test").otherwise("train").alias("split")), str(tmp_path / "s"))
    assert {r["split"]: r["rows"] for r in s.collect()} == {"test": 1, "train": 2}


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/page_docs.parquet"
    schema = spark.read.parquet(src).schema
    spark.read.parquet(src).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), schema, 1)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.sql(f"SELECT * FROM {name}")

    rows = spark.read.parquet(src)
    assert run(streams.score(stream, ["test", "example"]).select("id", "url_final_url_length"), "scored").count() == rows.count()
    asc = stream.withColumn("ts", F.col("captured_at").cast("timestamp"))
    assert run(streams.first_seen(asc, "id", "ts", "3650 days").select("id"), "seen").count() == rows.select("id").distinct().count()
    n = run(streams.counts(asc, "ts", "url", "1 day", "3650 days"), "counted", "complete").agg(F.sum("n")).first()[0]
    assert n == rows.where("captured_at is not null").count()
