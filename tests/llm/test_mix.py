import pytest

from pagesieve.llm import mix as M


def test_rates():
    r = M.rates({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.2, 5)})
    assert r["a"] * 100 == pytest.approx(r["b"] * 1000) and r["a"] == pytest.approx(2)
    assert M.rates({}, {"a": (1, 1)}) == {}


def test_shares_are_reached(spark):
    rows = [(k, "small" if k % 20 == 0 else "big" if k % 3 else None, f"word {k} " * (1 + k % 7), 5) for k in range(4000)] + [(9001, "small", None, 5), (9002, "big", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("small", 0.25, 3), ("big", 0.75, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = M.mix_sources(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["share"] == pytest.approx(0.25, abs=0.02) and got["none"]["used_tokens"] == 0
    assert mixed.where("source = 'big'").agg({"copies": "max"}).first()[0] == 1
    assert mixed.where("source = 'small'").agg({"copies": "max"}).first()[0] <= 3
    assert mixed.count() == M.mix_sources(docs, targets)[0].intersect(mixed).count()  # repeatable
    assert M.mix_sources(docs.limit(0), targets)[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x " * 50_000)], "doc_id bigint, text string")
    n = {r["doc_id"]: r["tokens"] for r in M.count_tokens(df, "doc_id", "text").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1 and n[5] >= 50_000


def test_shares_at_several_sizes(spark):
    import random

    rng = random.Random(5)
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 2), ("c", 0.2, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    for n in (300, 3000):
        docs = [(k, rng.choices("abcd", [1, 2, 4, 3])[0], "some words of text " * rng.randrange(1, 20)) for k in range(n)]
        mixed, report = M.mix_sources(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets)
        for r in report.where("target_share > 0").collect():
            assert r["rate"] <= r["max_repeats"] + 1e-6 and abs(r["share"] - r["target_share"]) < 4 / n**0.5
        assert {r["source"] for r in mixed.select("source").distinct().collect()} == set("abc")
