import pytest

from pagesieve.llm import lookalike as L


@pytest.mark.parametrize(
    "a, b",
    [("Ｓｉｌｗｉｃｋ", "Silwick"), ("Atención", "Atención"), ("a​b­c", "abc"), ("a b c", "a b c"), ("oﬃce", "office"), ("  x \n", "x")],
)
def test_same_look(a, b):
    assert L.visual_form(a) == L.visual_form(b) == b


@pytest.mark.parametrize("a, b", [("No. ²", "No. 2"), ("№ 2", "No 2"), ("Invöice", "Invoice"), ("ABC", "abc"), ("①", "1")])
def test_different_look(a, b):
    assert L.visual_form(a) != L.visual_form(b)


def _forms(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    changed = {r["raw"]: r["form"] for r in L.canonical_forms(df).collect()}
    return [changed.get(v, v) for v in values]


def test_repair_needs_the_vocabulary(spark):
    got = _forms(spark, ["Guide to safer passwords", "Guide tο safer passwοrds", "Вот слово", "zаqx here", None, ""])
    assert got == ["Guide to safer passwords", "Guide to safer passwords", "Вот слово", "zаqx here", None, ""]


def test_dominant_script_in_both_directions(spark):
    latin_m, latin_o = "Mосква", "кoт"  # Cyrillic words with a Latin letter
    assert L.repair_candidates(latin_m)[0] == (latin_m, "Москва", 0) and L.repair_candidates("pаypal")[0] == ("pаypal", "paypal", 0)
    honest = ["Москва", "кот", "Αθήνα", "λόγος", "Երևան", "բառ", "слово and word", "Αθήνα guide", "Երևան today"]
    assert _forms(spark, [latin_m, latin_o, *honest]) == ["Москва", "кот", *honest]
    # no word of the corpus comes out: nothing is changed
    assert _forms(spark, ["кoт", "собака"]) == ["кoт", "собака"]


def test_whole_token_of_another_script(spark):
    assert _forms(spark, ["site со here", "site co here"]) == ["site co here"] * 2
    assert _forms(spark, ["со мной", "site co here"]) == ["со мной", "site co here"]


def test_spellings_attest_each_other(spark):
    got = _forms(spark, ["plan 0Ο1Х", "plan 0О1Χ"])  # Greek and Cyrillic letters, no Latin original
    assert got[0] == got[1] == "plan 0O1X"


def test_pairs(spark):
    rows = [("1", "Ombrmora", "u"), ("2", "Оmbrmora", "u"), ("3", "Ombrmora", "u"), ("4", None, None), ("5", "ombrmora", ""), ("6", "Ombr​mora", "u")]
    df = spark.createDataFrame(rows, "id string, title string, raw string")
    got = {(r["id_a"], r["id_b"], r["field"]) for r in L.lookalike_pairs(df, "id", {"title": "title", "url": "raw"}).collect()}
    assert got == {("1", "2", "title"), ("2", "3", "title"), ("1", "6", "title"), ("3", "6", "title"), ("2", "6", "title")}
    assert L.lookalike_pairs(spark.createDataFrame([], "id string, title string"), "id", {"title": "title"}).count() == 0


def test_very_long_and_column_forms(spark):
    long = "wоrd " * 20_000
    df = spark.createDataFrame([(long, 1), ("word", 2)], "t string, raw int")
    out = L.consistent_text(df, ["t"]).orderBy("raw").collect()
    assert out[0]["t"] == ("word " * 20_000).strip() and out[1]["t"] == "word"
