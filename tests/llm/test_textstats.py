import numpy as np
import pyarrow as pa
import pytest

from pagesieve.llm import textstats as T

SENTENCE = "The billing portal explains the second step of the sign-in before the page is shown. "
CASES = {
    "prose": [SENTENCE, SENTENCE * 5, "\n".join(" ".join(((SENTENCE + " ") * 3).split(" ")[i : i + 7]) for i in range(0, 45, 7)), SENTENCE.lower().rstrip(". "), SENTENCE.upper() * 3, SENTENCE * 6 + "\n- one\n- two\n- three\n\n" + SENTENCE * 4],
    "list": ["\n".join(f"- entry {k}" for k in range(9)), SENTENCE + "\n" + "\n".join(f"{k}. Opening hours {k}" for k in range(1, 30)), "Names:\nAnna, Bert, Cora, Dora, Emil, Fritz, Gerd, Hans", "\n".join(["Kovrion", "Pellind", "Zinquar", "Kovpeth", "Silzeck"]), "Home · Blog · Sign in to X · Imprint · Press · Help"],
    "table": ["\n".join(f"row{k}\t{k * 7}\tyes" for k in range(9)), SENTENCE + "\n" + "\n".join(f"{k};{k * 3};no;2025-01-0{k}" for k in range(1, 9)), "\n".join(f"| a{k} | b | {k}.50 |" for k in range(6)), "\n".join(f"cell{k}      {k * 11}      no" for k in range(8))],
    "junk": ["QmFzZTY0IGlzIG5vdCBwcm9zZQ" * 20, "login " * 60, "*$8/><735;+42(y);1 5+#1;{[|)70#^7!$;:$!:{z/[-:&>4z-/}# c{-@*3_-66(b6^/~__.bb&[7}8>c2x)", "var e=function(x){return y.a[30]||!1};let b=function(x){return y.b[64]||!1};" * 3, "00000000  06 e6 80 bd 09 d0 f3 65 bb 20 0c 84 fd 1e 6b 4e\n" * 6, "_" * 300, "%C6%47bi%15%02%B6%12%225%50sp%CB3%91%2Bu%52s%A7n" * 5, "D�s Postf�ch v��sch�ckt d�� H��w��s �m E�d� d�� S��t�. " * 3],
}


def test_kinds():
    texts, kinds = zip(*[(t, k) for k, ts in CASES.items() for t in ts])
    v = T.votes(T.statistics(pa.array(texts * 30)))
    patterns, to, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy = T.fit(patterns, counts.astype(float))
    got = [T.KINDS[k] for k in posterior.argmax(axis=1)[to.ravel()][: len(texts)]]
    assert [(t[:40], g) for t, k, g in zip(texts, kinds, got) if k != g] == []
    assert (accuracy[(patterns > 0).any(axis=0)] > 0.5).all()


def test_statistics():
    s = T.statistics(pa.array(["One two. Three é4!", None, "", "a\n\nb c", "  "]))
    assert s["words"].tolist() == [4, 0, 0, 3, 0] and s["lines"].tolist() == [1, 0, 0, 2, 0] and s["chars"].tolist() == [18, 0, 0, 6, 2]
    assert s["mean_word_length"][0] == pytest.approx((3 + 4 + 5 + 3) / 4) and s["symbol_ratio"][0] == pytest.approx(2 / 18)
    t = pa.array(["x"] * 3 + ["é" * 7, "word " * 100_000])
    assert T.statistics(t.slice(3))["chars"].tolist() == [7, 500_000]
    assert len(T.statistics(pa.array([], pa.string()))["words"]) == 0


def test_operator(spark):
    rows = [(k, t, "x") for k, t in enumerate(sum(CASES.values(), []) * 3)] + [(900, None, "x"), (901, "", "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    out = {r["doc_id"]: r for r in T.text_kinds(df, "doc_id", "text").collect()}
    assert len(out) == len(rows) - 1 and out[900]["kind"] == "prose" and out[900]["probability"] == 0.25
    assert T.text_kinds(df, "doc_id", "text").count() == len(rows)
    assert T.text_kinds(df.limit(0), "doc_id", "text").count() == 0


def test_posteriors_by_an_ordinary_join(spark, monkeypatch):
    rows = [(k, "The parcel is ready and it is at the desk of the shop. We keep it for you until the end of the week.") for k in range(20)] + [(30, "a,b,c\n1,2,3\n4,5,6\n7,8,9"), (31, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = sorted(map(tuple, T.text_kinds(df, "doc_id", "text").collect()))
    monkeypatch.setattr(T, "BROADCAST", 0)
    assert sorted(map(tuple, T.text_kinds(df, "doc_id", "text").collect())) == a and len(a) == 22


def test_agreement_with_hand_labels(spark):
    """The functions see no labels; some of the labels are wrong on purpose."""
    import os

    import pytest

    tables = "/root/testdata/sf0.01"
    if not os.path.exists(f"{tables}/doc_labels.parquet"):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{tables}/doc_labels.parquet").select("doc_id", "kind").distinct()
    docs = spark.read.parquet(f"{tables}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id")
    got = T.text_kinds(docs, "doc_id", "text").select("doc_id", T.F.col("kind").alias("found")).join(labels, "doc_id")
    by_doc = got.groupBy("doc_id").agg(T.F.max(T.F.col("found") == T.F.col("kind")).alias("agrees"))
    assert by_doc.agg(T.F.avg(T.F.col("agrees").cast("int"))).first()[0] > 0.9
