import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import audit as A
from pagesieve.operators import curation as C
from pagesieve.operators import evaluation as E


def _h(counts):
    t = sum(counts)
    return -sum(c / t * math.log2(c / t) for c in counts if c)


def test_association_and_items(spark):
    rng = random.Random(1)
    rows = [(str(k), rng.choice("pb"), rng.choice("xyz")) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, label string, source string")
    a = A.association(df, "source", "label").first()
    hx, hy, hxy = (_h(list(Counter(v).values())) for v in ([r[2] for r in rows], [r[1] for r in rows], [r[1:] for r in rows]))
    assert a["entropy_x"] == pytest.approx(hx, abs=1e-6) and a["mi"] == pytest.approx(hx + hy - hxy, abs=1e-6)
    items = [(r[0], i) for r in rows for i in "abc" if rng.random() < (0.9 if i == "a" and r[1] == "p" else 0.3)] + [(r[0], "all") for r in rows]
    out = {r["item"]: r for r in A.item_rows(df, spark.createDataFrame(items, "id string, item string"), 5).collect()}
    label = dict((r[0], r[1]) for r in rows)
    inside = Counter(label[i] for i, x in items if x == "a")
    n, s = len(rows), sum(inside.values())
    rest = Counter(r[1] for r in rows) - inside
    mi = hy - s / n * _h(list(inside.values())) - (n - s) / n * _h(list(rest.values()))
    assert out["a"]["mi"] == pytest.approx(mi, abs=1e-6) and out["a"]["top_label"] == inside.most_common(1)[0][0] and out["all"]["mi"] == 0.0
    assert A.item_rows(df.where("label = 'p'"), spark.createDataFrame(items, "id string, item string"), 5).where("risk <> 'inconclusive'").count() == 0


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(50) * 1.0) for _ in range(999)]
    out = {r["k"]: r for r in A.nearest_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for k in "ab":
        v = sorted(x for g, x in rows if g == k)
        assert out[k]["p50"] == v[round((len(v) - 1) * 0.5)] and out[k]["p99"] == v[round((len(v) - 1) * 0.99)]


def test_ranks_and_splits(spark):
    rows = [(f"i{k}", "hot" if k % 3 else "b", f"d{k % 17}") for k in range(2000)] + [("n", None, None)]
    df = spark.createDataFrame(rows, "id string, label string, domain string")
    r = C.hash_rank(df, ["label"], "id").collect()
    by = defaultdict(list)
    for x in r:
        by[x["label"]].append(x["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(r) == len(rows)
    s = Counter((x["label"], x["split"]) for x in C.stratified(df, "label", "id", 0.2).collect())
    n = Counter(x[1] for x in rows)
    assert s[("hot", "test")] == round(n["hot"] * 0.2) and s[(None, "test")] == 0
    assert set(Counter(x["label"] for x in C.balance(df.where("label is not null"), "label", "id").collect()).values()) == {min(n["hot"], n["b"])}
    g = C.greedy_domains(df, "label", "domain", 0.2, 0.2).collect()
    assert len(g) == len({(x[1], x[2]) for x in rows if x[1]}) and {x["split"] for x in g} == {"train", "val", "test"}
    assert C.cap_per_key(df, "domain", "id", 2).where("domain = 'd3'").count() == 2
    assert C.oversample(df, F.col("label") == "b", 3).where("label = 'b'").count() == 3 * n["b"]


def test_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pb"), rng.choice(["p", "b", None, "x"]), rng.choice([0.1, 0.5, 0.5, rng.random()])) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, s string, score double")
    got = {r["class"]: r for r in E.scores(df, "t", "s", ["p", "b"]).collect()}
    tp = sum(a == b == "p" for a, b, _ in rows)
    assert got["p"]["precision"] == pytest.approx(tp / sum(b == "p" for _, b, _ in rows), abs=1e-6)
    pairs = [(x, y) for a, _, x in rows for c, _, y in rows if a == "p" and c == "b"]
    want = sum((x > y) + 0.5 * (x == y) for x, y in pairs) / len(pairs)
    assert E.auc(df, F.col("t") == "p", "score").first()["roc_auc"] == pytest.approx(want, abs=1e-6)
    assert E.confusion(df, "t", "s", ["p", "b"]).agg(F.sum("said_other")).first()[0] == sum(b not in ("p", "b") for _, b, _ in rows)


def test_answers(spark):
    text = "<think>Verdict: benign</think>Phishing risk factors:\n- url.long_url\n- none\nBenign mitigating factors:\n- none\nReasoning: x\nVerdict: **Phishing**"
    t = E.without_thoughts(F.col("t"))
    r = spark.createDataFrame([(text,), (None,), ("no verdict",)], "t string").select(E.infer_verdict(t).alias("v"), E.section_items(t, "phishing risk factors").alias("r")).collect()
    assert (r[0]["v"], r[0]["r"]) == ("phishing", ["url.long_url"]) and r[1]["v"] is None and r[2]["v"] is None
    assert E.rouge_l("a b c d", "a x c d") == pytest.approx(0.75) and E.rouge_l("", "a") == 0.0 and E.bleu("a b c d e", "a b c d e") == pytest.approx(1.0)
    v = {x["k"]: x["verdict"] for x in E.majority_vote(spark.createDataFrame([("1", "p"), ("1", "p"), ("1", "b"), ("2", "p"), ("2", "b"), ("3", None)], "k string, v string"), "k", "v", ("p", "b")).collect()}
    assert v == {"1": "p", "2": "unknown", "3": "unknown"}
