import random

import pytest

from pagesieve.llm import cap

SCHEMA = "domain string, id string, score double, key string, n int"  # with clashing names


def _brute(rows, most):
    best = {}
    for d, i, s, *_ in rows:
        if i is None:
            continue
        s = None if s is None or s != s else s
        old = best.get(i)
        rank = (s is not None, s if s is not None else 0, d or "")
        if old is None or rank > old[0]:
            best[i] = (rank, d, s)
    by = {}
    for i, (_, d, s) in best.items():
        if d:
            by.setdefault(d, []).append((s is None, -(s or 0), i))
    return {i for v in by.values() for *_, i in sorted(v)[most:]}


@pytest.mark.parametrize("seed, most, few, mid", [(1, 5, 100_000, 1024), (2, 7, 0, 256), (3, 40, 100_000, 64)])
def test_like_sorting(spark, monkeypatch, seed, most, few, mid):
    monkeypatch.setattr(cap, "BROADCAST", few)  # 0: by salted keys
    monkeypatch.setattr(cap, "MIDPOINTS", mid)
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        d = rng.choice(["hot", "hot", "hot", "b", "c", None, ""])
        s = rng.choice([None, 0.5, 0.5, 0.5, round(rng.random(), 2), rng.random(), float("nan"), float("inf"), -3.0])
        rows.append((d, f"id-of-some-length-{k:05d}" if seed % 2 else f"{k * 7919 % 10007}", s, "x", 1))
    rows += rows[:30]
    out = cap.cap_contributors(spark.createDataFrame(rows, SCHEMA), "domain", "id", "score", max_count=most).collect()
    assert {r["ident"] for r in out if not r["kept"]} == _brute(rows, most)
    assert len(out) == len({r[1] for r in rows})


def test_one_score_for_all(spark, monkeypatch):
    monkeypatch.setattr(cap, "MIDPOINTS", 4)
    rows = [("hot", f"{k:03d}", 0.5, "", 0) for k in range(300)]
    out = cap.cap_contributors(spark.createDataFrame(rows, SCHEMA), "domain", "id", "score", max_count=10).where("kept").collect()
    assert sorted(r["ident"] for r in out) == [f"{k:03d}" for k in range(10)]


def test_share_and_empty(spark):
    rows = [("a", str(k), float(k), "", 0) for k in range(100)] + [("b", "b", None, "", 0)]
    out = cap.cap_contributors(spark.createDataFrame(rows, SCHEMA), "domain", "id", "score", share=0.1, least=3)
    assert out.where("not kept").count() == 90
    assert cap.cap_contributors(spark.createDataFrame([], SCHEMA), "domain", "id", "score", share=0.1, least=3).count() == 0
