import random

import pytest

from pagesieve.llm import overlap as O

SCHEMA = "id string, split string, url string, clean_text string, source string, words string, cls int"


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def test_common_in_order_like_the_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(40))] for _ in range(2))
        assert O.common_in_order(a, b) == _lcs(a, b)


def test_share_of_a_cut_text():
    words = [str(k) for k in range(100)]
    assert O.share_in_common(words[:40], words) == 1.0
    assert O.share_in_common(words[40:], words) < 0.8
    assert O.share_in_common([], words) == 0.0


def test_near_copies_like_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 140))] for _ in range(40)]
    rows = []
    for k in range(160):
        t = list(rng.choice(texts))
        start = rng.randrange(len(t))
        for j in range(start, min(len(t), start + rng.choice([0, 0, 5, 10, 25]))):  # a changed stretch
            t[j] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            t = t[: len(t) * 2 // 3]
        rows.append((f"{k:03d}", rng.choice(["train", "train", "val", "test", None]), None, "URL: http://x/" + str(k) + "\n" + " ".join(t).upper() + "  ", rng.choice("ab"), "", 0))
    out = O.split_overlaps(spark.createDataFrame(rows, SCHEMA), "id", "split", "url", "clean_text", "source").collect()
    got = {(r["train_id"], r["eval_id"]) for r in out}
    words = {r[0]: r[3].split("\n")[1].lower().split() for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] not in (None, "train") and O.share_in_common(words[a[0]], words[b[0]]) >= O.SHARE}
    assert not got - want
    assert len(want) > 50 and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize(
    "a, b, same",
    [("http://x.test/a", "https://www.X.TEST/a/#top", True), ("https://x.test/a?utm_source=m&id=1", "https://x.test/a?id=1&gclid=3", True), ("https://x.test/a/?utm_a=1", "x.test/a", True), ("https://x.test/a?id=1", "https://x.test/a?id=2", False), ("https://x.test/A", "https://x.test/a", False), ("https://www.www.x.test/", "https://x.test/", False)],
)
def test_addresses(spark, a, b, same):
    df = spark.createDataFrame([("1", "train", a, None, "s", "", 0), ("2", "val", b, "", "s", "", 0)], SCHEMA)
    assert O.split_overlaps(df, "id", "split", "url", "clean_text", "source").count() == int(same)


def test_edges(spark):
    rows = [("1", "train", None, None, None, "", 0), ("2", "val", None, None, None, "", 0), ("3", "test", " ", "", None, "", 0), ("4", "train", None, "one word", None, "", 0), ("5", "val", None, "ONE  word", None, "", 0), ("5", "val", None, "ONE  word", None, "", 0), ("6", None, None, "one word", None, "", 0), (None, "val", None, "one word", None, "", 0)]
    out = O.split_overlaps(spark.createDataFrame(rows, SCHEMA), "id", "split", "url", "clean_text", "source")
    assert [(r["train_id"], r["eval_id"], r["by_text"], r["share"]) for r in out.collect()] == [("4", "5", True, 1.0)]
    assert O.overlap_report(out).first()["pairs"] == 1
    assert O.split_overlaps(spark.createDataFrame([], SCHEMA), "id", "split", "url", "clean_text", "source").count() == 0
    long = " ".join(str(k) for k in range(30_000))
    rows = [("1", "train", None, long, "s", "", 0), ("2", "test", None, long + " more", "s", "", 0)]
    assert O.split_overlaps(spark.createDataFrame(rows, SCHEMA), "id", "split", "url", "clean_text", "source").count() == 1


def test_scattered_changes_and_short_cut_off_texts_are_all_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [[rng.choice(vocabulary) for _ in range(n)] for n in (25, 60, 120, 150, 300, 700) for _ in range(5)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((f"t{k:03d}", "train", t))
        for v in range(6):
            n = [len(t), len(t), len(t) * 2 // 3, 20, 12, 5][v]
            c = t[:n]
            for j in rng.sample(range(n), int(n * rng.choice([0.1, 0.15, 0.19]))):  # single words, far apart
                c[j] = rng.choice([rng.choice(vocabulary), "", "x y"])
            rows.append((f"e{k:03d}{v}", "train" if (k + v) % 5 == 0 else "val", " ".join(c).split()))
    df = spark.createDataFrame([(i, s, None, " ".join(w), "s", "", 0) for i, s, w in rows], SCHEMA)
    got = {(r["train_id"], r["eval_id"]) for r in O.split_overlaps(df, "id", "split", "url", "clean_text", "source").collect()}
    want = {(a, b) for a, s, x in rows for b, t, y in rows if s == "train" != t and O.share_in_common(x, y) >= O.SHARE}
    assert got == want
    assert len(want) > 100


def test_long_texts_keep_to_their_own_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(O, "BLOCK_BYTES", 2000)
    long = " ".join(str(k) for k in range(70_000))
    texts = ["a b c", long, "a b c d", " ".join(str(k) for k in range(20))]
    blocks = [(b.column("n")[0].as_py(), b.column("bits")[0].as_py()) for b in O._blocks([pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["no", "words"])])]
    assert [n for n, _ in blocks] == [[3], [70_000], [4, 20]]
    import numpy as np

    same = [[[x.tolist() for x in O._may_share(np.array(n), b, np.array(m), c)] for m, c in blocks] for n, b in blocks]
    assert same[1][1] == [[0], [0]] and same[1][2] == [[0], [1]] and same[2][1] == [[1], [0]] and same[0][2] == [[0], [0]] and same[0][1] == [[], []]


@pytest.mark.parametrize("changed", [0.05, 0.1, 0.15, 0.2])
def test_scattered_changes_by_share(spark, changed):
    rng = random.Random(int(100 * changed))
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(50, 200))]
        c = list(t)
        for j in rng.sample(range(len(t)), int(len(t) * changed)):
            c[j] = f"new{k}x{j}"
        rows += [(f"t{k:03d}", "train", None, " ".join(t), "s", "", 0), (f"v{k:03d}", "val", None, " ".join(c), "s", "", 0)]
    got = {(r["train_id"], r["eval_id"]) for r in O.split_overlaps(spark.createDataFrame(rows, SCHEMA), "id", "split", "url", "clean_text", "source").collect()}
    assert got == {(f"t{k:03d}", f"v{k:03d}") for k in range(60)}
