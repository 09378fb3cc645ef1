import random

import pyarrow as pa

from pagesieve.llm import leak as K

WORDS = [f"word{k}" for k in range(60)]


def _text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def _brute(doc, item):
    """Longest passage by trying every pair of places."""
    best = 0
    for d in range(-len(item) + 1, len(doc)):
        same = [0 <= i + d < len(doc) and doc[i + d] == item[i] for i in range(len(item))]
        for i in range(len(same)):
            if not same[i]:
                continue
            bad = 0
            for j in range(i, len(same)):
                if not same[j]:
                    if j + 1 >= len(same) or not same[j - 1] or not same[j + 1]:
                        break
                    bad += 1
                elif bad * K.ONE_IN <= j - i + 1:
                    best = max(best, j - i + 1)
    return best


def test_like_brute_force(spark):
    rng = random.Random(5)
    items = [(k, _text(rng, rng.randrange(30, 60))) for k in range(12)]
    docs = []
    for n in range(150):
        item = rng.choice(items)[1]
        a = rng.randrange(len(item) - 12)
        part = list(item[a : a + rng.randrange(12, 45)])
        for j in range(len(part)):
            if rng.random() < 0.06:
                part[j] = "changed"
        docs.append((n, _text(rng, rng.randrange(30)) + part + _text(rng, rng.randrange(30))))
    df = spark.createDataFrame([(n, " ".join(t), 0) for n, t in docs], "doc_id bigint, text string, item int")
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in K.leaked_passages(df, "doc_id", "text", held, "item_id", "text").collect()}
    want = {(n, k): w for n, t in docs for k, i in items if (w := _brute(t, i)) >= K.LEAST}
    assert got == want and len(want) > 20
    assert K.without_leaks(df, "doc_id", K.leaked_passages(df, "doc_id", "text", held, "item_id", "text")).count() == len(docs) - len({n for n, _ in want})


def test_evenly_spaced_changes_and_places(spark):
    rng = random.Random(8)
    assert K.SEED == 7
    rows, held, want = [], [], {}
    for k, n in enumerate(range(24, 201, 2)):
        item = [f"i{k}x{j}" for j in range(n + 6)]
        held.append((k, " ".join(item)))
        c = n // 10
        for v, put in enumerate((lambda w: ["other"], lambda w: ["two-part", "x"][:1], lambda w: [])):
            part = item[3 : 3 + n]
            at = {round((j + 1) * (n + 1) / (c + 1)) - 1 for j in range(c)}
            changed = [x for j, w in enumerate(part) for x in ([w] if j not in at else put(w) or ["..."])]
            before = _text(rng, rng.randrange(20))
            rows.append((1000 * v + k, " ".join(before + changed + _text(rng, 5)), 0))
            if v < 2:  # a word left out is no changed word
                want[1000 * v + k, k] = (n, 3, len(before))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item int")
    items = spark.createDataFrame(held, "item_id bigint, text string")
    for part_words in (K.PART_WORDS, 3000):  # in one part and in several
        out = K.leaked_passages(df, "doc_id", "text", items, "item_id", "text", part_words).collect()
        got = {(r["doc_id"], r["item_id"]): (r["words"], r["item_from"], r["doc_from"]) for r in out if r["doc_id"] < 2000}
        assert got == want
        assert all(r["verbatim"] >= K.SEED for r in out)


def test_repeated_words_stay_bounded():
    # every word alike: places pair with places, but only left ends of runs are followed
    s = K.Searcher([(1, "a " * 3000)])
    found = list(s.shard(pa.array([7]), pa.array(["a " * 4000])))
    assert [(f[0], f[1], f[2]) for f in found] == [(7, 1, 3000)]


def test_longest_match_is_found_by_search():
    rng = random.Random(9)
    item, doc = [_text(rng, 300) for _ in range(2)]
    doc[50:90] = item[100:140]
    s = K.Searcher([(1, " ".join(item))])
    known, word, counts, _ = K._tokens(pa.array([" ".join(doc)]), s.code)
    docs = K._Words(known, word, counts)
    runs = [(int(a), int(b), int(n)) for q, p, n in s.matches(known, docs.left) for a, b, n in zip(q, p, n)]
    want = []
    for a in range(300):
        for b in range(300):
            if item[a] == doc[b] and not (a and b and item[a - 1] == doc[b - 1]):
                n = next((k for k in range(300 - max(a, b)) if item[a + k] != doc[b + k]), 300 - max(a, b))
                if n >= K.SEED:
                    want.append((a, b, n))
    assert sorted(runs) == sorted(want) and max(n for *_, n in want) >= 40


def test_spelling_does_not_matter(spark):
    rng = random.Random(6)
    item = [f"Größe{k}" for k in range(30)]
    held = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id bigint, text string")
    variants = ["> " + "\n> ".join(item), " ".join(item).upper(), "­".join([" ".join(item)[:9], " ".join(item)[9:]]), ", ".join(item), "  ".join(item[:24]), " ".join(item[:23]), " ".join(item).replace("ö", "ö")]
    rows = [(k, v) for k, v in enumerate(variants)] + [(90, None), (91, ""), (92, " ".join(item)), (92, " ".join(item)), (93, " ".join(_text(rng, 40_000) + item))]
    got = {r["doc_id"] for r in K.leaked_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", held, "item_id", "text").collect()}
    assert got == {0, 1, 2, 3, 4, 6, 92, 93}


def test_empty_tables(spark):
    docs, held = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert K.leaked_passages(docs, "doc_id", "text", held, "item_id", "text").count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert K.leaked_passages(one, "doc_id", "text", held, "item_id", "text").count() == 0


def test_words_normalized():
    a, b, c = K.normalized(pa.array(["L\u2019\u00c9t\u00e9 \u2013 a\u200bb", "l e\u0301te\u0301 ab", None])).to_pylist()
    assert a == b and len(a.split(" ")) == 3 and c == ""
