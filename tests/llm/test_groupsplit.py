import random
from collections import Counter

from pagesieve.llm import groupsplit as G


def test_largest_differencing_balances():
    rng = random.Random(1)
    weights = [rng.paretovariate(1.3) for _ in range(3000)]
    bins = G.balance(weights, 20)
    sums = Counter()
    for w, b in zip(weights, bins):
        sums[b] += w
    mean = sum(weights) / 20
    big = max(weights)
    assert len(sums) == 20 and max(sums.values()) <= max(1.01 * mean, big * 1.001)
    assert G.balance([], 5) == [] and len(set(G.balance([1.0] * 10, 10))) == 10


def test_components(spark):
    rng = random.Random(2)
    chain = [(f"c{k}", f"c{k + 1}") for k in range(40)]
    extra = [(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(6)]
    rows = chain + extra + [(None, "z"), ("q", "q")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a and a != b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    want = {}
    for n in got:
        want.setdefault(find(n), []).append(n)
    assert {frozenset(v) for v in want.values()} == {frozenset(n for n in got if got[n] == c) for c in set(got.values())}
    assert all(got[n] == min(v) for v in want.values() for n in v)


def test_splits_keep_groups_and_shares(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"d{min(int(rng.paretovariate(0.9)), 500)}", k, rng.choice(["train", "val", None])) for k in range(5000)] + [(None, 9001, "x"), (None, 9002, "x"), ("", 9003, None)]
    df = spark.createDataFrame(rows, "domain string, ident int, split string")
    links = spark.createDataFrame([("d7", "d9"), ("d9", "d11")], "a string, b string")
    monkeypatch.setattr(G, "BLOCK", 400)
    targets = {"train": 0.8, "val": 0.1, "test": 0.1}
    made = G.grouped_splits(df, "domain", targets, links, bins=40, ident="ident", before="split")
    out = made.collect()
    split = {r["domain"]: r["split"] for r in out}
    assert len(out) == len(split) == len({r[0] for r in rows} - {None, ""}) + 3  # records without a key are keys of their own
    assert split["d7"] == split["d9"] == split["d11"]
    n = Counter()
    for d, i, _ in rows:
        n[split[d or f"{G.ALONE}{i}"]] += 1
    total = sum(n.values())
    heaviest = Counter(d for d, *_ in rows if d).most_common(1)[0][1] / total
    assert n["train"] / total > 0.6 and abs(n["val"] / total - 0.1) < 0.05 + max(0, heaviest - 0.8)
    shares = {r["split"]: r for r in G.reached_shares(made, targets).collect()}
    assert {s: r["records"] for s, r in shares.items()} == dict(n) and shares["val"]["target_share"] == 0.1
    # every record once, with the split of its key; the hot key is salted
    records = G.assigned_records(df, "domain", "ident", made).collect()
    assert sorted(r["ident"] for r in records) == sorted(r[1] for r in rows)
    assert all(r["split"] == split[r["domain"] or f"{G.ALONE}{r['ident']}"] for r in records)
    conflicts = {r["domain"] for r in G.split_conflicts(made, "domain").collect()}
    before = {}
    for d, _, s in rows:
        if d and s:
            before.setdefault(d, set()).add(s)
    assert conflicts == {d for d, s in before.items() if len(s) > 1} and len(conflicts) > 5
    assert G.grouped_splits(df.limit(0), "domain", {"train": 1.0}).count() == 0


def test_bins_are_even_at_every_block_size(spark):
    rng = random.Random(4)
    weights = [(f"c{k}", float(int(rng.paretovariate(1.5)))) for k in range(6000)]
    mean = sum(w for _, w in weights) / 10
    df = spark.createDataFrame(weights, "component string, weight double")
    for block in (10_000, 2000, 500):  # without pieces and with them
        out = G.balanced_bins(df, 10, block).collect()
        assert sorted((r["component"], r["weight"]) for r in out) == sorted(weights)
        sums = Counter()
        for r in out:
            sums[r["bin"]] += r["weight"]
        assert len(sums) == 10 and max(sums.values()) <= max(1.02 * mean, max(w for _, w in weights) + 1) and min(sums.values()) >= 0.98 * mean
